"""Financial measures over a star schema: one conditional aggregate per grain, time views, benchmarks, budgets, payroll, consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import financial_year
from ..sources.staging import few

#: Accounts of the source's chart that measures name (fixed values): depreciation and finance interest, which EBITDA adds back, and those of ratios.
ADD_BACK = ("890", "895")
RATIOS = {"rent": ("820",), "motor_vehicle": ("810",), "labour": ("800", "805")}


def star(facts: DataFrame, accounts: DataFrame, entities: DataFrame) -> DataFrame:
    """Ledger facts (entity_id, account_code, posting_date, debit, credit, amount) with the dimensions' columns; unmatched facts drop, as with an inner relationship. The dimensions are counted,
    and few rows are broadcast: a shuffle by account would bring a third of the facts to one task."""
    return facts.join(few(accounts), "account_code").join(few(entities), "entity_id")


def _sum(column: str, *values: str, sign: int = 1) -> Column:
    return F.sum(F.when(F.col(column).isin(*values), F.col("amount") * sign).otherwise(0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, null where whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def profit_measures(rows: DataFrame, grain: list[str], add_back: tuple[str, ...] = ADD_BACK) -> DataFrame:
    """Debits, credits, net movement, revenue, cost of sales, gross profit and margin, operating expenses, EBITDA, profit before tax and margin, in one
    aggregate. Revenue goes by class, costs by sub-class; add_back are accounts among the operating expenses that EBITDA leaves out."""
    g = rows.groupBy(*grain).agg(
        F.sum("debit").alias("total_debits"), F.sum("credit").alias("total_credits"), F.sum("amount").alias("net_movement"), _sum("class", "Revenue", sign=-1).alias("revenue"), _sum("sub_class", "Cost of Sales").alias("cogs"),
        _sum("sub_class", "Operating Expenses").alias("operating_expenses"), _sum("account_code", *add_back).alias("added"),
    )
    gross = F.col("revenue") - F.col("cogs")
    profit = gross - F.col("operating_expenses")
    return g.select(*grain, "total_debits", "total_credits", "net_movement", "revenue", "cogs", gross.alias("gross_profit"), ratio(gross, F.col("revenue")).alias("gross_margin"), "operating_expenses", (profit + F.col("added")).alias("ebitda"), profit.alias("net_profit"), ratio(profit, F.col("revenue")).alias("net_margin"))


def position_measures(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Assets, liabilities, net assets, equity, check and working capital at each month's end: movements summed per month, then accumulated over all
    months up to it. Equity is the class's alone; the check takes earnings to date from assets too, as they are never closed to equity."""
    month = F.trunc("posting_date", "month").alias("month")
    profit = _sum("class", "Revenue", sign=-1) - _sum("sub_class", "Cost of Sales", "Operating Expenses")
    g = rows.groupBy(*keys, month).agg(
        _sum("class", "Asset").alias("assets"), _sum("class", "Liability", sign=-1).alias("liabilities"), _sum("class", "Equity", sign=-1).alias("equity"), profit.alias("earnings"),
        _sum("sub_class", "Current Assets", "Current Liabilities").alias("working_capital"),
    )
    upto = Window.partitionBy(*keys).orderBy("month")
    parts = ("assets", "liabilities", "equity", "earnings", "working_capital")
    cum = g.select(*keys, "month", *[F.sum(c).over(upto).alias(c) for c in parts])
    return cum.withColumns({"net_assets": F.col("assets") - F.col("liabilities"), "balance_check": F.col("assets") - F.col("liabilities") - F.col("equity") - F.col("earnings")})


def balance_sheet_amounts(positions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, month, class, balance): natural balances of position_measures by class; there is none across classes."""
    return positions.selectExpr(*keys, "month", "stack(3, 'Asset', assets, 'Liability', liabilities, 'Equity', equity) as (class, balance)")


def ratio_measures(rows: DataFrame, grain: list[str], ratios: dict[str, tuple[str, ...]] = RATIOS) -> DataFrame:
    """(grain, turnover, gross_margin, expense_ratio, and <name>_ratio of each of ratios): costs over revenue, null without revenue."""
    g = rows.groupBy(*grain).agg(_sum("class", "Revenue", sign=-1).alias("turnover"), _sum("sub_class", "Cost of Sales").alias("cogs"), _sum("sub_class", "Operating Expenses").alias("opex"), *[_sum("account_code", *v).alias(k) for k, v in ratios.items()])
    t = F.col("turnover")
    return g.select(*grain, "turnover", ratio(t - F.col("cogs"), t).alias("gross_margin"), ratio(F.col("cogs") + F.col("opex"), t).alias("expense_ratio"), *[ratio(F.col(k), t).alias(f"{k}_ratio") for k in ratios])


def time_views(monthly: DataFrame, keys: list[str], value: str) -> DataFrame:
    """month, quarter and year to date (financial year), the same month a year before, and the change, per key and month. monthly: (keys, month, value), one row each."""
    fy, quarter = financial_year("month"), F.floor((F.month("month") - 1) / 3)
    w = lambda *p: Window.partitionBy(*keys, *p).orderBy("month")
    v = monthly.withColumns({"mtd": F.col(value), "qtd": F.sum(value).over(w(F.year("month"), quarter)), "fytd": F.sum(value).over(w(fy))})
    before = monthly.select(*keys, F.add_months("month", 12).alias("month"), F.col(value).alias("prior_year"))
    j = v.join(before, [*keys, "month"], "left").withColumn("yoy", F.col(value) - F.col("prior_year"))
    return j.select(*keys, "month", "mtd", "qtd", "fytd", "prior_year", "yoy", F.when(F.col("prior_year") != 0, F.round(F.col("yoy") * 100 / F.abs("prior_year"), 2)).alias("yoy_percent"))


def budget_variance(actual: DataFrame, budget: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides brought to one grain, then a full outer join: (keys, actual, budget, variance, variance_percent)."""
    a = actual.groupBy(*keys).agg(F.sum("amount").alias("actual"))
    b = budget.groupBy(*keys).agg(F.sum("amount").alias("budget"))
    j = a.join(b, keys, "full_outer").fillna(0, ["actual", "budget"]).withColumn("variance", F.col("actual") - F.col("budget"))
    return j.withColumn("variance_percent", F.when(F.col("budget") != 0, F.round(F.col("variance") * 100 / F.abs("budget"), 2)))


def missing_budgets(entities: DataFrame, months: DataFrame, budget: DataFrame) -> DataFrame:
    """(entity_id, month) that every entity and month should have and the budget lacks. The grid is entities x months of one horizon."""
    return entities.select("entity_id").distinct().crossJoin(F.broadcast(months.select("month").distinct())).join(budget.select("entity_id", "month"), ["entity_id", "month"], "left_anti")


def benchmark_bands(turnover: DataFrame, bands: DataFrame, keep: list[str]) -> DataFrame:
    """Each (industry, turnover) row with its band's columns `keep`: lower bound exclusive, upper inclusive; none or several bands: null.

    bands: (industry, lower, upper, keep), a declared table, joined by industry with the range as a condition.
    """
    t = turnover.withColumn("__row", F.monotonically_increasing_id())
    hit = t.select("__row", "industry", "turnover").join(bands, "industry").where((F.col("turnover") > F.col("lower")) & (F.col("upper").isNull() | (F.col("turnover") <= F.col("upper"))))
    one = hit.groupBy("__row").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in keep]).where("n = 1").select("__row", *keep)
    return t.join(one, "__row", "left").drop("__row")


def outside(value: Column, low: Column, high: Column) -> Column:
    """How far value lies outside the inclusive range, with its sign; zero within."""
    return F.when(value.isNotNull() & low.isNotNull() & high.isNotNull(), F.when(value < low, value - low).when(value > high, value - high).otherwise(0.0))


def risk_label(turnover: Column, band: Column, variance: Column) -> Column:
    return F.when(F.coalesce(turnover, F.lit(0)) <= 0, "no turnover").when(band.isNull(), "no benchmark").when(variance.isNull(), "no margin").when(variance < 0, "below range").when(variance > 0, "above range").otherwise("within range")


def payroll_measures(events: DataFrame, grain: list[str]) -> DataFrame:
    """Wages, qualifying earnings, liability, on-time and late amounts, compliance, event counts, charge and interest under the payday regime, and a note.

    Charge and interest are withheld (null) while events wait for a calendar review. compliance is null without a liability. events: (…, gross,
    qualifying, liability, status ON_TIME or LATE_BREACH, charge, interest, payday boolean, state).
    """
    late, liability = F.col("status") == "LATE_BREACH", F.col("liability")
    g = events.groupBy(*grain).agg(
        F.sum("gross").alias("wages"), F.sum("qualifying").alias("qualifying"), F.sum("liability").alias("liability"), F.sum(F.when(~late, liability).otherwise(0)).alias("on_time"), F.sum(F.when(late, liability).otherwise(0)).alias("late"),
        F.count("*").alias("events"), F.count_if(late).alias("late_events"), F.count_if(F.col("state") == "CALENDAR_REVIEW").alias("reviews"), F.sum(F.when(F.col("payday"), F.col("charge"))).alias("charge"), F.sum(F.when(F.col("payday"), F.col("interest"))).alias("interest"),
        F.bool_or("payday").alias("payday"),
    )
    hide = lambda c: F.when(F.col("reviews") == 0, F.col(c)).alias(c)
    note = F.when(F.col("reviews") > 0, F.concat(F.col("reviews").cast("string"), F.lit(" events need a calendar review; charge and interest are withheld"))).when(~F.col("payday"), "quarterly receipts; payday charges don't apply").otherwise("recorded receipts; charge and interest are estimates")
    return g.select(*grain, "wages", "qualifying", "liability", "on_time", "late", ratio(F.col("on_time"), liability).alias("compliance"), "events", "late_events", "reviews", hide("charge"), hide("interest"), note.alias("note"))


def consolidation(rows: DataFrame, grain: list[str], members: DataFrame) -> DataFrame:
    """(group_id, grain, gross, eliminations, net) of every group of members (group_id, entity_id): eliminations are the intercompany amounts; null unless the
    grain holds every entity of the group."""
    sizes = members.groupBy("group_id").agg(F.count_distinct("entity_id").alias("size"))
    per = rows.groupBy("entity_id", *grain).agg(F.sum("amount").alias("gross"), F.sum(F.when(F.col("is_intercompany"), -F.col("amount")).otherwise(0)).alias("x"))
    g = per.join(members.distinct(), "entity_id").groupBy("group_id", *grain).agg(F.sum("gross").alias("gross"), F.sum("x").alias("x"), F.count("*").alias("n")).join(sizes, "group_id")
    whole = F.col("n") == F.col("size")
    return g.select("group_id", *grain, F.when(whole, F.col("gross")).alias("gross"), F.when(whole, F.col("x")).alias("eliminations"), F.when(whole, F.col("gross") + F.col("x")).alias("net"))


def report_context(rows: DataFrame, grain: list[str], all_entities: int) -> DataFrame:
    """(grain, scope, selection): whole group, one entity or part of it; the months covered."""
    g = rows.groupBy(*grain).agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("one"), F.min("posting_date").alias("a"), F.max("posting_date").alias("b"))
    scope = F.when(F.col("n") == all_entities, "whole group").when(F.col("n") == 1, F.col("one")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" entities")))
    return g.select(*grain, scope.alias("scope"), F.concat_ws(" to ", F.date_format("a", "yyyy-MM"), F.date_format("b", "yyyy-MM")).alias("selection"))


def latest_attributes(events: DataFrame, key: str, order: list[str], attributes: list[str]) -> DataFrame:
    """One row per key with the attributes of its latest event: max of a struct, so the shuffle carries one row per key and task."""
    return events.groupBy(key).agg(F.max(F.struct(*order, *attributes)).alias("m")).select(key, *[F.col(f"m.{a}").alias(a) for a in attributes])


def group_sort_key(members: DataFrame, group: str, order: str) -> DataFrame:
    """members with the smallest order of their group."""
    return members.withColumn(f"{group}_sort", F.min(order).over(Window.partitionBy(group)))
