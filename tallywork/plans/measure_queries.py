"""Queries of measures, calendar, grants and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import account_parts, accounting_number, financial_year, formula_safe, iso_date, money_display, money_text, turnover_bounds
from ..operators import calendar, grants, measures, reports
from ..sources.staging import few
from .derive import ITEMS_SQL, LEDGER_SQL, _values, in_cents, items, ledger, money, policy, table

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


#: account_code, report_section, class, sub_class, sort_order
ACCOUNTS = [
    ("110", "Balance Sheet", "Asset", "Current Assets", 3), ("210", "Balance Sheet", "Liability", "Current Liabilities", 4), ("510", "Balance Sheet", "Equity", "Equity", 6), ("610", "Profit and Loss", "Revenue", "Operating Revenue", 2),
    ("700", "Profit and Loss", "Expense", "Cost of Sales", 1), *[(c, "Profit and Loss", "Expense", "Operating Expenses", 10 + i) for i, c in enumerate(("800", "805", "810", "820", "890", "895"))],
]
#: The star's account of a ledger line: half of the tax is taken for equity, returns are spread over the operating expenses. Valid in both engines.
CODE_SQL = """CASE account_id WHEN '110' THEN '110' WHEN '600-A' THEN '610' WHEN '600-N' THEN '700' WHEN '820' THEN CASE WHEN l_suppkey % 2 = 0 THEN '510' ELSE '210' END
  ELSE CASE l_suppkey % 6 WHEN 0 THEN '800' WHEN 1 THEN '805' WHEN 2 THEN '810' WHEN 3 THEN '820' WHEN 4 THEN '890' ELSE '895' END END"""


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = ledger(spark, sf_dir).select(F.col("tenant").alias("entity_id"), F.expr(CODE_SQL).alias("account_code"), "posting_date", "debit", "credit", "amount", "l_suppkey", (F.col("l_suppkey") % 10 == 0).alias("is_intercompany"))
    e = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity_id"), F.col("r_name").alias("industry"))
    return measures.star(l, policy(spark, ACCOUNTS, "account_code string, report_section string, class string, sub_class string, sort_order int"), e)


STAR_SQL = f"{LEDGER_SQL}, coded AS (SELECT *, {CODE_SQL} AS account_code FROM ledger), star AS (SELECT tenant AS entity_id, account_code, posting_date, debit, credit, debit - credit AS amount, l_suppkey, l_suppkey % 10 = 0 AS is_intercompany, a.*, r_name AS industry FROM coded JOIN {_values(ACCOUNTS)} a(code, report_section, class, sub_class, sort_order) ON account_code = code JOIN nation n ON tenant = n.n_name JOIN region ON n.n_regionkey = r_regionkey)"
MONTH_SQL = "CAST(date_trunc('month', posting_date) AS DATE)"
SUMS_SQL = """-sum(CASE WHEN class = 'Revenue' THEN amount ELSE 0 END) AS r, sum(CASE WHEN sub_class = 'Cost of Sales' THEN amount ELSE 0 END) AS s, sum(CASE WHEN sub_class = 'Operating Expenses' THEN amount ELSE 0 END) AS o"""
PROFIT_SQL = f"{STAR_SQL}, g AS (SELECT entity_id, year(posting_date) AS year, sum(debit) AS d, sum(credit) AS c, sum(amount) AS n, {SUMS_SQL}, sum(CASE WHEN account_code IN ('890', '895') THEN amount ELSE 0 END) AS b FROM star GROUP BY ALL)"


def _in(sql: str) -> str:
    """A ratio to six places."""
    return f"round({sql}, 6)"


@query(f"WITH {PROFIT_SQL} SELECT entity_id, CAST(year AS INTEGER) AS year, CAST(d AS BIGINT) AS total_debits, CAST(c AS BIGINT) AS total_credits, CAST(n AS BIGINT) AS net_movement, CAST(r AS BIGINT) AS revenue, CAST(s AS BIGINT) AS cogs, CAST(r - s AS BIGINT) AS gross_profit, CAST(o AS BIGINT) AS operating_expenses, CAST(r - s - o + b AS BIGINT) AS ebitda, CAST(r - s - o AS BIGINT) AS net_profit, CASE WHEN r <> 0 THEN {_in('CAST(r - s AS DOUBLE) / r')} END AS gross_margin, CASE WHEN r <> 0 THEN {_in('CAST(r - s - o AS DOUBLE) / r')} END AS net_margin FROM g")
def profit_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By entity and year."""
    m = measures.profit_measures(star(spark, sf_dir).withColumn("year", F.year("posting_date")), ["entity_id", "year"])
    return m.select("entity_id", "year", *[in_cents(c).alias(c) for c in ("total_debits", "total_credits", "net_movement", "revenue", "cogs", "gross_profit", "operating_expenses", "ebitda", "net_profit")], *[F.round(c, 6).alias(c) for c in ("gross_margin", "net_margin")])


POS_SQL = f"""{STAR_SQL}, g AS (SELECT entity_id, {MONTH_SQL} AS month, {SUMS_SQL}, sum(CASE WHEN class = 'Asset' THEN amount ELSE 0 END) AS a, sum(CASE WHEN class = 'Liability' THEN -amount ELSE 0 END) AS l, sum(CASE WHEN class = 'Equity' THEN -amount ELSE 0 END) AS e, sum(CASE WHEN sub_class IN ('Current Assets', 'Current Liabilities') THEN amount ELSE 0 END) AS w FROM star GROUP BY ALL),
  p AS (SELECT entity_id, month, CAST(sum(a) OVER x AS BIGINT) AS assets, CAST(sum(l) OVER x AS BIGINT) AS liabilities, CAST(sum(e) OVER x AS BIGINT) AS equity, CAST(sum(r - s - o) OVER x AS BIGINT) AS earnings, CAST(sum(w) OVER x AS BIGINT) AS working_capital FROM g WINDOW x AS (PARTITION BY entity_id ORDER BY month))"""


@query(f"WITH {POS_SQL} SELECT *, assets - liabilities AS net_assets, assets - liabilities - equity - earnings AS balance_check FROM p")
def position_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances accumulated to each month's end; the check is zero throughout."""
    m = measures.position_measures(star(spark, sf_dir), ["entity_id"])
    return m.select("entity_id", "month", *[in_cents(c).alias(c) for c in ("assets", "liabilities", "equity", "earnings", "working_capital", "net_assets", "balance_check")])


@query(f"WITH {POS_SQL} SELECT entity_id, month, 'Asset' AS class, assets AS balance FROM p UNION ALL SELECT entity_id, month, 'Liability', liabilities FROM p UNION ALL SELECT entity_id, month, 'Equity', equity FROM p")
def balance_sheet_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural balances by class."""
    m = measures.balance_sheet_amounts(measures.position_measures(star(spark, sf_dir), ["entity_id"]), ["entity_id"])
    return m.select("entity_id", "month", "class", in_cents("balance").alias("balance"))


@query(f"""WITH {STAR_SQL}, m AS (SELECT entity_id, {MONTH_SQL} AS month, CAST(-sum(CASE WHEN class = 'Revenue' THEN amount ELSE 0 END) AS BIGINT) AS v FROM star GROUP BY ALL)
  SELECT m.entity_id, m.month, m.v AS mtd, CAST(sum(m.v) OVER (PARTITION BY m.entity_id, year(m.month), quarter(m.month) ORDER BY m.month) AS BIGINT) AS qtd, CAST(sum(m.v) OVER (PARTITION BY m.entity_id, year(m.month) + (month(m.month) >= 7)::INT ORDER BY m.month) AS BIGINT) AS fytd, p.v AS prior_year, m.v - p.v AS yoy
  FROM m LEFT JOIN m p ON p.entity_id = m.entity_id AND p.month + INTERVAL 12 MONTH = m.month""")
def time_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W05 on revenue."""
    m = star(spark, sf_dir).groupBy("entity_id", F.trunc("posting_date", "month").alias("month")).agg((-F.sum(F.when(F.col("class") == "Revenue", F.col("amount")).otherwise(0))).alias("revenue"))
    return measures.time_views(m, ["entity_id"], "revenue").select("entity_id", "month", *[in_cents(c).alias(c) for c in ("mtd", "qtd", "fytd", "prior_year", "yoy")])


BUDGET_SQL = f"{STAR_SQL}, a AS (SELECT entity_id, {MONTH_SQL} AS month, -sum(amount) AS actual FROM star WHERE class = 'Revenue' GROUP BY ALL), b AS (SELECT entity_id, month, CASE WHEN month(month) = 12 THEN NULL ELSE actual // 100000 * 100000 END AS budget FROM a)"


def _budget(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = star(spark, sf_dir).where("class = 'Revenue'").select("entity_id", F.trunc("posting_date", "month").alias("month"), (-F.col("amount")).alias("amount"))
    b = a.groupBy("entity_id", "month").agg((F.floor(F.sum("amount") / 1000) * 1000).cast("decimal(28,2)").alias("amount")).where("month(month) <> 12")
    return a, b


@query(f"WITH {BUDGET_SQL} SELECT a.entity_id, a.month, CAST(actual AS BIGINT) AS actual, CAST(coalesce(budget, 0) AS BIGINT) AS budget, CAST(actual - coalesce(budget, 0) AS BIGINT) AS variance FROM a JOIN b USING (entity_id, month)")
def budget_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets are revenue in whole thousands; December has none."""
    return measures.budget_variance(*_budget(spark, sf_dir), ["entity_id", "month"]).select("entity_id", "month", *[in_cents(c).alias(c) for c in ("actual", "budget", "variance")])


@query(f"WITH {BUDGET_SQL}, m AS (SELECT DISTINCT month FROM a) SELECT n_name AS entity_id, month FROM nation CROSS JOIN m WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.entity_id = n_name AND b.month = m.month AND month(b.month) <> 12)")
def missing_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J37, V14, U06."""
    a, b = _budget(spark, sf_dir)
    return measures.missing_budgets(table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity_id")), a, b)


#: Turnover range, and the gross profit's range in per cent of turnover.
BANDS = [("$0k-$100k", 20, 30), ("$100k-$1m", 10, 40), ("$1m-$4m", 12.5, 25), ("$3m-$50m", 15, 60), ("$50m-$900m", 45, 55)]
BAND_SQL = _values([(name, *[int(float(x[1:-1]) * (1000 if x[-1] == "k" else 1000000)) for x in name.split("-")], lo, hi) for name, lo, hi in BANDS]) + " bands(band, lower, upper, low, high)"
_REV = "CAST(t AS DOUBLE)"


@query(f"""WITH {STAR_SQL}, g AS (SELECT entity_id, year(posting_date) + (month(posting_date) >= 7)::INT AS fy, {SUMS_SQL.replace(" AS r,", " AS t,")}, sum(CASE WHEN account_code = '820' THEN amount ELSE 0 END) AS rent, sum(CASE WHEN account_code = '810' THEN amount ELSE 0 END) AS car, sum(CASE WHEN account_code IN ('800', '805') THEN amount ELSE 0 END) AS labour FROM star GROUP BY ALL),
  m AS (SELECT entity_id, fy, count(*) AS n, min(band) AS band, min(low) / 100 AS low, min(high) / 100 AS high FROM g JOIN {BAND_SQL} ON t > CAST(100 AS BIGINT) * lower AND t <= CAST(100 AS BIGINT) * upper GROUP BY ALL HAVING count(*) = 1),
  v AS (SELECT g.*, band, CASE WHEN t <> 0 THEN (t - s) / {_REV} END AS margin, low, high FROM g LEFT JOIN m USING (entity_id, fy)), w AS (SELECT *, CASE WHEN margin IS NOT NULL AND low IS NOT NULL THEN CASE WHEN margin < low THEN margin - low WHEN margin > high THEN margin - high ELSE 0 END END AS variance FROM v)
  SELECT entity_id, CAST(fy AS INTEGER) AS fy, CAST(t AS BIGINT) AS turnover, band, round(margin, 6) AS gross_margin, round(variance, 6) AS variance, CASE WHEN t <> 0 THEN round((s + o) / {_REV}, 6) END AS expense_ratio, CASE WHEN t <> 0 THEN round(rent / {_REV}, 6) END AS rent_ratio, CASE WHEN t <> 0 THEN round(car / {_REV}, 6) END AS motor_vehicle_ratio, CASE WHEN t <> 0 THEN round(labour / {_REV}, 6) END AS labour_ratio,
    CASE WHEN t <= 0 THEN 'no turnover' WHEN band IS NULL THEN 'no benchmark' WHEN variance IS NULL THEN 'no margin' WHEN variance < 0 THEN 'below range' WHEN variance > 0 THEN 'above range' ELSE 'within range' END AS risk FROM w""")
def benchmark_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By entity and financial year; bounds are read from the bands' names, of which two overlap."""
    s = star(spark, sf_dir).withColumn("fy", financial_year("posting_date"))
    r = measures.ratio_measures(s, ["entity_id", "industry", "fy"])
    bands = policy(spark, [(n, float(lo), float(hi)) for n, lo, hi in BANDS], "band string, low double, high double")
    lower, upper = turnover_bounds("band")
    bands = table(spark, sf_dir, "region").select(F.col("r_name").alias("industry")).crossJoin(bands.select("band", lower.alias("lower"), upper.alias("upper"), (F.col("low") / 100).alias("low"), (F.col("high") / 100).alias("high")))
    b = measures.benchmark_bands(r, bands, ["band", "low", "high"]).withColumn("variance", measures.outside(F.col("gross_margin"), F.col("low"), F.col("high")))
    ratios = [F.round(c, 6).alias(c) for c in ("gross_margin", "variance", "expense_ratio", "rent_ratio", "motor_vehicle_ratio", "labour_ratio")]
    return b.select("entity_id", "fy", in_cents("turnover").alias("turnover"), "band", *ratios, measures.risk_label(F.col("turnover"), F.col("band"), F.col("variance")).alias("risk"))


@query(f"""WITH {STAR_SQL}, m AS (SELECT n_name, r_name AS grp, count(*) OVER (PARTITION BY r_name) AS size, n_name = max(n_name) OVER (PARTITION BY r_name) AND r_name < 'B' AS last FROM nation JOIN region ON n_regionkey = r_regionkey),
  g AS (SELECT grp AS group_id, account_code, CAST(year(posting_date) AS INTEGER) AS year, count(DISTINCT entity_id) = max(size) AS whole, sum(amount) AS s, -sum(CASE WHEN is_intercompany THEN amount ELSE 0 END) AS x FROM star JOIN m ON entity_id = m.n_name WHERE NOT (account_code = '210' AND last) GROUP BY ALL)
  SELECT group_id, account_code, year, CASE WHEN whole THEN CAST(s AS BIGINT) END AS gross, CASE WHEN whole THEN CAST(x AS BIGINT) END AS eliminations, CASE WHEN whole THEN CAST(s + x AS BIGINT) END AS net FROM g""")
def consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region is a group; in some, one entity's tax account is left out, so that account has no group figure."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    members = n.select(F.col("r_name").alias("group_id"), F.col("n_name").alias("entity_id"))
    last = members.where("group_id < 'B'").groupBy("group_id").agg(F.max("entity_id").alias("entity_id")).select("entity_id", F.lit("210").alias("account_code"))
    rows = star(spark, sf_dir).join(few(last), ["entity_id", "account_code"], "left_anti")
    c = measures.consolidation(rows.withColumn("year", F.year("posting_date")), ["account_code", "year"], members)
    return c.select("group_id", "account_code", "year", *[in_cents(x).alias(x) for x in ("gross", "eliminations", "net")])


@query(f"""WITH {STAR_SQL} SELECT account_code, industry, CASE WHEN count(DISTINCT entity_id) = 25 THEN 'whole group' WHEN count(DISTINCT entity_id) = 1 THEN min(entity_id) ELSE count(DISTINCT entity_id) || ' entities' END AS scope, strftime(min(posting_date), '%Y-%m') || ' to ' || strftime(max(posting_date), '%Y-%m') AS selection FROM star GROUP BY account_code, industry""")
def report_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A41."""
    return measures.report_context(star(spark, sf_dir), ["account_code", "industry"], 25)


@query(f"WITH {STAR_SQL}, a AS (SELECT DISTINCT account_code, sub_class, sort_order FROM star) SELECT account_code, CAST(min(sort_order) OVER (PARTITION BY sub_class) AS INTEGER) AS sub_class_sort FROM a")
def sub_class_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W04, over the accounts that the ledger uses."""
    used = star(spark, sf_dir).select("account_code", "sub_class", "sort_order").distinct()
    return measures.group_sort_key(used, "sub_class", "sort_order").select("account_code", "sub_class_sort")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, CAST(max_by(round(value * 100), (ts, event_id)) AS BIGINT) AS value FROM events GROUP BY user_id")
def latest_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W03."""
    m = measures.latest_attributes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])
    return m.select("user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("value"))


# -- calendar ----------------------------------------------------------------------------------------------------------

HOLIDAYS = ["1998-01-01", "1998-01-26", "1998-04-10", "1998-04-13", "1998-04-25", "1998-12-25", "1998-12-28"]
DAYS_SQL = f"""days AS (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '2005-12-31', INTERVAL 1 DAY)) AS DATE) AS date), cal AS (SELECT date, isodow(date) < 6 AND date NOT IN ({', '.join(f"DATE '{d}'" for d in HOLIDAYS)}) AS is_bd FROM days), bd AS (SELECT date, is_bd, sum(is_bd::INT) OVER (ORDER BY date) AS n FROM cal)"""


def _calendar(spark: SparkSession) -> DataFrame:
    days = calendar.date_dimension(spark, "1990-01-01", "2005-12-31")
    return calendar.business_days(days, policy(spark, [(d,) for d in HOLIDAYS], "d string").select(F.col("d").cast("date").alias("date")))


@query(f"""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS orders FROM orders GROUP BY 1), x AS (SELECT d, orders, year(d) + (month(d) >= 7)::INT AS fy, (month(d) + 5) % 12 AS m FROM o) SELECT d AS date, orders, CAST(fy AS INTEGER) AS fy, 'FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') AS fy_label, make_date(fy - 1, 7, 1) AS fy_start, make_date(fy, 6, 30) AS fy_end, CAST(m // 3 + 1 AS INTEGER) AS fy_quarter, CAST(m + 1 AS INTEGER) AS fy_month, monthname(d) AS month_name, isodow(d) > 5 AS is_weekend FROM x""")
def date_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order days with their attributes."""
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("orders"))
    return o.join(calendar.date_dimension(spark, "1990-01-01", "2003-12-31"), "date").select("date", "orders", "fy", "fy_label", "fy_start", "fy_end", "fy_quarter", "fy_month", "month_name", "is_weekend")


@query(f"WITH {DAYS_SQL}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders) SELECT o_orderkey, e.date AS due FROM o JOIN bd s USING (date) JOIN bd e ON e.is_bd AND e.n = s.n + 7")
def business_day_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W18."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("pay"))
    return calendar.add_business_days(o, "pay", 7, _calendar(spark), "due").select("o_orderkey", "due")


#: Yearly rates in hundredths of a per cent by quarter, and each day's growth of one unit in 27 places, one day after the other.
RATES = {(y, q): (8 + (y + q) % 4) * 100 + q * 10 + 5 for y in range(1990, 2008) for q in (1, 2, 3, 4)}
GROWTH_SQL = """g(date, v) AS (SELECT DATE '1989-12-31', CAST('1000000000000000000000000000' AS HUGEINT) UNION ALL SELECT date + 1, v + v * ((8 + (year(date + 1) + quarter(date + 1)) % 4) * 100 + quarter(date + 1) * 10 + 5) // (10000 * (dayofyear(make_date(year(date + 1), 12, 31)))) FROM g WHERE date < DATE '2005-12-31')"""


@query(f"""WITH RECURSIVE {GROWTH_SQL}, {DAYS_SQL}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS pay, CAST(round(o_totalprice * 10) AS HUGEINT) AS c, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) END AS received FROM orders),
  d AS (SELECT o.*, e.date AS due FROM o LEFT JOIN bd s ON s.date = o.pay LEFT JOIN bd e ON e.is_bd AND e.n = s.n + 7), x AS (SELECT d.*, CASE WHEN received IS NULL THEN 'UNPAID' WHEN received > due THEN 'LATE' ELSE 'ON_TIME' END AS state, a.v AS va, z.v AS vz FROM d LEFT JOIN g a ON a.date = due LEFT JOIN g z ON z.date = received),
  y AS (SELECT *, CASE WHEN state = 'LATE' THEN (2 * c * vz + va) // (2 * va) - c ELSE 0 END AS earnings FROM x)
  SELECT o_orderkey, due, state, CAST(earnings AS BIGINT) AS earnings, CAST(CASE WHEN state = 'LATE' THEN ((c + earnings) * 60 + 50) // 100 ELSE 0 END AS BIGINT) AS uplift, CAST(CASE WHEN state = 'LATE' THEN c + earnings + ((c + earnings) * 60 + 50) // 100 ELSE 0 END AS BIGINT) AS charge FROM y""")
def contribution_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a pay event, received some days later."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    e = o.select("o_orderkey", F.to_date("o_orderdate").alias("pay_date"), money(F.round(F.col("o_totalprice") * 10).cast("long")).cast("decimal(18,2)").alias("amount"))
    e = e.withColumn("received", F.when(n % 50 != 0, F.date_add("pay_date", F.pmod(n, F.lit(90)).cast("int"))))
    rates = {k: f"{r / 100:.2f}" for k, r in RATES.items()}
    return calendar.settle(e, _calendar(spark), rates).select("o_orderkey", "due", "state", *[in_cents(c).alias(c) for c in ("earnings", "uplift", "charge")])


PAY_SQL = "p AS (SELECT o_orderpriority AS entity, year(o_orderdate) AS year, CAST(round(o_totalprice * 10) AS BIGINT) AS c, o_orderkey % 3 = 0 AS late, o_orderkey % 997 = 5 AS review, year(o_orderdate) >= 1995 AS payday FROM orders)"


@query(f"""WITH {PAY_SQL}, g AS (SELECT entity, year, sum(c * 8) AS w, sum(c) AS l, sum(CASE WHEN NOT late THEN c ELSE 0 END) AS t, sum(CASE WHEN late THEN c ELSE 0 END) AS x, sum(CASE WHEN late AND payday THEN c // 10 END) AS sgc, sum(CASE WHEN late AND payday THEN c // 100 END) AS gic, bool_or(payday) AS payday, count(*) AS events, count(*) FILTER (late) AS late_events, count(*) FILTER (review) AS reviews FROM p GROUP BY ALL)
  SELECT entity, CAST(year AS INTEGER) AS year, CAST(w AS BIGINT) AS wages, CAST(w - l AS BIGINT) AS qualifying, CAST(l AS BIGINT) AS liability, CAST(t AS BIGINT) AS on_time, CAST(x AS BIGINT) AS late, CASE WHEN l <> 0 THEN round(CAST(t AS DOUBLE) / l, 6) END AS compliance, events, late_events, reviews, CASE WHEN reviews = 0 AND payday THEN CAST(coalesce(sgc, 0) AS BIGINT) END AS charge, CASE WHEN reviews = 0 AND payday THEN CAST(coalesce(gic, 0) AS BIGINT) END AS interest,
  CASE WHEN reviews > 0 THEN reviews || ' events need a calendar review; charge and interest are withheld' WHEN NOT payday THEN 'quarterly receipts; payday charges don''t apply' ELSE 'recorded receipts; charge and interest are estimates' END AS note FROM g""")
def payroll_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A39, V16."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    c = F.round(F.col("o_totalprice") * 10).cast("long")
    late, year = n % 3 == 0, F.year("o_orderdate")
    e = o.withColumn("c", c).select(
        F.col("o_orderpriority").alias("entity"), year.alias("year"), money(F.col("c") * 8).alias("gross"), money(F.col("c") * 7).alias("qualifying"), money("c").alias("liability"), F.when(late, "LATE_BREACH").otherwise("ON_TIME").alias("status"),
        money(F.when(late, F.expr("c div 10")).otherwise(0)).alias("charge"), money(F.when(late, F.expr("c div 100")).otherwise(0)).alias("interest"), (year >= 1995).alias("payday"), F.when(n % 997 == 5, "CALENDAR_REVIEW").otherwise("OK").alias("state"),
    )
    m = measures.payroll_measures(e, ["entity", "year"])
    return m.select("entity", "year", *[in_cents(x).alias(x) for x in ("wages", "qualifying", "liability", "on_time", "late")], F.round("compliance", 6).alias("compliance"), "events", "late_events", "reviews", in_cents("charge").alias("charge"), in_cents("interest").alias("interest"), "note")


# -- grants ------------------------------------------------------------------------------------------------------------


def _grants(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Regions are grants, orders ledger rows; an order is allocated in halves to its priority as budget line, some of them over, unknown or bare."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    c = F.round(F.col("o_totalprice") * 100).cast("long")
    l = o.select(n.alias("ledger_id"), F.to_date("o_orderdate").alias("date"), money(c).alias("amount"), money(c).alias("cash_paid"))
    half = F.expr("c div 2")
    a = o.where(n % 10 != 0).select("*", c.alias("c"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).where("not (k = 1 and o_orderkey % 4 = 0)")
    a = a.select(F.concat_ws("-", n, "k").alias("allocation_id"), F.when((n % 37 == 0) & (F.col("k") == 0), -n - 1).otherwise(n).alias("ledger_id"), F.when((n % 41 == 0) & (F.col("k") == 0), "NOWHERE").otherwise(F.concat(F.lit("G"), F.col("o_custkey") % 5)).alias("grant_id"), F.col("o_orderpriority").alias("budget_line"), money(half + F.when(n % 13 == 0, 100).otherwise(0)).alias("amount"), money(half).alias("cash"), (n % 9 != 0).alias("approved"), F.when(n % 11 == 0, "").otherwise("x").alias("evidence"))
    g = policy(spark, [(f"G{i}", f"199{5 + i}-01-01", f"199{7 + i}-12-31" if i < 3 else f"200{i - 3}-12-31") for i in range(5)], "grant_id string, a string, b string").select("grant_id", F.col("a").cast("date").alias("start"), F.col("b").cast("date").alias("end"), money(F.lit(1000000)).alias("opening_unspent"))
    lines = o.select("o_orderpriority").distinct()
    b = g.select("grant_id").crossJoin(lines.where("o_orderpriority <> '5-LOW'")).select("grant_id", F.col("o_orderpriority").alias("budget_line"), money(F.lit(5000000000)).alias("budget"))
    return a, l, g, b


GRANT_SQL = """l AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_orderpriority AS line, o_custkey FROM orders),
  g AS (SELECT * FROM (VALUES ('G0', DATE '1995-01-01', DATE '1997-12-31'), ('G1', DATE '1996-01-01', DATE '1998-12-31'), ('G2', DATE '1997-01-01', DATE '1999-12-31'), ('G3', DATE '1998-01-01', DATE '2000-12-31'), ('G4', DATE '1999-01-01', DATE '2001-12-31')) v(gid, s, e)),
  a AS (SELECT id || '-' || k AS aid, CASE WHEN id % 37 = 0 AND k = 0 THEN -id - 1 ELSE id END AS lid, CASE WHEN id % 41 = 0 AND k = 0 THEN 'NOWHERE' ELSE 'G' || (o_custkey % 5) END AS gid, line, c // 2 + CASE WHEN id % 13 = 0 THEN 100 ELSE 0 END AS amount, c // 2 AS cash, id % 9 <> 0 AS approved, id % 11 = 0 AS bare FROM l CROSS JOIN (VALUES (0), (1)) v(k) WHERE id % 10 <> 0 AND NOT (k = 1 AND id % 4 = 0)),
  j AS (SELECT a.*, l.date, g.s, g.e FROM a LEFT JOIN l ON l.id = a.lid LEFT JOIN g ON g.gid = a.gid), bl AS (SELECT gid, line, sum(amount) AS allocated, sum(CASE WHEN date BETWEEN s AND e THEN amount ELSE 0 END) AS in_period, sum(CASE WHEN date BETWEEN s AND e AND approved AND NOT bare THEN amount ELSE 0 END) AS acceptable, sum(cash) AS cash FROM j WHERE date IS NOT NULL AND s IS NOT NULL GROUP BY gid, line)"""


@query(f"""WITH {GRANT_SQL} SELECT aid AS allocation_id, 'UNKNOWN_LEDGER' AS issue FROM j WHERE date IS NULL UNION ALL SELECT aid, 'UNKNOWN_GRANT' FROM j WHERE s IS NULL UNION ALL SELECT aid, 'OUTSIDE_AGREEMENT_PERIOD' FROM j WHERE date < s OR date > e UNION ALL SELECT aid, 'UNAPPROVED_ALLOCATION' FROM j WHERE NOT approved UNION ALL SELECT aid, 'MISSING_ALLOCATION_EVIDENCE' FROM j WHERE bare""")
def grant_allocation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J27, S31."""
    a, l, g, _ = _grants(spark, sf_dir)
    return grants.allocation_issues(a, l, g)


@query(f"""WITH {GRANT_SQL}, b AS (SELECT gid, line FROM g CROSS JOIN (SELECT DISTINCT line FROM l WHERE line <> '5-LOW')) SELECT coalesce(bl.gid, b.gid) AS grant_id, coalesce(bl.line, b.line) AS budget_line, CAST(coalesce(allocated, 0) AS BIGINT) AS allocated, CAST(coalesce(in_period, 0) AS BIGINT) AS in_period, CAST(coalesce(acceptable, 0) AS BIGINT) AS acceptable, CAST(coalesce(cash, 0) AS BIGINT) AS cash,
  CASE WHEN b.gid IS NULL THEN 'NO_BUDGET' WHEN acceptable > 5000000000 THEN 'OVER_BUDGET' ELSE 'WITHIN_BUDGET' END AS state FROM bl FULL JOIN b ON bl.gid = b.gid AND bl.line = b.line""")
def grant_budget_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    b = grants.budget_lines(*_grants(spark, sf_dir))
    return b.select("grant_id", "budget_line", *[in_cents(c).alias(c) for c in ("allocated", "in_period", "acceptable", "cash")], "state")


@query(f"""WITH {GRANT_SQL}, s AS (SELECT lid, sum(amount) AS a, sum(cash) AS c FROM a GROUP BY lid) SELECT id AS ledger_id, CAST(l.c - coalesce(s.a, 0) AS BIGINT) AS unallocated, CAST(l.c - coalesce(s.c, 0) AS BIGINT) AS unallocated_cash, CASE WHEN l.c < s.a OR l.c < s.c THEN 'OVER' WHEN s.a IS NULL THEN 'NONE' WHEN l.c = s.a THEN 'FULL' ELSE 'PART' END AS state FROM l LEFT JOIN s ON lid = id""")
def grant_ledger_tieout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25."""
    a, l, _, _ = _grants(spark, sf_dir)
    return grants.ledger_tieout(l, a).select("ledger_id", in_cents("unallocated").alias("unallocated"), in_cents("unallocated_cash").alias("unallocated_cash"), "state")


@query(f"""WITH {GRANT_SQL}, s AS (SELECT gid, sum(acceptable) AS spent FROM bl GROUP BY gid), r AS (SELECT 'G' || (c_custkey % 5) AS gid, sum(CAST(round(greatest(c_acctbal, 0) * 100) AS BIGINT)) AS received FROM customer GROUP BY 1) SELECT g.gid AS grant_id, 1000000 AS opening, CAST(coalesce(received, 0) AS BIGINT) AS received, CAST(coalesce(spent, 0) AS BIGINT) AS spent, CAST(greatest(coalesce(spent, 0) - 1000000 - coalesce(received, 0), 0) AS BIGINT) AS shortfall FROM g LEFT JOIN s USING (gid) LEFT JOIN r USING (gid)""")
def grant_funding_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' balances are receipts."""
    a, l, g, b = _grants(spark, sf_dir)
    r = table(spark, sf_dir, "customer").select(F.concat(F.lit("G"), F.col("c_custkey") % 5).alias("grant_id"), money(F.round(F.greatest("c_acctbal", F.lit(0)) * 100).cast("long")).alias("amount"))
    return grants.funding_movement(g, r, grants.budget_lines(a, l, g, b)).select("grant_id", in_cents("opening").cast("int").alias("opening"), *[in_cents(c).alias(c) for c in ("received", "spent", "shortfall")])


@query("""WITH c AS (SELECT 'G' || (s_suppkey % 5) AS grant_id, CASE s_suppkey % 3 WHEN 0 THEN 'interest' WHEN 1 THEN 'cash_contribution' ELSE 'in_kind' END AS kind, CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS a FROM supplier) SELECT grant_id, CAST(sum(CASE WHEN kind = 'interest' THEN a ELSE 0 END) AS BIGINT) AS interest, CAST(sum(CASE WHEN kind = 'cash_contribution' THEN a ELSE 0 END) AS BIGINT) AS cash_contribution, CAST(sum(CASE WHEN kind = 'in_kind' THEN a ELSE 0 END) AS BIGINT) AS in_kind FROM c GROUP BY grant_id""")
def grant_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27."""
    n = F.col("s_suppkey")
    c = table(spark, sf_dir, "supplier").select(F.concat(F.lit("G"), n % 5).alias("grant_id"), F.when(n % 3 == 0, "interest").when(n % 3 == 1, "cash_contribution").otherwise("in_kind").alias("kind"), money(F.round(F.abs("s_acctbal") * 100).cast("long")).alias("amount"))
    return grants.contributions(c).select("grant_id", *[in_cents(k).alias(k) for k in grants.KINDS])


@query(f"""WITH {GRANT_SQL}, b AS (SELECT gid, line FROM g CROSS JOIN (SELECT DISTINCT line FROM l WHERE line <> '5-LOW')) SELECT CAST(sum(allocated) AS BIGINT) AS allocated, CAST(sum(acceptable) AS BIGINT) AS acceptable, CAST(sum(cash) AS BIGINT) AS cash, count(*) FILTER (b.gid IS NULL OR acceptable > 5000000000) AS flagged, 'REVIEW' AS status FROM bl FULL JOIN b ON bl.gid = b.gid AND bl.line = b.line""")
def grant_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A28."""
    return grants.grant_totals(grants.budget_lines(*_grants(spark, sf_dir))).select(*[in_cents(c).alias(c) for c in ("allocated", "acceptable", "cash")], "flagged", "status")


# -- reports -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {ITEMS_SQL}, a AS (SELECT upper(tenant || l_partkey % 40) AS key, sum(net) AS l FROM items WHERE l_suppkey % 3 <> 0 GROUP BY 1), b AS (SELECT upper(tenant || l_partkey % 41) AS key, sum(net) AS r FROM items WHERE l_suppkey % 3 <> 0 OR l_partkey % 7 = 0 GROUP BY 1)
  SELECT coalesce(a.key, b.key) AS key, CAST(l AS BIGINT) AS left, CAST(r AS BIGINT) AS right, CAST(coalesce(l, 0) - coalesce(r, 0) AS BIGINT) AS difference, CASE WHEN r IS NULL THEN 'ONLY_LEFT' WHEN l IS NULL THEN 'ONLY_RIGHT' WHEN abs(l - r) > 1 THEN 'DIFFERENT' ELSE 'EQUAL' END AS state FROM a FULL JOIN b ON a.key = b.key""".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def keyed_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys differ in case, space and invisible characters."""
    i = items(spark, sf_dir)
    a = i.where("l_suppkey % 3 <> 0").select(F.concat(F.lit(" "), F.lower("tenant"), F.col("l_partkey") % 40, F.lit("​")).alias("key"), money("net").alias("amount"))
    b = i.where("l_suppkey % 3 <> 0 or l_partkey % 7 = 0").select(F.concat("tenant", F.col("l_partkey") % 41).alias("key"), money("net").alias("amount"))
    return reports.keyed_comparison(a, b).select("key", *[in_cents(c).alias(c) for c in ("left", "right", "difference")], "state")


CELLS_SQL = "c AS (SELECT p_brand AS book, p_type AS sheet, CAST(p_partkey AS VARCHAR) AS cell, p_partkey AS n FROM part)"


@query(f"WITH {CELLS_SQL} SELECT book, sheet, cell, CASE WHEN n % 5 = 0 THEN 'ADDED' WHEN n % 7 = 0 THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM c WHERE (n % 5 = 0) <> (n % 7 = 0) OR n % 3 = 0 AND n % 5 <> 0 AND n % 7 <> 0")
def cell_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are cells of two revisions."""
    return reports.cell_changes(*_cells(spark, sf_dir))


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    k = [F.col("p_brand").alias("book"), F.col("p_type").alias("sheet"), n.cast("string").alias("cell")]
    old = F.concat(F.lit("=[Old"), n % 4, F.lit(".xlsx]A!B"), n)
    return p.where(n % 5 != 0).select(*k, old.alias("formula")), p.where(n % 7 != 0).select(*k, F.when(n % 3 == 0, F.concat(F.lit("=[NEW"), n % 2, F.lit(".xlsx]A!B"), n)).otherwise(old).alias("formula"))


@query(f"WITH {CELLS_SQL}, a AS (SELECT DISTINCT book, CASE WHEN n % 3 = 0 THEN 'new' || n % 2 ELSE 'old' || n % 4 END || '.xlsx' AS link FROM c WHERE n % 7 <> 0) SELECT book, link FROM a EXCEPT SELECT book, 'old' || n % 4 || '.xlsx' FROM c WHERE n % 5 <> 0")
def new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J23, links."""
    return reports.new_links(*_cells(spark, sf_dir))


AGED_SQL = "x AS (SELECT c_mktsegment AS file, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS a, c_custkey AS n FROM customer), f AS (SELECT file, sum(a) AS a, sum(a * 2) AS b, sum(a * 3) + CASE WHEN file = 'BUILDING' THEN 5 ELSE 0 END AS t FROM x GROUP BY file)"


@query(f"""WITH {AGED_SQL} SELECT file, 'row' AS tie, CAST(-1 AS BIGINT) AS difference FROM x WHERE n % 25 = 0 UNION ALL SELECT file, 'row', CAST(a + b - t AS BIGINT) FROM f WHERE a + b <> t UNION ALL SELECT f.file, 'total', CAST((SELECT sum(3 * a + CASE WHEN n % 25 = 0 THEN 1 ELSE 0 END) FROM x WHERE x.file = f.file) - t AS BIGINT) FROM f WHERE (SELECT sum(3 * a + CASE WHEN n % 25 = 0 THEN 1 ELSE 0 END) FROM x WHERE x.file = f.file) <> t
  UNION ALL SELECT file, 'control', CAST(t - a * 3 AS BIGINT) FROM f WHERE t <> a * 3""")
def aged_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment is a file of two buckets; some row totals and one footer are out."""
    c = table(spark, sf_dir, "customer")
    a = F.round(F.abs("c_acctbal") * 100).cast("long")
    rows = c.select(F.col("c_mktsegment").alias("file"), F.lit(False).alias("is_footer"), money(a).alias("current"), money(a * 2).alias("older"), money(a * 3 + F.when(F.col("c_custkey") % 25 == 0, 1).otherwise(0)).alias("total"))
    s = c.groupBy(F.col("c_mktsegment").alias("file")).agg(F.sum(a).alias("a"))
    foot = s.select("file", F.lit(True).alias("is_footer"), money("a").alias("current"), money(F.col("a") * 2).alias("older"), money(F.col("a") * 3 + F.when(F.col("file") == "BUILDING", 5).otherwise(0)).alias("total"))
    found = reports.aged_ties(rows.unionByName(foot), ["current", "older"], s.select("file", money(F.col("a") * 3).alias("balance")))
    return found.select("file", "tie", in_cents("difference").alias("difference"))


@query("""WITH o AS (SELECT o_orderstatus AS file, o_orderkey AS n, 'S' || (o_orderkey // 100) AS section, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders), s AS (SELECT file, section, sum(c) AS t, count(*) AS k FROM o GROUP BY ALL) SELECT file, section, CAST(t + 1 AS BIGINT) AS total, CAST(t AS BIGINT) AS summed FROM s WHERE k % 5 = 0""")
def subtotal_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a report with section rows and totals, of which some are a cent out."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    block = F.expr("o_orderkey div 100")
    c = F.round(F.col("o_totalprice") * 100).cast("long")
    detail = o.select(F.col("o_orderstatus").alias("file"), (n * 10 + 5).alias("pos"), n.cast("string").alias("label"), money(c).alias("amount"))
    s = o.groupBy(F.col("o_orderstatus").alias("file"), block.alias("b")).agg(F.sum(c).alias("t"), F.count("*").alias("k"))
    head = s.select("file", (F.col("b") * 1000).alias("pos"), F.concat(F.lit("S"), "b").alias("label"), F.lit(None).cast("decimal(28,10)").alias("amount"))
    total = s.select("file", (F.col("b") * 1000 + 999).alias("pos"), F.concat(F.lit("Total S"), "b").alias("label"), money(F.col("t") + F.when(F.col("k") % 5 == 0, 1).otherwise(0)).alias("amount"))
    report = detail.unionByName(head).unionByName(total)
    totals = total.select("file", F.substring("label", 7, 99).alias("section"), F.col("amount").alias("total"))
    return reports.subtotal_proof(reports.fill_sections(report), totals).select("file", "section", in_cents("total").alias("total"), in_cents("summed").alias("summed"))


@query("""WITH c AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN '$1,234.50' WHEN 1 THEN '1e3' WHEN 2 THEN '12,34' WHEN 3 THEN '-7.25' WHEN 4 THEN '' ELSE '1234567' END AS raw, CASE o_orderkey % 3 WHEN 0 THEN '2026-02-30' WHEN 1 THEN '2026-02-28' ELSE '28/02/2026' END AS d, CASE o_orderkey % 4 WHEN 0 THEN '=1+1' WHEN 1 THEN ' @x' WHEN 2 THEN '-5' ELSE 'ok' END AS t, CASE o_orderkey % 3 WHEN 0 THEN 'Bank (090)' WHEN 1 THEN '090 - Bank' ELSE 'Bank (main)' END AS acc FROM orders)
  SELECT id, CASE raw WHEN '$1,234.50' THEN 123450 WHEN '-7.25' THEN -725 WHEN '1234567' THEN 123456700 END AS cents, CASE WHEN d = '2026-02-28' THEN DATE '2026-02-28' END AS day, CASE WHEN t IN ('=1+1', ' @x', '-5') THEN '''' || t ELSE t END AS safe, CASE WHEN acc = 'Bank (main)' THEN acc ELSE 'Bank' END AS name, CASE WHEN acc <> 'Bank (main)' THEN '090' END AS code FROM c""")
def guarded_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V03, V04, V18, V19 on spellings dealt over the orders."""
    n = F.col("o_orderkey")
    deal = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (n % len(x)).cast("int") + 1)
    c = table(spark, sf_dir, "orders").select(n.alias("id"), deal("$1,234.50", "1e3", "12,34", "-7.25", "", "1234567").alias("raw"), deal("2026-02-30", "2026-02-28", "28/02/2026").alias("d"), deal("=1+1", " @x", "-5", "ok").alias("t"), deal("Bank (090)", "090 - Bank", "Bank (main)").alias("acc"))
    name, code = account_parts("acc")
    return c.select("id", in_cents(accounting_number("raw")).cast("int").alias("cents"), iso_date("d").alias("day"), formula_safe("t").alias("safe"), name.alias("name"), code.alias("code"))


@query("SELECT c_custkey, CASE WHEN c < 0 THEN '-' ELSE '' END || abs(c) // 100 || '.' || lpad(CAST(abs(c) % 100 AS VARCHAR), 2, '0') AS plain, CASE WHEN c < 0 THEN '(' ELSE '' END || format('{:,}', abs(c) // 100) || '.' || lpad(CAST(abs(c) % 100 AS VARCHAR), 2, '0') || CASE WHEN c < 0 THEN ')' ELSE '' END AS shown FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS c FROM customer)")
def money_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V23."""
    m = money(F.round(F.col("c_acctbal") * 100).cast("long"))
    return table(spark, sf_dir, "customer").select("c_custkey", money_text(m).alias("plain"), money_display(m).alias("shown"))


