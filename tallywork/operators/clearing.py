"""Clearing accounts: matches, decisions, outstanding items, carry-forward and status per period, for all accounts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["tenant", "account_id", "currency"]
#: Items of a suggested match.
LEAST, MOST = 2, 20


def signed() -> Column:
    return F.col("debit") - F.col("credit")


def repeated_ids(items: DataFrame) -> DataFrame:
    """Transaction ids that stand more than once over opening and current items of a clearing account."""
    return items.groupBy(*KEY, "transaction_id").agg(F.count("*").alias("n")).where("n > 1")


def with_opening(opening: DataFrame, items: DataFrame) -> DataFrame:
    """Opening and current items in one table."""
    return opening.unionByName(items, allowMissingColumns=True)


def suggest_matches(items: DataFrame) -> DataFrame:
    """(key, reference, n, ids, suggestion): references whose LEAST to MOST items net to zero; ids in date order, numbered by reference.

    Sums decide first; only the items of short groups are collected, so a hot reference never meets in one task.
    """
    k = [*KEY, "reference"]
    zero = items.where("reference <> ''").groupBy(*k).agg(F.count("*").alias("n"), F.sum(signed()).alias("s")).where(f"n between {LEAST} and {MOST} and s = 0").drop("s")
    ids = items.join(zero, k).groupBy(*k, "n").agg(F.array_sort(F.collect_list(F.struct("date", "transaction_id"))).alias("ids"))
    return ids.select(*k, "n", F.transform("ids", lambda x: x["transaction_id"]).alias("ids"), F.row_number().over(Window.partitionBy(*KEY).orderBy("reference")).alias("suggestion"))


def group_issues(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """(key, group, issue): accepted groups with under two items, several decisions or notes, no note, unknown items, or a sum other than zero. decisions: (key, group, transaction_id, decision, note)."""
    d = decisions.join(items.select(*KEY, "transaction_id", signed().alias("amount")), [*KEY, "transaction_id"], "left")
    g = d.groupBy(*KEY, "group").agg(
        F.count("*").alias("n"), F.min("decision").alias("d1"), F.max("decision").alias("d2"), F.min("note").alias("n1"), F.max("note").alias("n2"), F.sum("amount").alias("s"), F.count_if(F.col("amount").isNull()).alias("lost")
    )
    accept = F.col("d2") == "accept"
    issues = [("TOO_FEW", accept & (F.col("n") < 2)), ("MIXED_DECISION", F.col("d1") != F.col("d2")), ("MIXED_NOTE", F.col("n1") != F.col("n2")), ("NO_NOTE", accept & (F.coalesce("n2", F.lit("")) == "")), ("UNKNOWN_ITEM", F.col("lost") > 0), ("NOT_ZERO", accept & (F.coalesce("s", F.lit(0)) != 0))]
    return g.select(*KEY, "group", F.explode(F.filter(F.array(*[F.when(c, F.lit(x)) for x, c in issues]), lambda x: x.isNotNull())).alias("issue"))


def outstanding(items: DataFrame, accepted: DataFrame) -> DataFrame:
    """Items in no accepted group (key, transaction_id)."""
    return items.join(accepted.select(*KEY, "transaction_id").distinct(), [*KEY, "transaction_id"], "left_anti")


def carry_forward(items: DataFrame, accepted: DataFrame, last_end: Column, days: int = 7) -> DataFrame:
    """(key, period_end, transaction_id, date, amount, age): every item at each period's end from its own until an accepted group clears it.

    items have `period_end`, periods are `days` long up to last_end; accepted: (key, transaction_id, cleared), the end of the period of the decision.
    Each item gives its own rows: no join with the periods, and any number of periods chains without a loop.
    """
    both = items.join(accepted.select(*KEY, "transaction_id", "cleared"), [*KEY, "transaction_id"], "left")
    until = F.coalesce(F.date_sub("cleared", days), last_end)
    ends = F.when(until >= F.col("period_end"), F.expr(f"sequence(period_end, __until, interval {days} days)"))
    rows = both.withColumn("__until", until).withColumn("end", F.explode(ends))
    return rows.select(*KEY, F.col("end").alias("period_end"), "transaction_id", "date", signed().alias("amount"), F.datediff("end", "date").alias("age"))


def period_status(items: DataFrame, balances: DataFrame, carried: DataFrame, days: int = 7) -> DataFrame:
    """(key, period_end, opening, movement, closing, n_outstanding, status). balances: (key, period_end, opening, closing) as reported.

    BLOCKED if the opening differs from what the period before carried, or opening plus movement from closing; REVIEW with items outstanding.
    """
    k = [*KEY, "period_end"]
    moves = items.groupBy(*k).agg(F.sum(signed()).alias("movement"))
    open_ = carried.groupBy(*k).agg(F.sum("amount").alias("left"), F.count("*").alias("n_outstanding"))
    before = open_.select(*KEY, F.date_add("period_end", days).alias("period_end"), F.col("left").alias("carried"))
    b = balances.join(moves, k, "left").join(open_, k, "left").join(before, k, "left").fillna(0, ["movement", "n_outstanding", "carried"])
    status = F.when((F.col("opening") != F.col("carried")) | (F.col("opening") + F.col("movement") != F.col("closing")), "BLOCKED").when(F.col("n_outstanding") > 0, "REVIEW").otherwise("PASS")
    return b.select(*k, "opening", "movement", "closing", "n_outstanding", status.alias("status"))


def previous_start(start: Column, end: Column) -> Column:
    """First day of the period before: as many whole months if the period is whole months, else as many days."""
    whole = (F.dayofmonth(start) == 1) & (end == F.last_day(end))
    months = F.months_between(F.date_add(end, 1), start).cast("int")
    return F.when(whole, F.add_months(start, -months)).otherwise(F.date_sub(start, F.datediff(end, start) + 1))
