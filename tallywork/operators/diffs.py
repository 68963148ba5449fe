"""Differences between two runs: exceptions, queries, sources, documents, scope; queues over many packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import listed


def exception_changes(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str], comparable: Column | None = None) -> DataFrame:
    """(keys, state) of two runs' rows: NEW, RECURRING, CHANGED, NOT_RAISED, or NOT_COMPARABLE where `comparable` (over the keys) is false.

    Each side's rows of a key are a sorted array, so several exceptions of one account compare as a whole. Not raised isn't resolved.
    """
    side = lambda d, n: d.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(n))
    a, b = side(before, "a").alias("x"), side(after, "b").alias("y")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    j = a.join(b, same, "full_outer").select(*[F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys], "a", "b")
    state = F.when(F.col("a").isNull(), "NEW").when(F.col("b").isNull(), "NOT_RAISED").when(F.col("a") == F.col("b"), "RECURRING").otherwise("CHANGED")
    return j.select(*keys, (state if comparable is None else F.when(comparable, state).otherwise("NOT_COMPARABLE")).alias("state"))


def source_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pack, slot, state) by digest: ADDED, REMOVED, CHANGED, UNCHANGED."""
    j = before.select("pack", "slot", F.col("sha256").alias("a")).join(after.select("pack", "slot", F.col("sha256").alias("b")), ["pack", "slot"], "full_outer")
    return j.select("pack", "slot", F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").when(F.col("a") == F.col("b"), "UNCHANGED").otherwise("CHANGED").alias("state"))


def unmatched_documents(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pack, sha256, side, n): documents of one run without a partner of the same digest in the other, by multiplicity. Counts, so copies never meet."""
    c = lambda d, n: d.groupBy("pack", "sha256").agg(F.count("*").alias(n))
    j = c(before, "a").join(c(after, "b"), ["pack", "sha256"], "full_outer").fillna(0, ["a", "b"]).withColumn("d", F.col("b") - F.col("a")).where("d <> 0")
    return j.select("pack", "sha256", F.when(F.col("d") > 0, "AFTER").otherwise("BEFORE").alias("side"), F.abs("d").alias("n"))


def population_equal(before: DataFrame, after: DataFrame, group: str, member: str) -> DataFrame:
    """(group, equal): whether both runs hold the same members."""
    j = before.select(group, member).distinct().withColumn("a", F.lit(1)).join(after.select(group, member).distinct().withColumn("b", F.lit(1)), [group, member], "full_outer")
    return j.groupBy(group).agg(F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("equal"))


def scope_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tenant, changes): what makes two runs' results incomparable. Rows (tenant, threshold, controls, mapping_sha256, accounts, period_start, period_end, status)."""
    a, b = before.alias("a"), after.alias("b")
    differs = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    from ..functions.columns import financial_year

    names = [("threshold", differs("threshold")), ("controls", differs("controls")), ("mapping", differs("mapping_sha256")), ("accounts", differs("accounts")), ("period gap", F.date_add("a.period_end", 1) != F.col("b.period_start")), ("financial year", financial_year("a.period_end") != financial_year("b.period_end")), ("blocked", (F.col("a.status") == "BLOCKED") | (F.col("b.status") == "BLOCKED"))]
    return a.join(b, F.col("a.tenant") == F.col("b.tenant")).select("a.tenant", listed(names).alias("changes"))


def pack_agreement(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """(run_id, ordinal, mismatch): rows of two forms of one pack that differ, with the differing fields, or that one lacks."""
    a, b = left.alias("a"), right.alias("b")
    j = a.join(b, (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.ordinal") == F.col("b.ordinal")), "full_outer")
    what = F.when(F.col("a.run_id").isNull(), "missing left").when(F.col("b.run_id").isNull(), "missing right").otherwise(listed([(f, ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))) for f in fields]))
    return j.select(F.coalesce("a.run_id", "b.run_id").alias("run_id"), F.coalesce("a.ordinal", "b.ordinal").alias("ordinal"), what.alias("mismatch")).where("mismatch <> ''")


def queue_summary(packs: DataFrame, found: DataFrame) -> DataFrame:
    """(measure, name, packs, items): packs by status, packs and exceptions by control. packs: (run_id, status); found: (run_id, control)."""
    by_status = packs.dropDuplicates(["run_id"]).groupBy("status").agg(F.count("*").alias("packs"))
    by_control = found.groupBy("control", "run_id").agg(F.count("*").alias("n")).groupBy("control").agg(F.count("*").alias("packs"), F.sum("n").alias("items"))
    return by_status.select(F.lit("status").alias("measure"), F.col("status").alias("name"), "packs", F.lit(None).cast("long").alias("items")).unionByName(by_control.select(F.lit("control").alias("measure"), F.col("control").alias("name"), "packs", "items"))


def queue(packs: DataFrame, status: str) -> DataFrame:
    """Packs of one status, each path once, ordered by date and path with `ordinal` within the date, so no task holds the queue."""
    return packs.where(F.col("status") == status).dropDuplicates(["run_id"]).withColumn("ordinal", F.row_number().over(Window.partitionBy("report_date").orderBy("run_id")))
