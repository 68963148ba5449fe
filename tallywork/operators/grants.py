"""Grant acquittal: allocations tied to ledger and agreements, budgets, funding movements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of contribution (fixed values of the pivot).
KINDS = ("interest", "cash_contribution", "in_kind")


def allocation_issues(allocations: DataFrame, ledger: DataFrame, agreements: DataFrame) -> DataFrame:
    """(allocation_id, issue): unknown ledger row or grant, outside the agreement, not approved, without evidence. allocations: (allocation_id, ledger_id, grant_id, budget_line, amount, cash, approved, evidence)."""
    j = allocations.join(ledger.select("ledger_id", "date"), "ledger_id", "left").join(agreements.select("grant_id", "start", "end"), "grant_id", "left")
    issues = [("UNKNOWN_LEDGER", F.col("date").isNull()), ("UNKNOWN_GRANT", F.col("start").isNull()), ("OUTSIDE_AGREEMENT_PERIOD", (F.col("date") < F.col("start")) | (F.col("date") > F.col("end"))), ("UNAPPROVED_ALLOCATION", ~F.col("approved")), ("MISSING_ALLOCATION_EVIDENCE", F.coalesce("evidence", F.lit("")) == "")]
    return j.select("allocation_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in issues]), lambda x: x.isNotNull())).alias("issue"))


def budget_lines(allocations: DataFrame, ledger: DataFrame, agreements: DataFrame, budgets: DataFrame) -> DataFrame:
    """(grant_id, budget_line, allocated, in_period, acceptable, cash, budget, state) per budgeted or used line. budgets: (grant_id, budget_line, budget)."""
    j = allocations.join(ledger.select("ledger_id", "date"), "ledger_id").join(agreements.select("grant_id", "start", "end"), "grant_id")
    inside = F.col("date").between(F.col("start"), F.col("end"))
    ok = inside & F.col("approved") & (F.coalesce("evidence", F.lit("")) != "")
    pick = lambda c, x: F.sum(F.when(c, F.col(x)).otherwise(0))
    g = j.groupBy("grant_id", "budget_line").agg(F.sum("amount").alias("allocated"), pick(inside, "amount").alias("in_period"), pick(ok, "amount").alias("acceptable"), F.sum("cash").alias("cash"))
    b = g.join(budgets, ["grant_id", "budget_line"], "full_outer").fillna(0, ["allocated", "in_period", "acceptable", "cash"])
    return b.withColumn("state", F.when(F.col("budget").isNull(), "NO_BUDGET").when(F.col("acceptable") > F.col("budget"), "OVER_BUDGET").otherwise("WITHIN_BUDGET"))


def ledger_tieout(ledger: DataFrame, allocations: DataFrame) -> DataFrame:
    """(ledger_id, unallocated, unallocated_cash, state): FULL, PART, NONE or OVER. ledger: (ledger_id, amount, cash_paid)."""
    a = allocations.groupBy("ledger_id").agg(F.sum("amount").alias("a"), F.sum("cash").alias("c"))
    j = ledger.join(a, "ledger_id", "left").withColumns({"unallocated": F.col("amount") - F.coalesce("a", F.lit(0)), "unallocated_cash": F.col("cash_paid") - F.coalesce("c", F.lit(0))})
    over = (F.col("unallocated") < 0) | (F.col("unallocated_cash") < 0)
    return j.select("ledger_id", "unallocated", "unallocated_cash", F.when(over, "OVER").when(F.col("a").isNull(), "NONE").when(F.col("unallocated") == 0, "FULL").otherwise("PART").alias("state"))


def funding_movement(agreements: DataFrame, receipts: DataFrame, lines: DataFrame) -> DataFrame:
    """(grant_id, opening, received, spent, closing, shortfall). agreements: (grant_id, opening_unspent)."""
    r = receipts.groupBy("grant_id").agg(F.sum("amount").alias("received"))
    s = lines.groupBy("grant_id").agg(F.sum("acceptable").alias("spent"))
    j = agreements.join(r, "grant_id", "left").join(s, "grant_id", "left").fillna(0, ["received", "spent"])
    closing = F.col("opening_unspent") + F.col("received") - F.col("spent")
    return j.select("grant_id", F.col("opening_unspent").alias("opening"), "received", "spent", closing.alias("closing"), F.greatest(-closing, F.lit(0)).alias("shortfall"))


def contributions(rows: DataFrame) -> DataFrame:
    """(grant_id, one column per kind)."""
    p = rows.groupBy("grant_id").pivot("kind", list(KINDS)).agg(F.sum("amount"))
    return p.fillna(0, list(KINDS))


def grant_totals(lines: DataFrame, issues: int | None = None) -> DataFrame:
    """One row: totals over all lines, and a status."""
    t = lines.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("allocated", "acceptable", "cash")], F.count_if(F.col("state") != "WITHIN_BUDGET").alias("flagged"))
    return t.withColumn("status", F.when(F.col("flagged") > 0, "REVIEW").otherwise("PASS"))
