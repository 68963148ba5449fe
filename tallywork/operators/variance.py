"""Policy-limited variance findings with hashed identities, decision coverage and a redaction proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import money_text, times
from .close import pair_periods


def variance_findings(tb: DataFrame, policy: DataFrame) -> DataFrame:
    """(tenant, report_date, section, account_id, current, prior, delta): accounts of either period, absent counting as nil, at or over both of the section's thresholds.

    policy: (tenant, report_date, section, minimum_absolute, minimum_percent), one row per reviewed section of a period. A prior of nil passes the percentage.
    """
    p = pair_periods(tb).withColumns({"section": F.coalesce("cur.section", "pri.section"), "current": F.coalesce("cur.ytd_net", F.lit(0)), "prior": F.coalesce("pri.ytd_net", F.lit(0))})
    j = p.join(policy, ["tenant", "report_date", "section"]).withColumn("delta", F.col("current") - F.col("prior"))
    millionths = (F.col("minimum_percent").cast("decimal(9,6)") * F.lit(10**6).cast("decimal(7,0)")).cast("decimal(9,0)")  # a product in which nothing is rounded
    over = (F.abs("delta") >= F.col("minimum_absolute")) & ((F.col("prior") == 0) | (times(F.abs("delta"), 10**8) >= F.abs("prior").cast("decimal(27,10)") * millionths)) & (F.col("delta") != 0)
    return j.where(over).select("tenant", "report_date", "section", "account_id", "current", "prior", "delta")


def section_drift(tb: DataFrame, section: str) -> DataFrame:
    """Accounts whose section changed from or to the reviewed one."""
    p = pair_periods(tb).where("cur is not null and pri is not null")
    a, b = F.col("cur.section"), F.col("pri.section")
    return p.where((a != b) & ((a == section) | (b == section))).select("tenant", "report_date", "account_id", b.alias("was"), a.alias("now"))


def truncate(found: DataFrame, most: int) -> DataFrame:
    """The first `most` findings of each tenant and period by account, with `total` and `truncated`."""
    k = Window.partitionBy("tenant", "report_date")
    return found.withColumns({"n": F.row_number().over(k.orderBy("section", "account_id")), "total": F.count("*").over(k)}).where(F.col("n") <= most).withColumn("truncated", F.col("total") > most)


def references(found: DataFrame) -> DataFrame:
    """Findings with account_ref, finding_id and evidence_ref in place of identities: a word and 24 hex digits of the SHA-256 over exact strings, each over
    the one before (fixed forms)."""
    ref = lambda word, *parts: F.concat(F.lit(f"{word}:"), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 24))
    account = found.withColumn("account_ref", ref("acct", "tenant", "account_id"))
    finding = account.withColumn("finding_id", ref("finding", "account_ref", money_text("delta"), F.col("report_date").cast("string")))
    return finding.withColumn("evidence_ref", ref("evidence", "finding_id", F.lit("reviewer-evidence")))


#: The digests that identify a run (fixed values).
RUN_DIGESTS = ("context_sha256", "current_csv_sha256", "current_manifest_sha256", "policy_sha256", "prior_csv_sha256", "prior_manifest_sha256", "request_sha256")


def run_id() -> Column:
    """The identity of a run over its seven digests, columns of these names: the SHA-256 of a compact JSON object with its members in order; null without one."""
    members = [F.concat(F.lit(f'"{d}":"'), F.col(d), F.lit('"')) for d in RUN_DIGESTS]
    whole = F.when(F.forall(F.array(*[F.col(d).isNotNull() for d in RUN_DIGESTS]), lambda x: x), F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")))
    return F.concat(F.lit("sha256:"), F.sha2(whole, 256))


def decision_issues(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """(finding_id, issue): decisions on unknown findings, findings decided more than once."""
    lost = decisions.join(found.select("finding_id"), "finding_id", "left_anti").select("finding_id", F.lit("UNKNOWN_FINDING").alias("issue")).distinct()
    twice = decisions.groupBy("finding_id").agg(F.count("*").alias("n")).where("n > 1").select("finding_id", F.lit("DECIDED_TWICE").alias("issue"))
    return lost.unionByName(twice)


def decision_coverage(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """(tenant, report_date, total, decided, undecided)."""
    d = found.join(decisions.select("finding_id", F.lit(1).alias("d")).distinct(), "finding_id", "left")
    g = d.groupBy("tenant", "report_date").agg(F.count("*").alias("total"), F.count("d").alias("decided"))
    return g.withColumn("undecided", F.col("total") - F.col("decided"))


def redaction_leaks(outgoing: DataFrame, forbidden: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): values of outgoing text columns that equal a forbidden identity (value). One pass: columns are unpivoted and joined once."""
    cells = outgoing.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").distinct()
    return cells.join(forbidden.select("value").distinct(), "value", "left_semi").select("column", "value")


def numeric_shape(outgoing: DataFrame, column: str) -> DataFrame:
    """Rows whose number is not plain decimal text."""
    return outgoing.where(~F.col(column).rlike(r"^-?\d+(\.\d+)?$"))
