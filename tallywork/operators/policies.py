"""Policies by tenant and date: a set is all rows of one tenant's file; the latest set that began by a report date is in force then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERIOD = ["tenant", "report_date"]


def in_force(periods: DataFrame, sets: DataFrame) -> DataFrame:
    """(tenant, report_date, effective_from): which of sets (tenant, effective_from) counts in each of periods (tenant, report_date); periods before a
    tenant's first set, and tenants without one, have no row. A tenant's dates and sets meet by tenant; only these two columns are joined."""
    dates, begun = periods.select(*PERIOD).distinct(), sets.select("tenant", "effective_from").distinct()
    return dates.join(begun, "tenant").where(F.col("effective_from") <= F.col("report_date")).groupBy(*PERIOD).agg(F.max("effective_from").alias("effective_from"))


def effective(policy: DataFrame, periods: DataFrame) -> DataFrame:
    """The rows of policy (tenant, effective_from, ...) that count in each period: report_date stands in place of effective_from. A whole set replaces the one
    before it, so an account that the new set leaves out has no row. A set without rows is not known."""
    return in_force(periods, policy).join(policy, ["tenant", "effective_from"]).drop("effective_from")


def everywhere(policy: DataFrame, periods: DataFrame) -> DataFrame:
    """A declared policy, the same for all tenants and dates, by period."""
    return periods.select(*PERIOD).distinct().crossJoin(F.broadcast(policy))  # a declared, small table


def covered(rows: DataFrame, policy: DataFrame) -> DataFrame:
    """rows of the periods that policy (by period) has a set for: a control says nothing about the others."""
    return rows.join(policy.select(*PERIOD).distinct(), PERIOD, "left_semi")


def policy_runs(periods: DataFrame, policies: dict[str, DataFrame]) -> DataFrame:
    """(tenant, report_date, control, state): RAN where the control's policy (by period) has a set in force, else SKIPPED."""
    dates = periods.select(*PERIOD).distinct()
    out = None
    for control, policy in policies.items():
        ran = policy.select(*PERIOD).distinct().withColumn("ran", F.lit(True))
        one = dates.join(ran, PERIOD, "left").select(*PERIOD, F.lit(control).alias("control"), F.when(F.col("ran"), "RAN").otherwise("SKIPPED").alias("state"))
        out = one if out is None else out.unionByName(one)
    return out
