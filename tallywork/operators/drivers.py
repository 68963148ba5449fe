"""What drove a variance: transactions between two dates, the largest of them, and recoding checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import few, staged


def window_transactions(variances: DataFrame, transactions: DataFrame) -> DataFrame:
    """Transactions of each variance's account after its prior date up to its own. The date range is a condition on the equi join by account and by year, so a hot account is spread over its years.
    Variances are written and counted: few of them are broadcast, and the transactions stay where they are.

    variances: (tenant, account_id, report_date, prior_date, difference); transactions: (tenant, account_id, transaction_id, date, amount).
    """
    v = few(staged(variances.withColumn("y", F.explode(F.sequence(F.year("prior_date"), F.year("report_date")))), "variances"))
    t = transactions.withColumn("y", F.year("date"))
    return v.join(t, ["tenant", "account_id", "y"]).where((F.col("date") > F.col("prior_date")) & (F.col("date") <= F.col("report_date"))).drop("y")


def driver_totals(variances: DataFrame, window: DataFrame) -> DataFrame:
    """(tenant, account_id, report_date, difference, total, unexplained, n, status) per variance, those without transactions too."""
    k = ["tenant", "account_id", "report_date"]
    s = window.groupBy(*k).agg(F.sum("amount").alias("total"), F.count("*").alias("n"))
    b = variances.join(s, k, "left").fillna(0, ["total", "n"]).withColumn("unexplained", F.col("difference") - F.col("total"))
    return b.select(*k, "difference", "total", "unexplained", "n", F.when(F.col("n") == 0, "NO_TRANSACTIONS").when(F.col("unexplained") == 0, "EXPLAINED").otherwise("PARTLY_EXPLAINED").alias("status"))


def top_drivers(window: DataFrame, k: int = 5) -> DataFrame:
    """The k largest transactions of each variance by absolute amount, then date and id, with `rank`. Spark keeps k rows per key before the shuffle."""
    w = Window.partitionBy("tenant", "account_id", "report_date").orderBy(F.abs("amount").desc(), "date", "transaction_id")
    return window.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recoding(original: DataFrame, asserted: DataFrame, current: DataFrame) -> DataFrame:
    """(tenant, transaction_id, state) of each asserted recoding from account to expected_account: NOT_FOUND, UNCHANGED, RECODED, OTHER_ACCOUNT, AMOUNT_CHANGED or REUSED.

    original and current: (tenant, transaction_id, account_id, amount); asserted: (tenant, transaction_id, expected_account, target_id).
    """
    t = current.select("tenant", F.col("transaction_id").alias("target_id"), F.col("account_id").alias("now_account"), F.col("amount").alias("now_amount"))
    a = asserted.withColumn("uses", F.count("*").over(Window.partitionBy("tenant", "target_id")))
    j = original.join(a, ["tenant", "transaction_id"]).join(t, ["tenant", "target_id"], "left")
    state = (
        F.when(F.col("uses") > 1, "REUSED").when(F.col("now_account").isNull(), "NOT_FOUND").when(F.col("now_amount") != F.col("amount"), "AMOUNT_CHANGED")
        .when(F.col("now_account") == F.col("expected_account"), "RECODED").when(F.col("now_account") == F.col("account_id"), "UNCHANGED").otherwise("OTHER_ACCOUNT")
    )
    return j.select("tenant", "transaction_id", state.alias("state"))


def unmatched_current(current: DataFrame, asserted: DataFrame) -> DataFrame:
    """Current transactions that no assertion names."""
    return current.join(asserted.select("tenant", F.col("target_id").alias("transaction_id")).distinct(), ["tenant", "transaction_id"], "left_anti")
