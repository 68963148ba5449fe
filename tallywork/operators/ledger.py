"""Ledger lines: journal checks, trial balances per month, clearing transactions, intercompany pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import AMOUNT, financial_year
from ..sources.staging import staged


def journal_issues(lines: DataFrame) -> DataFrame:
    """(tenant, journal_id, issue): a journal that doesn't balance, or with several posting dates. lines: (tenant, journal_id, posting_date, debit, credit)."""
    j = lines.groupBy("tenant", "journal_id").agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"), F.min("posting_date").alias("a"), F.max("posting_date").alias("b"))
    issues = F.filter(F.array(F.when(F.col("d") != F.col("c"), F.lit("UNBALANCED")), F.when(F.col("a") != F.col("b"), F.lit("SEVERAL_DATES"))), lambda x: x.isNotNull())
    return j.select("tenant", "journal_id", F.explode(issues).alias("issue"))


def line_issues(lines: DataFrame, accounts: DataFrame, entities: DataFrame) -> DataFrame:
    """lines that break a rule, with `issue`: amount = debit - credit, one side only, known account and entity, counterparty only on intercompany lines."""
    known = lines.join(accounts.select("account_id", F.lit(True).alias("has_account")), "account_id", "left").join(entities.select(F.col("entity_id").alias("tenant"), F.lit(True).alias("has_entity")), "tenant", "left")
    issue = (
        F.when(F.col("amount") != F.col("debit") - F.col("credit"), "AMOUNT")
        .when((F.col("debit") < 0) | (F.col("credit") < 0) | ((F.col("debit") > 0) & (F.col("credit") > 0)), "SIGN")
        .when(F.col("has_account").isNull(), "ACCOUNT")
        .when(F.col("has_entity").isNull(), "ENTITY")
        .when(F.col("counterparty").isNotNull() & (F.col("counterparty") == F.col("tenant")), "COUNTERPARTY")
    )
    return known.withColumn("issue", issue).where("issue is not null").drop("has_account", "has_entity")


def trial_balances(lines: DataFrame, chart: DataFrame) -> DataFrame:
    """Canonical trial balances per tenant and month: every account of the chart in every month from a tenant's first to the last of all.

    lines: (tenant, account_id, posting_date, debit, credit); chart: (account_id, account_name, account_code, section), small. debit and
    credit are the month's movement, ytd_* run from the financial year's start; each net amount stands on its side.
    """
    month = F.trunc("posting_date", "month")
    sums = staged(lines.groupBy("tenant", "account_id", month.alias("month")).agg((F.sum("debit") - F.sum("credit")).cast(AMOUNT).alias("net")), "ledger-sums")  # read twice, so the lines are once
    spans = sums.groupBy("tenant").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    grid = spans.select("tenant", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month")).crossJoin(F.broadcast(chart))  # the chart is a declared, small table
    full = grid.join(sums, ["tenant", "account_id", "month"], "left").withColumn("net", F.coalesce("net", F.lit(0).cast(AMOUNT)))
    year = Window.partitionBy("tenant", "account_id", financial_year("month")).orderBy("month")
    full = full.withColumn("ytd", F.sum("net").over(year))
    zero = F.lit(0).cast(AMOUNT)
    side = lambda c, sign: F.greatest(F.col(c).cast(AMOUNT) * sign, zero).cast(AMOUNT)
    return full.select(
        F.last_day("month").alias("report_date"), "tenant", "section", "account_id", "account_name", "account_code",
        side("net", 1).alias("debit"), side("net", -1).alias("credit"), side("ytd", 1).alias("ytd_debit"), side("ytd", -1).alias("ytd_credit"),
    )


def clearing_shape(lines: DataFrame, currency: str) -> DataFrame:
    """Ledger lines as clearing transactions, one positive side each; zero lines drop."""
    return lines.where("debit > 0 or credit > 0").select("tenant", "account_id", F.lit(currency).alias("currency"), F.concat_ws(".", "journal_id", "line_number").alias("transaction_id"), F.col("posting_date").alias("date"), F.col("journal_id").alias("reference"), F.lit("").alias("description"), "debit", "credit")


def unmatched_intercompany(lines: DataFrame) -> DataFrame:
    """(day, entity_a, entity_b, leg, difference, entities): unordered pairs whose amounts of one day and leg don't net to zero over both. lines: (tenant, counterparty, posting_date, leg, amount)."""
    pair = lines.where("counterparty is not null").select(F.col("posting_date").alias("day"), F.least("tenant", "counterparty").alias("entity_a"), F.greatest("tenant", "counterparty").alias("entity_b"), "leg", "tenant", "amount")
    # two entities at most per pair, so min and max tell whether both posted
    sums = pair.groupBy("day", "entity_a", "entity_b", "leg").agg(F.sum("amount").alias("difference"), (1 + (F.min("tenant") != F.max("tenant")).cast("int")).alias("entities"))
    return sums.where("difference <> 0 or entities <> 2")
