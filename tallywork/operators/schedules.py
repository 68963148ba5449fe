"""Supporting schedules: expense claims, account migration, inter-entity balances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _issues(df: DataFrame, keys: list[str], issues: list[tuple]) -> DataFrame:
    return df.select(*keys, F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in issues]), lambda x: x.isNotNull())).alias("issue"))


def expense_issues(invoices: DataFrame, claims: DataFrame, payments: DataFrame) -> DataFrame:
    """(tenant, id, issue) over invoices (tenant, invoice_id, supplier, reference, amount, evidence), claims (tenant, claim_id, invoice_id, amount, approved) and payments (tenant, payment_id, claim_id, amount)."""
    per_invoice = claims.groupBy("tenant", "invoice_id").agg(F.sum("amount").alias("claimed"))
    inv = invoices.join(per_invoice, ["tenant", "invoice_id"], "left").fillna(0, ["claimed"])
    a = _issues(inv.withColumn("id", F.col("invoice_id")), ["tenant", "id"], [("OVER_ALLOCATED", F.col("claimed") > F.col("amount")), ("UNDER_ALLOCATED", F.col("claimed") < F.col("amount")), ("MISSING_RECEIPT", F.coalesce("evidence", F.lit("")) == "")])
    twice = invoices.groupBy("tenant", "supplier", "reference").agg(F.count("*").alias("n")).where("n > 1")
    b = invoices.join(twice, ["tenant", "supplier", "reference"], "left_semi").select("tenant", F.col("invoice_id").alias("id"), F.lit("DUPLICATE_REFERENCE").alias("issue"))
    per_claim = payments.groupBy("tenant", "claim_id").agg(F.sum("amount").alias("paid"))
    c = claims.join(per_claim, ["tenant", "claim_id"], "left").fillna(0, ["paid"]).join(invoices.select("tenant", "invoice_id", F.lit(1).alias("known")), ["tenant", "invoice_id"], "left")
    c = _issues(c.withColumn("id", F.col("claim_id")), ["tenant", "id"], [("OVERPAID", F.col("paid") > F.col("amount")), ("UNPAID", F.col("approved") & (F.col("paid") < F.col("amount"))), ("PAID_UNAPPROVED", ~F.col("approved") & (F.col("paid") > 0)), ("UNKNOWN_INVOICE", F.col("known").isNull())])
    d = payments.join(claims.select("tenant", "claim_id"), ["tenant", "claim_id"], "left_anti").select("tenant", F.col("payment_id").alias("id"), F.lit("UNLINKED_PAYMENT").alias("issue"))
    return a.unionByName(b).unionByName(c).unionByName(d)


def expense_clearing(claims: DataFrame, payments: DataFrame, balances: DataFrame) -> DataFrame:
    """(tenant, expected, ledger_balance, difference): approved claims less their payments against the clearing account (tenant, ledger_balance)."""
    owed = claims.where("approved").groupBy("tenant").agg(F.sum("amount").alias("claimed"))
    paid = payments.groupBy("tenant").agg(F.sum("amount").alias("paid"))
    b = balances.join(owed, "tenant", "left").join(paid, "tenant", "left").fillna(0, ["claimed", "paid"])
    return b.select("tenant", (F.col("claimed") - F.col("paid")).alias("expected"), "ledger_balance", (F.col("claimed") - F.col("paid") - F.col("ledger_balance")).alias("difference"))


def mapping_issues(mapping: DataFrame, before: DataFrame) -> DataFrame:
    """(tenant, id, issue): source accounts whose weights don't sum to one, accounts without a mapping, repeated items."""
    w = mapping.groupBy("tenant", "source_account").agg(F.sum("weight").alias("w")).where("w <> 1").select("tenant", F.col("source_account").alias("id"), F.lit("WEIGHTS").alias("issue"))
    lost = before.select("tenant", F.col("account").alias("source_account")).distinct().join(mapping, ["tenant", "source_account"], "left_anti").select("tenant", F.col("source_account").alias("id"), F.lit("UNMAPPED_ACCOUNT").alias("issue"))
    twice = before.groupBy("tenant", "item_id", "account").agg(F.count("*").alias("n")).where("n > 1").select("tenant", F.col("item_id").alias("id"), F.lit("DUPLICATE_ITEM").alias("issue"))
    return w.unionByName(lost).unionByName(twice)


def migration(before: DataFrame, mapping: DataFrame, after: DataFrame) -> DataFrame:
    """(tenant, item_id, account, expected, actual, state): balances before, spread by weights, against those after; absent differs from nil.

    before and after: (tenant, item_id, account, amount decimal(18,2)); mapping: (tenant, source_account, target_account, weight decimal(7,6)). Products keep eight places, so sums are exact.
    """
    moved = before.join(mapping.withColumnRenamed("source_account", "account"), ["tenant", "account"])
    e = moved.groupBy("tenant", "item_id", F.col("target_account").alias("account")).agg(F.sum((F.col("amount") * F.col("weight")).cast("decimal(26,8)")).alias("expected"))
    a = after.groupBy("tenant", "item_id", "account").agg(F.sum("amount").alias("actual"))
    state = F.when(F.col("actual").isNull(), "MISSING").when(F.col("expected").isNull(), "UNEXPECTED").when(F.col("expected") != F.col("actual"), "DIFFERENT").otherwise("EQUAL")
    return e.join(a, ["tenant", "item_id", "account"], "full_outer").withColumn("state", state)


def interentity(records: DataFrame) -> DataFrame:
    """(entity_a, entity_b, reference, sum_a, sum_b, state): both sides of an unordered pair must net to zero; DISPUTED, ONE_SIDED, DIFFERENCE or EQUAL. One aggregate, no self join."""
    r = records.withColumns({"entity_a": F.least("entity", "counterparty"), "entity_b": F.greatest("entity", "counterparty")})
    first = F.col("entity") == F.col("entity_a")
    g = r.groupBy("entity_a", "entity_b", "reference").agg(
        F.sum(F.when(first, F.col("amount")).otherwise(0)).alias("sum_a"), F.sum(F.when(~first, F.col("amount")).otherwise(0)).alias("sum_b"), F.count_if(first).alias("n_a"), F.count_if(~first).alias("n_b"), F.bool_or("disputed").alias("disputed")
    )
    state = F.when(F.col("disputed"), "DISPUTED").when((F.col("n_a") == 0) | (F.col("n_b") == 0), "ONE_SIDED").when(F.col("sum_a") + F.col("sum_b") != 0, "DIFFERENCE").otherwise("EQUAL")
    return g.select("entity_a", "entity_b", "reference", "sum_a", "sum_b", state.alias("state"))
