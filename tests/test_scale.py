"""What queries read, shuffle and write, by their plans and folders."""

from pathlib import Path

from pyspark.sql import functions as F

from tallywork import plans
from tallywork.operators import drivers, measures
from tallywork.plans import derive, measure_queries
from tallywork.sources import staging

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def written(spark, name):
    return set(Path(staging.shared_dir(spark)).glob(f"{name}-*"))


def test_line_items_are_shuffled_once(spark):
    """with customers too large for a broadcast, their join takes orders alone."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(derive.items(spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_customer = [x for x in text.splitlines() if "Exchange hashpartitioning" in x and "custkey" in x]
    assert by_customer and not any("net" in x for x in by_customer)
    assert text.index("l_orderkey") < text.index("o_custkey")  # line items meet what orders have found


def test_trial_balances_are_made_once_a_query(spark):
    """a query that asks for them four times sums the ledger once, and the next query sums it again."""
    for _ in range(2):
        before = written(spark, "ledger-sums")
        plans.queries()["unmapped_accounts"](spark, SF)
        assert len(written(spark, "ledger-sums") - before) == 1


def test_facts_arent_shuffled_by_account(spark):
    """Three accounts hold all facts, so a shuffle by account would bring a third to one task."""
    text = plan(measure_queries.star(spark, SF))
    assert "hashpartitioning(account_code" not in text and "hashpartitioning(entity_id" not in text
    many = spark.range(5).select(F.col("id").cast("string").alias("account_code"))
    assert "hint" not in staging.few(many, 4)._jdf.queryExecution().analyzed().toString().lower() and "hint" in staging.few(many, 5)._jdf.queryExecution().analyzed().toString().lower()
    facts = spark.range(10).select((F.col("id") % 5).cast("string").alias("account_code"), F.lit("e").alias("entity_id"))
    assert measures.star(facts, many, spark.createDataFrame([("e",)], "entity_id string")).count() == 10


def test_transactions_stay_where_they_are(spark):
    """few variances are broadcast, so transactions aren't shuffled by account."""
    v = spark.createDataFrame([("t", "a", "2024-02-29", "2024-01-31", 1)], "tenant string, account_id string, r string, p string, difference long").selectExpr("tenant", "account_id", "CAST(r AS DATE) AS report_date", "CAST(p AS DATE) AS prior_date", "difference")
    t = spark.range(60).selectExpr("'t' AS tenant", "'a' AS account_id", "CAST(id AS STRING) AS transaction_id", "date_add(DATE'2024-01-31', CAST(id AS INT)) AS date", "id AS amount")
    got = drivers.window_transactions(v, t)
    assert "Exchange hashpartitioning" not in plan(got) and sorted(int(r["transaction_id"]) for r in got.collect()) == list(range(1, 30))


def test_evidence_and_source_meet_once(spark):
    """one shuffle for both directions; rows count as often as they stand, and a null equals nothing."""
    from tallywork.operators import checks

    e = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), (None, 3)], "k string, n int")
    s = spark.createDataFrame([("a", 1), ("a", 1), ("c", 4), (None, 3)], "k string, n int")
    got = checks.evidence_population(e, s, ["k", "n"])
    assert plan(got).count("Exchange hashpartitioning") == 1
    assert sorted((r["k"] or "", r["n"], r["issue"]) for r in got.collect()) == [("", 3, "NOT_IN_EVIDENCE"), ("", 3, "NOT_IN_SOURCE"), ("b", 2, "NOT_IN_SOURCE"), ("b", 2, "NOT_IN_SOURCE"), ("c", 4, "NOT_IN_EVIDENCE")]
