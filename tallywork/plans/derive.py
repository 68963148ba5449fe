"""Accounting tables derived from the driver's tables, in Spark, and the same as SQL common table expressions.

A customer's nation is the tenant. A line item is a journal of three lines: a receivable, revenue by return flag, and tax. Amounts are
rounded to cents before they become decimals, so both engines agree.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import AMOUNT
from ..operators.ledger import trial_balances
from ..sources.staging import staged

#: account_id, account_name, account_code, section
CHART = [("110", "Receivables", "1100", "Assets"), ("600-A", "Sales A", "4001", "Revenue"), ("600-N", "Sales N", "4002", "Revenue"), ("600-R", "Sales R", "4003", "Revenue"), ("820", "GST", "8200", "Liabilities")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: Column | str) -> Column:
    return F.round((F.col(x) if isinstance(x, str) else x) * 100).cast("long")


def money(cents: Column | str) -> Column:
    """Cents as an amount."""
    c = F.col(cents) if isinstance(cents, str) else cents
    return (c.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(AMOUNT)


def in_cents(x: Column | str) -> Column:
    return F.round((F.col(x) if isinstance(x, str) else x) * 100, 0).cast("long")


def chart(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHART, "account_id string, account_name string, account_code string, section string")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their tenant, in cents. Orders find their tenant first, so that line items are shuffled once however large the customers are."""
    l, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    gross = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = l.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.to_date("l_shipdate").alias("posting_date"), "l_returnflag", cents(gross).alias("net"), cents(gross * F.col("l_tax")).alias("tax"))
    sold = c.select("c_custkey", "c_nationkey").join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    sold = o.select("o_orderkey", "o_custkey").join(sold, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_nationkey", "n_name")
    return lines.join(sold, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("n_name").alias("tenant"), "n_nationkey", "l_suppkey", "l_partkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("posting_date", "yyyyMMdd")).alias("journal_id"),
        "posting_date", "l_returnflag", "net", "tax",
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger lines: one pass over the items, exploded; no join per line."""
    zero = F.lit(0).cast("long")
    line = lambda n, account, d, c: F.struct(F.lit(n).alias("line_number"), account.alias("account_id"), d.alias("d"), c.alias("c"))
    lines = F.array(line(1, F.lit("110"), F.col("net") + F.col("tax"), zero), line(2, F.concat(F.lit("600-"), "l_returnflag"), zero, F.col("net")), line(3, F.lit("820"), zero, F.col("tax")))
    rows = items(spark, sf_dir).select("tenant", "n_nationkey", "journal_id", "posting_date", "l_suppkey", F.explode(lines).alias("x"))
    debit, credit = money("x.d"), money("x.c")
    return rows.select("tenant", "n_nationkey", "journal_id", "posting_date", "l_suppkey", "x.line_number", "x.account_id", debit.alias("debit"), credit.alias("credit"), (debit - credit).cast(AMOUNT).alias("amount"))


#: The trial balances of the query that is being built, by folder.
_BUILT: ContextVar[dict[str, DataFrame] | None] = ContextVar("built", default=None)


def one_ledger(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query with the trial balances that it and those it calls ask for made once, and written; another call of it makes them anew."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if _BUILT.get() is not None:
            return query(spark, sf_dir)
        token = _BUILT.set({})
        try:
            return query(spark, sf_dir)
        finally:
            _BUILT.reset(token)

    return run


def tb(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _BUILT.get()
    if built is None:
        return trial_balances(ledger(spark, sf_dir), chart(spark))
    if sf_dir not in built:
        built[sf_dir] = staged(trial_balances(ledger(spark, sf_dir), chart(spark)), "trial-balances")
    return built[sf_dir]


def policy(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# -- the same as SQL ---------------------------------------------------------------------------------------------------


def _values(rows: list[tuple]) -> str:
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


CHART_SQL = f"chart AS (SELECT * FROM {_values(CHART)} t(account_id, account_name, account_code, section))"
ITEMS_SQL = """items AS (SELECT n_name AS tenant, n_nationkey, l_suppkey, l_partkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS journal_id,
  CAST(l_shipdate AS DATE) AS posting_date, l_returnflag, CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS net, CAST(round(l_extendedprice * (1 - l_discount) * l_tax * 100) AS BIGINT) AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
LEDGER_SQL = f"""{ITEMS_SQL}, ledger AS (SELECT tenant, n_nationkey, journal_id, posting_date, l_suppkey, 1 AS line_number, '110' AS account_id, net + tax AS debit, 0 AS credit FROM items
  UNION ALL SELECT tenant, n_nationkey, journal_id, posting_date, l_suppkey, 2, '600-' || l_returnflag, 0, net FROM items
  UNION ALL SELECT tenant, n_nationkey, journal_id, posting_date, l_suppkey, 3, '820', 0, tax FROM items)"""
#: tb: amounts in cents; month is the first of the month, fy the year in which the financial year ends
TB_SQL = f"""{LEDGER_SQL}, {CHART_SQL}, sums AS (SELECT tenant, account_id, date_trunc('month', posting_date)::DATE AS month, CAST(sum(debit - credit) AS BIGINT) AS net FROM ledger GROUP BY ALL),
  spans AS (SELECT tenant, min(month) AS a, max(month) AS b FROM sums GROUP BY tenant),
  grid AS (SELECT tenant, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM spans),
  tb AS (SELECT tenant, month, last_day(month) AS report_date, section, account_id, account_name, account_code, coalesce(net, 0) AS net, year(month) + (CASE WHEN month(month) >= 7 THEN 1 ELSE 0 END) AS fy,
    CAST(sum(coalesce(net, 0)) OVER (PARTITION BY tenant, account_id, year(month) + (CASE WHEN month(month) >= 7 THEN 1 ELSE 0 END) ORDER BY month) AS BIGINT) AS ytd
    FROM grid CROSS JOIN chart LEFT JOIN sums USING (tenant, account_id, month))"""
PAIRS_SQL = f"""{TB_SQL}, dates AS (SELECT tenant, report_date, prior_date FROM (SELECT tenant, report_date, lag(report_date) OVER (PARTITION BY tenant ORDER BY report_date) AS prior_date FROM (SELECT DISTINCT tenant, report_date FROM tb)) WHERE prior_date IS NOT NULL),
  pairs AS (SELECT d.tenant, d.report_date, d.prior_date, c.account_id, c.account_name, c.account_code, c.section, c.ytd AS cur, p.ytd AS pri, c.net AS cur_net, p.net AS pri_net
    FROM dates d JOIN tb c ON c.tenant = d.tenant AND c.report_date = d.report_date JOIN tb p ON p.tenant = d.tenant AND p.report_date = d.prior_date AND p.account_id = c.account_id)"""
