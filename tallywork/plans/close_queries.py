"""Queries of the ledger and close controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import AMOUNT
from ..operators import close, ledger
from ..operators.policies import everywhere
from ..sources.staging import staged
from .derive import LEDGER_SQL, PAIRS_SQL, TB_SQL, _values, chart, in_cents, money, policy, table
from .derive import ledger as ledger_lines
from .derive import tb as trial_balance

MAPPED = [("110", "Working capital"), ("600-A", "Income"), ("600-N", "Income"), ("820", "Tax")]
PERMITTED = [("Assets", "Working capital"), ("Revenue", "Income"), ("Liabilities", "Payables")]
EXPECTED = [("110", "debit", True), ("600-A", "credit", True), ("820", "credit", False), ("900", "nil", False), ("910", "any", True)]
CLASSES = [("600-A", "taxable_sales"), ("600-N", "taxable_sales"), ("600-R", "taxable_sales"), ("820", "gst_collected")]
Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def _short(found: DataFrame) -> DataFrame:
    return found.select("control", "status", "tenant", "report_date", "account_id", *[in_cents(c).alias(c) for c in ("current_value", "prior_value", "difference")], "reason")


def _cte(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


@query(f"WITH {TB_SQL} SELECT report_date, tenant, section, account_id, account_name, account_code, greatest(net, 0) AS debit, greatest(-net, 0) AS credit, greatest(ytd, 0) AS ytd_debit, greatest(-ytd, 0) AS ytd_credit FROM tb")
def tb_from_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as trial balances per tenant and month."""
    return trial_balance(spark, sf_dir).select("report_date", "tenant", "section", "account_id", "account_name", "account_code", *[in_cents(c).alias(c) for c in ("debit", "credit", "ytd_debit", "ytd_credit")])


@query(f"""WITH {LEDGER_SQL}, bent AS (SELECT tenant, journal_id, CASE WHEN hash_bit = 0 AND line_number = 1 THEN debit + 1 ELSE debit END AS debit, credit,
  CASE WHEN l_suppkey % 101 = 0 AND line_number = 2 THEN posting_date + 1 ELSE posting_date END AS posting_date FROM (SELECT *, l_suppkey % 97 AS hash_bit FROM ledger)),
  j AS (SELECT tenant, journal_id, sum(debit) AS d, sum(credit) AS c, min(posting_date) AS a, max(posting_date) AS b FROM bent GROUP BY ALL)
  SELECT tenant, journal_id, 'UNBALANCED' AS issue FROM j WHERE d <> c UNION ALL SELECT tenant, journal_id, 'SEVERAL_DATES' FROM j WHERE a <> b""")
def journal_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A32, on lines of which some are bent."""
    lines = ledger_lines(spark, sf_dir)
    bent = lines.withColumn("debit", F.when((F.col("l_suppkey") % 97 == 0) & (F.col("line_number") == 1), F.col("debit") + F.lit("0.01").cast(AMOUNT)).otherwise(F.col("debit")))
    bent = bent.withColumn("posting_date", F.when((F.col("l_suppkey") % 101 == 0) & (F.col("line_number") == 2), F.date_add("posting_date", 1)).otherwise(F.col("posting_date")))
    return ledger.journal_issues(bent)


@query(f"""WITH {LEDGER_SQL} SELECT tenant, journal_id, line_number, CASE WHEN account_id = '600-R' THEN 'ACCOUNT' WHEN tenant = 'X' THEN 'ENTITY' ELSE 'COUNTERPARTY' END AS issue
  FROM ledger WHERE account_id = '600-R' OR l_suppkey % 89 = 0""")
def ledger_line_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on an unknown account, and lines whose counterparty is their own entity."""
    lines = ledger_lines(spark, sf_dir).withColumn("counterparty", F.when(F.col("l_suppkey") % 89 == 0, F.col("tenant")))
    accounts = chart(spark).where("account_id <> '600-R'")
    entities = table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity_id"))
    return ledger.line_issues(lines, accounts, entities).select("tenant", "journal_id", "line_number", "issue")


@query(f"""WITH {LEDGER_SQL} SELECT tenant, account_id, concat_ws('.', journal_id, line_number) AS transaction_id, posting_date AS date, CAST(debit AS BIGINT) AS debit, CAST(credit AS BIGINT) AS credit FROM ledger WHERE debit > 0 OR credit > 0""")
def ledger_clearing_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A34."""
    return ledger.clearing_shape(ledger_lines(spark, sf_dir), "AUD").select("tenant", "account_id", "transaction_id", "date", in_cents("debit").alias("debit"), in_cents("credit").alias("credit"))


@query(f"""WITH {LEDGER_SQL}, s AS (SELECT s_suppkey, n_name AS counterparty FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  x AS (SELECT posting_date AS day, least(tenant, counterparty) AS entity_a, greatest(tenant, counterparty) AS entity_b, CASE WHEN account_id IN ('110', '820') THEN 'BS' ELSE 'PL' END AS leg, tenant, debit - credit AS amount FROM ledger JOIN s ON l_suppkey = s_suppkey WHERE tenant <> counterparty)
  SELECT day, entity_a, entity_b, leg, CAST(sum(amount) AS BIGINT) AS difference, CAST(count(DISTINCT tenant) AS INTEGER) AS entities FROM x GROUP BY day, entity_a, entity_b, leg HAVING sum(amount) <> 0 OR count(DISTINCT tenant) <> 2""")
def unmatched_intercompany(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's nation is the counterparty."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("counterparty"))
    lines = ledger_lines(spark, sf_dir).drop("n_nationkey").join(s, F.col("l_suppkey") == F.col("s_suppkey")).where("tenant <> counterparty")
    lines = lines.withColumn("leg", F.when(F.col("account_id").isin("110", "820"), "BS").otherwise("PL"))
    return ledger.unmatched_intercompany(lines).withColumn("difference", in_cents("difference"))


def _bent_tb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trial balance in which one account is a cent out where the month's day count is 30."""
    bend = (F.col("account_id") == "110") & (F.dayofmonth("report_date") == 30)
    return trial_balance(spark, sf_dir).withColumn("debit", F.when(bend, F.col("debit") + F.lit("0.01").cast(AMOUNT)).otherwise(F.col("debit")))


@query(f"""WITH {TB_SQL}, t AS (SELECT tenant, report_date, sum(greatest(net, 0) + CASE WHEN account_id = '110' AND day(report_date) = 30 THEN 1 ELSE 0 END) AS d, sum(greatest(-net, 0)) AS c FROM tb GROUP BY ALL)
  SELECT 'trial_balance_integrity' AS control, 'BLOCKED' AS status, tenant, report_date, CAST(NULL AS VARCHAR) AS account_id, CAST(d AS BIGINT) AS current_value, CAST(c AS BIGINT) AS prior_value, CAST(d - c AS BIGINT) AS difference, 'movement debits and credits differ' AS reason FROM t WHERE d <> c""")
def tb_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A01."""
    return _short(close.integrity(_bent_tb(spark, sf_dir)))


@query(f"""WITH {PAIRS_SQL}, gone AS (SELECT * FROM tb WHERE NOT (account_id = '600-N' AND month(report_date) = 3) AND NOT (account_id = '820' AND month(report_date) = 5))
  SELECT 'period_comparison' AS control, 'REVIEW' AS status, coalesce(c.tenant, p.tenant) AS tenant, coalesce(c.report_date, p.report_date) AS report_date, coalesce(c.account_id, p.account_id) AS account_id, c.ytd AS current_value, p.ytd AS prior_value, CAST(NULL AS BIGINT) AS difference,
    CASE WHEN c.tenant IS NULL THEN 'account is absent from the current period' ELSE 'account is new in the current period' END AS reason
  FROM (SELECT g.* FROM gone g JOIN dates USING (tenant, report_date)) c FULL JOIN (SELECT g.tenant, d.report_date, g.account_id, g.ytd FROM gone g JOIN dates d ON g.tenant = d.tenant AND g.report_date = d.prior_date) p ON c.tenant = p.tenant AND c.report_date = p.report_date AND c.account_id = p.account_id
  WHERE c.tenant IS NULL OR p.tenant IS NULL""")
def period_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two accounts are left out of some months."""
    some = trial_balance(spark, sf_dir).where("not (account_id = '600-N' and month(report_date) = 3) and not (account_id = '820' and month(report_date) = 5)")
    return _short(close.period_comparison(close.pair_periods(some)))


@query(f"""WITH {PAIRS_SQL} SELECT 'period_variance' AS control, 'REVIEW' AS status, tenant, report_date, account_id, cur AS current_value, pri AS prior_value, cur - pri AS difference,
  CASE WHEN cur > 0 AND pri < 0 OR cur < 0 AND pri > 0 THEN 'balance changed sign' WHEN pri = 0 THEN 'balance from nil' ELSE 'movement over both thresholds' END AS reason
  FROM pairs WHERE abs(cur - pri) >= 10000000 AND 10 * abs(cur - pri) >= abs(pri) AND cur <> pri""")
def period_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W06 over J01's pairs, at 100,000.00 and 0.10."""
    return _short(close.period_variance(close.pair_periods(trial_balance(spark, sf_dir)), "100000", "0.10"))


@query(f"""WITH {PAIRS_SQL} SELECT tenant, report_date, account_id, cur AS current_value, pri AS prior_value FROM pairs WHERE cur <> pri AND abs(cur - pri) >= 1 AND 100000000 * CAST(abs(cur - pri) AS HUGEINT) >= 4321 * CAST(abs(pri) AS HUGEINT)""")
def exact_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W06 at 0.01 and 0.00004321: a fraction of eight places is compared without rounding."""
    got = close.period_variance(close.pair_periods(trial_balance(spark, sf_dir)), "0.01", "0.00004321")
    return got.select("tenant", "report_date", "account_id", *[in_cents(c).alias(c) for c in ("current_value", "prior_value")])


@query(f"""WITH {PAIRS_SQL} SELECT 'account_metadata' AS control, 'REVIEW' AS status, tenant, report_date, account_id, cur AS current_value, pri AS prior_value, CAST(NULL AS BIGINT) AS difference,
  CASE WHEN account_id = '820' THEN 'account name and section changed' ELSE 'account code changed' END AS reason FROM pairs WHERE account_id = '110' AND (month(report_date) = 3) <> (month(prior_date) = 3) OR account_id = '820' AND (year(report_date) >= 1998) <> (year(prior_date) >= 1998)""")
def account_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account has another code each March, one another name and section from 1998."""
    t = trial_balance(spark, sf_dir)
    march, late = (F.col("account_id") == "110") & (F.month("report_date") == 3), (F.col("account_id") == "820") & (F.year("report_date") >= 1998)
    t = t.withColumns({"account_code": F.when(march, "1101").otherwise(F.col("account_code")), "account_name": F.when(late, "Tax").otherwise(F.col("account_name")), "section": F.when(late, "Equity").otherwise(F.col("section"))})
    return _short(close.account_metadata(close.pair_periods(t)))


@query(f"""WITH {PAIRS_SQL} SELECT DISTINCT tenant, report_date, 'the periods lie in different financial years' AS reason FROM pairs WHERE year(report_date) + (month(report_date) >= 7)::INT <> year(prior_date) + (month(prior_date) >= 7)::INT""")
def financial_year_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W08, V22."""
    return close.financial_year_reset(close.pair_periods(trial_balance(spark, sf_dir))).select("tenant", "report_date", "reason")


@query(f"WITH {TB_SQL} SELECT tenant, report_date, account_id, ytd AS current_value FROM tb WHERE account_id NOT IN ('110', '600-A', '600-N', '820')")
def account_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J02."""
    t = staged(trial_balance(spark, sf_dir), "trial-balances")
    return close.mapping(t, everywhere(policy(spark, MAPPED, "account_id string, review_group string"), t)).select("tenant", "report_date", "account_id", in_cents("current_value").alias("current_value"))


@query(f"WITH {TB_SQL} SELECT tenant, report_date, account_id, 'section permits: Payables' AS reason FROM tb WHERE account_id = '820'")
def mapping_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J03."""
    t = staged(trial_balance(spark, sf_dir), "trial-balances")
    found = close.mapping_compatibility(t, everywhere(policy(spark, MAPPED, "account_id string, review_group string"), t), everywhere(policy(spark, PERMITTED, "section string, review_group string"), t))
    return found.select("tenant", "report_date", "account_id", "reason")


@query(f"""WITH {TB_SQL}, pol AS (SELECT * FROM {_values([(a, b, c) for a, b, c in EXPECTED])} t(account_id, e, m)), f AS (SELECT d.tenant, d.report_date, pol.account_id, e, m, coalesce(ytd, 0) AS n, coalesce(net, 0) AS v FROM (SELECT DISTINCT tenant, report_date FROM tb) d CROSS JOIN pol LEFT JOIN tb USING (tenant, report_date, account_id))
  SELECT tenant, report_date, account_id, 'balance is not ' || e AS reason FROM f WHERE e = 'debit' AND n < 0 OR e = 'credit' AND n > 0 OR e = 'nil' AND n <> 0 UNION ALL SELECT tenant, report_date, account_id, 'no movement where one is expected' FROM f WHERE m AND v = 0""")
def balance_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two accounts of the policy are in no trial balance."""
    t = staged(trial_balance(spark, sf_dir), "trial-balances")
    return close.balance_policy(t, everywhere(policy(spark, EXPECTED, "account_id string, expected_balance string, expect_movement boolean"), t)).select("tenant", "report_date", "account_id", "reason")


def _subledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subledger_of(spark, sf_dir, trial_balance(spark, sf_dir))


def _subledger_of(spark: SparkSession, sf_dir: str, t: DataFrame) -> DataFrame:
    """Receivables per tenant, a cent more where the nation's key divides by five; and one account that no ledger has."""
    keys = table(spark, sf_dir, "nation").select(F.col("n_name").alias("tenant"), (F.col("n_nationkey") % 5 == 0).alias("bend"))
    rows = close.net(t).where("account_id = '110'").join(keys, "tenant")
    own = rows.select("tenant", "report_date", "account_id", (F.col("ytd_net") + F.when(F.col("bend"), F.lit(1)).otherwise(0)).cast(AMOUNT).alias("subledger_balance"))
    return own.unionByName(rows.where("bend").select("tenant", "report_date", F.lit("115").alias("account_id"), F.lit(5).cast(AMOUNT).alias("subledger_balance")))


SUB_SQL = f"{TB_SQL}, k AS (SELECT n_name AS tenant, n_nationkey % 5 = 0 AS bend FROM nation)"


@query(f"""WITH {SUB_SQL} SELECT tenant, report_date, account_id, -100 AS difference, 'subledger and ledger differ' AS reason FROM tb JOIN k USING (tenant) WHERE account_id = '110' AND bend
  UNION ALL SELECT tenant, report_date, '115', NULL, 'subledger account is not in the trial balance' FROM tb JOIN k USING (tenant) WHERE account_id = '110' AND bend""")
def subledger_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J05."""
    return close.subledger(trial_balance(spark, sf_dir), _subledger(spark, sf_dir)).select("tenant", "report_date", "account_id", in_cents("difference").cast("int").alias("difference"), "reason")


@query(f"WITH {SUB_SQL} SELECT tenant, report_date, account_id, ytd AS current_value FROM tb JOIN k USING (tenant) WHERE account_id = '820' AND NOT bend AND ytd <> 0")
def reconciliation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The equity reconciliation covers the tax account of some tenants."""
    covered = table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0").select(F.col("n_name").alias("tenant"), F.lit("820").alias("account_id"))
    return close.reconciliation_coverage(trial_balance(spark, sf_dir), _subledger(spark, sf_dir), covered).select("tenant", "report_date", "account_id", in_cents("current_value").alias("current_value"))


GST_SQL = f"""{TB_SQL}, g AS (SELECT tenant, report_date, -sum(CASE WHEN section = 'Revenue' THEN net ELSE 0 END) AS sales, -sum(CASE WHEN account_id = '820' THEN net ELSE 0 END) AS tax,
  CASE WHEN day(report_date) = 31 THEN 10000 ELSE 0 END AS settled FROM tb GROUP BY tenant, report_date)"""


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled_of(trial_balance(spark, sf_dir))


def _settled_of(t: DataFrame) -> DataFrame:
    return t.where("account_id = '820' and day(report_date) = 31").select("tenant", "report_date", F.lit("collected").alias("side"), F.lit(100).cast(AMOUNT).alias("amount"))


@query(f"WITH {GST_SQL} SELECT tenant, report_date, CAST(tax AS BIGINT) AS recorded, CAST(10 * (tax + settled) - sales AS BIGINT) AS tenfold FROM g WHERE abs(10 * (tax + settled) - sales) * 2 > 10 * (20000 + abs(tax))")
def gst_reasonableness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A03, at 100.00 and 0.50."""
    t = staged(trial_balance(spark, sf_dir), "trial-balances")
    found = close.gst_reasonableness(t, everywhere(policy(spark, CLASSES, "account_id string, gst_class string"), t), _settled_of(t), "100", "0.5")
    return found.select("tenant", "report_date", in_cents("current_value").alias("recorded"), F.round(F.col("difference") * 1000, 0).cast("long").alias("tenfold"))


@query(f"WITH {GST_SQL} SELECT tenant, report_date, 'collected' AS side, CAST(10 * (tax + settled) - sales AS BIGINT) AS tenfold FROM g UNION ALL SELECT tenant, report_date, 'paid', 0 FROM g")
def gst_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A04."""
    t = staged(trial_balance(spark, sf_dir), "trial-balances")
    s = close.gst_sides(t, everywhere(policy(spark, CLASSES, "account_id string, gst_class string"), t), _settled_of(t))
    return s.select("tenant", "report_date", "side", F.round(F.col("difference") * 1000, 0).cast("long").alias("tenfold"))


@query(f"WITH {TB_SQL} SELECT tenant, report_date, 'not classed: ' || string_agg(account_name, ', ' ORDER BY account_name) AS reason FROM tb WHERE net <> 0 AND account_id IN ('110', '600-R') GROUP BY ALL")
def gst_not_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account has no class, one a mixed one."""
    t = staged(trial_balance(spark, sf_dir), "trial-balances")
    classes = [(a, "mixed" if a == "600-R" else c) for a, c in CLASSES]
    return close.gst_not_run(t, everywhere(policy(spark, classes, "account_id string, gst_class string"), t)).select("tenant", "report_date", "reason")


_ABN = " + ".join(f"(CAST(substr(a, {i + 1}, 1) AS INT) - {1 if i == 0 else 0}) * {w}" for i, w in enumerate((10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)))
CONTACTS_SQL = f"""c AS (SELECT n_name AS tenant, CAST(c_custkey AS VARCHAR) AS contact_id, c_mktsegment || (CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END) || CAST(c_custkey // 2 AS VARCHAR) AS name, CAST(10000000000 + (c_custkey // 2) * 97 AS VARCHAR) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey),
  v AS (SELECT *, ({_ABN}) % 89 = 0 AS valid FROM c)"""


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as contacts: two neighbours share a name but for a space, and a number."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    half = F.expr("c_custkey div 2")
    return c.select(F.col("n_name").alias("tenant"), F.col("c_custkey").cast("string").alias("contact_id"), F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(""), half.cast("string")).alias("name"), (F.lit(10000000000) + half * 97).cast("string").alias("abn"))


@query(f"""WITH {CONTACTS_SQL} SELECT tenant, contact_id, 'INVALID_ABN' AS issue FROM v WHERE NOT valid
  UNION ALL SELECT tenant, contact_id, 'SHARED_ABN' FROM v WHERE valid QUALIFY count(*) OVER (PARTITION BY tenant, a) > 1
  UNION ALL SELECT tenant, contact_id, 'SHARED_NAME' FROM v QUALIFY count(*) OVER (PARTITION BY tenant, lower(replace(name, ' ', ''))) > 1""")
def contact_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A06, V20."""
    return close.contact_register(contacts(spark, sf_dir))


@query(f"""WITH {PAIRS_SQL}, e AS (SELECT tenant, report_date, account_id, -pri AS opening, CASE WHEN month(report_date) = 7 THEN 0 ELSE -cur_net END AS movement, -cur AS closing FROM pairs WHERE section = 'Liabilities')
  SELECT tenant, report_date, account_id, CAST(opening AS BIGINT) AS opening, CAST(movement AS BIGINT) AS movement, CAST(closing AS BIGINT) AS closing, CAST(opening + movement - closing AS BIGINT) AS difference FROM e
  UNION ALL SELECT tenant, report_date, NULL, CAST(sum(opening) AS BIGINT), CAST(sum(movement) AS BIGINT), CAST(sum(closing) AS BIGINT), CAST(sum(opening + movement - closing) AS BIGINT) FROM e GROUP BY tenant, report_date""")
def equity_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the tax account; July's movements are missing from the schedule."""
    t = trial_balance(spark, sf_dir).where("section = 'Liabilities'")
    found = close.equity_reconciliation(close.pair_periods(t), t.where("month(report_date) <> 7").select("tenant", "report_date", "account_id", "debit", "credit"))
    return found.select("tenant", "report_date", "account_id", *[in_cents(c).alias(c) for c in ("opening", "movement", "closing", "difference")])


@query(f"""WITH {PAIRS_SQL}, e AS (SELECT tenant, report_date, account_id FROM pairs WHERE section = 'Liabilities' UNION ALL SELECT DISTINCT tenant, report_date, NULL FROM pairs WHERE section = 'Liabilities'), m AS (SELECT *, month(report_date) AS mo FROM e)
  SELECT tenant, report_date, account_id, 'NOT_STORED' AS issue FROM m WHERE mo = 1 AND account_id IS NULL UNION ALL SELECT tenant, report_date, 'extra', 'UNKNOWN' FROM m WHERE mo = 2 AND account_id IS NOT NULL UNION ALL SELECT tenant, report_date, account_id, 'CLOSING' FROM m WHERE mo = 3 UNION ALL SELECT tenant, report_date, account_id, unnest(['OPENING', 'DIFFERENCE']) FROM m WHERE mo = 4""")
def equity_result_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results of which some lack the total, know another account, or have other figures."""
    t = trial_balance(spark, sf_dir).where("section = 'Liabilities'")
    done = staged(close.equity_reconciliation(close.pair_periods(t), t.select("tenant", "report_date", "account_id", "debit", "credit")), "equity")
    month, cent = F.month("report_date"), F.lit("0.01").cast(AMOUNT)
    stored = done.where(~((month == 1) & F.col("account_id").isNull())).withColumns({"closing": F.when(month == 3, F.col("closing") + cent).otherwise(F.col("closing")), "opening": F.when(month == 4, F.col("opening") + cent).otherwise(F.col("opening")), "difference": F.when(month == 4, F.col("difference") + cent).otherwise(F.col("difference"))})
    more = done.where((month == 2) & F.col("account_id").isNotNull()).withColumn("account_id", F.lit("extra"))
    return close.equity_result_issues(done, stored.unionByName(more)).select("tenant", "report_date", "account_id", "issue")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The controls over trial balances of two periods, enriched; the trial balances are written once and read by each."""
    t = staged(trial_balance(spark, sf_dir), "trial-balances")
    pairs, mapped = close.pair_periods(t), everywhere(policy(spark, MAPPED, "account_id string, review_group string"), t)
    parts = [close.integrity(t), close.period_comparison(pairs), close.period_variance(pairs, "100000", "0.10"), close.account_metadata(pairs), close.financial_year_reset(pairs), close.mapping(t, mapped)]
    return close.enrich(close.union(parts), mapped)


FOUND_SQL = f"""{PAIRS_SQL}, found AS (SELECT 'period_variance' AS control, tenant, report_date, account_id, account_name, CASE WHEN cur > 0 AND pri < 0 OR cur < 0 AND pri > 0 THEN 'balance changed sign' WHEN pri = 0 THEN 'balance from nil' ELSE 'movement over both thresholds' END AS reason
    FROM pairs WHERE abs(cur - pri) >= 10000000 AND 10 * abs(cur - pri) >= abs(pri) AND cur <> pri
  UNION ALL SELECT DISTINCT 'financial_year_reset', tenant, report_date, NULL, NULL, 'the periods lie in different financial years' FROM pairs WHERE year(report_date) + (month(report_date) >= 7)::INT <> year(prior_date) + (month(prior_date) >= 7)::INT
  UNION ALL SELECT 'account_mapping', tenant, report_date, account_id, account_name, 'account has no review group' FROM tb WHERE account_id = '600-R')"""


CLASSED = [*CLASSES, ("110", "bas_excluded")]
REQUIRED = [("subledger",), ("integrity",), ("gst",)]


def _evidence(periods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A calculation of each tenant's tax per period, and the digests that are known: some failed, of another period, or of an unknown source."""
    month = F.month("report_date")
    sha = F.sha2(F.concat_ws("|", "tenant", F.date_format("report_date", "yyyy-MM-dd")), 256)
    rows = periods.select(
        sha.alias("evidence_id"), "tenant", "report_date", F.concat(F.lit("gst-"), F.lower(F.translate("tenant", " ", "-"))).alias("label"), F.when(month % 4 == 0, "failed").otherwise("computed").alias("status"),
        F.when(month == 5, F.date_add("report_date", 1)).otherwise(F.col("report_date")).alias("period_end"), F.when(month == 7, 0).otherwise(1).alias("rate_tables"), sha.alias("sha256"), (month != 9).alias("accepted"),
    )
    return rows, rows.where("month(report_date) <> 11").select("sha256")


def all_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the exceptions of every control, of all tenants and periods, enriched. The trial balances are written once and read by each."""
    t = staged(trial_balance(spark, sf_dir), "trial-balances")
    periods = t.select("tenant", "report_date").distinct()
    pairs, mapped = close.pair_periods(t), everywhere(policy(spark, MAPPED, "account_id string, review_group string"), t)
    classes = everywhere(policy(spark, CLASSED, "account_id string, gst_class string"), t)
    covered = table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0").select(F.col("n_name").alias("tenant"), F.lit("820").alias("account_id"))
    tax = t.where("section = 'Liabilities'")
    movements = tax.where("month(report_date) <> 7").select("tenant", "report_date", "account_id", "debit", "credit")
    runs = _runs_of(periods).unionByName(periods.select("*", F.lit("gst").alias("control"), F.lit("RAN").alias("state")))
    parts = [
        close.integrity(t), close.period_comparison(pairs), close.period_variance(pairs, "100000", "0.10"), close.account_metadata(pairs), close.financial_year_reset(pairs), close.mapping(t, mapped),
        close.mapping_compatibility(t, mapped, everywhere(policy(spark, PERMITTED, "section string, review_group string"), t)),
        close.balance_policy(t, everywhere(policy(spark, EXPECTED, "account_id string, expected_balance string, expect_movement boolean"), t)),
        close.subledger(t, _subledger_of(spark, sf_dir, t)), close.reconciliation_coverage(t, _subledger_of(spark, sf_dir, t), covered),
        close.gst_reasonableness(t, classes, _settled_of(t), "100", "0.5"), close.gst_not_run(t, classes), close.contact_exceptions(contacts(spark, sf_dir), periods),
        close.equity_exceptions(close.equity_reconciliation(close.pair_periods(tax), movements)), close.evidence_exceptions(*_evidence(periods)),
        close.required_controls(runs, policy(spark, REQUIRED, "control string")),
    ]
    return close.enrich(close.union(parts), mapped)


def _control(control: str, select: str, account: str = "NULL", name: str = "NULL", status: str = "REVIEW") -> str:
    """SQL of one control's rows; select: from tenant and report_date on, with reason first."""
    return f"SELECT '{control}' AS control, '{status}' AS status, tenant, report_date, {account} AS account_id, {name} AS account_name, {select}"


ALL_FOUND_SQL = f"""{FOUND_SQL}, {GST_SQL[GST_SQL.index("g AS ("):]}, k AS (SELECT n_name AS tenant, n_nationkey % 5 = 0 AS bend FROM nation), {CONTACTS_SQL}, d AS (SELECT DISTINCT tenant, report_date FROM tb),
  pol AS (SELECT * FROM {_values(EXPECTED)} t(account_id, e, m)), pf AS (SELECT d.tenant, d.report_date, pol.account_id, account_name, e, m, coalesce(ytd, 0) AS n, coalesce(net, 0) AS v FROM d CROSS JOIN pol LEFT JOIN tb USING (tenant, report_date, account_id)),
  reg AS (SELECT tenant, contact_id, 'INVALID_ABN' AS issue FROM v WHERE NOT valid UNION ALL SELECT tenant, contact_id, 'SHARED_ABN' FROM v WHERE valid QUALIFY count(*) OVER (PARTITION BY tenant, a) > 1 UNION ALL SELECT tenant, contact_id, 'SHARED_NAME' FROM v QUALIFY count(*) OVER (PARTITION BY tenant, lower(replace(name, ' ', ''))) > 1),
  ev AS (SELECT *, month(report_date) AS mo, 'gst-' || lower(replace(tenant, ' ', '-')) AS label FROM d),
  every AS (SELECT control, 'REVIEW' AS status, tenant, report_date, account_id, account_name, reason FROM found
  UNION ALL {_control("mapping_compatibility", "'section permits: Payables' FROM tb WHERE account_id = '820'", "account_id", "account_name")}
  UNION ALL {_control("balance_policy", "'balance is not ' || e FROM pf WHERE e = 'debit' AND n < 0 OR e = 'credit' AND n > 0 OR e = 'nil' AND n <> 0", "account_id", "account_name")}
  UNION ALL {_control("balance_policy", "'no movement where one is expected' FROM pf WHERE m AND v = 0", "account_id", "account_name")}
  UNION ALL {_control("subledger_reconciliation", "'subledger and ledger differ' FROM tb JOIN k USING (tenant) WHERE account_id = '110' AND bend", "account_id", "account_name")}
  UNION ALL {_control("subledger_reconciliation", "'subledger account is not in the trial balance' FROM tb JOIN k USING (tenant) WHERE account_id = '110' AND bend", "'115'")}
  UNION ALL {_control("reconciliation_coverage", "'nothing reconciles this balance' FROM tb JOIN k USING (tenant) WHERE account_id = '820' AND NOT bend AND ytd <> 0", "account_id", "account_name")}
  UNION ALL {_control("gst_reasonableness", "'recorded tax differs from a tenth of the taxable amounts' FROM g WHERE abs(10 * (tax + settled) - sales) * 2 > 10 * (20000 + abs(tax))")}
  UNION ALL {_control("contact_register", "issue || ' ' || contact_id FROM reg JOIN (SELECT tenant, max(report_date) AS report_date FROM d GROUP BY tenant) USING (tenant)")}
  UNION ALL {_control("equity_reconciliation", "'opening plus movements differ from the closing' FROM pairs WHERE section = 'Liabilities' AND abs(-pri + (CASE WHEN month(report_date) = 7 THEN 0 ELSE -cur_net END) + cur) > 1", "account_id")}
  UNION ALL {_control("calculation_evidence", "label || ': ' || i FROM (SELECT *, unnest(['NOT_COMPUTED', 'WRONG_PERIOD', 'NO_RATE_TABLE', 'NOT_ACCEPTED', 'UNKNOWN_DIGEST']) AS i, unnest([mo % 4 = 0, mo = 5, mo = 7, mo = 9, mo = 11]) AS hit FROM ev) WHERE hit")}
  UNION ALL {_control("required_controls", "'subledger failed' FROM d WHERE month(report_date) % 3 <> 0", status="BLOCKED")})"""


@query(f"""WITH {ALL_FOUND_SQL} SELECT f.control, f.status, tenant, report_date, f.account_id, m.g AS review_group, reason, CAST(row_number() OVER (PARTITION BY tenant, report_date ORDER BY f.status <> 'BLOCKED', f.control, coalesce(f.account_id, ''), reason) AS INTEGER) AS ordinal
  FROM every f LEFT JOIN {_values(MAPPED)} m(account_id, g) ON f.account_id = m.account_id""")
def close_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exception of every control, tenant and period in its order."""
    return close.ordered(all_found(spark, sf_dir)).select("control", "status", "tenant", "report_date", "account_id", "review_group", "reason", "ordinal")


@query(f"""WITH {ALL_FOUND_SQL}, s AS (SELECT tenant, report_date, max(CASE status WHEN 'BLOCKED' THEN 2 ELSE 1 END) AS n FROM every GROUP BY ALL) SELECT d.tenant, d.report_date, CASE n WHEN 2 THEN 'BLOCKED' WHEN 1 THEN 'REVIEW' ELSE 'PASS' END AS status FROM d LEFT JOIN s USING (tenant, report_date)""")
def close_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 over every control: failed required controls block."""
    return close.overall_status(trial_balance(spark, sf_dir), all_found(spark, sf_dir))


@query(f"""WITH {FOUND_SQL} SELECT 'Q-' || substr(sha256(concat_ws('|', length(control) || ':' || control, length(tenant) || ':' || tenant, '10:' || CAST(report_date AS VARCHAR), length(account_id) || ':' || account_id, length(reason) || ':' || reason)), 1, 12) AS query_id,
  control, account_id, CASE control WHEN 'period_variance' THEN 'What caused the movement in ' || account_name || '?' ELSE 'Where is ' || account_name || ' reported?' END AS question FROM found WHERE account_id IS NOT NULL""")
def client_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R05."""
    return close.client_queries(found(spark, sf_dir)).select("query_id", "control", "account_id", "question")


@query(f"""WITH {FOUND_SQL}, d AS (SELECT DISTINCT tenant, report_date FROM tb) SELECT d.tenant, d.report_date, CASE WHEN count(f.control) > 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM d LEFT JOIN found f USING (tenant, report_date) GROUP BY ALL""")
def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return close.overall_status(trial_balance(spark, sf_dir), found(spark, sf_dir))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs_of(trial_balance(spark, sf_dir).select("tenant", "report_date").distinct())


def _runs_of(t: DataFrame) -> DataFrame:
    state = F.explode(F.array(F.struct(F.lit("subledger").alias("control"), F.when(F.month("report_date") % 3 == 0, "RAN").otherwise("FAILED").alias("state")), F.struct(F.lit("integrity").alias("control"), F.lit("RAN").alias("state"))))
    return t.withColumn("x", state).select("tenant", "report_date", "x.control", "x.state")


@query(f"""WITH {TB_SQL}, d AS (SELECT DISTINCT tenant, report_date FROM tb) SELECT tenant, report_date, 'subledger failed' AS reason FROM d WHERE month(report_date) % 3 <> 0 UNION ALL SELECT tenant, report_date, 'gst skipped' FROM d""")
def required_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One control fails outside quarter ends, one never runs."""
    return close.required_controls(_runs(spark, sf_dir), policy(spark, [("subledger",), ("integrity",), ("gst",)], "control string")).select("tenant", "report_date", "reason")


@query(f"""WITH {TB_SQL}, d AS (SELECT DISTINCT tenant, report_date FROM tb) SELECT tenant, report_date, CASE WHEN month(report_date) % 3 <> 0 THEN 'subledger' ELSE '' END AS not_run, CASE WHEN month(report_date) % 3 <> 0 THEN 'integrity' ELSE 'integrity, subledger' END AS relied_on FROM d""")
def controls_not_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return close.controls_not_run(_runs(spark, sf_dir))


@query("""WITH e AS (SELECT CAST(event_id AS VARCHAR) AS evidence_id, 'L' || CAST(user_id % 50 AS VARCHAR) AS label, event_type, CAST(ts AS DATE) AS day, event_id FROM events)
  SELECT evidence_id, 'NOT_COMPUTED' AS issue FROM e WHERE event_type = 'error' UNION ALL SELECT evidence_id, 'NOT_ACCEPTED' FROM e WHERE event_id % 13 = 0 UNION ALL SELECT evidence_id, 'WRONG_PERIOD' FROM e WHERE event_id % 17 = 0
  UNION ALL SELECT evidence_id, 'NO_RATE_TABLE' FROM e WHERE event_id % 4 = 0 UNION ALL SELECT evidence_id, 'UNKNOWN_DIGEST' FROM e WHERE event_id % 19 = 0 UNION ALL SELECT evidence_id, 'REPEATED_LABEL' FROM e QUALIFY count(*) OVER (PARTITION BY day, label) > 1""")
def evidence_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is one calculation."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(
        n.cast("string").alias("evidence_id"), F.concat(F.lit("L"), (F.col("user_id") % 50).cast("string")).alias("label"), F.when(F.col("event_type") == "error", "failed").otherwise("computed").alias("status"), F.date_add(F.to_date("ts"), F.when(n % 17 == 0, 1).otherwise(0)).alias("period_end"),
        F.to_date("ts").alias("report_date"), (n % 4).cast("int").alias("rate_tables"), F.sha2(n.cast("string"), 256).alias("sha256"), (n % 13 != 0).alias("accepted"),
    )
    return close.evidence_issues(rows, e.where("event_id % 19 <> 0").select(F.sha2(F.col("event_id").cast("string"), 256).alias("sha256")))


__all__ = ["Q", "S", "money"]
