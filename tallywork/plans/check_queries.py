"""Queries of source checks and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, drivers
from ..sources.staging import staged
from .derive import LEDGER_SQL, TB_SQL, in_cents, ledger, table, tb
from .transaction_queries import WINDOW_SQL, _variances, _window

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


@query("""WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS k, l_linenumber AS n, CASE WHEN l_partkey % 50 = 0 THEN ' ' ELSE l_returnflag END AS f FROM lineitem) SELECT k AS journal_id, n AS line_number, 'BLANK_flag' AS issue FROM l WHERE f = ' ' UNION ALL SELECT k, n, 'REPEATED_KEY' FROM l GROUP BY k, n HAVING count(*) > 1""")
def require_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and line number are no key."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("journal_id"), F.col("l_linenumber").alias("line_number"), F.when(F.col("l_partkey") % 50 == 0, " ").otherwise(F.col("l_returnflag")).alias("flag"))
    return checks.require_rows(l, ["flag"], ["journal_id", "line_number"])


@query("""WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS n, c_mktsegment AS i FROM customer) SELECT id AS entity_id, 'UNKNOWN_INDUSTRY' AS issue FROM s WHERE i = 'BUILDING' UNION ALL SELECT id, 'INVALID_ABN' FROM s WHERE n % 3 = 0 UNION ALL SELECT id, 'CURRENCY' FROM s WHERE n % 5 = 0 UNION ALL SELECT id, 'WEIGHT' FROM s WHERE n % 7 = 0""")
def entity_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities."""
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey")
    e = c.select(n.cast("string").alias("entity_id"), F.when(n % 3 == 0, "51824753557").otherwise("51 824 753 556").alias("abn"), F.col("c_mktsegment").alias("anzsic_code"), F.when(n % 5 == 0, "NZD").otherwise("AUD").alias("currency"), F.when(n % 7 == 0, 2).otherwise(1).alias("consolidation_weight"))
    return checks.entity_issues(e, c.select(F.col("c_mktsegment").alias("anzsic_code")).where("anzsic_code <> 'BUILDING'"))


@query("""WITH b AS (SELECT CAST(o_custkey AS VARCHAR) AS e, o_orderpriority AS a, CAST(o_orderdate AS DATE) AS d, o_custkey AS n FROM orders) SELECT e AS entity_id, a AS account_code, d AS period_date, 'UNKNOWN_ENTITY' AS issue FROM b WHERE n % 9 = 0 UNION ALL SELECT e, a, d, 'UNKNOWN_ACCOUNT' FROM b WHERE a = '5-LOW' UNION ALL SELECT e, a, d, 'NOT_PROFIT_AND_LOSS' FROM b WHERE a = '2-HIGH' UNION ALL SELECT e, a, d, 'NOT_MONTH_START' FROM b WHERE day(d) <> 1
  UNION ALL SELECT e, a, d, 'OUTSIDE_HORIZON' FROM b WHERE NOT d BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def budget_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as budget rows."""
    o = table(spark, sf_dir, "orders")
    b = o.select(F.col("o_custkey").cast("string").alias("entity_id"), F.col("o_orderpriority").alias("account_code"), F.to_date("o_orderdate").alias("period_date"))
    e = table(spark, sf_dir, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").cast("string").alias("entity_id"))
    a = o.select(F.col("o_orderpriority").alias("account_code")).distinct().where("account_code <> '5-LOW'").withColumn("report_section", F.when(F.col("account_code") == "2-HIGH", "Balance Sheet").otherwise("Profit and Loss"))
    return checks.budget_issues(b, e, a, "1996-01-01", "1999-12-31")


PAY_SQL = "p AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS n, CAST(o_orderdate AS DATE) + 10000 AS d FROM orders)"


@query(f"""WITH {PAY_SQL} SELECT id AS event_id, 'NEGATIVE' AS issue FROM p WHERE n % 31 = 0 UNION ALL SELECT id, 'QUALIFYING_OVER_GROSS' FROM p WHERE n % 29 = 0 AND n % 31 <> 0 OR n % 31 = 0 UNION ALL SELECT id, 'RECEIVED_BEFORE_REMITTED' FROM p WHERE n % 23 = 0 AND n % 4 <> 0 UNION ALL SELECT id, 'DUE_BEFORE_PAY' FROM p WHERE n % 19 = 0""")
def payroll_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pay events."""
    return checks.payroll_issues(_pay(spark, sf_dir))


def _pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    d = F.date_add(F.to_date("o_orderdate"), 10000)
    return o.select(n.cast("string").alias("event_id"), d.alias("pay_date"), F.when(n % 31 == 0, -1).otherwise(100).alias("gross"), F.when(n % 29 == 0, 101).otherwise(90).alias("qualifying"), F.lit(9).alias("liability"), F.date_add(d, 3).alias("remitted"), F.when(n % 4 != 0, F.date_add(d, F.when(n % 23 == 0, 2).otherwise(5))).alias("received"), F.date_add(d, F.when(n % 19 == 0, -1).otherwise(7)).alias("due_date"))


@query(f"WITH {PAY_SQL} SELECT id AS event_id, CASE WHEN d >= DATE '2026-07-01' THEN 'PAYDAY' ELSE 'QUARTERLY' END AS regime, CASE WHEN n % 4 = 0 THEN 'ESTIMATE' ELSE 'ACTUAL' END AS basis FROM p")
def payroll_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V16, derived columns."""
    return checks.payroll_basis(_pay(spark, sf_dir)).select("event_id", "regime", "basis")


@query("""WITH l AS (SELECT l_returnflag AS file, l_orderkey AS k FROM lineitem GROUP BY ALL) SELECT file, k AS source_row, 'NOT_MAPPED' AS issue FROM l WHERE k % 7 = 0 AND k % 11 <> 0 UNION ALL SELECT file, k, 'NOT_IN_DETAIL' FROM l WHERE k % 11 = 0 AND k % 7 <> 0 UNION ALL SELECT file, k, 'MAPPED_TWICE' FROM l WHERE k % 7 <> 0 AND k % 13 = 0""")
def line_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J28."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("file"), F.col("l_orderkey").alias("source_row")).distinct()
    m = l.where("source_row % 7 <> 0")
    return checks.line_mapping(l.where("source_row % 11 <> 0"), m.unionByName(m.where("source_row % 13 = 0")))


@query(f"WITH {TB_SQL} SELECT tenant, report_date, count(*) AS accounts, CAST(sum(greatest(net, 0)) AS BIGINT) AS movement, CAST(sum(greatest(ytd, 0)) AS BIGINT) AS ytd, sum(net) = 0 AND sum(ytd) = 0 AS balanced FROM tb GROUP BY ALL")
def tb_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T09."""
    return checks.tb_summary(tb(spark, sf_dir)).select("tenant", "report_date", "accounts", in_cents("movement").alias("movement"), in_cents("ytd").alias("ytd"), "balanced")


@query(f"""WITH {TB_SQL}, bad AS (SELECT DISTINCT tenant || report_date AS file FROM tb WHERE month(report_date) IN (2, 3)) SELECT tenant, report_date, account_id, CASE WHEN month(report_date) = 4 AND account_id = '110' THEN '''=' || account_name ELSE account_name END AS account_name, account_code FROM tb WHERE tenant || report_date NOT IN (FROM bad)""")
def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts as `Name (code)`; February's reports lack an id, March's repeat one."""
    m = F.month("report_date")
    account_id = F.when((m == 2) & (F.col("account_id") == "820"), "").when((m == 3) & (F.col("account_id") == "820"), " 110 ").otherwise(F.col("account_id"))
    name = F.concat(F.when((m == 4) & (F.col("account_id") == "110"), "=").otherwise(""), F.col("account_name"), F.lit(" ("), "account_code", F.lit(")"))
    rows = tb(spark, sf_dir).withColumns({"account": name, "file": F.concat("tenant", "report_date")}).withColumn("account_id", account_id)
    return checks.canonical_rows(rows)[0].select("tenant", "report_date", "account_id", "account_name", "account_code")


@query(f"""WITH {WINDOW_SQL}, s AS (SELECT tenant, account_id, report_date, sum(amount) AS total, count(*) AS n FROM w GROUP BY ALL) SELECT v.tenant, v.account_id, v.report_date, coalesce(difference = total AND n <= 5, false) AS explained FROM v LEFT JOIN s USING (tenant, account_id, report_date)""")
def finding_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence holds the five largest transactions."""
    v, w = _variances(spark, sf_dir), _window(spark, sf_dir)
    k = ["tenant", "account_id", "report_date"]
    top = drivers.top_drivers(w).groupBy(*k).agg(F.count("*").alias("drivers"))
    totals = drivers.driver_totals(v, w).join(top, k, "left")
    ids = v.select(*k, F.concat_ws("|", *k).alias("query_id"))
    return checks.finding_evidence(v, ids, totals).select(*k, "explained")


@query(f"""WITH {LEDGER_SQL}, t AS (SELECT DISTINCT tenant, journal_id, CAST(credit AS BIGINT) AS amount, l_suppkey AS s FROM ledger WHERE line_number = 2) SELECT tenant, journal_id, amount + 1 AS amount, 'NOT_IN_SOURCE' AS issue FROM t WHERE s % 20 = 0 UNION ALL SELECT tenant, journal_id, amount, 'NOT_IN_EVIDENCE' FROM t WHERE s % 20 = 0 OR s % 21 = 0""")
def evidence_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some evidence amounts are a cent out, some rows are missing."""
    t = ledger(spark, sf_dir).where("line_number = 2").select("tenant", "journal_id", in_cents("credit").alias("amount"), "l_suppkey").distinct()
    t = staged(t, "source-rows")  # read by both sides
    e = t.where("l_suppkey % 21 <> 0 or l_suppkey % 20 = 0").withColumn("amount", F.col("amount") + F.when(F.col("l_suppkey") % 20 == 0, 1).otherwise(0))
    return checks.evidence_population(e.drop("l_suppkey"), t.drop("l_suppkey"), ["tenant", "journal_id", "amount"])


@query("""WITH m AS (SELECT CAST(o_orderkey AS VARCHAR) AS file, o_orderkey AS n FROM orders) SELECT file, 'ENTITY' AS issue FROM m WHERE n % 10 = 1 UNION ALL SELECT file, 'CUT_OFF' FROM m WHERE n % 10 = 2 UNION ALL SELECT file, 'DIGEST' FROM m WHERE n % 10 = 3 UNION ALL SELECT file, 'FOOTER' FROM m WHERE n % 10 = 4 UNION ALL SELECT file, 'MISSING_FILE' FROM m WHERE n % 10 = 5""")
def aged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a report's manifest."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    row = lambda k: [n.cast("string").alias("file"), F.concat("o_orderstatus", F.when(k == 1, "!").otherwise("")).alias("entity"), F.date_add(F.to_date("o_orderdate"), F.when(k == 2, 1).otherwise(0)).alias("as_at"), F.lit("accrual").alias("basis"), F.sha2(F.concat(n.cast("string"), F.when(k == 3, "x").otherwise("")), 256).alias("sha256"), (n % 7 + F.when(k == 4, 1).otherwise(0)).alias("footer_record")]
    return checks.aged_metadata(o.where(n % 10 != 5).select(*row(n % 10)), o.select(*row(F.lit(0))))


@query("""WITH e AS (SELECT DISTINCT event_type AS file, CAST(user_id AS INTEGER) AS r, event_id % 3 AS k FROM events) SELECT DISTINCT file, CASE WHEN k = 2 THEN NULL ELSE r END AS record, CASE k WHEN 0 THEN 'Invoice or receipt' WHEN 1 THEN 'Report with its footer' ELSE 'Control account reconciliation' END AS request FROM e""")
def evidence_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as exception texts."""
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit("row of record "), "user_id")).when(k == 1, F.concat(F.lit("footer differs, record "), "user_id")).otherwise("control balance differs")
    return checks.evidence_requests(table(spark, sf_dir, "events").select(F.col("event_type").alias("file"), text.alias("text")))


@query("""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS file, p_partkey AS n FROM part) SELECT file, 'REPORT_TYPE' AS issue FROM p WHERE n % 11 = 0 UNION ALL SELECT file, 'TITLES' FROM p WHERE n % 7 = 0 UNION ALL SELECT file, 'DATE' FROM p WHERE n % 7 <> 0 AND n % 5 = 0 UNION ALL SELECT file, 'COLUMNS' FROM p WHERE n % 3 = 0""")
def report_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as reports."""
    n = F.col("p_partkey")
    cols = F.array(*[F.lit(c) for c in ("Account", "Debit", "Credit", "YTD Debit", "YTD Credit")])
    titles = F.array(F.lit("Trial Balance"), F.when(n % 7 == 0, "Demo").when(n % 5 == 0, "As at 31 June 2026").otherwise("As at 30 June 2026"))
    r = table(spark, sf_dir, "part").select(n.cast("string").alias("file"), F.when(n % 11 == 0, "Aged").otherwise("TrialBalance").alias("type"), titles.alias("titles"), F.when(n % 3 == 0, F.slice(cols, 1, 4)).otherwise(cols).alias("columns"))
    return checks.report_identity(r, "2026-06-30")


@query("""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS code, p_partkey AS n FROM part) SELECT code AS account_code, 'UNKNOWN_CLASS' AS issue FROM p WHERE n % 4 = 3 UNION ALL SELECT code, 'SECTION' FROM p WHERE n % 4 <> 3 AND n % 9 = 0 UNION ALL SELECT code, 'NORMAL_BALANCE' FROM p WHERE n % 4 <> 3 AND n % 13 = 0 UNION ALL SELECT code, 'NO_SUB_CLASS' FROM p WHERE n % 17 = 0""")
def chart_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as accounts."""
    n = F.col("p_partkey")
    cls = F.when(n % 4 == 0, "Assets").when(n % 4 == 1, "Revenue").when(n % 4 == 2, "Expenses").otherwise("Other")
    sheet, debit = (n % 4 == 0) != (n % 9 == 0), F.when(n % 4 == 1, n % 13 == 0).otherwise(n % 13 != 0)
    a = table(spark, sf_dir, "part").select(n.cast("string").alias("account_code"), cls.alias("class"), F.when(n % 17 == 0, "").otherwise("x").alias("sub_class"), F.when(sheet, "Balance Sheet").otherwise("Profit and Loss").alias("report_section"), F.when(debit, "debit").otherwise("credit").alias("normal_balance"))
    return checks.chart_issues(a)
