"""Queries of workpaper readiness, ledger-gate variance and run differences. A pack is a tenant's month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import AMOUNT, money_text
from ..operators import close, diffs, gate, variance
from ..operators.policies import everywhere
from ..sources.staging import staged
from .close_queries import FOUND_SQL, found
from .derive import LEDGER_SQL, PAIRS_SQL, TB_SQL, _values, chart, in_cents, ledger, policy, table, tb

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def _pack(date: str):
    return F.concat_ws(":", "tenant", F.date_format(date, "yyyy-MM"))


def pack_tb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close.net(tb(spark, sf_dir)).select(_pack("report_date").alias("pack"), "tenant", "report_date", "account_id", F.col("ytd_net").alias("net"), F.col("current_net").alias("moved"))


PACK_SQL = f"{TB_SQL}, ptb AS (SELECT tenant || ':' || strftime(month, '%Y-%m') AS pack, tenant, month, report_date, account_id, ytd AS net, net AS moved FROM tb), packs AS (SELECT DISTINCT pack, tenant, month, report_date, CASE WHEN month(month) = 6 THEN 'year_end' WHEN month(month) % 3 = 0 THEN 'bas' ELSE 'month_end' END AS profile FROM ptb)"


def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.month("report_date")
    return pack_tb(spark, sf_dir).select("pack", "tenant", "report_date").distinct().withColumn("profile", F.when(m == 6, "year_end").when(m % 3 == 0, "bas").otherwise("month_end"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot has a source; bank reconciliations are empty in February, open items missing in May."""
    slots = policy(spark, [(s,) for s in sorted({s for _, s, _ in gate.PROFILES})], "slot string")
    p = packs(spark, sf_dir).crossJoin(F.broadcast(slots))  # a declared list
    m = F.month("report_date")
    return p.where(~((m == 5) & (F.col("slot") == "open_items"))).select("pack", "slot", F.when((m == 2) & (F.col("slot") == "bank_rec"), 0).otherwise(10).alias("size"))


@query(f"""WITH {PACK_SQL}, need AS (SELECT * FROM {_values([(a, b) for a, b, r in gate.PROFILES if r])} t(profile, slot)) SELECT pack, CASE WHEN slot = 'bank_rec' THEN 'EMPTY_ARTEFACT' ELSE 'MISSING_ARTEFACT' END AS code, slot
  FROM packs JOIN need USING (profile) WHERE month(month) = 2 AND slot = 'bank_rec' OR month(month) = 5 AND slot = 'open_items'""")
def missing_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J19, S22."""
    slots = policy(spark, gate.PROFILES, "profile string, slot string, required boolean")
    return gate.missing_artefacts(packs(spark, sf_dir), slots, _sources(spark, sf_dir)).select("pack", "code", "slot")


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).where("account_id = '820'").select(_pack("posting_date").alias("pack"), F.col("journal_id").alias("posting_id"), F.col("posting_date").alias("date"), "account_id", "debit", "credit", (F.col("debit") - F.col("credit")).alias("net"), "l_suppkey")


POST_SQL = "post AS (SELECT tenant || ':' || strftime(posting_date, '%Y-%m') AS pack, journal_id AS posting_id, posting_date AS date, account_id, debit, credit, debit - credit AS net, l_suppkey FROM ledger WHERE account_id = '820')"


@query(f"""WITH {PACK_SQL}, {POST_SQL}, d AS (SELECT pack, count(*) AS n, sum(credit - debit) AS m FROM post GROUP BY pack), s AS (SELECT pack, m // 100 * 100 + CASE WHEN n % 5 = 0 THEN 300 ELSE 0 END - m AS d FROM d) SELECT pack, 'TIEOUT_BREAK' AS code, 'differs by ' || CAST(CAST(d / 100 AS DECIMAL(18,2)) AS VARCHAR) AS reason FROM s WHERE abs(d) > 99""")
def activity_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-dollar statements; every fifth is 3.00 out."""
    p = _postings(spark, sf_dir)
    d = p.groupBy("pack").agg(F.count("*").alias("n"), F.floor(F.sum(F.col("credit") - F.col("debit"))).alias("m"))
    s = d.select("pack", F.lit("1A").alias("label"), (F.col("m") + F.when(F.col("n") % 5 == 0, 3).otherwise(0)).cast(AMOUNT).alias("amount"))
    s = s.unionByName(d.select("pack", F.lit("1B").alias("label"), F.lit(0).cast(AMOUNT).alias("amount")))
    return gate.activity_statement(s, p).select("pack", "code", "reason")


@query(f"""WITH {PACK_SQL}, {POST_SQL}, m AS (SELECT pack, sum(credit - debit) AS movement FROM post GROUP BY pack), c AS (SELECT pack, -net AS closing, moved FROM ptb WHERE account_id = '820' AND month(month) <> 4)
  SELECT pack, CAST(closing + moved + CASE WHEN movement % 7 = 0 THEN 100 ELSE 0 END AS BIGINT) AS opening, CAST(movement AS BIGINT) AS movement, CAST(closing AS BIGINT) AS closing, CAST(CASE WHEN movement % 7 = 0 THEN 100 ELSE 0 END AS BIGINT) AS difference FROM c JOIN m USING (pack) WHERE movement % 7 = 0""")
def gst_roll_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings are out where the movement's cents divide by seven; April's trial balances lack the account."""
    t, p = pack_tb(spark, sf_dir).where("not (account_id = '820' and month(report_date) = 4)"), _postings(spark, sf_dir)
    m = p.groupBy("pack").agg(in_cents(F.sum(F.col("credit") - F.col("debit"))).alias("c"))
    o = t.where("account_id = '820'").join(m, "pack").select("pack", (F.col("moved") - F.col("net") + F.when(F.col("c") % 7 == 0, 1).otherwise(0)).alias("opening"))
    return gate.gst_roll_forward(o, p, t).select("pack", *[in_cents(c).alias(c) for c in ("opening", "movement", "closing", "difference")])


@query(f"WITH {PACK_SQL}, {POST_SQL} SELECT DISTINCT pack, account_id FROM post WHERE substr(pack, length(pack) - 1) = '04'")
def control_accounts_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15."""
    return gate.control_accounts_missing(_postings(spark, sf_dir), pack_tb(spark, sf_dir).where("not (account_id = '820' and month(report_date) = 4)"))


@query(f"""WITH {PACK_SQL}, {POST_SQL}, b AS (SELECT pack, max(credit) * CASE WHEN count(*) % 3 = 0 THEN 1 WHEN count(*) % 3 = 1 THEN 2 ELSE 9 END AS d FROM post WHERE credit > 0 GROUP BY pack),
  h AS (SELECT b.pack, d, rank, posting_id FROM b JOIN post ON b.pack = post.pack JOIN (VALUES (1), (2)) r(rank) ON post.net * rank = -d), f AS (SELECT pack, rank, posting_id FROM h QUALIFY row_number() OVER (PARTITION BY pack ORDER BY rank, posting_id) = 1)
  SELECT b.pack, CAST(d AS BIGINT) AS difference, CASE WHEN rank = 1 THEN 'SAME_SIZE' WHEN rank = 2 THEN 'DOUBLE' WHEN d % 9 = 0 THEN 'TRANSPOSED' END AS hint, posting_id FROM b LEFT JOIN f USING (pack)""")
def difference_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A break is the month's largest posting, twice it, or nine times it."""
    p = _postings(spark, sf_dir)
    n = F.count("*") % 3
    b = p.where("credit > 0").groupBy("pack").agg((F.max("credit") * F.when(n == 0, 1).when(n == 1, 2).otherwise(9)).cast("decimal(18,2)").alias("difference"))
    return gate.difference_hints(b, p).select("pack", in_cents("difference").alias("difference"), "hint", "posting_id")


def _banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = in_cents("net")
    t = pack_tb(spark, sf_dir).where("account_id = '110'")
    cent = F.lit("0.01").cast("decimal(3,2)")
    return t.select("pack", F.when(c % 11 == 0, "999").otherwise(F.col("account_id")).alias("account_id"), (F.col("net") + F.when(c % 3 == 0, cent).otherwise(0)).alias("statement_balance"), (F.col("net") + F.when(c % 5 == 0, cent).otherwise(0)).alias("gl_balance"))


@query(f"""WITH {PACK_SQL}, b AS (SELECT pack, net AS c FROM ptb WHERE account_id = '110') SELECT pack, CASE WHEN c % 11 = 0 THEN 'BANK_ACCOUNT_ABSENT' ELSE 'BANK_TB_DIFFERENCE' END AS code FROM b WHERE c % 11 = 0 OR c % 5 = 0
  UNION ALL SELECT pack, 'BANK_STATEMENT_DIFFERENCE' FROM b WHERE (c % 3 = 0) <> (c % 5 = 0)""")
def bank_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16, A15."""
    return gate.bank_reconciliation(_banks(spark, sf_dir), pack_tb(spark, sf_dir)).select("pack", "code")


LINES = [("Receivables", "110", "debit"), ("Sales", "600-A", "credit"), ("Sales", "600-N", "credit"), ("Other", "777", "debit")]
AMOUNTS = [("Receivables", "TIED", "W1"), ("Sales", "TIED", ""), ("Other", "EXCEPTION", "W2"), ("Reserve", "TIED", "W3")]


def _matrix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = packs(spark, sf_dir).where("profile = 'year_end'").select("pack")
    t = pack_tb(spark, sf_dir).where("account_id = '110'").select("pack", "net")
    m = p.crossJoin(F.broadcast(policy(spark, AMOUNTS, "statement_line string, status string, workpaper_ref string"))).join(t, "pack").withColumns({"statement_amount": F.col("net"), "source_file": F.lit("tb.csv")})
    return m, p.crossJoin(F.broadcast(policy(spark, LINES, "statement_line string, account_id string, normal_balance string")))


@query(f"WITH {PACK_SQL} SELECT pack, code, reason FROM packs CROSS JOIN (VALUES ('TIEOUT_UNSUPPORTED', 'Sales'), ('TIEOUT_BREAK', 'Other')) t(code, reason) WHERE profile = 'year_end'")
def tie_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    return gate.tie_out(_matrix(spark, sf_dir)[0]).select("pack", "code", "reason")


@query(f"""WITH {PACK_SQL}, y AS (SELECT pack FROM packs WHERE profile = 'year_end'), n AS (SELECT pack, sum(CASE WHEN account_id = '110' THEN net END) AS r, -sum(CASE WHEN account_id IN ('600-A', '600-N') THEN net END) AS s FROM ptb GROUP BY pack)
  SELECT pack, l AS statement_line, CAST(CASE l WHEN 'Receivables' THEN r WHEN 'Sales' THEN s END AS BIGINT) AS computed, CASE l WHEN 'Receivables' THEN 'EQUAL' WHEN 'Sales' THEN CASE WHEN s = r THEN 'EQUAL' ELSE 'DIFFERENT' END WHEN 'Other' THEN 'UNKNOWN_ACCOUNT' ELSE 'UNMAPPED_LINE' END AS state FROM y JOIN n USING (pack) CROSS JOIN (VALUES ('Receivables'), ('Sales'), ('Other'), ('Reserve')) t(l)""")
def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line claims the receivables' amount."""
    m, lines = _matrix(spark, sf_dir)
    return gate.statement_lines(m, lines, pack_tb(spark, sf_dir)).select("pack", "statement_line", in_cents("computed").alias("computed"), "state")


@query(f"WITH {PACK_SQL} SELECT pack, account_id FROM ptb JOIN packs USING (pack) WHERE profile = 'year_end' AND net <> 0 AND account_id IN ('600-R', '820')")
def unmapped_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17, the other way."""
    _, lines = _matrix(spark, sf_dir)
    t = pack_tb(spark, sf_dir).join(packs(spark, sf_dir).where("profile = 'year_end'").select("pack"), "pack", "left_semi")
    return gate.unmapped_accounts(lines, t).select("pack", "account_id")


@query("""SELECT o_orderpriority AS pack, CASE WHEN o_orderstatus = 'O' THEN 'OPEN_ITEM_BLOCKING' ELSE 'OPEN_ITEM_INCOMPLETE' END AS code, CAST(o_orderkey AS VARCHAR) AS reason FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 9 = 0 OR o_orderstatus <> 'O' AND o_orderkey % 3 = 0""")
def open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are items, their priority the pack."""
    n = F.col("o_orderkey")
    i = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("pack"), n.cast("string").alias("item_id"), F.when(n % 9 == 0, "BLOCKING").otherwise("TRIVIAL").alias("severity"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLEARED").alias("status"), F.when(n % 3 == 0, "").otherwise("done").alias("resolution"))
    return gate.open_items(i).select("pack", "code", "reason")


@query("""WITH c AS (SELECT 'P' || c_custkey AS pack, c_custkey AS n FROM customer) SELECT pack, 'SELF_REVIEW_INCOMPLETE' AS code, CASE WHEN n % 6 = 0 THEN 'evidence, totals' WHEN n % 2 = 0 THEN 'totals' ELSE 'evidence' END AS reason FROM c WHERE n % 2 = 0 OR n % 3 = 0
  UNION ALL SELECT pack, 'REVIEWER_IS_PREPARER', 'reviewer_is_preparer' FROM c WHERE n % 5 = 0 UNION ALL SELECT pack, 'REVIEWED_EARLY', 'reviewed_early' FROM c WHERE n % 7 = 0""")
def self_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review per customer."""
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey")
    r = c.select(F.concat(F.lit("P"), n.cast("string")).alias("pack"), F.lit("AB").alias("preparer"), F.when(n % 5 == 0, " ab ").otherwise("CD").alias("reviewer"), F.when(n % 7 == 0, F.lit("2026-06-29")).otherwise("2026-07-02").cast("date").alias("prepared_on"), F.lit("2026-06-30").cast("date").alias("period_end"), F.create_map(F.lit("totals"), n % 2 != 0, F.lit("evidence"), n % 3 != 0).alias("assertions"))
    return gate.self_review(r).select("pack", "code", "reason")


@query(f"""WITH {PACK_SQL}, {POST_SQL}, p AS (SELECT pack, tenant, month, report_date, min(date) AS a, max(date) AS b FROM packs JOIN post USING (pack) GROUP BY ALL)
  SELECT pack, 'PERIOD_ORDER' AS code FROM p WHERE month(month) = 1 UNION ALL SELECT pack, 'PERIOD_BINDING' FROM p WHERE day(report_date) = 30 UNION ALL SELECT pack, 'POSTING_OUTSIDE_PERIOD' FROM p WHERE a < month + 1 OR b > (CASE WHEN day(report_date) = 30 THEN report_date - 1 ELSE report_date END)""")
def period_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """January's prior date is its own; 30-day months declare the 29th; periods start on the 2nd."""
    s = _postings(spark, sf_dir).groupBy("pack").agg(F.min("date").alias("first_posting"), F.max("date").alias("last_posting"))
    d = F.col("report_date")
    p = packs(spark, sf_dir).join(s, "pack").select("pack", d.alias("tb_date"), F.when(F.month(d) == 1, d).otherwise(F.add_months(d, -1)).alias("prior_date"), F.date_add(F.trunc(d, "month"), 1).alias("period_start"), F.when(F.dayofmonth(d) == 30, F.date_sub(d, 1)).otherwise(d).alias("period_end"), "first_posting", "last_posting")
    return gate.period_order(p).select("pack", "code")


@query(f"""WITH {PACK_SQL}, f AS (SELECT pack, month, slot FROM packs JOIN {_values([(a, b) for a, b, r in gate.PROFILES if r])} t(profile, slot) USING (profile) WHERE month(month) = 2 AND slot = 'bank_rec' OR month(month) = 5 AND slot = 'open_items')
  SELECT pack, slot, year(month) % 2 = 0 AND slot = 'bank_rec' AS repeat FROM f""")
def repeat_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even years' empty reconciliations were open before; their other findings were closed."""
    slots = policy(spark, gate.PROFILES, "profile string, slot string, required boolean")
    f = gate.missing_artefacts(packs(spark, sf_dir), slots, _sources(spark, sf_dir))
    even = F.substring(F.col("pack"), -7, 4).cast("int") % 2 == 0
    prior = f.where(even).select("pack", "code", "slot", F.when(F.col("slot") == "bank_rec", "OPEN").otherwise("CLOSED").alias("status"))
    return gate.mark_repeats(f, prior).select("pack", "slot", "repeat")


@query(f"""WITH {PACK_SQL}, f AS (SELECT DISTINCT pack FROM packs JOIN {_values([(a, b) for a, b, r in gate.PROFILES if r])} t(profile, slot) USING (profile) WHERE month(month) = 2 AND slot = 'bank_rec' OR month(month) = 5 AND slot = 'open_items') SELECT pack, CASE WHEN pack IN (SELECT pack FROM f) THEN 'BLOCKED' ELSE 'READY' END AS status FROM packs""")
def pack_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 for packs."""
    slots = policy(spark, gate.PROFILES, "profile string, slot string, required boolean")
    p = packs(spark, sf_dir)
    return gate.pack_status(p, gate.missing_artefacts(p, slots, _sources(spark, sf_dir)))


LABELS = ("Invoice", "Total", "Date")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn as a two-page document with labelled lines."""
    c = table(spark, sf_dir, "conversations")
    twice = F.when(F.col("turn") % 2 == 0, F.lit("\nTotal: 9")).otherwise("")
    return c.select(F.concat_ws(".", "conv_id", "turn").alias("doc_id"), F.concat(F.lit("# Invoice: "), "role", F.lit("\nTotal: "), F.col("turn").cast("string"), twice, F.lit("\fno label: x\n## Date: 2026\n"), F.regexp_replace("text", "[\f\n]", " ")).alias("text"))


OBS_SQL = "o AS (SELECT conv_id || '.' || turn AS doc_id, role, turn FROM conversations)"


@query(f"""WITH {OBS_SQL} SELECT doc_id, 'Invoice' AS field, 1 AS page, 1 AS line, role AS value FROM o UNION ALL SELECT doc_id, 'Total', 1, 2, CAST(turn AS VARCHAR) FROM o UNION ALL SELECT doc_id, 'Total', 1, 3, '9' FROM o WHERE turn % 2 = 0 UNION ALL SELECT doc_id, 'Date', 2, 2, '2026' FROM o""")
def field_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10, S34."""
    return gate.observations(_texts(spark, sf_dir), LABELS)


@query(f"WITH {OBS_SQL} SELECT doc_id, 'Invoice' AS field, role AS value FROM o UNION ALL SELECT doc_id, 'Total', CAST(turn AS VARCHAR) FROM o WHERE turn % 2 <> 0 UNION ALL SELECT doc_id, 'Date', '2026' FROM o")
def prefilled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11."""
    return gate.prefill(gate.observations(_texts(spark, sf_dir), LABELS))


@query("""WITH d AS (SELECT source AS pack, doc_id, n_chars AS n, sha256(text) AS h, lang FROM documents) SELECT pack, doc_id, 'CONTEXT_MISMATCH' AS code FROM d WHERE lang <> 'en' UNION ALL SELECT pack, doc_id, 'REVIEW_REQUIRED' FROM d WHERE n % 4 = 0 UNION ALL SELECT pack, doc_id, 'DUPLICATE_BYTES' FROM d QUALIFY row_number() OVER (PARTITION BY pack, h ORDER BY doc_id) > 1
  UNION ALL SELECT pack, doc_id, 'GST_SIGN' FROM d WHERE n % 6 = 0 AND n <> 0 UNION ALL SELECT pack, doc_id, 'GST_SIZE' FROM d WHERE n % 5 = 0 AND n <> 0""")
def document_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source; amounts from their length."""
    d, n = table(spark, sf_dir, "documents"), F.col("n_chars").cast("decimal(18,2)")
    tax = (n / F.when(F.col("n_chars") % 5 == 0, 10).otherwise(12)).cast("decimal(18,6)") * F.when(F.col("n_chars") % 6 == 0, -1).otherwise(1)
    return gate.document_controls(d.select(F.col("source").alias("pack"), "doc_id", F.sha2("text", 256).alias("sha256"), F.col("lang").alias("entity"), F.lit("en").alias("pack_entity"), (F.col("n_chars") % 4 != 0).alias("reviewed"), n.alias("amount"), tax.alias("gst")))


POLICY = [("Revenue", "1000", "15"), ("Assets", "50000", "20")]


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = staged(tb(spark, sf_dir), "trial-balances")
    limits = policy(spark, POLICY, "section string, a string, b string").select("section", F.col("a").cast(AMOUNT).alias("minimum_absolute"), F.col("b").cast("decimal(6,2)").alias("minimum_percent"))
    return variance.variance_findings(t, everywhere(limits, t))


VF_SQL = f"{PAIRS_SQL}, vf AS (SELECT tenant, report_date, section, account_id, cur, pri, cur - pri AS delta FROM pairs JOIN (VALUES ('Revenue', 100000, 15), ('Assets', 5000000, 20)) p(section, a, b) USING (section) WHERE abs(cur - pri) >= a AND (pri = 0 OR 100 * abs(cur - pri) >= abs(pri) * b) AND cur <> pri)"


@query(f"WITH {VF_SQL} SELECT tenant, report_date, account_id, cur AS current, pri AS prior, delta FROM vf")
def variance_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20."""
    return _findings(spark, sf_dir).select("tenant", "report_date", "account_id", *[in_cents(c).alias(c) for c in ("current", "prior", "delta")])


@query(f"WITH {VF_SQL} SELECT tenant, report_date, account_id, count(*) OVER (PARTITION BY tenant, report_date) AS total, count(*) OVER (PARTITION BY tenant, report_date) > 2 AS truncated FROM vf QUALIFY row_number() OVER (PARTITION BY tenant, report_date ORDER BY section, account_id) <= 2")
def truncated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W02."""
    return variance.truncate(_findings(spark, sf_dir), 2).select("tenant", "report_date", "account_id", "total", "truncated")


@query(f"WITH {PAIRS_SQL} SELECT tenant, report_date, account_id, CASE WHEN month(report_date) = 3 THEN 'Liabilities' ELSE 'Equity' END AS was, CASE WHEN month(report_date) = 3 THEN 'Equity' ELSE 'Liabilities' END AS now FROM pairs WHERE account_id = '820' AND month(report_date) IN (3, 4)")
def section_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account is moved each March."""
    move = (F.col("account_id") == "820") & (F.month("report_date") == 3)
    return variance.section_drift(tb(spark, sf_dir).withColumn("section", F.when(move, "Equity").otherwise(F.col("section"))), "Equity")


REF_SQL = f"{VF_SQL}, m AS (SELECT *, CASE WHEN cur < 0 THEN '-' ELSE '' END || (abs(cur) // 100) || '.' || lpad(CAST(abs(cur) % 100 AS VARCHAR), 2, '0') AS ct, CASE WHEN pri < 0 THEN '-' ELSE '' END || (abs(pri) // 100) || '.' || lpad(CAST(abs(pri) % 100 AS VARCHAR), 2, '0') AS pt FROM vf), q AS (SELECT *, CASE WHEN cur < pri THEN '-' ELSE '' END || (abs(cur - pri) // 100) || '.' || lpad(CAST(abs(cur - pri) % 100 AS VARCHAR), 2, '0') AS dt, 'acct:' || substr(sha256(tenant || ':' || account_id), 1, 24) AS account_ref FROM m), r AS (SELECT tenant, report_date, account_id, account_ref, 'finding:' || substr(sha256(account_ref || ':' || dt || ':' || CAST(report_date AS VARCHAR)), 1, 24) AS finding_id FROM q)"


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variance.references(_findings(spark, sf_dir))


@query(f"WITH {REF_SQL} SELECT account_ref, finding_id, 'evidence:' || substr(sha256(finding_id || ':reviewer-evidence'), 1, 24) AS evidence_ref FROM r")
def hashed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R06, V23."""
    return _refs(spark, sf_dir).select("account_ref", "finding_id", "evidence_ref")


@query(f"""WITH {TB_SQL}, t AS (SELECT tenant, report_date, CAST(CAST(sum(greatest(ytd, 0)) AS BIGINT) AS VARCHAR) AS total FROM tb GROUP BY ALL)
  SELECT tenant, report_date, 'sha256:' || sha256('{{' || {" || ',' || ".join(f"""'"{d}":"' || sha256('{d}:' || tenant || ':' || CAST(report_date AS VARCHAR) || ':' || total) || '"'""" for d in variance.RUN_DIGESTS)} || '}}') AS run_id FROM t""")
def run_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per tenant and period, over seven digests that its balances decide."""
    t = tb(spark, sf_dir).groupBy("tenant", "report_date").agg(in_cents(F.sum("ytd_debit")).cast("string").alias("total"))
    t = t.select("tenant", "report_date", *[F.sha2(F.concat_ws(":", F.lit(d), "tenant", F.col("report_date").cast("string"), "total"), 256).alias(d) for d in variance.RUN_DIGESTS])
    return t.select("tenant", "report_date", variance.run_id().alias("run_id"))


@query(f"WITH {REF_SQL} SELECT tenant, report_date, count(*) AS total, count(*) FILTER (finding_id < 'finding:8') AS decided, count(*) FILTER (finding_id >= 'finding:8') AS undecided FROM r GROUP BY ALL")
def decision_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the findings are decided."""
    r = _refs(spark, sf_dir)
    return variance.decision_coverage(r, r.where("finding_id < 'finding:8'").select("finding_id"))


@query(f"WITH {REF_SQL} SELECT finding_id, 'DECIDED_TWICE' AS issue FROM r WHERE finding_id < 'finding:2' UNION ALL SELECT 'x' || finding_id, 'UNKNOWN_FINDING' FROM r WHERE finding_id > 'finding:e'")
def decision_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J31."""
    r = _refs(spark, sf_dir).select("finding_id")
    return variance.decision_issues(r, r.unionByName(r.where("finding_id < 'finding:2'")).unionByName(r.where("finding_id > 'finding:e'").select(F.concat(F.lit("x"), "finding_id").alias("finding_id"))))


@query(f"""WITH {REF_SQL} SELECT DISTINCT 'label' AS column, CASE account_id WHEN '110' THEN account_id WHEN '600-A' THEN account_name WHEN '600-N' THEN account_code ELSE tenant END AS value FROM r JOIN chart USING (account_id)""")
def redaction_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outgoing rows with an identity left in a text column: an account's id, name or code, or the tenant."""
    r = _refs(spark, sf_dir).join(F.broadcast(chart(spark).select("account_id", "account_name", "account_code")), "account_id")  # a declared list
    a = F.col("account_id")
    r = r.withColumn("label", F.when(a == "110", a).when(a == "600-A", F.col("account_name")).when(a == "600-N", F.col("account_code")).otherwise(F.col("tenant")))
    bad = r.select(F.explode(F.array("tenant", "account_id", "account_name", "account_code")).alias("value"))
    return variance.redaction_leaks(r, bad, ["account_ref", "finding_id", "label"])


@query(f"WITH {REF_SQL} SELECT tenant, report_date, account_id FROM r WHERE account_id IN ('110', '600-A') OR account_id = '600-N' AND month(report_date) = 3")
def numeric_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outgoing numbers that aren't plain decimal text: with a comma, an exponent or a sign of dollars."""
    a, text = F.col("account_id"), money_text("delta")
    odd = F.when(a == "110", F.concat(text, F.lit(",5"))).when(a == "600-A", F.concat(text, F.lit("E2"))).when((a == "600-N") & (F.month("report_date") == 3), F.concat(F.lit("$"), text)).otherwise(text)
    return variance.numeric_shape(_refs(spark, sf_dir).withColumn("shown", odd), "shown").select("tenant", "report_date", "account_id")


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The exceptions of each period against those of the tenant's next period, as two runs."""
    f = found(spark, sf_dir).where("account_id is not null").select("control", "tenant", "account_id", "reason", F.date_format("report_date", "yyyy-MM").alias("run"), "report_date")
    return f.select("control", "tenant", "account_id", "reason", F.date_format(F.add_months("report_date", 1), "yyyy-MM").alias("run")), f.drop("report_date")


@query(f"""WITH {FOUND_SQL}, f AS (SELECT control, tenant, account_id, string_agg(reason, '|' ORDER BY reason) AS r, strftime(report_date, '%Y-%m') AS run, strftime(date_trunc('month', report_date) + INTERVAL 1 MONTH, '%Y-%m') AS next FROM found WHERE account_id IS NOT NULL GROUP BY control, tenant, account_id, report_date)
  SELECT coalesce(a.control, b.control) AS control, coalesce(a.tenant, b.tenant) AS tenant, coalesce(a.account_id, b.account_id) AS account_id, coalesce(a.next, b.run) AS run, CASE WHEN substr(coalesce(a.next, b.run), 6) = '07' THEN 'NOT_COMPARABLE' WHEN a.r IS NULL THEN 'NEW' WHEN b.r IS NULL THEN 'NOT_RAISED' WHEN a.r = b.r THEN 'RECURRING' ELSE 'CHANGED' END AS state
  FROM f a FULL JOIN f b ON a.control = b.control AND a.tenant = b.tenant AND a.account_id = b.account_id AND a.next = b.run""")
def exception_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs are not comparable over a financial year's start."""
    a, b = _two_runs(spark, sf_dir)
    return diffs.exception_changes(a, b, ["control", "tenant", "account_id", "run"], ["reason"], F.substring("run", 6, 2) != "07")


@query("""WITH d AS (SELECT source AS pack, CAST(doc_id // 20 AS VARCHAR) AS slot, doc_id AS n, text FROM documents WHERE doc_id % 20 = 0), a AS (SELECT pack, slot, sha256(text) AS h FROM d WHERE n % 60 <> 0), b AS (SELECT pack, slot, sha256(text || CASE WHEN n % 80 = 0 THEN 'x' ELSE '' END) AS h FROM d WHERE n % 140 <> 0)
  SELECT coalesce(a.pack, b.pack) AS pack, coalesce(a.slot, b.slot) AS slot, CASE WHEN a.h IS NULL THEN 'ADDED' WHEN b.h IS NULL THEN 'REMOVED' WHEN a.h = b.h THEN 'UNCHANGED' ELSE 'CHANGED' END AS state FROM a FULL JOIN b ON a.pack = b.pack AND a.slot = b.slot""".replace("doc_id // 20", "doc_id").replace("WHERE doc_id % 20 = 0", "").replace("n % 60", "n % 3").replace("n % 80", "n % 4").replace("n % 140", "n % 7"))
def source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a slot; some are added, some removed, some changed."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    row = lambda text: [F.col("source").alias("pack"), n.cast("string").alias("slot"), F.sha2(text, 256).alias("sha256")]
    return diffs.source_changes(d.where(n % 3 != 0).select(*row(F.col("text"))), d.where(n % 7 != 0).select(*row(F.concat("text", F.when(n % 4 == 0, "x").otherwise("")))))


@query("""WITH a AS (SELECT source AS pack, sha256(text) AS h, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY ALL), b AS (SELECT source AS pack, sha256(text) AS h, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY ALL)
  SELECT coalesce(a.pack, b.pack) AS pack, coalesce(a.h, b.h) AS sha256, CASE WHEN coalesce(b.n, 0) > coalesce(a.n, 0) THEN 'AFTER' ELSE 'BEFORE' END AS side, abs(coalesce(b.n, 0) - coalesce(a.n, 0)) AS n FROM a FULL JOIN b ON a.pack = b.pack AND a.h = b.h WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def unmatched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J36, U04."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("pack"), F.sha2("text", 256).alias("sha256"))
    return diffs.unmatched_documents(d.where("doc_id % 3 <> 0"), d.where("doc_id % 5 <> 0"))


@query(f"""WITH {TB_SQL}, s AS (SELECT tenant, month, report_date, string_agg(account_id, ',' ORDER BY account_id) FILTER (net <> 0) AS accounts FROM tb GROUP BY ALL), j AS (SELECT b.tenant, b.month, a.accounts IS DISTINCT FROM b.accounts AS x, month(b.month) = 7 AS fy, month(b.month) = 3 OR month(b.month) = 4 AS t, month(b.month) = 10 AS g FROM s a JOIN s b ON a.tenant = b.tenant AND a.month + INTERVAL 1 MONTH = b.month)
  SELECT tenant || ':' || strftime(month, '%Y-%m') AS tenant, concat_ws(', ', CASE WHEN t THEN 'threshold' END, CASE WHEN x THEN 'accounts' END, CASE WHEN g THEN 'period gap' END, CASE WHEN fy THEN 'financial year' END) AS changes FROM j""")
def scope_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month against the next; March has another threshold, October starts late."""
    t = close.net(tb(spark, sf_dir))
    s = t.groupBy("tenant", "report_date").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("current_net") != 0, F.col("account_id")))), ",").alias("accounts"))
    s = s.select("tenant", "report_date", F.when(F.month("report_date") == 3, 2).otherwise(1).alias("threshold"), F.lit("all").alias("controls"), F.lit("m").alias("mapping_sha256"), F.when(F.col("accounts") != "", F.col("accounts")).alias("accounts"), F.date_add(F.trunc("report_date", "month"), F.when(F.month("report_date") == 10, 1).otherwise(0)).alias("period_start"), F.col("report_date").alias("period_end"), F.lit("REVIEW").alias("status"))
    after = s.withColumn("tenant", _pack("report_date"))
    before = s.withColumn("tenant", F.concat_ws(":", "tenant", F.date_format(F.add_months(F.trunc("report_date", "month"), 1), "yyyy-MM")))
    return diffs.scope_changes(before, after)


@query("""WITH o AS (SELECT o_orderstatus AS run_id, o_orderkey AS ordinal FROM orders) SELECT run_id, ordinal, CASE WHEN ordinal % 7 = 0 THEN 'missing right' WHEN ordinal % 11 = 0 THEN 'missing left' WHEN ordinal % 26 = 0 THEN 'amount, text' WHEN ordinal % 13 = 0 THEN 'amount' ELSE 'text' END AS mismatch
  FROM o WHERE NOT (ordinal % 7 = 0 AND ordinal % 11 = 0) AND (ordinal % 7 = 0 OR ordinal % 11 = 0 OR ordinal % 13 = 0 OR ordinal % 2 = 0 AND ordinal % 17 = 0)""".replace("ordinal % 26 = 0", "ordinal % 13 = 0 AND ordinal % 34 = 0"))
def pack_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two forms of a pack's rows."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    a = o.where(n % 11 != 0).select(F.col("o_orderstatus").alias("run_id"), n.alias("ordinal"), n.alias("amount"), F.col("o_orderpriority").alias("text"))
    b = o.where(n % 7 != 0).select(F.col("o_orderstatus").alias("run_id"), n.alias("ordinal"), (n + F.when(n % 13 == 0, 1).otherwise(0)).alias("amount"), F.concat("o_orderpriority", F.when(n % 34 == 0, "!").otherwise("")).alias("text"))
    return diffs.pack_agreement(a, b, ["amount", "text"])


@query(f"""WITH {FOUND_SQL}, d AS (SELECT DISTINCT tenant, report_date FROM tb), s AS (SELECT d.tenant, d.report_date, CASE WHEN count(f.control) > 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM d LEFT JOIN found f USING (tenant, report_date) GROUP BY ALL)
  SELECT 'status' AS measure, status AS name, count(*) AS packs, CAST(NULL AS BIGINT) AS items FROM s GROUP BY ALL UNION ALL SELECT 'control', control, count(DISTINCT (tenant, report_date)), count(*) FROM found GROUP BY control""")
def queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A43, U05."""
    f = found(spark, sf_dir)
    p = close.overall_status(tb(spark, sf_dir), f).select(_pack("report_date").alias("run_id"), "status")
    return diffs.queue_summary(p.unionByName(p), f.select(_pack("report_date").alias("run_id"), "control"))


@query(f"""WITH {FOUND_SQL}, s AS (SELECT DISTINCT tenant, report_date FROM found) SELECT tenant || ':' || strftime(report_date, '%Y-%m') AS run_id, CAST(row_number() OVER (PARTITION BY report_date ORDER BY tenant || ':' || strftime(report_date, '%Y-%m')) AS INTEGER) AS ordinal FROM s""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10."""
    p = close.overall_status(tb(spark, sf_dir), found(spark, sf_dir)).select(_pack("report_date").alias("run_id"), "report_date", "status")
    return diffs.queue(p, "REVIEW").select("run_id", "ordinal")
