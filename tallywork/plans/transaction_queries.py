"""Queries of clearing, drivers, recoding and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clearing, close, drivers, schedules
from .derive import LEDGER_SQL, PAIRS_SQL, in_cents, ledger, money, table, tb

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a receipt, and a settlement some days later: none for every seventh, a cent short for every eleventh; periods are weeks."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    amount, zero = F.round(F.col("value") * 100).cast("long") + 2, F.lit(0).cast("long")
    r = F.struct(F.concat(F.lit("R"), n.cast("string")).alias("id"), F.to_date("ts").alias("date"), amount.alias("d"), zero.alias("c"))
    s = F.when(n % 7 != 0, F.struct(F.concat(F.lit("S"), n.cast("string")).alias("id"), F.date_add(F.to_date("ts"), (n % 9).cast("int")).alias("date"), zero.alias("d"), (amount - F.when(n % 11 == 0, 1).otherwise(0)).alias("c")))
    x = e.select("event_type", n.cast("string").alias("reference"), F.explode(F.filter(F.array(r, s), lambda x: x.isNotNull())).alias("x"))
    end = F.date_add(F.trunc("x.date", "week"), 6)
    return x.select(F.col("event_type").alias("tenant"), F.lit("1190").alias("account_id"), F.lit("AUD").alias("currency"), F.col("x.id").alias("transaction_id"), "x.date", "reference", money("x.d").alias("debit"), money("x.c").alias("credit"), end.alias("period_end"))


RECEIPTS_SQL = """e AS (SELECT event_type AS tenant, event_id, CAST(event_id AS VARCHAR) AS reference, CAST(ts AS DATE) AS day, CAST(round(value * 100) AS BIGINT) + 2 AS amount FROM events),
  items AS (SELECT tenant, 'R' || reference AS transaction_id, day AS date, reference, amount FROM e UNION ALL SELECT tenant, 'S' || reference, day + CAST(event_id % 9 AS INTEGER), reference, -(amount - CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) FROM e WHERE event_id % 7 <> 0),
  x AS (SELECT *, CAST(date_trunc('week', date) AS DATE) + 6 AS period_end FROM items)"""


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third balanced pair is accepted, in the period of its later item."""
    items = receipts(spark, sf_dir).where("reference % 7 <> 0 and reference % 11 <> 0 and reference % 3 = 0")
    ends = items.groupBy(*clearing.KEY, "reference").agg(F.max("period_end").alias("cleared"))
    return items.select(*clearing.KEY, "transaction_id", "reference").join(ends, [*clearing.KEY, "reference"])


ACCEPTED_SQL = f"{RECEIPTS_SQL}, ok AS (SELECT tenant, transaction_id, max(period_end) OVER (PARTITION BY tenant, reference) AS cleared FROM x WHERE reference::INT % 7 <> 0 AND reference::INT % 11 <> 0 AND reference::INT % 3 = 0)"
CARRIED_SQL = f"{ACCEPTED_SQL}, top AS (SELECT max(period_end) AS last FROM x), carried AS (SELECT tenant, transaction_id, date, amount, CAST(unnest(generate_series(period_end, coalesce(cleared - 7, last), INTERVAL 7 DAY)) AS DATE) AS period_end FROM x LEFT JOIN ok USING (tenant, transaction_id) CROSS JOIN top)"


@query(f"WITH {RECEIPTS_SQL}, g AS (SELECT tenant, reference, count(*) AS n, string_agg(transaction_id, ',' ORDER BY date, transaction_id) AS ids FROM x GROUP BY tenant, reference HAVING count(*) BETWEEN 2 AND 20 AND sum(amount) = 0) SELECT tenant, reference, n, ids, CAST(row_number() OVER (PARTITION BY tenant ORDER BY reference) AS INTEGER) AS suggestion FROM g")
def suggested_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R02."""
    return clearing.suggest_matches(receipts(spark, sf_dir)).select("tenant", "reference", "n", F.array_join("ids", ",").alias("ids"), "suggestion")


@query(f"""WITH {RECEIPTS_SQL}, d AS (SELECT tenant, reference AS g, transaction_id, amount, CASE WHEN reference::INT % 5 = 0 AND transaction_id LIKE 'S%' THEN 'reject' ELSE 'accept' END AS decision, CASE WHEN reference::INT % 6 = 0 THEN '' ELSE 'seen' END AS note FROM x),
  a AS (SELECT tenant, g, count(*) AS n, min(decision) AS d1, max(decision) AS d2, max(note) AS nt, sum(amount) AS s FROM d GROUP BY tenant, g)
  SELECT tenant, g AS "group", 'TOO_FEW' AS issue FROM a WHERE n < 2 AND d2 = 'accept' UNION ALL SELECT tenant, g, 'MIXED_DECISION' FROM a WHERE d1 <> d2 UNION ALL SELECT tenant, g, 'NO_NOTE' FROM a WHERE nt = '' AND d2 = 'accept' UNION ALL SELECT tenant, g, 'NOT_ZERO' FROM a WHERE s <> 0 AND d2 = 'accept'""")
def match_group_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair is a group; some decisions are mixed, some lack a note."""
    r, n = receipts(spark, sf_dir), F.col("reference").cast("int")
    d = r.select(*clearing.KEY, F.col("reference").alias("group"), "transaction_id", F.when((n % 5 == 0) & F.col("transaction_id").startswith("S"), "reject").otherwise("accept").alias("decision"), F.when(n % 6 == 0, "").otherwise("seen").alias("note"))
    return clearing.group_issues(r, d).select("tenant", "group", "issue")


@query(f"WITH {ACCEPTED_SQL} SELECT tenant, transaction_id, amount FROM x WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.tenant = x.tenant AND ok.transaction_id = x.transaction_id)")
def outstanding_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U03."""
    return clearing.outstanding(receipts(spark, sf_dir), accepted(spark, sf_dir)).select("tenant", "transaction_id", in_cents(clearing.signed()).alias("amount"))


def _carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = receipts(spark, sf_dir)
    last = r.agg(F.max("period_end").alias("last_end"))  # one row
    return clearing.carry_forward(r.crossJoin(F.broadcast(last)), accepted(spark, sf_dir), F.col("last_end"))


@query(f"WITH {CARRIED_SQL} SELECT tenant, period_end, transaction_id, amount, CAST(period_end - date AS INTEGER) AS age FROM carried")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items outstanding at each week's end."""
    return _carried(spark, sf_dir).select("tenant", "period_end", "transaction_id", in_cents("amount").alias("amount"), "age")


@query(f"""WITH {CARRIED_SQL}, m AS (SELECT tenant, period_end, sum(amount) AS movement FROM x GROUP BY ALL), o AS (SELECT tenant, period_end, sum(amount) AS l, count(*) AS n FROM carried GROUP BY ALL),
  b AS (SELECT m.tenant, m.period_end, movement, coalesce(p.l, 0) AS opening, coalesce(p.l, 0) + movement + CASE WHEN day(m.period_end) % 2 = 0 THEN 100 ELSE 0 END AS closing, coalesce(o.n, 0) AS n FROM m LEFT JOIN o USING (tenant, period_end) LEFT JOIN o p ON p.tenant = m.tenant AND p.period_end + 7 = m.period_end)
  SELECT tenant, period_end, CAST(opening AS BIGINT) AS opening, CAST(movement AS BIGINT) AS movement, CAST(closing AS BIGINT) AS closing, n AS n_outstanding, CASE WHEN opening + movement <> closing THEN 'BLOCKED' WHEN n > 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM b""")
def clearing_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported closings are out by 1.00 in weeks that end on an even day."""
    r, k = receipts(spark, sf_dir), [*clearing.KEY, "period_end"]
    carried = _carried(spark, sf_dir)
    before = carried.groupBy(*clearing.KEY, F.date_add("period_end", 7).alias("period_end")).agg(F.sum("amount").alias("opening"))
    b = r.groupBy(*k).agg(F.sum(clearing.signed()).alias("m")).join(before, k, "left").fillna(0, ["opening"])
    b = b.select(*k, "opening", (F.col("opening") + F.col("m") + F.when(F.dayofmonth("period_end") % 2 == 0, 1).otherwise(0)).alias("closing"))
    return clearing.period_status(r, b, carried).select("tenant", "period_end", *[in_cents(c).alias(c) for c in ("opening", "movement", "closing")], "n_outstanding", "status")


def _variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = close.pair_periods(tb(spark, sf_dir)).where("cur is not null and pri is not null and year(report_date) = year(prior_date) and month(report_date) <> 7")
    return p.select("tenant", "account_id", "report_date", "prior_date", (F.col("cur.ytd_net") - F.col("pri.ytd_net")).alias("difference")).where(F.abs("difference") >= 100000)


VAR_SQL = f"{PAIRS_SQL}, v AS (SELECT tenant, account_id, report_date, prior_date, cur - pri AS difference FROM pairs WHERE year(report_date) = year(prior_date) AND month(report_date) <> 7 AND abs(cur - pri) >= 10000000)"
WINDOW_SQL = f"{VAR_SQL}, t AS (SELECT tenant, account_id, concat_ws('.', journal_id, line_number) AS transaction_id, posting_date AS date, debit - credit AS amount FROM ledger WHERE l_suppkey % 10 <> 0), w AS (SELECT v.*, transaction_id, date, amount FROM v JOIN t ON v.tenant = t.tenant AND v.account_id = t.account_id AND date > prior_date AND date <= report_date)"


def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ledger(spark, sf_dir).where("l_suppkey % 10 <> 0").select("tenant", "account_id", F.concat_ws(".", "journal_id", "line_number").alias("transaction_id"), F.col("posting_date").alias("date"), "amount")
    return drivers.window_transactions(_variances(spark, sf_dir), t)


@query(f"WITH {WINDOW_SQL}, s AS (SELECT tenant, account_id, report_date, sum(amount) AS total, count(*) AS n FROM w GROUP BY ALL) SELECT v.tenant, v.account_id, v.report_date, CAST(difference AS BIGINT) AS difference, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(difference - coalesce(total, 0) AS BIGINT) AS unexplained, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'NO_TRANSACTIONS' WHEN difference = total THEN 'EXPLAINED' ELSE 'PARTLY_EXPLAINED' END AS status FROM v LEFT JOIN s USING (tenant, account_id, report_date)")
def variance_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the suppliers' lines is missing from the transactions."""
    return drivers.driver_totals(_variances(spark, sf_dir), _window(spark, sf_dir)).select("tenant", "account_id", "report_date", *[in_cents(c).alias(c) for c in ("difference", "total", "unexplained")], "n", "status")


@query(f"WITH {WINDOW_SQL} SELECT tenant, account_id, report_date, transaction_id, CAST(amount AS BIGINT) AS amount, CAST(row_number() OVER (PARTITION BY tenant, account_id, report_date ORDER BY abs(amount) DESC, date, transaction_id) AS INTEGER) AS rank FROM w QUALIFY rank <= 5")
def top_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W01."""
    return drivers.top_drivers(_window(spark, sf_dir)).select("tenant", "account_id", "report_date", "transaction_id", in_cents("amount").alias("amount"), "rank")


RECODE_SQL = f"""{LEDGER_SQL}, o AS (SELECT tenant, journal_id AS transaction_id, account_id, credit AS amount, l_suppkey FROM ledger WHERE line_number = 2), a AS (SELECT tenant, transaction_id, CASE WHEN l_suppkey % 2 = 0 THEN '600-N' ELSE '600-R' END AS expected_account, transaction_id AS target_id FROM o WHERE account_id = '600-A' AND l_suppkey % 3 = 0),
  c AS (SELECT tenant, transaction_id, CASE WHEN account_id = '600-A' AND l_suppkey % 4 = 0 THEN '600-N' ELSE account_id END AS account_id, amount + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS amount FROM o WHERE l_suppkey % 7 <> 0)"""


def _recode(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = ledger(spark, sf_dir).where("line_number = 2").select("tenant", F.col("journal_id").alias("transaction_id"), "account_id", F.col("credit").alias("amount"), "l_suppkey")
    a = o.where("account_id = '600-A' and l_suppkey % 3 = 0").select("tenant", "transaction_id", F.when(F.col("l_suppkey") % 2 == 0, "600-N").otherwise("600-R").alias("expected_account"), F.col("transaction_id").alias("target_id"))
    moved = F.when((F.col("account_id") == "600-A") & (F.col("l_suppkey") % 4 == 0), "600-N").otherwise(F.col("account_id"))
    c = o.where("l_suppkey % 7 <> 0").select("tenant", "transaction_id", moved.alias("account_id"), (F.col("amount") + F.when(F.col("l_suppkey") % 5 == 0, F.lit("0.01").cast("decimal(3,2)")).otherwise(0)).alias("amount"))
    return o.drop("l_suppkey"), a, c


@query(f"""WITH {RECODE_SQL} SELECT o.tenant, o.transaction_id, CASE WHEN count(*) OVER (PARTITION BY o.tenant, a.target_id) > 1 THEN 'REUSED' WHEN c.account_id IS NULL THEN 'NOT_FOUND' WHEN c.amount <> o.amount THEN 'AMOUNT_CHANGED' WHEN c.account_id = a.expected_account THEN 'RECODED' WHEN c.account_id = o.account_id THEN 'UNCHANGED' ELSE 'OTHER_ACCOUNT' END AS state
  FROM o JOIN a USING (tenant, transaction_id) LEFT JOIN c ON c.tenant = a.tenant AND c.transaction_id = a.target_id""")
def recoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J09, S18."""
    return drivers.recoding(*_recode(spark, sf_dir))


@query(f"WITH {RECODE_SQL} SELECT tenant, transaction_id, account_id FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.tenant = c.tenant AND a.target_id = c.transaction_id)")
def unmatched_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10."""
    _, a, c = _recode(spark, sf_dir)
    return drivers.unmatched_current(c, a).select("tenant", "transaction_id", "account_id")


def _expenses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders are invoices, with one claim each (some short, some over, some unknown) and a payment."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    inv = o.select(F.col("o_orderstatus").alias("tenant"), n.cast("string").alias("invoice_id"), F.col("o_custkey").cast("string").alias("supplier"), (n % 50).cast("string").alias("reference"), money(cents).alias("amount"), F.when(n % 23 == 0, "").otherwise("scan").alias("evidence"))
    claims = o.select(F.col("o_orderstatus").alias("tenant"), F.concat(F.lit("C"), n.cast("string")).alias("claim_id"), F.when(n % 29 == 0, F.concat(F.lit("X"), n.cast("string"))).otherwise(n.cast("string")).alias("invoice_id"), money(cents + F.when(n % 13 == 0, 5).when(n % 17 == 0, -5).otherwise(0)).alias("amount"), (n % 10 != 0).alias("approved"))
    pays = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderstatus").alias("tenant"), F.concat(F.lit("P"), n.cast("string")).alias("payment_id"), F.when(n % 31 == 0, F.concat(F.lit("Y"), n.cast("string"))).otherwise(F.concat(F.lit("C"), n.cast("string"))).alias("claim_id"), money(cents).alias("amount"))
    return inv, claims, pays


EXPENSES_SQL = """o AS (SELECT o_orderstatus AS tenant, o_orderkey AS n, CAST(o_custkey AS VARCHAR) AS supplier, CAST(o_orderkey % 50 AS VARCHAR) AS reference, CAST(round(o_totalprice * 100) AS BIGINT) AS amount FROM orders),
  inv AS (SELECT tenant, CAST(n AS VARCHAR) AS id, supplier, reference, amount, n % 23 = 0 AS bare FROM o), cl AS (SELECT tenant, 'C' || n AS id, CASE WHEN n % 29 = 0 THEN 'X' || n ELSE CAST(n AS VARCHAR) END AS inv_id, amount + CASE WHEN n % 13 = 0 THEN 5 WHEN n % 17 = 0 THEN -5 ELSE 0 END AS amount, n % 10 <> 0 AS approved FROM o),
  pay AS (SELECT tenant, 'P' || n AS id, CASE WHEN n % 31 = 0 THEN 'Y' || n ELSE 'C' || n END AS claim_id, amount FROM o WHERE n % 3 <> 0),
  ic AS (SELECT inv.*, coalesce(c, 0) AS claimed FROM inv LEFT JOIN (SELECT tenant, inv_id, sum(amount) AS c FROM cl GROUP BY ALL) x ON x.tenant = inv.tenant AND x.inv_id = inv.id), cp AS (SELECT cl.*, coalesce(p, 0) AS paid FROM cl LEFT JOIN (SELECT tenant, claim_id, sum(amount) AS p FROM pay GROUP BY ALL) y ON y.tenant = cl.tenant AND y.claim_id = cl.id)"""


@query(f"""WITH {EXPENSES_SQL} SELECT tenant, id, 'OVER_ALLOCATED' AS issue FROM ic WHERE claimed > amount UNION ALL SELECT tenant, id, 'UNDER_ALLOCATED' FROM ic WHERE claimed < amount UNION ALL SELECT tenant, id, 'MISSING_RECEIPT' FROM ic WHERE bare
  UNION ALL SELECT tenant, id, 'DUPLICATE_REFERENCE' FROM inv QUALIFY count(*) OVER (PARTITION BY tenant, supplier, reference) > 1 UNION ALL SELECT tenant, id, 'OVERPAID' FROM cp WHERE paid > amount UNION ALL SELECT tenant, id, 'UNPAID' FROM cp WHERE approved AND paid < amount
  UNION ALL SELECT tenant, id, 'PAID_UNAPPROVED' FROM cp WHERE NOT approved AND paid > 0 UNION ALL SELECT tenant, id, 'UNKNOWN_INVOICE' FROM cl WHERE NOT EXISTS (SELECT 1 FROM inv WHERE inv.tenant = cl.tenant AND inv.id = cl.inv_id) UNION ALL SELECT tenant, id, 'UNLINKED_PAYMENT' FROM pay WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.tenant = pay.tenant AND cl.id = pay.claim_id)""")
def expense_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22, J11, S15."""
    return schedules.expense_issues(*_expenses(spark, sf_dir))


@query(f"WITH {EXPENSES_SQL} SELECT tenant, CAST((SELECT sum(amount) FROM cl WHERE approved AND cl.tenant = t.tenant) - (SELECT sum(amount) FROM pay WHERE pay.tenant = t.tenant) AS BIGINT) AS expected FROM (SELECT DISTINCT tenant FROM o) t")
def expense_clearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22, the clearing balance."""
    _, c, p = _expenses(spark, sf_dir)
    return schedules.expense_clearing(c, p, c.select("tenant", F.lit(0).cast("decimal(18,2)").alias("ledger_balance")).distinct()).select("tenant", in_cents("expected").alias("expected"))


def _migration(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts' prices by brand move to type accounts by weights; some afterwards differ, some are missing, some mappings are off."""
    p, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    cents = F.round(F.col("p_retailprice") * 100).cast("long") * 4
    before = p.select(F.lit("T").alias("tenant"), n.cast("string").alias("item_id"), F.col("p_brand").alias("account"), money(cents).cast("decimal(18,2)").alias("amount"))
    mapping = p.select(F.lit("T").alias("tenant"), F.col("p_brand").alias("source_account")).distinct().where("source_account <> 'Brand#3'")
    mapping = mapping.withColumn("x", F.explode(F.array(F.struct(F.lit("A").alias("t"), F.lit("0.25").alias("w")), F.struct(F.lit("B").alias("t"), F.when(F.col("source_account") == "Brand#5", "0.5").otherwise("0.75").alias("w")))))
    mapping = mapping.select("tenant", "source_account", F.col("x.t").alias("target_account"), F.col("x.w").cast("decimal(7,6)").alias("weight"))
    after = p.where("p_partkey % 11 <> 0").withColumn("c", cents).withColumn("t", F.explode(F.array(F.lit("A"), F.lit("B")))).select(F.lit("T").alias("tenant"), n.cast("string").alias("item_id"), F.col("t").alias("account"), money(F.expr("c div 4 * case when t = 'A' then 1 else 3 end + case when p_partkey % 13 = 0 then 1 else 0 end")).alias("amount"))
    return before, mapping, after


MIGRATION_SQL = """p AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_partkey AS n, p_brand, CAST(round(p_retailprice * 100) AS BIGINT) * 4 AS c FROM part), t AS (SELECT * FROM (VALUES ('A', 1), ('B', 3)) v(account, w)),
  e AS (SELECT item_id, account, c // 4 * CASE WHEN account = 'B' AND p_brand = 'Brand#5' THEN 2 ELSE w END AS expected FROM p CROSS JOIN t WHERE p_brand <> 'Brand#3'), a AS (SELECT item_id, account, c // 4 * w + CASE WHEN n % 13 = 0 THEN 1 ELSE 0 END AS actual FROM p CROSS JOIN t WHERE n % 11 <> 0)"""


@query(f"WITH {MIGRATION_SQL} SELECT item_id, account, CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual, CASE WHEN actual IS NULL THEN 'MISSING' WHEN expected IS NULL THEN 'UNEXPECTED' WHEN expected <> actual THEN 'DIFFERENT' ELSE 'EQUAL' END AS state FROM e FULL JOIN a USING (item_id, account)")
def account_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12."""
    return schedules.migration(*_migration(spark, sf_dir)).select("item_id", "account", in_cents("expected").alias("expected"), in_cents("actual").alias("actual"), "state")


@query("SELECT DISTINCT p_brand AS id, 'UNMAPPED_ACCOUNT' AS issue FROM part WHERE p_brand = 'Brand#3' UNION ALL SELECT DISTINCT p_brand, 'WEIGHTS' FROM part WHERE p_brand = 'Brand#5'")
def migration_mapping_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    b, m, _ = _migration(spark, sf_dir)
    return schedules.mapping_issues(m, b).select("id", "issue")


@query(f"""WITH {LEDGER_SQL}, s AS (SELECT s_suppkey, n_name AS counterparty FROM supplier JOIN nation ON s_nationkey = n_nationkey), r AS (SELECT tenant AS entity, counterparty, strftime(posting_date, '%Y-%m') AS reference, debit - credit AS amount, l_suppkey % 41 = 0 AND tenant = 'NATION_1' AS disputed FROM ledger JOIN s ON l_suppkey = s_suppkey WHERE line_number = 1 AND tenant <> counterparty),
  g AS (SELECT least(entity, counterparty) AS entity_a, greatest(entity, counterparty) AS entity_b, reference, sum(CASE WHEN entity < counterparty THEN amount ELSE 0 END) AS sum_a, sum(CASE WHEN entity > counterparty THEN amount ELSE 0 END) AS sum_b, count(*) FILTER (entity < counterparty) AS n_a, count(*) FILTER (entity > counterparty) AS n_b, bool_or(disputed) AS disputed FROM r GROUP BY 1, 2, 3)
  SELECT entity_a, entity_b, reference, CAST(sum_a AS BIGINT) AS sum_a, CAST(sum_b AS BIGINT) AS sum_b, CASE WHEN disputed THEN 'DISPUTED' WHEN n_a = 0 OR n_b = 0 THEN 'ONE_SIDED' WHEN sum_a + sum_b <> 0 THEN 'DIFFERENCE' ELSE 'EQUAL' END AS state FROM g""")
def interentity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("counterparty"))
    r = ledger(spark, sf_dir).where("line_number = 1").join(s, F.col("l_suppkey") == F.col("s_suppkey")).where("tenant <> counterparty")
    r = r.select(F.col("tenant").alias("entity"), "counterparty", F.date_format("posting_date", "yyyy-MM").alias("reference"), "amount", ((F.col("l_suppkey") % 41 == 0) & (F.col("tenant") == "NATION_1")).alias("disputed"))
    return schedules.interentity(r).select("entity_a", "entity_b", "reference", in_cents("sum_a").alias("sum_a"), in_cents("sum_b").alias("sum_b"), "state")
