"""Queries of the packs that are written and read back, of report-shaped files, and of rules that have no query of their own elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import currency_fits, one_side
from ..operators import checks, clearing, gate, redact, reports
from ..sources import readers, writers
from ..sources.staging import new_path, staged
from . import check_queries, close_queries, gate_queries, measure_queries, transaction_queries
from .derive import TB_SQL, in_cents, money, policy, table, tb
from .file_queries import BASE_SQL, base, file_no, write_files

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


# -- packs -------------------------------------------------------------------------------------------------------------

#: Pack -> (survey id, table -> (query, a text column whose lengths are added up)).
PACKS = {
    "close_pack": ("K01", {"exceptions": ("close_review", "reason"), "client_queries": ("client_queries", "question"), "trial_balance": ("tb_from_ledger", "account_name")}),
    "gate_pack": ("K02", {"findings": ("repeat_findings", None), "tie_out": ("tie_out", None), "open_items": ("open_items", None)}),
    "clearing_pack": ("K03", {"outstanding": ("outstanding_items", "transaction_id"), "suggestions": ("suggested_matches", "ids"), "carry_forward": ("carry_forward", "transaction_id")}),
    "drivers_pack": ("K04", {"drivers": ("variance_drivers", None), "top_drivers": ("top_drivers", None)}),
    "grant_pack": ("K05", {"budget_lines": ("grant_budget_lines", "state"), "funding_movements": ("grant_funding_movement", None), "contributions": ("grant_contributions", None), "allocation_evidence": ("grant_allocation_issues", "issue"), "ledger_tieout": ("grant_ledger_tieout", None)}),
    "review_projection": ("K08", {"run": ("pack_status", "status"), "exceptions": ("close_review", "reason"), "evidence": ("finding_evidence", None)}),
}
_Q = close_queries.Q | transaction_queries.Q | gate_queries.Q | measure_queries.Q | check_queries.Q
_S = close_queries.S | transaction_queries.S | gate_queries.S | measure_queries.S | check_queries.S


def pack_query(name: str) -> None:
    ident, tables = PACKS[name]

    def load(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = new_path(spark, name)
        writers.write_pack({t: _Q[q](spark, sf_dir) for t, (q, _) in tables.items()}, path)
        parts = []
        for t, (_, text) in tables.items():
            letters = F.coalesce(F.sum(F.length(text)), F.lit(0)) if text else F.lit(0)
            parts.append(spark.read.parquet(f"{path}/{t}").agg(F.count("*").alias("n"), letters.cast("long").alias("letters")).select(F.lit(t).alias("name"), "n", "letters"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    load.__name__ = name
    load.__doc__ = f"{ident}: the pack's tables written, by period where they have one, and read back: rows and letters of each."
    Q[name] = load
    S[name] = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, CAST({f'coalesce(sum(length({text})), 0)' if text else '0'} AS BIGINT) AS letters FROM ({_S[q]})" for t, (q, text) in tables.items())


for pack in PACKS:
    pack_query(pack)


@query(close_queries.S["ledger_clearing_shape"])
def transaction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger lines exported as clearing transactions and read again under the contract."""
    path = new_path(spark, "transactions")
    shape = close_queries.ledger.clearing_shape(close_queries.ledger_lines(spark, sf_dir), "AUD")
    heads = {c: h for h, (c, _, _) in readers.CONTRACTS["transactions"].columns.items()}
    writers.export_csv(shape.select(*[F.col(c).alias(heads[c]) for c in shape.columns]), path, compression="gzip")
    accepted, _ = readers.read_csv(spark, path, readers.CONTRACTS["transactions"], captured=False)  # exports of any size
    return accepted.select("tenant", "account_id", "transaction_id", "date", in_cents("debit").alias("debit"), in_cents("credit").alias("credit"))


@query(f"""WITH {BASE_SQL} SELECT CAST(k AS INTEGER) AS file, CASE k % 6 WHEN 1 THEN 'VALUE' WHEN 2 THEN 'REPEATED_KEY' WHEN 3 THEN 'HEADER' ELSE 'WIDTH' END AS code, CAST(CASE k % 6 WHEN 2 THEN 2 ELSE 1 END AS BIGINT) AS n FROM base WHERE r = 1 AND (k % 6 IN (1, 3, 4) OR k % 6 = 2 AND m > 1)""")
def refusal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals of the contacts' files as a table, written and read back."""
    from . import file_queries

    found = file_queries.Q["load_contacts"](spark, sf_dir).where("code is not null").select("file", "code", "n")
    path = new_path(spark, "refusals")
    writers.write_table(found, path, ())
    return spark.read.parquet(path)


@query(f"WITH {TB_SQL} SELECT report_date, count(*) AS n, CAST(sum(net) AS BIGINT) AS net FROM tb WHERE month(report_date) NOT IN (6, 8) OR month(report_date) = 6 AND account_id = '110' GROUP BY report_date")
def published_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd months are published, then even ones, then June again with one account and August with none: every period is read as its last run left it."""
    t = staged(tb(spark, sf_dir), "trial-balances")
    path, month = new_path(spark, "published"), F.month("report_date")
    again = t.where(month == 6).where("account_id = '110'")
    for n, (run, rows, periods) in enumerate([("first", t.where(month % 2 == 1), t.where(month % 2 == 1)), ("second", t.where(month % 2 == 0), t.where(month % 2 == 0)), ("third", again, t.where(month.isin(6, 8)))]):
        writers.publish_table(rows, path, run, n, periods)
    back = writers.read_published(spark, path, t.schema)
    return back.groupBy("report_date").agg(F.count("*").alias("n"), in_cents(F.sum(F.col("debit") - F.col("credit"))).alias("net"))


# -- report-shaped files -----------------------------------------------------------------------------------------------

HEAD = "'Contact,Current,< 1 Month,1 Month,2 Months,3 Months,Older,Total'"
#: Of a contact: its name, and what it owes in six buckets.
_OWED = [f"({'n'} * {p} % 1009)" for p in (7, 11, 13, 17, 19, 23)]
_LINE = "concat('\"Contact ', CAST(n AS STRING), ', Ltd\",', " + ", ',', ".join(f"CAST({x} AS STRING)" for x in _OWED) + f", ',', CAST({' + '.join(_OWED)} AS STRING))"


def _reports(spark: SparkSession, sf_dir: str, name: str, sections: bool) -> DataFrame:
    """Records of a report per nation: title, header, contacts (in two sections), footer. Some lack the header, a bucket or a cell."""
    b = base(spark, sf_dir, BASE_SQL)
    line = f"CASE WHEN k % 6 = 4 AND r = 1 THEN concat({_LINE}, ',9') ELSE {_LINE} END"
    one = b.groupBy("k").agg(*[F.sum(F.expr(x)).alias(f"s{i}") for i, x in enumerate(_OWED)])
    total = "concat('Total,', " + ", ',', ".join(f"CAST(s{i} AS STRING)" for i in range(6)) + f", ',', CAST({' + '.join(f's{i}' for i in range(6))} AS STRING))"
    blank = "',,,,,,,'"
    head = f"CASE k % 6 WHEN 3 THEN 'Name,Current' WHEN 2 THEN replace({HEAD}, 'Older', 'Old') ELSE {HEAD} END"
    edges = [("-9", "'Aged Report'"), ("-8", "concat('Nation ', CAST(k AS STRING))"), ("-7", "''"), ("-6", head), ("1000000000001", total), ("1000000000002", "''"), ("1000000000003", "'Percentage of total,,,,,,,100'")]
    rows = b.selectExpr("k AS file", f"CAST({'CASE WHEN n % 2 = 0 THEN n ELSE n + 100000000000 END' if sections else 'n'} AS BIGINT) AS seq", f"{line} AS value")
    for seq, value in edges:
        rows = rows.unionByName(one.selectExpr("k AS file", f"CAST({seq} AS BIGINT) AS seq", f"{value} AS value"))
    if sections:
        for seq, value in (("-1", f"concat('Even', {blank})"), ("99999999999", "'Total Even,0,0,0,0,0,0,0'"), ("100000000000", f"concat('Odd', {blank})"), ("999999999999", "'Total Odd,0,0,0,0,0,0,0'")):
            rows = rows.unionByName(one.selectExpr("k AS file", f"CAST({seq} AS BIGINT) AS seq", f"{value} AS value"))
    path = new_path(spark, name)
    write_files(rows, path)
    return readers.read_positions(spark, f"{path}/*/*.txt")


_AGED_SQL = f"""WITH {BASE_SQL}, o AS (SELECT k, n, {' + '.join(_OWED)} AS total FROM base WHERE k % 6 IN (0, 1, 5)), bad AS (SELECT CAST(k AS INTEGER) AS file, CASE k % 6 WHEN 2 THEN 'HEADER' WHEN 3 THEN 'NO_HEADER' ELSE 'WIDTH' END AS code FROM base WHERE r = 1 AND k % 6 IN (2, 3, 4))"""


@query(f"{_AGED_SQL} SELECT CAST(k AS INTEGER) AS file, 'Contact ' || n || ', Ltd' AS contact, CAST(total AS BIGINT) AS total, NULL AS code FROM o UNION ALL SELECT file, NULL, NULL, code FROM bad")
def aged_receivables_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aged receivables of every nation; footers aren't contacts."""
    rows, bad = reports.aged_report(_reports(spark, sf_dir, "aged-receivables", False))
    ok = rows.where("not is_footer").select(file_no(F.col("file")).alias("file"), F.col("label").alias("contact"), F.col("row")["Total"].cast("long").alias("total"))
    return ok.unionByName(bad.select(file_no(F.col("file")).alias("file"), "code"), allowMissingColumns=True)


@query(f"{_AGED_SQL} SELECT CAST(k AS INTEGER) AS file, CASE WHEN n % 2 = 0 THEN 'Even' ELSE 'Odd' END AS section, 'Contact ' || n || ', Ltd' AS contact, CAST(total AS BIGINT) AS total FROM o")
def aged_payables_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aged payables with the section that each contact stands under; section totals go."""
    rows, _ = reports.aged_report(_reports(spark, sf_dir, "aged-payables", True))
    flat = rows.where("not is_footer").select("file", "pos", "label", F.col("row")["Total"].try_cast("decimal(18,2)").alias("amount"))
    return reports.fill_sections(flat).select(file_no(F.col("file")).alias("file"), "section", F.col("label").alias("contact"), F.col("amount").cast("long").alias("total"))


@query(f"""WITH {BASE_SQL} SELECT CAST(k AS INTEGER) AS file, 'e' || n AS employee, 'from nation ' || k AS note, NULL AS code FROM base WHERE k % 6 IN (0, 5) UNION ALL SELECT CAST(k AS INTEGER), NULL, NULL, CASE k % 6 WHEN 1 THEN 'HEADER' WHEN 2 THEN 'WIDTH' WHEN 3 THEN 'NOTE_MISSING' ELSE 'NOTE_NOT_LAST' END FROM base WHERE r = 1 AND k % 6 IN (1, 2, 3, 4)""")
def payday_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payday reports of every nation; the NOTE record must be the last, once and with its provenance."""
    b = base(spark, sf_dir, BASE_SQL)
    cells = lambda **given: "concat_ws(',', " + ", ".join(given.get(h, f"'{h[0]}'") for h in reports.PAYDAY) + ")"
    line = b.selectExpr("k AS file", "n AS seq", f"concat({cells(employee_id=chr(39) + 'e' + chr(39) + ' || CAST(n AS STRING)')}, CASE WHEN k % 6 = 2 AND r = 1 THEN ',x' ELSE '' END) AS value")
    one = b.where("r = 1")
    head = one.selectExpr("k AS file", "-1 AS seq", f"CASE WHEN k % 6 = 1 THEN 'row' ELSE '{','.join(reports.PAYDAY)}' END AS value")
    note = one.selectExpr("k AS file", "CASE WHEN k % 6 = 4 THEN 0 ELSE 1000000000000 END AS seq", f"{cells(employee_id=chr(39) + 'NOTE' + chr(39), notes='CASE WHEN k % 6 = 3 THEN ' + chr(39) * 2 + ' ELSE concat(' + chr(39) + 'from nation ' + chr(39) + ', CAST(k AS STRING)) END')} AS value")
    path = new_path(spark, "payday")
    rows = line.unionByName(head.withColumn("seq", F.col("seq").cast("long"))).unionByName(note.withColumn("seq", F.col("seq").cast("long")))
    write_files(rows.withColumn("seq", F.col("seq").cast("long")), path)
    found, bad = reports.payday_report(readers.read_positions(spark, f"{path}/*/*.txt"))
    ok = found.select(file_no(F.col("file")).alias("file"), F.col("row")["employee_id"].alias("employee"), "note")
    return ok.unionByName(bad.select(file_no(F.col("file")).alias("file"), "code"), allowMissingColumns=True)


@query(f"""WITH {BASE_SQL} SELECT CAST(k AS INTEGER) AS file, 'r' || n AS reference, CAST(CASE WHEN n % 2 = 0 THEN n ELSE -n END AS BIGINT) AS amount, NULL AS code FROM base WHERE k % 6 IN (0, 5) UNION ALL SELECT CAST(k AS INTEGER), NULL, NULL, CASE k % 6 WHEN 1 THEN 'HEADER' WHEN 2 THEN 'WIDTH' WHEN 3 THEN 'SECTION' ELSE 'SUBTOTAL' END FROM base WHERE r = 1 AND k % 6 IN (1, 2, 3, 4)""")
def account_transaction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of one account, whose subtotal must equal its detail; a section before it belongs to another account."""
    b = base(spark, sf_dir, BASE_SQL)
    amount = "CAST(CAST(n AS DECIMAL(18,2)) AS STRING)"
    line = f"concat('2024-06-01,Sale,text,r', CAST(n AS STRING), ',', CASE WHEN n % 2 = 0 THEN {amount} ELSE '' END, ',', CASE WHEN n % 2 = 1 THEN {amount} ELSE '' END, ',,,')"
    rows = b.selectExpr("k AS file", "n AS seq", f"concat({line}, CASE WHEN k % 6 = 2 AND r = 1 THEN ',x' ELSE '' END) AS value")
    one = b.groupBy("k").agg(F.sum(F.when(F.col("n") % 2 == 0, F.col("n")).otherwise(0)).alias("d"), F.sum(F.when(F.col("n") % 2 == 1, F.col("n")).otherwise(0)).alias("c"))
    total = "concat('Total Bank,,,,', CAST(CAST(d + CASE WHEN k % 6 = 4 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS STRING), ',', CAST(CAST(c AS DECIMAL(18,2)) AS STRING), ',,,')"
    heads = ",".join(reports.ACCOUNT_TRANSACTIONS)
    edges = [("-9", "'Account Transactions'"), ("-8", f"CASE WHEN k % 6 = 1 THEN 'Date' ELSE '{heads}' END"), ("-7", "'Cash,,,,,,,,'"), ("-6", "'2024-06-01,Sale,text,other,5.00,,,,'"), ("-5", "'Total Cash,,,,5.00,,,,'"), ("-4", "CASE WHEN k % 6 = 3 THEN 'Banks,,,,,,,,' ELSE 'Bank,,,,,,,,' END"), ("-3", "'Opening Balance,,,,7.00,,,,'"), ("1000000000000", total)]
    for seq, value in edges:
        rows = rows.unionByName(one.selectExpr("k AS file", f"CAST({seq} AS BIGINT) AS seq", f"{value} AS value"))
    path = new_path(spark, "account-transactions")
    write_files(rows.withColumn("seq", F.col("seq").cast("long")), path)
    found, bad = reports.account_transactions(readers.read_positions(spark, f"{path}/*/*.txt"), "Bank")
    side = lambda h: F.coalesce(F.col("row")[h].try_cast("decimal(18,2)"), F.lit(0))
    ok = found.select(file_no(F.col("file")).alias("file"), F.col("row")["Reference"].alias("reference"), (side("Debit") - side("Credit")).cast("long").alias("amount"))
    return ok.unionByName(bad.select(file_no(F.col("file")).alias("file"), "code"), allowMissingColumns=True)


@query(f"""WITH {BASE_SQL} SELECT CAST(k AS INTEGER) AS file, CASE WHEN n % 2 = 0 THEN 'Even' ELSE 'Odd' END AS section, 'Row' AS row_type, 'a' || n AS account_id, CAST(n AS VARCHAR) AS debit FROM base
  UNION ALL SELECT CAST(k AS INTEGER), CASE WHEN n % 2 = 0 THEN 'Even' ELSE 'Odd' END, 'SummaryRow', NULL, CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) FROM base GROUP BY k, n % 2""")
def nested_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested report documents of every nation, of two sections, as flat rows."""
    b = base(spark, sf_dir, BASE_SQL).withColumn("section", F.when(F.col("n") % 2 == 0, "Even").otherwise("Odd"))
    cell = "'{{\"Value\":\"', {0}, '\",\"Attributes\":[{{\"Id\":\"account\",\"Value\":\"', {1}, '\"}}]}}'"
    row = "concat('{\"RowType\":\"Row\",\"Cells\":[', " + cell.format("'x'", "'a', CAST(n AS STRING)") + ", ',', " + cell.format("CAST(n AS STRING)", "'a', CAST(n AS STRING)") + ", ']}')"
    each = b.selectExpr("k", "section", "n", f"{row} AS item").groupBy("k", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]), ",").alias("items"), F.sum("n").alias("s"))
    part = "concat('{\"RowType\":\"Section\",\"Title\":\"', section, '\",\"Rows\":[', items, ',{\"RowType\":\"SummaryRow\",\"Cells\":[{\"Value\":\"Total\"},{\"Value\":\"', CAST(s AS STRING), '\"}]}]}')"
    head = '{"RowType":"Header","Cells":[{"Value":"Account"},{"Value":"Debit"}]}'
    docs = each.selectExpr("k", f"{part} AS p").groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("p")), ",").alias("p"))
    docs = docs.select(F.col("k").alias("file"), F.lit(0).alias("seq"), F.concat(F.lit('{"Reports":[{"ReportType":"TrialBalance","ReportTitles":["Trial Balance"],"Rows":[' + head + ","), "p", F.lit("]}]}")).alias("value"))
    path = new_path(spark, "nested-reports")
    write_files(docs, path)
    found = readers.read_report(spark, f"{path}/*/*.txt")
    return found.select(file_no(F.col("file")).alias("file"), "section", "row_type", "account_id", F.col("cells")["Debit"].alias("debit"))


# -- rules -------------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 7 AS d, o_orderkey % 5 AS c, CASE o_orderkey % 4 WHEN 0 THEN 'AUD' WHEN 1 THEN 'aud' WHEN 2 THEN 'USD' END AS cur FROM orders)
  SELECT k AS o_orderkey, (d - 3 > 0) <> (c - 2 > 0) AND d - 3 >= 0 AND c - 2 >= 0 AS one_side, coalesce(cur = 'AUD', false) AS currency_fits, CASE WHEN d = 0 OR d > 5 THEN 'THRESHOLD' WHEN c > 3 THEN 'FRACTION' END AS threshold_issue FROM o""")
def guard_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of one side, currency and thresholds on values that orders give."""
    k = F.col("o_orderkey")
    cur = F.when(k % 4 == 0, "AUD").when(k % 4 == 1, "aud").when(k % 4 == 2, "USD")
    absolute = F.when(k % 7 == 0, F.lit("-1")).when(k % 7 > 5, F.lit("NaN")).otherwise(F.lit("10.5"))
    fraction = F.when(k % 5 > 3, F.lit("1.01")).otherwise(F.lit("0.1"))
    return table(spark, sf_dir, "orders").select("o_orderkey", one_side(k % 7 - 3, k % 5 - 2).alias("one_side"), currency_fits(cur, F.lit("AUD")).alias("currency_fits"), checks.threshold_issue(absolute, fraction).alias("threshold_issue"))


@query("""WITH x AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders GROUP BY o_custkey) SELECT o_custkey, array_to_string(p[1:3], ', ') || CASE WHEN len(p) > 3 THEN ' and ' || (len(p) - 3) || ' more' ELSE '' END AS priorities FROM x""")
def first_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priorities of a customer's orders, three of them by name."""
    names = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    return names.select("o_custkey", gate.first_three(F.col("p")).alias("priorities"))


@query("""WITH s AS (SELECT o_custkey AS doc_id, epoch(CAST(o_orderdate AS TIMESTAMP))::BIGINT // 86400 AS a, epoch(CAST(o_orderdate AS TIMESTAMP))::BIGINT // 86400 + 30 + o_orderkey % 90 AS b FROM orders),
  f AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM s), i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM f)
  SELECT doc_id, min(a) AS "start", max(b) AS "end" FROM i GROUP BY doc_id, island""")
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a customer has an order open, each for some weeks."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), day.alias("start"), (day + 30 + F.col("o_orderkey") % 90).alias("end"))
    return redact.merge_intervals(spans)


@query("""WITH e AS (SELECT c_mktsegment || ' ' || CAST(c_custkey // 2 AS VARCHAR) AS value, c_custkey FROM customer), n AS (SELECT *, count(*) OVER (PARTITION BY lower(value)) AS n FROM e)
  SELECT value, 'REPEATED_VALUE' AS issue FROM n WHERE n > 1 UNION ALL SELECT value, 'PLACEHOLDER_SHAPE' FROM n WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0""")
def entity_map_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as an entity map; neighbours of one segment share a name, some placeholders have another shape or kind."""
    k = F.col("c_custkey")
    name = F.concat("c_mktsegment", F.lit(" "), F.expr("c_custkey div 2").cast("string"))
    placeholder = F.when(k % 5 == 0, F.concat(F.lit("client_"), k.cast("string"))).when(k % 7 == 0, F.concat(F.lit("OTHER_0"), k.cast("string"))).otherwise(F.concat(F.lit("CLIENT_0"), k.cast("string")))
    return redact.entity_map_issues(table(spark, sf_dir, "customer").select(name.alias("value"), placeholder.alias("placeholder"), F.lit("CLIENT").alias("kind")))


@query("""WITH x AS (SELECT c_nationkey AS tenant, CAST(o_orderkey // 2 AS VARCHAR) AS id, year(o_orderdate) < 1995 AS opening FROM orders JOIN customer ON o_custkey = c_custkey) SELECT tenant, id AS transaction_id, count(*) AS n FROM x GROUP BY ALL HAVING count(*) > 1""")
def repeated_transaction_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening items and current ones in one table; an id must stand once over both."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("tenant")), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select("tenant", F.lit("110").alias("account_id"), F.lit("AUD").alias("currency"), F.expr("o_orderkey div 2").cast("string").alias("transaction_id"), F.year("o_orderdate").alias("year"), money(F.lit(100)).alias("debit"))
    both = clearing.with_opening(rows.where("year < 1995").drop("year"), rows.where("year >= 1995").drop("year", "debit").withColumn("credit", money(F.lit(100))))
    return clearing.repeated_ids(both).select("tenant", "transaction_id", "n")


@query("""SELECT n_name AS wanted, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) WHEN (SELECT count(*) FROM nation o WHERE contains(lower(o.n_name), lower(substr(n.n_name, 1, 5)))) = 1 THEN CAST(n_nationkey AS VARCHAR) END AS id FROM nation n""")
def tenant_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation asked for by its id, or by the first letters of its name."""
    n = table(spark, sf_dir, "nation")
    asked = n.select(F.col("n_name").alias("wanted"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise(F.lower(F.substring("n_name", 1, 5))).alias("ask"))
    return reports.tenants_chosen(n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name")), asked).select("wanted", "id")


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE l_extendedprice END * 100 AS BIGINT) AS debit FROM (SELECT l_orderkey, l_linenumber, l_returnflag, round(l_quantity) AS l_quantity, round(l_extendedprice) AS l_extendedprice FROM lineitem)""")
def chosen_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period amounts for one kind of line, year-to-date ones for the others."""
    l = table(spark, sf_dir, "lineitem")
    cents = lambda c: money(F.round(c).cast("long") * 100)
    rows = l.select("l_orderkey", "l_linenumber", "l_returnflag", cents("l_quantity").alias("period_debit"), cents("l_extendedprice").alias("ytd_debit"), money(F.lit(0)).alias("period_credit"), money(F.lit(0)).alias("ytd_credit"))
    both = reports.choose_pair(rows.where("l_returnflag = 'A'"), False).unionByName(reports.choose_pair(rows.where("l_returnflag <> 'A'"), True))
    return both.select("l_orderkey", "l_linenumber", in_cents("debit").alias("debit"))


__all__ = ["Q", "S", "policy"]


#: Records of a nation's trial balance by layout: code and name in one cell with both pairs, a cell each with the period's, and a spreadsheet's labels.
_TB_HEADS = ("Account,Debit,Credit,YTD Debit,YTD Credit", "Account Code,Account Name,Debit,Credit", "Account Code,Account,Account Type,Debit - Year to date,Credit - Year to date,30 June 2023")
_TB_LINES = (
    "concat('\"Acct, ', CAST(n AS STRING), CASE WHEN n % 10 = 0 THEN '' ELSE concat(' (', CAST(n AS STRING), 'A)') END, '\",1.00,,', CAST(n AS STRING), '.50,')",
    "concat(CASE WHEN n % 10 = 0 THEN '' ELSE concat(CAST(n AS STRING), 'A') END, ',\"Acct, ', CAST(n AS STRING), '\",', CAST(n AS STRING), '.50,0')",
    "concat(CASE WHEN n % 10 = 0 THEN '' ELSE concat(CAST(n AS STRING), 'A') END, ',\"Acct, ', CAST(n AS STRING), '\",Revenue,\"', CAST(n AS STRING), '.50\",,7')",
)


@query(f"""WITH {BASE_SQL} SELECT CAST(k AS INTEGER) AS file, CASE WHEN n % 10 <> 0 THEN CAST(n AS VARCHAR) || 'A' END AS account_code, 'Acct, ' || n AS account_name, CAST(n * 100 + 50 AS BIGINT) AS debit, CAST(NULL AS VARCHAR) AS code FROM base WHERE k % 7 NOT IN (3, 4, 5, 6)
  UNION ALL SELECT CAST(k AS INTEGER), NULL, NULL, NULL, CASE k % 7 WHEN 3 THEN 'NO_HEADER' WHEN 4 THEN 'PAIR' WHEN 5 THEN 'WIDTH' ELSE 'AMOUNT' END FROM base WHERE r = 1 AND k % 7 IN (3, 4, 5, 6)""")
def trial_balance_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report-shaped trial balances of three layouts under title rows, with a total; some lack the header or a pair, or have a wide record or an
    amount that is none."""
    b = base(spark, sf_dir, BASE_SQL)
    pick = lambda texts: "CASE k % 3 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"
    line = pick(_TB_LINES)
    line = f"CASE WHEN k % 7 = 5 AND r = 1 THEN concat({line}, ',9') WHEN k % 7 = 6 AND r = 1 THEN replace({line}, '.50', '.5O') ELSE {line} END"
    heads = pick([f"'{h}'" for h in _TB_HEADS])
    head = f"CASE k % 7 WHEN 3 THEN 'Accounts,Debit' WHEN 4 THEN replace(replace({heads}, 'Debit', 'Dr'), 'YTD', 'Y') ELSE {heads} END"
    total = pick(["'Total,1,1,1,1'", "',Total,1,1'", "',Total,,1,1,1'"])
    rows = b.selectExpr("k AS file", "n AS seq", f"{line} AS value")
    for seq, value in ((-5, "'Trial Balance'"), (-4, "concat('Accountable Nation ', CAST(k AS STRING))"), (-3, "''"), (-2, head), (1 << 40, total)):
        rows = rows.unionByName(b.where("r = 1").selectExpr("k AS file", f"CAST({seq} AS BIGINT) AS seq", f"{value} AS value"))
    path = new_path(spark, "trial-balance-reports")
    write_files(rows, path)
    good, bad = reports.trial_balance_report(readers.read_positions(spark, f"{path}/*/*.txt"))
    no = lambda kind: F.lit(None).cast(kind)
    ok = good.select(file_no(F.col("file")).alias("file"), "account_code", "account_name", in_cents("debit").alias("debit"), no("string").alias("code"))
    return ok.unionByName(bad.select(file_no(F.col("file")).alias("file"), no("string").alias("account_code"), no("string").alias("account_name"), no("long").alias("debit"), "code"))
