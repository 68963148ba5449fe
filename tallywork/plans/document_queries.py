"""Queries of JSON sources: documents are written from the driver's tables into a store, with planted faults of value, nesting and repetition, and read under their guards.

Eight customers' numbers make one document of each kind, so documents grow with the table. A document's number decides whether it is sound or which of its
kind's faults it has; a fault is one replaced part of its text, and its refusal names path and code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import documents
from ..sources.staging import new_path
from .derive import table
from .file_queries import file_no

Q, S = {}, {}

#: n: a row's number; k: its document's; a, m: the least and the count of a document's rows.
BASE_SQL = "base AS (SELECT c_custkey AS n, CAST(floor(c_custkey / 8) AS INTEGER) AS k FROM customer), files AS (SELECT k, min(n) AS a, count(*) AS m FROM base GROUP BY k)"
HEX = "ab" * 32


@dataclass(frozen=True)
class Spec:
    """ids: of the survey; root: text of a document, {items} its rows; item: text of a row; shown: members in a line, and line, the same as text. faults: (part, in
    its place, path, code)."""

    ids: str
    root: str
    shown: str
    line: str
    faults: tuple[tuple[str, str, str, str], ...]
    item: str = ""
    array: str = ""


def member(name: str, value: str) -> str:
    return f'"{name}":"{value}"'


TWICE = "DUPLICATE_MEMBER"
REPORT = '{"name":"Trial Balance","as_at":"2024-06-30","basis":"accrual","currency":"AUD","tracking_filters":[],"include_drafts":false}'
SPECS = {
    "reviewer_note": Spec(
        "S10", '{"reviewer_initials":"AB{k}","reviewed_on":"2024-07-05","comment":"seen {k}"}', "reviewer_initials reviewed_on comment", "AB{k}|2024-07-05|seen {k}",
        (("2024-07-05", "5 July 2024", "$.reviewed_on", "VALUE"), ('"AB{k}"', '" "', "$.reviewer_initials", "VALUE"), ('"comment"', '"reviewed_on":"2024-07-06","comment"', "$", TWICE), ('"seen {k}"', "7", "$.comment", "TYPE"), (',"comment":"seen {k}"', "", "$.comment", "MEMBER")),
    ),
    "self_review": Spec(
        "S21", '{"preparer_initials":"P{k}","prepared_on":"2024-07-05","engagement_type":"bas","period_end":"2024-06-30","period_start":"2024-04-01","assertions":{"pack_complete":true,"tie_outs_done":true,"open_items_listed":true,"variances_explained":false,"self_reviewed":true}}',
        "preparer_initials prepared_on engagement_type period_end", "P{k}|2024-07-05|bas|2024-06-30",
        (("2024-07-05", "2024-06-29", "$.prepared_on", "BEFORE_PERIOD_END"), ("2024-04-01", "2024-07-01", "$.period_start", "ORDER"), ('"self_reviewed":true', '"self_reviewed":"true"', "$.assertions.self_reviewed", "TYPE"), ('"tie_outs_done":true,', '', "$.assertions.tie_outs_done", "MEMBER"), ('"bas"', '"annual"', "$.period_start", "PROFILE"), ('"pack_complete":true', '"pack_complete":true,"pack_complete":false', "$", TWICE)),
    ),
    "opening_items": Spec(
        "S13", '{"schema":"clearing-carry-v1","identity":{"Tenant":"T{k}","AccountID":"880","Currency":"AUD"},"period_end":"2024-05-31","balance":"{m}.00","items":[{items}],"notes":{"t{a}":"asked"}}',
        "TransactionID Date Debit Credit", "t{n}|2024-05-15|1.00|0.00",
        (('"balance":"{m}.00"', '"balance":"{m}.01"', "$.balance", "SUM"), ('"t{a}":"asked"', '"u{a}":"asked"', "$.notes", "UNKNOWN_ITEM"), ('"t{a}","Date":"2024-05-15"', '"t{a}","Date":"2024-06-15"', "$.items[0].Date", "AFTER_PERIOD_END"), ('"t{a}","Date":"2024-05-15"', '"t{a}","Date":"2024-05-32"', "$.items[0].Date", "VALUE"),
         ('"identity":{', '"identity":{"Tenant":"U","x":1,', "$", TWICE), ('"Currency":"AUD"},"period_end"', '"Currency":"AUD","Unit":1},"period_end"', "$.identity.Unit", "MEMBER"), ("clearing-carry-v1", "clearing-carry-v2", "$.schema", "VALUE")),
        '{"TransactionID":"t{n}","Date":"2024-05-15","Tenant":"T{k}","AccountID":"880","Currency":"AUD","Reference":"","Description":"d","Debit":"1.00","Credit":"0.00"}', "items",
    ),
    "expenses": Spec(
        "S15", '{"schema_version":1,"tenant":"T{k}","currency":"AUD","cutoff":"2024-06-30","invoices":[{items}],"claims":[{"claim_id":"c","invoice_id":"i{a}","employee":"E","amount":"5","approved":true}],"payments":[{"payment_id":"p","claim_id":"c","reference":"r","amount":"2.5","date":"2024-06-01"}],"ledger_balance":"-2.50"}',
        "invoice_id supplier amount evidence", "i{n}|S|{n}.5|",
        (('"approved":true', '"approved":"yes"', "$.claims[0].approved", "TYPE"), ('"2.5","date":"2024-06-01"', '"2.5","date":"2024-07-01"', "$.payments[0].date", "AFTER_CUTOFF"), ('"-2.50"', '"-2.505"', "$.ledger_balance", "VALUE"), ('"i{a}","supplier":"S"', '"i{a}","supplier":" S"', "$.invoices[0].supplier", "VALUE"), ('"c","invoice_id"', '"c","claim_id":"c","invoice_id"', "$", TWICE),
         ('"schema_version":1', '"schema_version":2', "$.schema_version", "VALUE")),
        '{"invoice_id":"i{n}","supplier":"S","reference":"r{n}","amount":"{n}.5","evidence":""}', "invoices",
    ),
    "migration": Spec(
        "S15", '{"schema_version":1,"tenant":"T{k}","currency":"AUD","cutoff":"2024-06-30","mapping":[{"mapping_id":"a","source_account":"1","target_account":"2","weight":"0.25"},{"mapping_id":"b","source_account":"1","target_account":"3","weight":"0.75"},{"mapping_id":"c","source_account":"4","target_account":"3","weight":"1"}],"before":[{items}],"after":[]}',
        "row_id item_id amount", "r{n}|i{n}|-{n}.00",
        (('"0.75"', '"0.74"', "$.mapping", "WEIGHTS"), ('"0.75"', '"1.75"', "$.mapping[1].weight", "VALUE"), ('"r{a}","item_id"', '"r{a}","row":"x","item_id"', "$.before[0].row", "MEMBER"), ('"mapping_id":"b"', '"mapping_id":"a"', "$.mapping", "REPEATED_KEY"), ('"after":[]', '"after":{}', "$.after", "TYPE")),
        '{"row_id":"r{n}","item_id":"i{n}","account":"1","amount":"-{n}.00","reference":"x","tax_code":"GST"}', "before",
    ),
    "interentity": Spec(
        "S15", '{"schema_version":1,"currency":"AUD","cutoff":"2024-06-30","entities":["A","B"],"records":[{items}]}', "row_id entity counterparty amount disputed", "r{n}|A|B|{n}|false",
        (('["A","B"]', '["A","A"]', "$.entities", "REPEATED_KEY"), ('"r{a}","entity":"A"', '"r{a}","entity":"B"', "$.records[0]", "ENTITIES"), ('"r{a}","entity":"A"', '"r{a}","entity":null', "$.records[0].entity", "TYPE"), ('"entities":["A","B"],', '"entities":["A","B"],"currency":"USD",', "$", TWICE)),
        '{"row_id":"r{n}","entity":"A","counterparty":"B","account":"1","reference":"L","evidence":"e","date":"2024-03-31","amount":"{n}","disputed":false}', "records",
    ),
    "equity_schedule": Spec(
        "S16", '{"schema_version":1,"tenant":"T{k}","opening_date":"2023-06-30","closing_date":"2024-06-30","currency":"AUD","basis":"ledger_equity","prior_source_sha256":"' + HEX + '","current_source_sha256":"' + HEX.replace("a", "c") + '","equity_account_ids":["900","910"],"complete":true,"movements":[{items}]}',
        "movement_id date account_id debit credit", "m{n}|2024-03-15|900|0|{n}.25",
        (('"m{a}","date":"2024-03-15"', '"m{a}","date":"15 March 2024"', "$.movements[0].date", "VALUE"), ('"m{a}","date":"2024-03-15"', '"m{a}","date":"2023-06-30"', "$.movements[0].date", "OUTSIDE_INTERVAL"), ('"' + HEX + '"', '"' + HEX.upper() + '"', "$.prior_source_sha256", "VALUE"), 
         ('"m{a}","date"', '"m{a}","movement_id":"x","date"', "$", TWICE), ('"complete":true', '"complete":1', "$.complete", "TYPE"), ('"ledger_equity"', '"ledger equity"', "$.basis", "VALUE"), ('"m{a}","date"', '"m{a}","note":{"deep":[]},"date"', "$.movements[0].note", "MEMBER")),
        '{"movement_id":"m{n}","date":"2024-03-15","account_id":"900","debit":"0","credit":"{n}.25","description":"d","evidence_reference":"e"}', "movements",
    ),
    "calculation_evidence": Spec(
        "S17", '{"schema":"calculation-evidence/1","calculation_sha256":"' + HEX + '","calculation":{"label":"gst-{k}","call":{"calculator":"gst","period":"2024-06","status":"COMPUTED"},"upstream":{"manifest":{"rate_table_uris":[{items}]},"advisory":{"notes":["as stated"]}},"normalised":{"values":{"due":"12.50"}},"validation":{"accepted":true,"findings":[]}}}',
        "schema calculation_sha256", "calculation-evidence/1|" + HEX,
        (('"uri":"u{a}"', '"uri":7', "$.calculation.upstream.manifest.rate_table_uris[0].uri", "TYPE"), ('"12.50"', '"12,50"', "$.calculation.normalised.values.due", "VALUE"), ('"accepted":true', '"accepted":"yes"', "$.calculation.validation.accepted", "TYPE"), ("gst-{k}", "GST {k}", "$.calculation.label", "VALUE"), ('"as stated"', "{}", "$.calculation.upstream.advisory.notes[0]", "TYPE"),
         ('"status":"COMPUTED"', '"status":"COMPUTED","status":"FAILED"', "$", TWICE), ("calculation-evidence/1", "calculation-evidence/2", "$.schema", "VALUE")),
        '{"uri":"u{n}"}',
    ),
    "coding_assertions": Spec(
        "S18", '{"schema_version":1,"tenant":"T{k}","currency":"AUD","period_start":"2024-06-01","period_end":"2024-06-30","original_sha256":"' + HEX + '","current_sha256":"' + HEX + '","expectations":[{items}]}',
        "original_account_id transaction_id current_account_id expected_account_id", "1|t{n}|2|",
        (("2024-06-01", "2024-07-01", "$.period_start", "ORDER"), ('"current_sha256":"' + HEX, '"current_sha256":"' + HEX[1:], "$.current_sha256", "VALUE"), ('"t{a}","current_account_id":"2"', '"t{a}","current_account_id":""', "$.expectations[0].current_account_id", "VALUE"), ('"expectations":[', '"expectations":[{"original_account_id":"1","transaction_id":"t{a}","current_account_id":"3","expected_account_id":"","purpose":"p","evidence_reference":""},', "$.expectations", "REPEATED_KEY")),
        '{"original_account_id":"1","transaction_id":"t{n}","current_account_id":"2","expected_account_id":"","purpose":"p","evidence_reference":"e"}', "expectations",
    ),
    "responses": Spec(
        "S19", '{"schema_version":1,"pack_sha256":"' + HEX + '","responses":[{items}]}', "query_id explanation reviewed_on", "Q-{n}|because {n}|2024-07-05",
        (('"Q-{a}","explanation":"because {a}"', '"Q-{a}","explanation":" "', "$.responses[0].explanation", "VALUE"), ('"Q-{a}","explanation"', '"Q-{a}","answer":"x","explanation"', "$.responses[0].answer", "MEMBER"), ('"' + HEX + '"', '"abc"', "$.pack_sha256", "VALUE"), ('"responses":[', '"responses":[17,', "$.responses[0]", "TYPE"), ('"schema_version":1', '"schema_version":"1"', "$.schema_version", "TYPE")),
        '{"query_id":"Q-{n}","explanation":"because {n}","evidence_reference":"e","reviewer":"R","reviewed_on":"2024-07-05"}', "responses",
    ),
    "source_manifest": Spec(
        "S32", '{"schema_version":"source-manifest.v1","mode":"synthetic","source_system":"export","entity_ref":"E{k}","report":' + REPORT + ',"export":{"schema":"x-tb-csv.v1","csv":"tb{k}.csv","sha256":"' + HEX + '","generated_at":"2024-07-01T09:30:00+10:00"}}', "mode entity_ref", "synthetic|E{k}",
        (('"accrual"', '"cash"', "$.report.basis", "VALUE"), ('"as_at":"2024-06-30"', '"as_at":"2024-06-31"', "$.report.as_at", "VALUE"), ('"include_drafts":false', '"include_drafts":null', "$.report.include_drafts", "TYPE"), ('"csv":"tb{k}.csv"', '"csv":"tb{k}.csv","csv":"other.csv"', "$", TWICE), ("2024-07-01T09:30:00+10:00", "yesterday", "$.export.generated_at", "VALUE"), ('"csv":"tb{k}.csv",', "", "$.export.csv", "MEMBER")),
    ),
    "review_context": Spec(
        "S32", '{"schema_version":"review-context.v1","mode":"synthetic","current_manifest":"c{k}.json","prior_manifest":"p{k}.json"}', "current_manifest prior_manifest", "c{k}.json|p{k}.json",
        (('"synthetic"', '"live"', "$.mode", "VALUE"), ('"c{k}.json"', '["c{k}.json"]', "$.current_manifest", "TYPE"), ('{"schema', '{"mode":"synthetic","schema', "$", TWICE), ('{"schema', '["schema', "$", "NOT_JSON")),
    ),
    "review_policy": Spec(
        "S32", '{"schema_version":"review-policy.v1","policy_id":"P{k}","operations":{"trial_balance_variance":{"allowed_sections":["Revenue","Assets"],"minimum_absolute_delta":"1000.00","minimum_percent_delta":"15","max_results":25}},"model_projection":["finding_id","evidence_ref","account_ref","section","current_ytd_net","prior_ytd_net","delta","percent_change","review_reason"]}',
        "schema_version policy_id", "review-policy.v1|P{k}",
        (('"max_results":25', '"max_results":0', "$.operations.trial_balance_variance.max_results", "VALUE"), ('"1000.00"', '"-1"', "$.operations.trial_balance_variance.minimum_absolute_delta", "VALUE"), ('"Assets"]', "5]", "$.operations.trial_balance_variance.allowed_sections[1]", "TYPE"), ('"max_results":25', '"max_results":25,"extra":1', "$.operations.trial_balance_variance.extra", "MEMBER"),
         ('"finding_id",', "", "$.model_projection", "VALUE"), ('"operations":{', '"operations":{"journal":{},', "$.operations.journal", "MEMBER")),
    ),
    "review_request": Spec(
        "S32", '{"schema_version":"review-request.v1","request_id":"R{k}","operation":"trial_balance_variance","section":"Revenue","policy_id":"P{k}"}', "request_id section policy_id", "R{k}|Revenue|P{k}",
        (('"trial_balance_variance"', '"post_journal"', "$.operation", "VALUE"), ('"R{k}"', '""', "$.request_id", "VALUE"), ('"section":"Revenue",', "", "$.section", "MEMBER")),
    ),
    "agreements": Spec(
        "S31", '{"schema_version":1,"entity":"E{k}","currency":"AUD","ledger_start":"2024-07-01","ledger_end":"2025-06-30","amount_basis":"GST-inclusive","agreements":[{items}]}', "grant_id start end opening_cash", "G{n}|2024-07-01|2025-06-30|{n}",
        (('"G{a}","start":"2024-07-01"', '"G{a}","start":"2026-07-01"', "$.agreements[0].start", "ORDER"), ('"G{a}","start":"2024-07-01"', '"G{a}","start":"1/7/24"', "$.agreements[0].start", "VALUE"), ('"b{a}":"10"', '"b{a}":"-10"', "$.agreements[0].budget.b{a}", "VALUE"), ('{"b{a}":"10"}', "{}", "$.agreements[0].budget", "TOO_FEW"), ('"b{a}":"10"', '"b{a}":"10","b{a}":"11"', "$", TWICE)),
        '{"grant_id":"G{n}","start":"2024-07-01","end":"2025-06-30","opening_cash":"{n}","opening_unspent_funding":"0","budget":{"b{n}":"10"},"agreement_evidence":"e"}', "agreements",
    ),
    "entity_map": Spec(
        "S33, E10", '{"schema_version":1,"entries":[{items}]}', "value placeholder kind added", "Name {n}|PERSON_0{n}|person|2024-01-01",
        (('"PERSON_0{a}","kind":"person"', '"PERSON_0{a}","kind":"staff"', "$.entries[0].placeholder", "KIND"), ('"value":"Name {a}"', '"value":"see ABN_01"', "$.entries[0].value", "PLACEHOLDER"), ('"entries":[', '"entries":[{"value":"x","placeholder":"PERSON_0{a}","kind":"person","added":"2024-01-01"},', "$.entries", "REPEATED_KEY"), ('"PERSON_0{a}"', '"PERSON-1"', "$.entries[0].placeholder", "VALUE")),
        '{"value":"Name {n}","placeholder":"PERSON_0{n}","kind":"person","added":"2024-01-01"}', "entries",
    ),
}


def filled(text: str, **columns: str) -> str:
    """SQL for text with its {name}s replaced by columns."""
    out = "'" + text.replace("'", "''") + "'"
    for name, column in columns.items():
        if "{" + name + "}" in text:
            out = f"replace({out}, '{{{name}}}', {column})"
    return out


def _text(column: str) -> str:
    return f"CAST({column} AS STRING)"


def _documents(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(file, content) of a kind: one shuffle by document, its rows with it."""
    spec, own = SPECS[name], {c: _text(c) for c in "kam"}
    held = [F.min("n").alias("a"), F.count("*").alias("m")]
    if spec.item:  # eight at most in a list
        item = F.expr(filled(spec.item, n=_text("n"), k=_text("k"))).alias("item")
        held.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item))), lambda x: x["item"]), ",").alias("items"))
    docs = _numbers(spark, sf_dir).groupBy("k").agg(*held).selectExpr("*", f"{filled(spec.root, **own, items='items')} AS doc")
    cases = " ".join(f"WHEN {i} THEN replace(doc, {filled(x, **own)}, {filled(y, **own)})" for i, (x, y, _, _) in enumerate(spec.faults, 1))
    return docs.selectExpr("concat('/file=', k, '/document.json') AS file", f"encode(CASE k % {len(spec.faults) + 1} {cases} ELSE doc END, 'UTF-8') AS content")


def write_documents(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = new_path(spark, f"documents-{name}")
    documents.store(_documents(spark, sf_dir, name), path)
    return path


def shown(of: Column, names: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(of[c].cast("string"), F.lit("")) for c in names.split()])


def document_query(name: str) -> None:
    spec = SPECS[name]

    def load(spark: SparkSession, sf_dir: str) -> DataFrame:
        accepted, refusals = documents.read_json(spark, write_documents(spark, sf_dir, name), name, stored=True)
        no = F.lit(None).cast("string")
        lines = F.transform(F.col(f"doc.{spec.array}"), lambda x: shown(x, spec.shown)) if spec.array else F.array(shown(F.col("doc"), spec.shown))
        ok = accepted.select(file_no(F.col("file")).alias("file"), F.explode(lines).alias("line"), no.alias("path"), no.alias("code"))
        return ok.unionByName(refusals.select(file_no(F.col("file")).alias("file"), no.alias("line"), "path", "code"))

    load.__name__ = f"load_{name}"
    load.__doc__ = f"{spec.ids}: documents under their guards; those with a planted fault are refused, with its path and code (K10)."
    Q[load.__name__] = load
    faults = spec.faults
    rows, columns = ("base", {"n": _text("n"), "k": _text("k")}) if spec.array else ("files", {"k": _text("k")})
    parts = [f"SELECT k AS file, {filled(spec.line, **columns)} AS line, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS code FROM {rows} WHERE k % {len(faults) + 1} = 0"]
    parts += [f"SELECT k, NULL, {filled(path, a=_text('a'))}, '{code}' FROM files WHERE k % {len(faults) + 1} = {i}" for i, (_, _, path, code) in enumerate(faults, 1)]
    S[load.__name__] = f"WITH {BASE_SQL} {' UNION ALL '.join(parts)}".replace("AS STRING", "AS VARCHAR")


for source in SPECS:
    document_query(source)


# -- accepted documents against other tables ---------------------------------------------------------------------------


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        S[f.__name__] = f"WITH {BASE_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS i FROM base) {sql}"
        return f

    return add


def _accepted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return documents.read_json(spark, write_documents(spark, sf_dir, name), name, stored=True)[0]


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS n", "CAST(floor(c_custkey / 8) AS INTEGER) AS k")


def _told(found: DataFrame) -> DataFrame:
    return found.select(file_no(F.col("file")).alias("file"), "path", "code")


@query("SELECT k AS file, '$.period_end' AS path, CASE WHEN k % 3 = 1 THEN 'UNKNOWN_IDENTITY' ELSE 'NOT_PRECEDING' END AS code FROM files WHERE k % 8 = 0 AND k % 3 <> 0")
def opening_period_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening items whose period isn't the one before that which they open, or which open none."""
    periods = _numbers(spark, sf_dir).select("k").distinct().where("k % 3 <> 1").selectExpr("concat('T', k) AS tenant", "'880' AS account_id", "'AUD' AS currency", "CASE WHEN k % 3 = 2 THEN DATE'2024-07-01' ELSE DATE'2024-06-01' END AS period_start")
    return _told(documents.opening_period_issues(_accepted(spark, sf_dir, "opening_items"), periods))


@query("SELECT k AS file, '$.responses[' || i || CASE WHEN n % 5 = 0 THEN '].query_id' ELSE '].reviewed_on' END AS path, CASE WHEN n % 5 = 0 THEN 'UNKNOWN_QUERY' ELSE 'BEFORE_CLOSE' END AS code FROM numbered WHERE k % 6 = 0 AND (n % 5 = 0 OR n % 7 = 0)")
def response_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to queries that the pack doesn't hold, or given before the close."""
    packs = _numbers(spark, sf_dir).where("n % 5 <> 0").selectExpr(f"'{HEX}' AS pack_sha256", "concat('Q-', n) AS query_id", "CASE WHEN n % 7 = 0 THEN DATE'2024-07-06' ELSE DATE'2024-06-30' END AS report_date")
    return _told(documents.response_issues(_accepted(spark, sf_dir, "responses"), packs))


@query("SELECT k AS file, '$.policy_id' AS path, 'UNKNOWN_POLICY' AS code FROM files WHERE k % 4 = 0 AND k % 7 <> 0")
def request_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review requests under policies that weren't accepted."""
    return _told(documents.request_issues(_accepted(spark, sf_dir, "review_request"), _accepted(spark, sf_dir, "review_policy")))


@query("""SELECT k AS file, '$.' || s || '_manifest' AS path, CASE WHEN k % 7 <> 0 THEN 'UNKNOWN_MANIFEST' ELSE 'DIGEST' END AS code FROM files, (VALUES ('current'), ('prior')) x(s) WHERE k % 5 = 0 AND (k % 7 <> 0 OR k % 2 = 1)
  UNION ALL SELECT k, '$.report.as_at', 'ORDER' FROM files WHERE k % 5 = 0 AND k % 7 = 0""")
def context_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review contexts whose manifests weren't accepted, whose exports have other bytes than declared, or whose two dates are the same."""
    made = _accepted(spark, sf_dir, "source_manifest")
    named = [made.withColumn("file", F.concat(F.lit(f"m/{x}"), file_no(F.col("file")), F.lit(".json"))) for x in "cp"]
    exports = _numbers(spark, sf_dir).select("k").distinct().selectExpr("concat('tb', k, '.csv') AS name", f"CASE WHEN k % 2 = 1 THEN repeat('0', 64) ELSE '{HEX}' END AS sha256", "DATE'2024-06-30' AS report_date")
    return _told(documents.context_issues(_accepted(spark, sf_dir, "review_context"), named[0].unionByName(named[1]), exports))
