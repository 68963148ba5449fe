"""JSON guards: every fault of every kind alone, duplicates and nesting, and documents against other tables."""

import json
import re

import pytest

from tallywork.plans.document_queries import SPECS
from tallywork.sources import documents


def filled(text):
    return text.replace("{k}", "3").replace("{a}", "24").replace("{n}", "24").replace("{m}", "1")


def sound(name):
    return filled(SPECS[name].root).replace("{items}", filled(SPECS[name].item))


def faults(spark, texts, name):
    rows = spark.createDataFrame([(str(n), "", t) for n, t in enumerate(texts)], "file string, sha256 string, text string")
    found = documents.judged(rows, documents.DOCUMENTS[name]).select("file", "faults").collect()
    return {int(r["file"]): {(f["path"], f["code"]) for f in r["faults"]} for r in found}


@pytest.mark.parametrize("name", sorted(SPECS))
def test_faults(spark, name):
    spec = SPECS[name]
    texts = [sound(name), *[sound(name).replace(filled(x), filled(y)) for x, y, _, _ in spec.faults]]
    got = faults(spark, texts, name)
    assert got == {0: set()} | {n: {(filled(path), code)} for n, (_, _, path, code) in enumerate(spec.faults, 1)}


@pytest.mark.parametrize("name", sorted(documents.DOCUMENTS))
def test_other_shapes(spark, name):
    for n, found in faults(spark, ["", "[]", "7", "null", "{", '{"a":1,"a":2}', "{}"], name).items():
        assert found, (name, n)
    assert faults(spark, [sound(name)[:-1] + ',"more":{"deep":[1,{"x":1,"x":2}]}}'], name)[0] == {("$", "DUPLICATE_MEMBER")}


def test_several_faults_are_all_told(spark):
    doc = json.loads(sound("equity_schedule")) | {"currency": "aud", "closing_date": 7}
    doc["movements"] *= 2
    doc["movements"][1] = doc["movements"][1] | {"debit": "1.005"}
    assert faults(spark, [json.dumps(doc)], "equity_schedule")[0] == {("$.currency", "VALUE"), ("$.closing_date", "TYPE"), ("$.movements", "REPEATED_KEY"), ("$.movements[1].debit", "VALUE")}


def accepted(spark, name, docs):
    rows = spark.createDataFrame([(f"/x/{f}", "", json.dumps(d)) for f, d in docs.items()], "file string, sha256 string, text string")
    f = documents.judged(rows, documents.DOCUMENTS[name])
    assert not f.where("size(faults) > 0").count()
    return f


def issues(df):
    return {(r["file"].rsplit("/", 1)[-1], r["path"], r["code"]) for r in df.collect()}


def test_opening_periods(spark):
    doc = json.loads(sound("opening_items"))
    other = doc | {"identity": doc["identity"] | {"Tenant": "U"}, "items": [doc["items"][0] | {"Tenant": "U"}]}
    opening = accepted(spark, "opening_items", {"a": doc, "b": other, "c": doc | {"period_end": "2024-06-01"}})
    periods = spark.createDataFrame([("T3", "880", "AUD", "2024-06-01")], "tenant string, account_id string, currency string, d string").selectExpr("tenant", "account_id", "currency", "CAST(d AS DATE) AS period_start")
    assert issues(documents.opening_period_issues(opening, periods)) == {("b", "$.period_end", "UNKNOWN_IDENTITY"), ("c", "$.period_end", "NOT_PRECEDING")}


def test_responses(spark):
    doc = json.loads(sound("responses"))
    row = doc["responses"][0]
    made = accepted(spark, "responses", {"a": doc, "b": doc | {"pack_sha256": "0" * 64}, "c": doc | {"responses": [row, row | {"query_id": "Q-none"}, row | {"query_id": "Q-2", "reviewed_on": "2024-06-29"}]}})
    packs = spark.createDataFrame([(doc["pack_sha256"], q, "2024-06-30") for q in ("Q-24", "Q-2")], "pack_sha256 string, query_id string, d string").selectExpr("pack_sha256", "query_id", "CAST(d AS DATE) AS report_date")
    assert issues(documents.response_issues(made, packs)) == {("b", "$.pack_sha256", "UNKNOWN_PACK"), ("c", "$.responses[1].query_id", "UNKNOWN_QUERY"), ("c", "$.responses[2].reviewed_on", "BEFORE_CLOSE")}


def test_contexts_are_bound_by_digest(spark):
    base = json.loads(sound("source_manifest"))

    def manifest(csv, sha, as_at, **report):
        return base | {"report": base["report"] | {"as_at": as_at} | report, "export": base["export"] | {"csv": csv, "sha256": sha}}

    sha = {n: f"{n:x}" * 64 for n in range(3)}
    made = accepted(spark, "source_manifest", {"now.json": manifest("now.csv", sha[0], "2024-06-30"), "then.json": manifest("then.csv", sha[1].upper(), "2024-05-31"), "last.json": manifest("last.csv", sha[2], "2023-05-31"), "forged.json": manifest("now.csv", sha[1], "2024-06-30"), "lost.json": manifest("lost.csv", sha[1], "2024-06-30"), "drafts.json": manifest("then.csv", sha[1], "2024-05-31", include_drafts=True)})
    exports = spark.createDataFrame([("now.csv", sha[0], "2024-06-30"), ("then.csv", sha[1], "2024-05-31"), ("last.csv", sha[2], "2023-05-31")], "name string, sha256 string, d string").selectExpr("name", "sha256", "CAST(d AS DATE) AS report_date")
    context = json.loads(sound("review_context"))
    pairs = {"good": ("now", "then"), "order": ("then", "now"), "years": ("now", "last"), "forged": ("forged", "then"), "lost": ("lost", "then"), "none": ("now", "missing"), "drafts": ("now", "drafts")}
    made_of = accepted(spark, "review_context", {k: context | {"current_manifest": f"m/{a}.json", "prior_manifest": f"m/{b}.json"} for k, (a, b) in pairs.items()})
    assert issues(documents.context_issues(made_of, made, exports)) == {
        ("order", "$.report.as_at", "ORDER"), ("years", "$.report.as_at", "FINANCIAL_YEARS"), ("forged", "$.current_manifest", "DIGEST"), ("lost", "$.current_manifest", "UNKNOWN_EXPORT"), ("none", "$.prior_manifest", "UNKNOWN_MANIFEST"), ("drafts", "$.report.include_drafts", "MISMATCH"),
    }


def test_requests(spark):
    policies = accepted(spark, "review_policy", {"p": json.loads(sound("review_policy"))})
    doc = json.loads(sound("review_request"))
    made = accepted(spark, "review_request", {"a": doc, "b": doc | {"section": "Equity"}, "c": doc | {"policy_id": "other"}})
    assert issues(documents.request_issues(made, policies)) == {("b", "$.section", "NOT_ALLOWED"), ("c", "$.policy_id", "UNKNOWN_POLICY")}


def test_read_json(spark, tmp_path):
    import hashlib

    (tmp_path / "good.json").write_text(sound("interentity"))
    (tmp_path / "bad.json").write_text("{")
    got, refusals = documents.read_json(spark, str(tmp_path), "interentity")
    assert [(r["entity"], r["entities"]) for r in documents.items(got, "records", ("entities",)).collect()] == [("A", ["A", "B"])]
    assert got.first()["sha256"] == hashlib.sha256(sound("interentity").encode()).hexdigest()
    assert [(r["path"], r["code"]) for r in refusals.collect()] == [("$", "NOT_JSON")]


@pytest.mark.parametrize("name", ["interentity"])
def test_documents_share_files(spark, name):
    """documents lie in a store of a few files, and are parsed once for both results."""
    from pathlib import Path

    from tallywork.plans import document_queries

    sf_dir = "/root/testdata/sf0.01"
    path = document_queries.write_documents(spark, sf_dir, name)
    assert spark.read.parquet(path).count() == 188
    assert len(list(Path(path).rglob("*.parquet"))) <= 4 * spark.sparkContext.defaultParallelism
    accepted, refusals = documents.read_json(spark, path, name, stored=True)
    for half in (accepted, refusals):
        assert "parse_json" not in half._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["reviewer_note", "migration", "agreements"])
def test_kinds_are_judged_once(spark, name):
    """F2 to F12 and others: a kind of document, with a list or without, lies in a few files and is parsed once for what is accepted and what is refused."""
    from pathlib import Path

    from tallywork.plans import document_queries

    path = document_queries.write_documents(spark, "/root/testdata/sf0.001", name)
    assert len(list(Path(path).rglob("*.parquet"))) <= 4 * spark.sparkContext.defaultParallelism
    for half in documents.read_json(spark, path, name, stored=True):
        assert "parse_json" not in half._jdf.queryExecution().optimizedPlan().toString()


def _variants(spark, name):
    """How often a kind's guards take a map, a list or a single member out of a VARIANT."""
    rows = spark.createDataFrame([("", "", "{}")], "file string, sha256 string, text string")
    text = documents.judged(rows, documents.DOCUMENTS[name])._jdf.queryExecution().analyzed().toString()
    return {x: text.count(f"$, {t}") for x, t in (("maps", "MapType"), ("lists", "ArrayType"))} | {"members": len(re.findall(r"\$\.\w+, VariantType", text))}


def _nodes(node):
    """Objects and lists under a guard."""
    under = list(node.members.values()) if isinstance(node, documents.Struct) else [node.of] if isinstance(node, (documents.Rows, documents.Named)) else []
    return [node, *[x for u in under for x in _nodes(u)]]


@pytest.mark.parametrize("name", sorted(SPECS))
def test_values_are_taken_apart_once(spark, name):
    """F2 to F12 and others: a VARIANT taken from another is built anew, so an object or list is taken apart once, whatever its guards ask."""
    kinds = [type(x) for x in _nodes(documents.DOCUMENTS[name].root)]
    assert _variants(spark, name) == {"maps": kinds.count(documents.Struct) + kinds.count(documents.Named), "lists": kinds.count(documents.Rows), "members": 0}


@pytest.mark.parametrize("name", sorted(SPECS))
def test_documents_take_one_shuffle(spark, name):
    from tallywork.plans import document_queries

    assert document_queries._documents(spark, "/root/testdata/sf0.001", name)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["context_issues", "opening_period_issues", "request_issues"])
def test_accepted_documents_are_written_once(spark, name):
    """what was judged is written, and what was accepted is read from it."""
    from pathlib import Path

    from tallywork.plans import document_queries
    from tallywork.sources import staging

    folder = Path(staging.shared_dir(spark))
    before = set(folder.iterdir())
    document_queries.Q[name](spark, "/root/testdata/sf0.001")
    assert sorted({x.name.split("-")[0] for x in set(folder.iterdir()) - before}) == ["documents", "judged"]
