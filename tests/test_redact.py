"""Pseudonymisation on planted identifiers."""

import re

import pytest

from tallywork.operators import numbers, redact

ABN, TFN = "51 824 753 556", "123 456 782"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, f"Pay {ABN} and 51824753556, mail a.b@c.example.com twice: a.b@c.example.com"), (2, f"TFN {TFN}\nand Acme *Pty* Ltd, again ACME PTY\nLTD"), (3, "call 02 1234 5678 or 063-000"), (4, "Ms Jane Citizen paid 12345678"),
        (5, None), (6, ""), (7, "51 824 753 557 fails its check"), (8, "carried ABN_01"), (9, "Dr Minister is a term"), (10, "é日本🙂 x@y.example.org é"),
        (11, "ABN: 51 824 753 557, A.C.N. 123-456-789, Medicare card number 2123 45678 1/2, tax file number 123 456 78 and BSB 063000"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string")


ENTITIES = [("Acme Pty Ltd", "CLIENT_01", "CLIENT")]


def test_spans_and_placeholders(docs):
    got = {(r["doc_id"], r["kind"], r["value"], r["placeholder"]) for r in redact.placeholders(redact.structured_spans(docs)).collect()}
    assert got == {
        (1, "ABN", ABN, "ABN_01"), (1, "ABN", "51824753556", "ABN_01"), (1, "EMAIL", "a.b@c.example.com", "EMAIL_01"), (2, "TFN", TFN, "TFN_01"), (3, "PHONE", "02 1234 5678", "PHONE_01"), (3, "BSB", "063-000", "BSB_01"), (10, "EMAIL", "x@y.example.org", "EMAIL_01"),
        (11, "ABN", "51 824 753 557", "ABN_01"), (11, "ACN", "123-456-789", "ACN_01"), (11, "MEDICARE", "2123 45678 1/2", "MEDICARE_01"), (11, "TFN", "123 456 78", "TFN_01"), (11, "BSB", "063000", "BSB_01"),
    }


def test_redact_halts_and_restores(docs):
    clean, found, counts = redact.redact(docs, ENTITIES)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[1] == "Pay ABN_01 and ABN_01, mail EMAIL_01 twice: EMAIL_01" and texts[2] == "TFN TFN_01\nand CLIENT_01, again CLIENT_01"
    assert texts[3] == "call PHONE_01 or BSB_01" and texts[5] is None and texts[6] == "" and texts[9] == "Dr Minister is a term" and texts[10] == "é日本🙂 EMAIL_01 é"
    assert {(r["doc_id"], r["kind"]) for r in found.collect()} == {(4, "PERSON"), (4, "LONG_NUMBER"), (7, "LONG_NUMBER"), (8, "PLACEHOLDER")} and not {4, 7, 8} & set(texts)
    assert {(r["doc_id"], r["kind"], r["n"]) for r in counts.collect()} >= {(1, "ABN", 2), (1, "EMAIL", 2), (2, "CLIENT", 2)}
    known = redact.placeholders(redact.structured_spans(docs)).select("doc_id", "placeholder", "value").dropDuplicates(["doc_id", "placeholder"])
    back = {r["doc_id"]: r["text"] for r in redact.restore(clean, known).collect()}
    assert back[3] == "call 02 1234 5678 or 063-000"
    issues = {(r["doc_id"], r["issue"], r["value"]) for r in redact.verify(clean, known.select("doc_id", "placeholder")).collect()}
    assert issues == {(2, "UNKNOWN_PLACEHOLDER", "CLIENT_01")}


def test_values_match_spans_where_nothing_overlaps(docs):
    values = {(r["doc_id"], r["kind"], r["value"]) for r in redact.identifier_values(docs.where("doc_id <> 11")).collect()}  # a number behind its name may pass its check too
    spans = {(r["doc_id"], r["kind"], r["value"]) for r in redact.structured_spans(docs.where("doc_id <> 11")).collect()}
    assert values == spans


def test_intervals_and_score(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 8, 9), (1, 20, 21), (2, 1, 2)], "doc_id long, start int, end int")
    assert {tuple(r) for r in redact.merge_intervals(spans).select("doc_id", "start", "end").collect()} == {(1, 0, 9), (1, 20, 21), (2, 1, 2)}
    planted = spark.createDataFrame([(1, "A", 3, 5), (1, "A", 9, 12), (2, "B", 1, 2)], "doc_id long, kind string, start int, end int")
    assert {tuple(r) for r in redact.score(planted, spans).collect()} == {("A", 2, 1), ("B", 1, 1)}


def test_entity_map(spark):
    rows = spark.createDataFrame([("Acme  Ltd", "CLIENT_01", "CLIENT"), ("*acme* ltd", "CLIENT_02", "CLIENT"), ("Other", "CLIENT_3", "CLIENT"), ("", "CLIENT_04", "CLIENT")], "value string, placeholder string, kind string")
    assert {tuple(r) for r in redact.entity_map_issues(rows).collect()} == {("Acme  Ltd", "REPEATED_VALUE"), ("*acme* ltd", "REPEATED_VALUE"), ("Other", "PLACEHOLDER_SHAPE"), ("", "EMPTY_VALUE")}


def test_normalise(spark):
    row = redact.normalise(spark.createDataFrame([(1, "é\r\nx\ry"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text"] for r in row] == ["é\nx\ny", None]


def test_forms_of_the_reference(spark):
    rows = [(1, "Jane Citizen came"), (2, "born 3 June 1980"), (3, "lives at 12 Smith Court"), (4, "on 3-6-1980"), (5, "the Income Tax Assessment Act"), (6, "INCOME Tax ruling"), (7, "Act Jane Citizen"), (8, "at 7b St Kilda Rd"), (9, "ask Mr. Smith"), (10, "no name here")]
    found = redact.residual(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["kind"], r["value"]) for r in found.where("doc_id <> 8 or kind = 'ADDRESS'").collect()} == {
        (1, "PERSON", "Jane Citizen"), (2, "DATE", "3 June 1980"), (3, "ADDRESS", "12 Smith Court"), (4, "DATE", "3-6-1980"), (7, "PERSON", "Jane Citizen"), (8, "ADDRESS", "7b St Kilda Rd"), (9, "PERSON", "Mr. Smith"),
    }
    rows = [(1, "call (02) 1234 5678"), (2, "0412 345 678"), (3, "+61 2 1234 5678"), (4, "1300 123 456"), (5, "13 12 34"), (6, "ACN 004 085 616")]
    spans = redact.structured_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["kind"], r["value"]) for r in spans.collect()} == {(1, "PHONE", "(02) 1234 5678"), (2, "PHONE", "0412 345 678"), (3, "PHONE", "+61 2 1234 5678"), (4, "PHONE", "1300 123 456"), (5, "PHONE", "13 12 34"), (6, "ACN", "004 085 616")}


def test_counts_of_all_kinds(spark):
    from collections import Counter

    from tallywork.plans import queries, text_queries

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in text_queries.documents(spark, sf).collect()}
    spans, want = {}, Counter()
    for r in redact.placeholders(redact.structured_spans(text_queries.documents(spark, sf))).collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["placeholder"]))
        want[(r["doc_id"], r["kind"])] += 1
    names = sorted((v for v, _, _ in text_queries.ENTITIES), key=lambda v: (-len(v), v))
    entity = re.compile("|".join(rf"(?<!\w){'(?:[*_`]|\\s)+'.join(v.split())}(?!\w)" for v in names), re.IGNORECASE)
    for doc, text in texts.items():
        for a, e, p in sorted(spans.get(doc, []), reverse=True):
            text = text[:a] + p + text[e:]
        if n := len(entity.findall(text)):
            want[(doc, "CLIENT")] += n
    got = queries()["replacement_counts"](spark, sf).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["kind"]): r["n"] for r in got} == want and {"CLIENT", "EMAIL"} <= {k for _, k in want}


def test_long_texts_take_time_in_proportion(spark):
    """Four times the text, with as many more identifiers, takes less than eight times as long to scan and rebuild, and some seconds."""
    import time

    took = []
    for n in (2000, 8000):
        docs = spark.createDataFrame([(1, "\n".join(f"line {i} mail u{i}@x.example.org" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        spans = redact.placeholders(redact.structured_spans(docs))
        text = redact.replace_spans(docs, spans).first()["text"]
        took.append(time.time() - began)
        assert text.count("EMAIL_") == n and "@" not in text
    assert took[1] < 8 * took[0] + 5


def test_each_search_is_one_pass(spark):
    """A redaction searches a text once each for identifiers, the map and what is left, however many results are read."""
    d = spark.createDataFrame([(i, f"ABN 51 824 753 556, met Jane Citizen {i}" if i % 2 else "plain") for i in range(200)], "doc_id long, text string")
    passes = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert passes(redact.structured_spans(d)) == 1 and passes(redact.residual(d)) == 1
    clean, found, counts = redact.redact(d, [("Acme", "CLIENT_01", "CLIENT")])
    assert passes(counts) == 0  # read from what was written
    assert {r["doc_id"] for r in clean.collect()} == set(range(0, 200, 2)) and {r["kind"] for r in found.collect()} == {"PERSON"}


def test_texts_are_rebuilt_a_few_at_a_time(spark):
    """replacing and the search for cut numbers take texts from Arrow in slices, never a whole batch as Python objects; other columns stay."""
    d = spark.createDataFrame([(i, None if i % 7 == 0 else f"{i} é ab", float(i)) for i in range(200)], "doc_id long, text string, x double").coalesce(1)
    spans = d.where("doc_id % 2 = 1 and text is not null").selectExpr("doc_id", "CAST(length(text) - 2 AS INT) AS start", "length(text) AS end", "'Z_01' AS placeholder")
    done = redact.replace_spans(d, spans)
    for df in (done, numbers.cut_numbers(d, spans)):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" not in text and "MapInPandas" not in text and "MapInArrow" in text
    assert {tuple(r) for r in done.collect()} == {(i, None if i % 7 == 0 else f"{i} é Z_01" if i % 2 else f"{i} é ab", float(i)) for i in range(200)}


def test_restoring_uses_the_spans_of_the_redaction(spark, monkeypatch):
    """planted_restored searches each text for identifiers and for the map's values once."""
    from tallywork.plans import text_queries

    calls, own, named = [], redact.structured_spans, redact.entity_spans
    monkeypatch.setattr(redact, "structured_spans", lambda d: calls.append("own") or own(d))
    monkeypatch.setattr(redact, "entity_spans", lambda d, e: calls.append("named") or named(d, e))
    text_queries.Q["planted_restored"](spark, "/root/testdata/sf0.001")
    assert sorted(calls) == ["named", "own"]


def test_numbers_are_found_around_digits():
    """a search around digits finds what a search of the whole text does."""
    import random

    pick, patterns = random.Random(7), {k: p for k, (p, _) in redact.SPANS.items()} | {"behind:" + k: p for k, p in redact.LABELLED.items()}
    bits = ["51 824 753 556", "123 456 782", "063-000", "+61 (02) 1234 5678", "(02) 1234 5678", "1300 123 456", "2123 45678 1", "ABN: ", "Australian Business Number (ABN) card number: ", "Tax File Number (TFN) no.: ", "medicare ", "BSB ", "x", "é", "_", "\n", " ", "-", "7", "٣", "a" * 70, " " * 66, "word " * 13]
    whole, near = redact.patterns_in(patterns), redact.patterns_in(patterns, patterns.keys() - {"EMAIL"})
    seen = 0
    for _ in range(3000):
        text = "".join(pick.choices(bits, k=pick.randrange(1, 9)))
        want = list(whole(text))
        assert list(near(text)) == want, text
        seen += len(want)
    assert seen > 1000 and numbers.zones("a" * 500) == [] and numbers.zones("1" + "a" * 500 + "2") == [(0, 3), (437, 504)]
