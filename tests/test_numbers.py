"""Split identifiers, list markers, cut numbers and entity maps on planted texts."""

import time

import pytest

from tallywork.operators import entity_map, numbers, redact
from tallywork.plans.text_queries import SPLITS


@pytest.mark.parametrize(("text", "want"), SPLITS)
def test_cases(spark, text, want):
    from pyspark.sql import functions as F  # noqa: F401

    written, split, marked = numbers.number_places(text), numbers.split_places(text), numbers.marker_places(text)
    values = {text[a:b] for a, b in written + split + marked}
    assert (not values) if want is None else want[1] in values


def test_digits_beside_a_number_dont_hide_it():
    for text in ("12345678 123   456   782", "123   456   7829", "2026123   456   782", "51   824   753   5569", "123﻿456﻿782", "123‎456‎782", "123`456`782"):
        spans = numbers.merged(numbers.number_places(text) + numbers.split_places(text))
        assert spans and spans[0][1] >= text.rindex("7") + 1, text


def test_cut_numbers(spark):
    text = "\n> 142   240   404\n667330 "
    assert [text[a:b] for a, b in numbers.split_places(text, [(15, 25)])] == ["142   240   404"]
    docs = spark.createDataFrame([(1, text), (2, None), (3, "142 240")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 15, 25), (3, 0, 3)], "doc_id long, start int, end int")
    assert [(r["doc_id"], r["value"], r["line"]) for r in numbers.cut_numbers(docs, spans).collect()] == [(1, "142   240   404", 2)]


def test_found_numbers_halt(spark):
    docs = spark.createDataFrame([(1, "<td>123</td><td>456</td><td>782</td>"), (2, "plain words"), (3, "A/C # 1234567"), (4, "TFN 123 456\n782. Next"), (5, "")], "doc_id long, text string")
    clean, found, _ = redact.redact(docs, [("Jane Roe", "PERSON_01", "PERSON")])
    assert {r["doc_id"] for r in clean.collect()} == {2, 5}
    assert {(r["doc_id"], r["kind"]) for r in found.collect()} == {(1, "SPLIT_NUMBER"), (3, "ACCOUNT_NUMBER"), (4, "LIST_MARKER")}


def test_time_grows_with_the_text():
    took = []
    for n in (3000, 12_000):
        text = "12 34 | 567, 89\n\n" * n + "<b 1" * n
        began = time.time()
        numbers.split_places(text), numbers.number_places(text), numbers.marker_places(text)
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 0.5


ENTITIES = [("Acme Pty Ltd", "CLIENT_01", "CLIENT"), ("Acme", "CLIENT_02", "CLIENT"), ("Straße AG", "CLIENT_03", "CLIENT"), ("José", "PERSON_01", "PERSON"), ("Unit 12", "CLIENT_04", "CLIENT"), ("A-B Co.", "CLIENT_05", "CLIENT"), ("ΣΟΦΟΣ", "PERSON_02", "PERSON")]
TEXTS = [
    (1, "acme **PTY**\nltd and Acme, not Acmes"), (2, "STRASSE ag; JOSÉ and jose"), (3, "Unit 12345678 and unit 12."), (4, "a-b co. but A - B Co."), (5, "σοφος"), (6, None), (7, ""), (8, "Acme Acme Pty Ltd"),
]


@pytest.mark.parametrize("most", [100, 3])
def test_entity_map(spark, most):
    """By lookup and, beyond the bound, by a join."""
    got = entity_map.entity_spans(spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(ENTITIES, "value string, placeholder string, kind string"), most)
    assert sorted((r["doc_id"], r["value"], r["placeholder"], r["line"]) for r in got.collect()) == sorted([
        (1, "acme **PTY**\nltd", "CLIENT_01", 1), (1, "Acme", "CLIENT_02", 2), (2, "STRASSE ag", "CLIENT_03", 1), (2, "JOSÉ", "PERSON_01", 1), (3, "unit 12", "CLIENT_04", 1), (4, "a-b co.", "CLIENT_05", 1), (5, "σοφος", "PERSON_02", 1),
        (8, "Acme", "CLIENT_02", 1), (8, "Acme Pty Ltd", "CLIENT_01", 1),
    ])


def test_large_maps_take_time_in_proportion_to_the_text():
    lexicon = entity_map.Lexicon([(f"name{i} of{i % 977} firm", f"CLIENT_{i:06}", "CLIENT") for i in range(100_000)])
    took = []
    for n in (20_000, 80_000):
        text = " ".join(f"name{i % 99_999} of{(i % 99_999) % 977} firm said" for i in range(n))
        began = time.time()
        assert sum(1 for _ in lexicon.find(text)) == n
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_folding(spark):
    rows = spark.createDataFrame([("Straße", "CLIENT_01", "CLIENT"), ("STRASSE", "CLIENT_02", "CLIENT"), ("Σοφος", "CLIENT_03", "CLIENT"), ("σοφοσ", "CLIENT_04", "CLIENT"), ("İx", "CLIENT_05", "CLIENT")], "value string, placeholder string, kind string")
    assert {tuple(r) for r in redact.entity_map_issues(rows).collect()} == {(v, "REPEATED_VALUE") for v in ("Straße", "STRASSE", "Σοφος", "σοφοσ")}


def test_split_numbers_stand_apart_from_streets(spark, tmp_path):
    """a document whose letters begin like a street is no part of the planted number."""
    import duckdb

    from tallywork.plans import text_queries

    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, "St St St Ct") for i in range(len(text_queries.SPLITS))] + [(100, None), (101, "")], "doc_id long, text string").write.parquet(path)
    got = sorted(tuple(r) for r in text_queries.split_numbers(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert got == sorted(con.execute(text_queries.S["split_numbers"]).fetchall())
