"""Vector best-fit packing: ids against the tokenizers library, every constraint, and the number of sequences."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import tallywork.llm.bestfit as bestfit

SF = "/root/testdata/sf0.001"
PATH = P.path("word_bpe_49k.json")
CLASHES = "piece start length ids doc_tokens sequence_id offset open".split()
ODD = [(1, None), (2, ""), (3, "One"), (3, "One"), (4, "word " * 20_000), (5, "a" * 9000), (6, "é日本🙂 ΑΣ İ <|endoftext|> x"), (7, " \n\t "), (None, "it's DON'T"), (8, "x" * 3 + "\x1c" + "y ź")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder(library):
    pick, letters = random.Random(3), "aAbZ éÀß'sTtreEll.,<|endoftext|>\n\t01½ÿſŁǅ日本́İıΣς🙂\xa0\x85\x1c-_&*  "
    texts = ["".join(pick.choice(letters) for _ in range(pick.randrange(40))) for _ in range(3000)]
    code = bestfit.Encoder(PATH)
    for _ in range(2):  # anew, and as remembered
        for text, got in zip(texts, code.encode_many(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def held(got, want, size, documents, attention):
    """Every document's pieces and every sequence's places, and each capacity."""
    docs, sequences = {}, {}
    for r in got:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
        assert r["length"] == len(r["ids"]) // 4
    for i, texts in want.items():
        tokens = {len(x) for x in texts}
        assert {r["doc_tokens"] for r in docs[i]} == tokens
        built = sorted([b"".join(r["ids"] for r in sorted(part, key=lambda r: r["start"])) for part in [[r for r in docs[i] if r["doc_tokens"] == n] for n in tokens]]) if len(texts) == len(tokens) else None
        assert built is None or built == sorted(np.array(x, "<u4").tobytes() for x in texts)
        assert sum(r["length"] for r in docs[i]) == sum(map(len, texts))
        for r in docs[i]:  # only long documents are cut, into whole pieces but for the last
            assert r["start"] == r["piece"] * size and r["length"] == min(size, r["doc_tokens"] - r["start"])
    assert set(docs) == set(want)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size and len(rows) <= documents and sum(r["length"] ** 2 for r in rows) <= attention
    return len(sequences)


def test_pack(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    want = {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append(ids(library, r["text"]))
    tokens = sum(len(x) for v in want.values() for x in v)
    got = bestfit.pack_best_fit(docs.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(7), PATH).collect()
    n = held(got, want, 2048, 2048, 2048**2)
    assert n <= 1.02 * tokens / 2048 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity(spark, library, rule, monkeypatch):
    monkeypatch.setattr(bestfit, "EPOCH", 500)  # several epochs, and pieces that tasks leave open
    docs = spark.createDataFrame([(i, "word " * (i % 60)) for i in range(300)], "doc_id long, text string").repartition(3)
    want = {r["doc_id"]: [ids(library, r["text"])] for r in docs.collect()}
    n = held(bestfit.pack_best_fit(docs, PATH, 64, 3, 64**2, rule=rule).collect(), want, 64, 3, 64**2)
    least = max(-(-sum(len(x[0]) for x in want.values()) // 64), 100)
    assert n <= 1.5 * least
    with pytest.raises(Exception, match="exceeds a capacity"):
        bestfit.pack_best_fit(docs, PATH, 64, 3, 100, rule=rule).collect()


def test_rules_differ():
    lengths = np.array([900, 700, 500, 400, 300, 200, 100, 90, 80] * 9)
    by_norm, by_dot = (bestfit.assign(lengths, 1000, 4, 1000**2, (1, 1, 1), r) for r in ("norm", "dot"))
    assert not np.array_equal(by_norm, by_dot)


def test_query(spark, library):
    from tallywork.llm.queries import op11_best_fit

    texts = {r["doc_id"]: ids(library, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op11_best_fit(spark, SF).collect():
        part = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())


def test_empty_table(spark):
    assert bestfit.pack_best_fit(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
