"""The Merkle manifest against brute force, with blocks of one level and of three."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallywork.llm import merkle

SF = "/root/testdata/sf0.001"
ODD = [(None, None, None, None, None), (None, "X", None, None, None), (5, "AbC", "en", None, 3), (5, "AbC", "en", None, 3), (5, "abc", "en", None, 3), (7, "", "en", "solo", 0), (1, "A", "x", "é", 1), (2, "B", "x", "zz", 1), (9, "Long " * 50_000, "x", "zz", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "grp block pos n digest other before after subroot root leaf proof_sha256 folded_root verified copied at part level idx".split()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 16 * 16
        run = level[first : first + 16]
        out.append(("".join(run[: i - first]), "".join(run[i - first + 1 :])))
        i //= 16
    return out


def lowered(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {s: tree([leaf(r, r["text"]) for r in by[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    root, out = top[-1][0] if order else None, []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            at = leaf(r, lowered(r["text"]) if hit else r["text"])
            for before, after in path:
                at = sha(before + at + after)
            out.append((r["doc_id"], leaf(r, r["text"]), trees[s][-1][0], root, sha("".join(a + b for a, b in path)), at, at == root))
    return sorted(out, key=str)


def proved(df, depth):
    got = merkle.prove(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, depth=depth).collect()
    return got, sorted((tuple(r)[:-1] for r in got), key=str)


@pytest.mark.parametrize("depth", [1, 3])
def test_prove(spark, depth):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(ODD, SCHEMA))
    got, rows = proved(docs.withColumns({c: F.lit("clash") for c in CLASHES}), depth)
    assert rows == brute([r.asDict() for r in docs.collect()])
    for r in got:  # a version's new nodes end in its root
        assert r["copied"] is None or (r["copied"][-1] if r["copied"] else r["folded_root"]) == r["folded_root"]
    assert any(r["copied"] for r in got) and any(not r["verified"] for r in got)


def test_one_large_group(spark):
    docs = spark.range(0, 5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(5).cast("long").alias("n_chars"))
    assert proved(docs, 3)[1] == brute([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    docs = spark.createDataFrame(ODD[5 : 5 + n], SCHEMA)
    assert proved(docs, 3)[1] == brute([r.asDict() for r in docs.collect()])


def test_manifest(spark):
    docs = spark.range(0, 300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("lang"), (F.col("id") % 2).cast("string").alias("source"), F.lit(5).cast("long").alias("n_chars"))
    rows = [r.asDict() for r in docs.collect()]
    want = {(s, k, i, d) for s in "01" for k, level in enumerate(tree([leaf(r, "t") for r in rows if r["source"] == s])) if k for i, d in enumerate(level)}
    for depth in (1, 3):
        assert {tuple(r) for r in merkle.manifest(docs, depth=depth).collect()} == want


def test_a_version_shares_nodes():
    top = merkle.grow([sha(str(i)) for i in range(300)], 3)[-1][0]
    path = merkle.route(77, 3)
    other = top.copy(path, sha("x"))
    assert other.digest != top.digest and top.copy(path, sha("77")).digest == top.digest
    assert all(a is b for i, (a, b) in enumerate(zip(top.children, other.children, strict=True)) if i != path[0])
    assert all(a is b for i, (a, b) in enumerate(zip(top.children[path[0]].children, other.children[path[0]].children, strict=True)) if i != path[1])
