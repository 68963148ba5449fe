"""Embeddings, pages, the pipeline and the registered queries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import tallywork.llm.embeddings as embeddings
from tallywork.llm import queries, urls

SF = "/root/testdata/sf0.001"
RULES = queries.URL_RULES


# -- 5: URLs -----------------------------------------------------------------------------------------------------------


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest] + [len(rest)])]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


URLS = [None, "", "no scheme", "http://", "http://ORG/", "https://a.Example.org/es/x?y#z", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/", "http://org", "http://com/de/", "http://x.com/fr/", "http://x.com?/de/", "ftp://u@h.com:80/de/#a://b", "http://com./de/", "http://é.com/de/ü", "http://a..org/\n/x", "x://y://example.org/es/"]


def test_urls(spark):
    rows = spark.createDataFrame([(i % 16, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted((r["page_id"], *(x or "" for x in r[1:])) for r in urls.judge_urls(rows, rules).collect())
    assert got == sorted((i % 16, *(x or "" for x in judged(u))) for i, u in enumerate(URLS * 2))
    assert urls.judge_urls(rows.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(rows, rules.limit(0)).collect()} == {"allow"}


def test_urls_of_many_path_lengths(spark):
    """More lengths than any list should have, and two rules of one host whose paths begin alike."""
    rules = [("h.example", "/" + "a" * n, "block" if n % 2 else "allow") for n in range(600)] + [("other.example", "/", "block"), (None, "/", "block")]
    rows = spark.createDataFrame([(n, f"http://www.h.example/{'a' * n}b") for n in range(0, 620, 31)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(rows, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    longest = {n: min(n, 599) for n in range(0, 620, 31)}
    assert got == {n: ("h.example/" + "a" * k, "block" if k % 2 else "allow") for n, k in longest.items()}


def test_urls_plan_is_native(spark):
    plan = queries.op5_url_filters(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# -- 7: embeddings -----------------------------------------------------------------------------------------------------


def linked(rows, least=0.98):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    links[i] += 1
                    links[j] += 1
                    a, b = root(rows[i][0]), root(rows[j][0])
                    parent[max(a, b)] = min(a, b)
    return sorted((r[0], links[k], root(r[0]), r[0] == root(r[0])) for k, r in enumerate(rows))


def vectors():
    rnd, rows = np.random.default_rng(4), []
    for i in range(240):
        base = rnd.normal(size=8) if i % 3 else rows[i // 2][1] if i else rnd.normal(size=8)
        rows.append((i, [float(np.float32(x)) for x in np.asarray(base) * (1 + i % 2) + rnd.normal(size=8) * 0.02 * (i % 5)], i % 2))
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0], [-0.0] + [1.0] * 7, [0.0] + [1.0] * 7]
    return rows + [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(1100, rows[1][1], None), (1101, rows[1][1], rows[1][2]), (1102, rows[1][1], rows[1][2])]


@pytest.mark.parametrize(("aim", "block"), [(2048, 512), (10, 7)])
def test_embeddings(spark, aim, block, monkeypatch):
    monkeypatch.setattr(embeddings, "AIM", aim)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("clash")).repartition(3)
    assert sorted(tuple(r) for r in embeddings.link_embeddings(df).collect()) == linked(rows)
    assert embeddings.link_embeddings(df.limit(0)).count() == 0


def test_embeddings_spanning_links():
    rnd = np.random.default_rng(5)
    for n in (1, 2, 30, 600):
        near = rnd.random((n, n)) < 1.2 / n
        near = (near | near.T) & ~np.eye(n, dtype=bool)
        ids, label = rnd.permutation(n) + 100, None
        label = ids.copy()
        for _ in range(n):
            label = np.minimum(label, np.where(near, label[None, :], 10**9).min(axis=1))
        assert dict(embeddings.spanning(near, ids)) == {int(i): int(c) for i, c in zip(ids, label, strict=True) if c < i}


# -- pipeline and queries ----------------------------------------------------------------------------------------------


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, n = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == docs.columns, name
        assert rows.count() <= n
        n = rows.count()
    assert n > 0
    kept = {r["doc_id"] for r in rows.select("doc_id").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == kept


def test_pipeline_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows and columns named like those of the operators; and no rows."""
    rnd = random.Random(5)
    fine, other = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    long = "\n".join(" ".join(f"y{rnd.randrange(900)}" for _ in range(12)) for _ in range(9000))
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, fine, None, "a", 9), (4, fine, "en", "a", 9), (5, other, "en", None, None), (5, other, "en", None, None), (6, long, "en", "a", 9), (7, "one two", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    clash = docs.withColumns({c: F.lit("own") for c in ("n_lines", "n_removed", "removed", "n_words", "kept", "component_id", "key", "c0", "ids")})
    for df, want in ((docs, {3: 1, 5: 2, 6: 1}), (clash, {3: 1, 5: 2, 6: 1}), (clash.limit(0), {})):
        columns, kinds = df.columns, df.dtypes
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == columns and df.dtypes == kinds
        found = df.collect()
        assert {i: sum(r["doc_id"] == i for r in found) for i in {r["doc_id"] for r in found}} == want
        assert all(r["n_chars"] == len(r["text"]) for r in found) and all(r[c] == "own" for r in found for c in columns if c in ("n_removed", "removed", "kept", "c0"))
        pieces = corpus_pipeline.STAGES[-1][1](spark, df, SF).collect()
        assert {r["doc_id"] for r in pieces} == set(want)


def test_pipeline_drops_near_copies_at_five_words(spark):
    rnd, rows = random.Random(4), []
    for i in range(80):
        words = [f"b{i % 8}w{j}" for j in range(100 + i % 8)]
        for at in rnd.sample(range(len(words)), rnd.randint(0, 3)):
            words[at] = f"r{i}x{at}"
        rows.append((i, " ".join(words), "en", "a", 9))
    rows += [(100, " ".join(f"e{j}" for j in range(100)), "en", "a", 9), (101, " ".join(f"e{j}" if j not in (30, 60) else "changed" for j in range(100)), "en", "a", 9)]  # 86 of 106 shingles of 5 words, 92 of 104 of 3
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((r[0], r[1].split()) for r in rows)}
    top = {i: i for i in sets}
    for _ in sets:
        top = {i: min(top[j] for j in sets if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in sets}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.ngram_jaccard(spark, docs, SF).collect()}
    assert kept == {i for i in sets if top[i] == i} and 101 not in kept


@pytest.mark.parametrize("name", [x for x in queries.queries() if x != "pipeline"])
def test_query_runs(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    out = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted(map(tuple, out.fetchall()), key=str)


def test_cells_are_fitted_on_the_given_table(spark, monkeypatch):
    """k-means runs whatever a label's size, and vectors visit several cells."""
    made = []
    monkeypatch.setattr(embeddings, "fit_cells", lambda sample, k, fit=embeddings.fit_cells: made.append(k) or fit(sample, k))
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert embeddings.link_embeddings(df).count() == df.count()
    assert made and made[0] >= embeddings.CELLS
