"""Repeated runs of lines, found by winnowing over line hashes and deleted where they come later."""

from __future__ import annotations

from hashlib import blake2b

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import among, cut, map_rows

#: A run of lines counts as repeated from this many words on.
MIN_WORDS = 50


def _hash(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def windows(text: str | None, min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes, bytes]]:
    """(first line, last line, hash of the lines, fingerprint) of the shortest windows of at least min_words words that begin, or end, at a
    line. The fingerprint is the least line hash of the window, the last of equals: equal windows select the same."""
    lines = [x.encode() for x in (text or "").split("\n")]
    words, hashes = [len(x.split()) for x in lines], [_hash(x) for x in lines]
    spans, end, n = set(), 0, 0
    for start in range(len(lines)):
        while end < len(lines) and n < min_words:
            n += words[end]
            end += 1
        if n < min_words:
            break
        spans.add((start, end - 1))
        n -= words[start]
    start, n = len(lines) - 1, 0
    for last in range(len(lines) - 1, -1, -1):
        while start >= 0 and n < min_words:
            n += words[start]
            start -= 1
        if n < min_words:
            break
        spans.add((start + 1, last))
        n -= words[last]
    return [(a, b, hashes[a] if a == b else _hash(b"".join(hashes[a : b + 1])), min(hashes[a : b + 1])) for a, b in sorted(spans)]


def line_matches(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, first_line, last_line, source_id, source_key, source_line): runs of lines with at least min_words words that stand,
    line for line, at an earlier place of the table, which begins at source_line of the source; written. text_key: the text's MD5.

    Winnowing: each window of just min_words words selects its least line hash, so a repeated run has a fingerprint in each of its windows.
    Fingerprints that stand once drop their windows. Positions of the others are joined to the first position with the same window around the
    fingerprint, never in pairs of all: one row per window, however often a passage stands. A match is extended both ways over the
    matches that touch it and have the same source at the same distance. Extending it line by line against one earlier position would lose
    runs whose windows first stand in different documents; against all of them it would meet every pair.
    Joins are of written tables, so AQE splits a hot line.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))

    def run(keys, digests, texts):
        out = [[] for _ in range(6)]
        for doc, digest, text in zip(keys, digests, texts, strict=True):
            for window in windows(text, min_words):
                for col, x in zip(out, (doc, digest, *window), strict=True):
                    col.append(x)
        return out

    at = F.struct("doc_id", "text_key", "first_line")
    seen = cut(map_rows(rows.where("text is not null"), f"doc_id {kind}, text_key string, first_line int, last_line int, lines binary, fingerprint binary", run), "line-windows")
    places = cut(seen.groupBy("fingerprint").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a != b").select("fingerprint"), "line-fingerprints")
    near = cut(seen.join(places, "fingerprint", "left_semi").drop("fingerprint"), "line-candidates")
    firsts = cut(near.groupBy("lines").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first != last").select("lines", "first"), "line-firsts")
    met = near.join(firsts, "lines").where(at > F.col("first"))
    met = cut(met.select("doc_id", "text_key", "first_line", "last_line", "first", (F.col("first_line") - F.col("first.first_line")).alias("shift")).distinct(), "line-repeats")
    ways = ["doc_id", "text_key", F.col("first.doc_id"), F.col("first.text_key"), "shift"]  # one document's windows with one source
    w = Window.partitionBy(*ways).orderBy("first_line", "last_line")
    fresh = F.coalesce(F.col("first_line") > F.max("last_line").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    run_no = F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = met.withColumn("run", run_no).groupBy(*ways[:2], F.col("first.doc_id").alias("source_id"), F.col("first.text_key").alias("source_key"), "shift", "run")
    runs = runs.agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"))
    return cut(runs.select("doc_id", "text_key", "first_line", "last_line", "source_id", "source_key", (F.col("first_line") - F.col("shift")).alias("source_line")), "line-matches")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its text less later repeats, and n_lines, n_removed, removed array<int> (line numbers from 0).

    Documents are ordered by doc_id, then by a digest of the text. A line goes if it lies in a run of consecutive lines with at least
    min_words words in all that stands, line for line, at an earlier place: in an earlier document, or earlier in the same one. First
    occurrences stay. Words are runs without ASCII white space; lines end at \\n only. Rows equal in doc_id and text count as one document and all
    come out alike. Null texts stay null with no line; a text whose lines all go becomes empty; an empty table stays empty. A very long text
    is hashed whole by one task. Clashing columns n_lines, n_removed and removed are replaced.

    The runs are those of line_matches. Only documents that may lose lines are shuffled to meet them, told apart by a bitmap of their ids.
    """
    matches = line_matches(docs, min_words, id_col, text_col)
    gone = matches.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first_line", "last_line")).alias("spans"))
    removed = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first_line"], s["last_line"])))))
    gone = cut(gone.select("doc_id", "text_key", removed.alias("removed")), "line-deletions")
    kept = docs.drop("n_lines", "n_removed", "removed")
    names, text = kept.columns, F.col(text_col)
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n", -1))).cast("long").alias("n_lines")
    none = F.array().cast("array<int>")

    def cleaned(rows: DataFrame) -> DataFrame:
        d = rows.select(F.struct(*names).alias("d"), F.md5(text).alias("key"))
        # merged at any size: the plan doesn't change with the number of deletions
        joined = d.join(gone.hint("merge").alias("g"), F.col(f"d.{id_col}").eqNullSafe(F.col("g.doc_id")) & (F.col("key") == F.col("g.text_key")), "left").select("d.*", "g.removed")
        lines = F.split(text, "\n", -1)
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
        less = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
        return joined.select(
            *[less.alias(c) if c == text_col else c for c in names], n_lines, F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", none).alias("removed")
        )

    told = among(kept, gone, id_col)
    if told is None:
        return cleaned(kept)
    same = told.where("not __in").select(*names, n_lines, F.lit(0).cast("long").alias("n_removed"), none.alias("removed"))
    return cleaned(told.where("__in").select(*names)).unionByName(same)
