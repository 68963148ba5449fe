"""An entity map's values in texts, whatever their case, composition, markup or wrapping: a lookup of word sequences, in time linear in the text.

A text and a value fold to the same atoms: words and single marks, in full casefolding. A map of up to MOST values goes to every Python worker as a
dictionary of atom sequences; a larger one is joined by a hash of the sequence.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbers import marker_places, merged, number_places, scan

#: Values of a map that every worker holds (about 100 bytes each).
MOST = 250_000
#: A word, with combining marks, or one other mark.
_ATOM = re.compile(r"[^\W_](?:[^\W_]|[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f])*|[^\w\s*`]")
_MARK = re.compile(r"[\s*_`]+")


def folded(value: str) -> str:
    """A value without case, composition, markup and repeated space."""
    return unicodedata.normalize("NFC", " ".join(_MARK.sub(" ", unicodedata.normalize("NFC", value).casefold()).split()))


def fold_column(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else folded(x))


def atoms(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(_ATOM.finditer(text))
    if unicodedata.is_normalized("NFC", text):  # then each part of it is
        return [m[0].casefold() for m in found], [m.span() for m in found]
    return [unicodedata.normalize("NFC", m[0]).casefold() for m in found], [m.span() for m in found]


class Lexicon:
    """Values by their atoms. Of values that fold alike the first by placeholder counts."""

    def __init__(self, entities: list[tuple[str, str, str]]):
        self.of: dict[tuple[str, ...], list[tuple[str, str, str]]] = {}
        for value, placeholder, kind in sorted(entities, key=lambda e: (e[1], e[0])):
            key = tuple(atoms(value)[0])
            if key:
                self.of.setdefault(key, []).append((folded(value), placeholder, kind))
        sizes: dict[str, set[int]] = {}
        for key in self.of:
            sizes.setdefault(key[0], set()).add(len(key))
        self.sizes = {k: sorted(v, reverse=True) for k, v in sizes.items()}

    def find(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        """(start, end, placeholder, kind), leftmost and longest first, none over another or a protected place. A sequence whose marks and spaces aren't the
        value's is no match."""
        names, places = atoms(text)
        kept = Protected(text)
        i = 0
        while i < len(names):
            step = 1
            for n in self.sizes.get(names[i], ()):
                if i + n <= len(names) and (held := self.of.get(tuple(names[i : i + n]))):
                    start, end = places[i][0], places[i + n - 1][1]
                    own = folded(text[start:end])
                    hit = next(((p, k) for f, p, k in held if f == own), None)
                    if hit and whole_words(text, start, end) and not kept.bars(start, end):
                        yield start, end, *hit
                        step = n
                        break
            i += step


def whole_words(text: str, start: int, end: int) -> bool:
    word = lambda c: c.isalnum()
    return not (start and word(text[start - 1]) and word(text[start]) or end < len(text) and word(text[end]) and word(text[end - 1]))


class Protected:
    """Places that no value may take: list markers that may be numbers, and a part of a written number. Found only once a match asks."""

    def __init__(self, text: str):
        self.text, self.places = text, None

    def bars(self, start: int, end: int) -> bool:
        if not any(c.isdecimal() for c in self.text[max(0, start - 3) : end + 3]):
            return False
        if self.places is None:
            self.places = merged(marker_places(self.text)), merged(number_places(self.text))
        for n, places in enumerate(self.places):
            k = bisect_left(places, (end, -1)) - 1
            if k >= 0 and places[k][1] > start and (n == 0 or not (start <= places[k][0] and places[k][1] <= end)):
                return True
        return False


def entity_spans(documents: DataFrame, entities: DataFrame | list[tuple[str, str, str]], most: int = MOST) -> DataFrame:
    """(doc_id, kind, start, end, value, line, placeholder) of a map's values (value, placeholder, kind) in documents; lines count from 1.

    Leftmost first, of those the longest, none over another. Null and empty texts give none. The map is counted: up to `most` values are sent to every
    worker, more are joined.
    """
    spark = documents.sparkSession
    table = spark.createDataFrame(entities, "value string, placeholder string, kind string") if isinstance(entities, list) else entities.select("value", "placeholder", "kind")
    few = table.limit(most + 1).collect() if not isinstance(entities, list) else entities
    if len(few) > most:
        return joined_spans(documents, table)
    held, made = spark.sparkContext.broadcast([tuple(r) for r in few]), []

    def find(text: str) -> Iterator[tuple[str, int, int, str]]:
        if not made:
            made.append(Lexicon(held.value))  # once a worker
        return ((k, a, e, p) for a, e, p, k in made[0].find(text))

    return scan(documents, find, "placeholder string")


def _key(names: list[str]) -> bytes:
    return blake2b("\0".join(names).encode(), digest_size=16).digest()


def joined_spans(documents: DataFrame, table: DataFrame) -> DataFrame:
    """entity_spans by a join on a digest of each sequence of atoms as long as some value; only digests and places are shuffled."""
    from .redact import arbitrate

    keyed = F.pandas_udf(lambda s: s.map(lambda x: _key(atoms(x or "")[0])), "binary")
    size = F.pandas_udf(lambda s: s.map(lambda x: len(atoms(x or "")[0])), "int")
    fold = F.pandas_udf(fold_column, "string")
    values = table.select(keyed("value").alias("key"), fold("value").alias("folded"), size("value").alias("n"), "placeholder", F.col("kind").alias("e_kind")).where("n > 0")
    values = values.groupBy("key", "folded").agg(F.min(F.struct("placeholder", "e_kind")).alias("e"))
    sizes = sorted(r["n"] for r in table.select(size("value").alias("n")).where("n > 0").distinct().collect())  # a few lengths
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                if not text:
                    continue
                names, places = atoms(text)
                kept, breaks, rows = Protected(text), [m.start() for m in re.finditer("\n", text)], []
                for i in range(len(names)):
                    for n in sizes:
                        if i + n <= len(names):
                            a, e = places[i][0], places[i + n - 1][1]
                            if whole_words(text, a, e) and not kept.bars(a, e):
                                rows.append((_key(names[i : i + n]), doc, a, e, text[a:e], bisect_left(breaks, a) + 1))
                yield pd.DataFrame(rows, columns=["key", "doc_id", "start", "end", "value", "line"])

    grams = documents.select("doc_id", "text").mapInPandas(run, f"key binary, doc_id {kind}, start int, end int, value string, line int")
    met = grams.join(values, "key").where(fold("value") == F.col("folded"))
    spans = met.select("doc_id", F.concat_ws("\0", "e.e_kind", "e.placeholder").alias("kind"), "start", "end", "value", "line", F.lit(0).alias("priority"))
    kept = arbitrate(spans)
    return kept.select("doc_id", F.substring_index("kind", "\0", 1).alias("kind"), "start", "end", "value", "line", F.substring_index("kind", "\0", -1).alias("placeholder"))
