"""Pseudonymisation: identifier values and spans, arbitration, placeholders, entity map, residual sweep, halt, verify, restore.

Python only finds spans, a batch at a time; arbitration, numbering, rebuilding and all decisions are DataFrame work.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Collection, Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import abn_valid, acn_valid, medicare_valid, tfn_valid
from ..sources.staging import staged
from .entity_map import entity_spans, fold_column
from .numbers import SLICE, cut_numbers, numbers_in, scan, zones

#: kind -> (pattern, priority); Java, RE2 and Python read them alike.
PATTERNS = {
    "EMAIL": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 1),
    "ABN": (r"\b\d{2} ?\d{3} ?\d{3} ?\d{3}\b", 2),
    "MEDICARE": (r"\b[2-6]\d{3} ?\d{5} ?\d\b", 3),
    "TFN": (r"\b\d{3} ?\d{3} ?\d{3}\b", 4),
    "BSB": (r"\b\d{3}-\d{3}\b", 5),
    "PHONE": (r"\b0[23478] ?\d{4} ?\d{4}\b", 6),
    "ACN": (r"\b\d{3} ?\d{3} ?\d{3}\b", 7),
}
_AFTER = r"(?: card)?(?: number| no\.?)?:? ?"
#: kind -> pattern of a number behind its name, which is taken whether its check holds or not: the first group. Java, RE2 and Python read them alike.
LABELLED = {
    "ABN": rf"(?i)\b(?:ABN|A\.B\.N\.|Australian Business Number(?: \(ABN\))?){_AFTER}(\d{{2}}(?:[ -]?\d{{3}}){{3}})\b",
    "MEDICARE": rf"(?i)\bMedicare{_AFTER}(\d{{4}}[ -]?\d{{5}}[ -]?\d(?:[ /-]?\d)?)\b",
    "TFN": rf"(?i)\b(?:TFN|Tax File Number(?: \(TFN\))?){_AFTER}(\d{{3}}[ -]?\d{{3}}[ -]?\d{{2,3}})\b",
    "ACN": rf"(?i)\b(?:ACN|A\.C\.N\.|Australian Company Number(?: \(ACN\))?){_AFTER}(\d{{3}}(?:[ -]?\d{{3}}){{2}})\b",
    "BSB": rf"(?i)\bBSB{_AFTER}(\d{{3}}[ -]?\d{{3}})\b",
}
#: What spans are found by: identifier_values keeps to PATTERNS, which its SQL states.
SPANS = PATTERNS | {
    "PHONE": (r"(?<!\d)(?:\(0\d\) ?\d{4} ?\d{4}|04\d{2} ?\d{3} ?\d{3}|\+61 ?(?:\(0?\d\)|\d)(?: ?\d){8}|1[38]00 ?\d{3} ?\d{3}|13 ?\d{2} ?\d{2}|0[23478] ?\d{4} ?\d{4})(?!\w)", 6),
}
#: What is left is a candidate if it looks like one of these.
RESIDUAL = {
    "DATE": r"\b\d{1,2}/\d{1,2}/\d{4}\b|\b(?:0?[1-9]|[12]\d|3[01])(?:\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+|-(?:0?[1-9]|1[0-2])-)(?:19|20)\d{2}\b",
    "ADDRESS": r"\b\d{1,4}[A-Za-z]?(?:\s+[A-ZÀ-ÖØ-Þ][-'’A-Za-zÀ-ÖØ-öø-ÿ]+){1,2}\s+(?:Street|St|Road|Rd|Avenue|Ave|Drive|Dr|Court|Ct|Place|Pl|Lane|Ln|Parade|Pde|Crescent|Cres|Highway|Hwy|Terrace|Tce|Close|Way|Circuit|Boulevard|Esplanade|Grove)\b",
    "PERSON": r"\b(?:Mr|Mrs|Ms|Dr)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?\b",
    "PLACEHOLDER": r"\b(?:CLIENT|EMAIL|ABN|ACN|TFN|MEDICARE|BSB|PHONE)_\d{2,}\b",
}
#: Two or three capitalised words, and one of them.
_WORD = r"[A-ZÀ-ÖØ-Þ][-'’A-Za-zÀ-ÖØ-öø-ÿ]{1,20}"
NAME = rf"(?<![^\W_])(?<![^\W_]_){_WORD},?\s+{_WORD}(?:\s+{_WORD})?(?![^\W_])(?!_[^\W_])"
#: Capitalised words with one of these name no person (fixed values).
STATUTORY = "Act Regulation Schedule Division Subdivision Part Chapter Section Commissioner Minister Treasurer Commonwealth Australian Australia Board Tax Taxation Income Superannuation Court Tribunal Appeals Determination Notice Instrument Amendment".split()


def valid(kind: Column, value: Column) -> Column:
    """Whether a value's check digits hold; kinds without any pass."""
    digits = F.translate(value, " -", "")
    return F.when(kind == "ABN", abn_valid(digits)).when(kind == "ACN", acn_valid(digits)).when(kind == "TFN", tfn_valid(digits)).when(kind == "MEDICARE", medicare_valid(digits)).otherwise(F.lit(True))


def identifier_values(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, value): every match of every pattern whose check holds, and every number behind its name, found in Catalyst; overlaps are not
    decided here."""
    named = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("text", F.lit(p), 0), named(k)) for k, (p, _) in PATTERNS.items()]))
    bare = documents.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.kind", "x.value").where(valid(F.col("kind"), F.col("value")))
    behind = F.flatten(F.array(*[F.transform(F.regexp_extract_all("text", F.lit(p), 1), named(k)) for k, p in LABELLED.items()]))
    return bare.unionByName(documents.select("doc_id", F.explode(behind).alias("x")).select("doc_id", "x.kind", "x.value"))


def normalise(documents: DataFrame) -> DataFrame:
    """Texts with \\n line ends, in Unicode normal form C, for which Spark has no function."""

    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x.replace("\r\n", "\n").replace("\r", "\n")))

    return documents.withColumn("text", F.pandas_udf(nfc, "string")("text"))


def statutory(value: str) -> bool:
    """Whether a term of STATUTORY stands in value; in any case if one of its words is in capitals."""
    terms = rf"\b(?:{'|'.join(STATUTORY)})\b"
    return bool(re.search(terms, value)) or any(len(w) > 1 and w.isupper() for w in re.split(r"[\s,]+", value)) and bool(re.search(terms, value, re.IGNORECASE))


def person_names(text: str) -> list[tuple[int, int]]:
    """Places of two or three capitalised words without a statutory term; of three with one, the pairs without. A refused window goes on at its second word."""
    found, at, name, word = [], 0, re.compile(NAME), re.compile(_WORD)
    while m := name.search(text, at):
        if not statutory(m[0]):
            found.append(m.span())
            at = m.end()
            continue
        words = [w.span() for w in word.finditer(text, m.start(), m.end())]
        pairs = [(a, d) for (a, _), (_, d) in zip(words, words[1:], strict=False) if len(words) == 3 and not statutory(text[a:d])]
        found += pairs
        at = m.end() if pairs else words[1][0]
    return found


def names_in(text: str) -> Iterator[tuple[str, int, int]]:
    """(PERSON, start, end): names, and titles with one word that no name holds."""
    names = person_names(text)
    inside = {i for a, e in names for i in range(a, e)}
    more = [m.span() for m in re.finditer(RESIDUAL["PERSON"], text) if not inside & set(range(*m.span())) and not statutory(m[0])]
    return (("PERSON", a, e) for a, e in names + more)


def find_names(documents: DataFrame) -> DataFrame:
    """Spans as of find_spans, of kind PERSON."""
    return scan(documents, names_in)


def patterns_in(patterns: dict[str, str], numeric: Collection[str] = ()) -> Callable[[str], Iterator[tuple[str, int, int]]]:
    """A search of a text for (kind, start, end) of all matches, or of their first groups if a pattern has one. numeric: kinds of which a match is a number
    behind its name, so that they are searched around digits only (numbers.zones)."""

    def find(text: str) -> Iterator[tuple[str, int, int]]:
        near, whole = zones(text) if numeric else [], [(0, len(text))]
        for k, p in patterns.items():
            for a, e in near if k in numeric else whole:
                for m in re.compile(p).finditer(text, a, e):
                    yield k, *m.span(min(m.re.groups, 1))

    return find


def find_spans(documents: DataFrame, patterns: dict[str, str], numeric: Collection[str] = ()) -> DataFrame:
    """(doc_id, kind, start, end, value, line): all matches, in characters, or their first groups if a pattern has one; lines count from 1. Null texts
    give none."""
    return scan(documents, patterns_in(patterns, numeric))


def structured_spans(documents: DataFrame) -> DataFrame:
    """Spans of identifiers whose checks hold and of numbers behind their names, which come first, after arbitration. One pass finds both."""
    behind = "behind:"
    patterns = {k: p for k, (p, _) in SPANS.items()} | {behind + k: p for k, p in LABELLED.items()}
    spans = find_spans(documents, patterns, patterns.keys() - {"EMAIL"})
    named = F.col("kind").startswith(behind)
    rank = F.create_map(*[F.lit(x) for k, (_, n) in SPANS.items() for x in (k, n)])
    spans = spans.where(named | valid(F.col("kind"), F.col("value"))).withColumn("priority", F.when(named, 0).otherwise(rank[F.col("kind")]))
    return arbitrate(spans.withColumn("kind", F.regexp_replace("kind", f"^{behind}", "")))


def arbitrate(spans: DataFrame) -> DataFrame:
    """Non-overlapping spans of each document: the earliest start wins, then the longest, then the priority. A fold over each run of overlapping spans, which
    is short however many spans a document has."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(w))
    s = F.struct("start", (-F.col("end")).alias("back"), "priority", "end", "kind", "value", "line")
    per = spans.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(s)).alias("s"))
    none = F.filter("s", lambda x: F.lit(False))
    kept = F.aggregate("s", none, lambda acc, x: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["end"] <= x["start"]), F.concat(acc, F.array(x))).otherwise(acc))
    return per.select("doc_id", F.explode(kept).alias("x")).select("doc_id", "x.kind", "x.start", "x.end", "x.value", "x.line")


def merge_intervals(spans: DataFrame) -> DataFrame:
    """(doc_id, start, end): overlapping or touching spans as one, by gaps and islands."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("fresh", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(w)).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def once_a_line(spans: DataFrame) -> DataFrame:
    """(doc_id, kind, value, line, n): one candidate per value and line."""
    return spans.groupBy("doc_id", "kind", "value", "line").agg(F.count("*").alias("n"))


def placeholders(spans: DataFrame) -> DataFrame:
    """spans with `placeholder` KIND_nn, numbered per document and kind by first appearance of the value."""
    key = F.translate(F.lower("value"), " -", "")
    first = F.min("start").over(Window.partitionBy("doc_id", "kind", "key"))
    n = F.dense_rank().over(Window.partitionBy("doc_id", "kind").orderBy("first"))
    return spans.withColumn("key", key).withColumn("first", first).withColumn("n", n).withColumn("placeholder", F.concat_ws("_", "kind", F.when(F.col("n") < 10, F.lpad(F.col("n").cast("string"), 2, "0")).otherwise(F.col("n").cast("string")))).drop("key", "first", "n")


def replace_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """documents with each span's text replaced by its placeholder; spans don't overlap. Texts are rebuilt in one pass each."""
    per = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder"))).alias("s"))
    per = per.select("doc_id", *[F.col(f"s.{c}").alias(f"__{c}") for c in ("start", "end", "placeholder")])

    names = documents.columns
    at_text = names.index("text")

    def rebuilt(text: str | None, starts: list[int] | None, ends: list[int], marks: list[str]) -> str | None:
        if text is None or starts is None:
            return text
        parts, at = [], 0
        for start, end, mark in zip(starts, ends, marks, strict=True):
            parts += [text[at:start], mark]
            at = end
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                columns = b.slice(at, SLICE).columns
                texts = [rebuilt(*row) for row in zip(columns[at_text].to_pylist(), *[c.to_pylist() for c in columns[len(names) :]], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == at_text else c for n, c in enumerate(columns[: len(names)])], names=names)

    j = documents.join(per, "doc_id", "left").select(*names, "__start", "__end", "__placeholder")
    return j.mapInArrow(run, documents.schema)


def fold(value: Column) -> Column:
    """A value without case, composition, markup and repeated space, for which Spark has no function."""
    return F.pandas_udf(fold_column, "string")(value)


def entity_map_issues(entities: DataFrame) -> DataFrame:
    """(value, issue) of map rows (value, placeholder, kind): repeated folded values, placeholders of another shape than KIND_nn."""
    e = entities.withColumn("folded", fold(F.col("value"))).withColumn("n", F.count("*").over(Window.partitionBy("folded")))
    shape = F.col("placeholder").rlike(r"^[A-Z]+_\d{2,}$") & F.col("placeholder").startswith(F.concat("kind", F.lit("_")))
    issues = [("REPEATED_VALUE", F.col("n") > 1), ("PLACEHOLDER_SHAPE", ~shape), ("EMPTY_VALUE", F.col("folded") == "")]
    return e.select("value", F.explode(F.filter(F.array(*[F.when(c, F.lit(x)) for x, c in issues]), lambda x: x.isNotNull())).alias("issue"))


def residual(documents: DataFrame) -> DataFrame:
    """Candidates that no rule replaced: long, split and account numbers, numbers with a list marker or into an address, dates, addresses, names; statutory
    terms are none. One per value and line."""
    searches = patterns_in({k: p for k, p in RESIDUAL.items() if k not in ("PLACEHOLDER", "PERSON")}), numbers_in(RESIDUAL["ADDRESS"]), names_in
    return once_a_line(scan(documents, lambda text: chain.from_iterable(f(text) for f in searches)))


def carried_placeholders(documents: DataFrame) -> DataFrame:
    """Placeholders that the input holds already: they are candidates too."""
    return once_a_line(find_spans(documents.where(F.col("text").contains("_")), {"PLACEHOLDER": RESIDUAL["PLACEHOLDER"]}))


def redact(documents: DataFrame, entities: DataFrame | list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean, candidates, counts): redacted texts of documents without a candidate, the candidates that halt the others, and replacements by document and kind.
    A number of which only a part was replaced halts, whatever the entity map takes of the rest."""
    own, once, named = replacements(documents, entities)
    return redacted(documents, own, once, named)


def replacements(documents: DataFrame, entities: DataFrame | list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(own, once, named): identifiers' spans, texts without them, and the map's spans in those. Each is written, as several results read it: else each would
    search the texts again."""
    own = staged(placeholders(structured_spans(documents)), "own-spans")
    once = staged(replace_spans(documents.select("doc_id", "text"), own), "replaced")
    return own, once, staged(entity_spans(once, entities), "named-spans")


def redacted(documents: DataFrame, own: DataFrame, once: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean, candidates, counts), as of redact, of what replacements() gave."""
    done = staged(replace_spans(once, named), "done")
    found = residual(done).unionByName(carried_placeholders(documents)).unionByName(once_a_line(cut_numbers(documents, own)))
    clean = done.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    counts = own.select("doc_id", "kind").unionByName(named.select("doc_id", "kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))
    return clean, found, counts


def verify(clean: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, issue, value): identifiers that are left in redacted texts, and placeholders without a map row (doc_id, placeholder)."""
    left = structured_spans(clean).select("doc_id", F.lit("IDENTIFIER_LEFT").alias("issue"), "value")
    used = find_spans(clean, {"PLACEHOLDER": RESIDUAL["PLACEHOLDER"]}).select("doc_id", F.col("value").alias("placeholder")).distinct()
    lost = used.join(known, ["doc_id", "placeholder"], "left_anti").select("doc_id", F.lit("UNKNOWN_PLACEHOLDER").alias("issue"), F.col("placeholder").alias("value"))
    return left.unionByName(lost)


def restore(clean: DataFrame, known: DataFrame) -> DataFrame:
    """clean with placeholders replaced by their values; known: (doc_id, placeholder, value), the first value of a placeholder."""
    spans = find_spans(clean, {"PLACEHOLDER": RESIDUAL["PLACEHOLDER"]}).select("doc_id", "start", "end", F.col("value").alias("placeholder"))
    back = spans.join(known.select("doc_id", "placeholder", "value"), ["doc_id", "placeholder"]).select("doc_id", "start", "end", F.col("value").alias("placeholder"))
    return replace_spans(clean, back)


def disclosure(clean: DataFrame, entity_map_sha256: str, destination: str, decision: str) -> DataFrame:
    """One record per clean document: digests, destination, decision."""
    return clean.select("doc_id", F.sha2("text", 256).alias("payload_sha256"), F.lit(entity_map_sha256).alias("map_sha256"), F.lit(destination).alias("destination"), F.lit(decision).alias("decision"))


def recheck(records: DataFrame, clean: DataFrame) -> DataFrame:
    """(doc_id, state) of records against texts: SAME, CHANGED, MISSING."""
    j = records.join(clean.select("doc_id", F.sha2("text", 256).alias("now")), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("now").isNull(), "MISSING").when(F.col("now") == F.col("payload_sha256"), "SAME").otherwise("CHANGED").alias("state"))


def score(planted: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, planted, caught): planted spans (doc_id, kind, start, end) that found spans contain."""
    p = planted.withColumn("id", F.struct("doc_id", "start", "end"))
    f = found.select(F.col("doc_id").alias("d"), F.col("start").alias("a"), F.col("end").alias("b"))
    hit = p.join(f, (F.col("doc_id") == F.col("d")) & (F.col("a") <= F.col("start")) & (F.col("b") >= F.col("end")), "left_semi").select("id").withColumn("caught", F.lit(1))
    return p.join(hit.distinct(), "id", "left").groupBy("kind").agg(F.count("*").alias("planted"), F.count("caught").alias("caught"))
