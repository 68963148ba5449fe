"""Quality rules whose cutoffs follow each language and source, from mergeable quantile sketches."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, map_rows

#: White space that ends a word, and the symbols that count.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Rates in thousandths of a word or line, each with the percentage of documents whose quantile shows the group's spread, and how many
#: times that spread (upper quantile less median) a document may lie above the median. A quartile isn't moved by junk in up to a quarter of
#: the documents; rates that are 0 in almost all clean documents show their spread only near the end. chars: the mean word's length in
#: thousandths of a character.
RULES = {"symbols": (75, 8), "repeats": (98, 4), "dup_lines": (98, 4), "chars": (75, 8)}
#: The least spread of a group in which all are even: so many thousandths, and one part in EVEN of the median.
LEAST_SPREAD, EVEN = 5, 20
#: A group's quantiles are averaged with its language's, which count as so many documents, and a language's with the corpus's.
SHRINK = 50
#: A cutoff is at most so many times the language's, and a language's so many times the corpus's: a source of junk doesn't excuse itself.
BOUND = 2
#: Significant bits of a sketch's buckets: a quantile is low by one part in 2 ** (BITS - 1) at most.
BITS = 7

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word) of a whole text."""
    text = text or ""
    words = text.encode().split()  # bytes.split knows exactly SPACE
    lines, seen, dups, full = text.split("\n"), set(), 0, 0
    for line in lines:
        if line.strip(SPACE):
            full += 1
            dups += line in seen
            seen.add(line)
    repeats = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            times, last = Counter(windows), 0
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeats += i + 3 - max(i, last)
                    last = i + 3
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), dups, repeats, full


def measure_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(doc_id, *by, FEATURES) of each row; null text has no words."""
    keys = [id_col, *by]
    kinds = ", ".join(f"`{c}` {docs.schema[k].dataType.simpleString()}" for c, k in zip(["doc_id", *by], keys, strict=True))
    return map_rows(docs.select(*keys, text_col), f"{kinds}, {FEATURES}", lambda *c: [*c[:-1], *(zip(*map(measure, c[-1]), strict=True) if c[-1] else [[]] * 6)])


def rates() -> dict[str, F.Column]:
    return {
        "symbols": F.expr("1000 * n_symbols div greatest(n_words, 1)"),
        "repeats": F.expr("1000 * n_repeat_words div greatest(n_words, 1)"),
        "dup_lines": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"),
        "chars": F.expr("1000 * word_chars div greatest(n_words, 1)"),
    }


def bucket(x: F.Column) -> F.Column:
    """The lower end of x's bucket: x with all but its BITS leading bits cleared."""
    shift = F.greatest(F.length(F.bin(x)) - BITS, F.lit(0))
    return F.expr("1").cast("long") * x - F.pmod(x, F.pow(F.lit(2.0), shift).cast("long"))


def base_failed(alias: str = "") -> F.Column:
    n_words, n_repeats = F.col(f"{alias}n_words"), F.col(f"{alias}n_repeat_words")
    return (n_words < 50) | (100 * n_repeats > 50 * n_words)


def per_rate(part: int) -> F.Column:
    """RULES' figure number `part` of the column rate."""
    return F.create_map(*[F.lit(x) for k, v in RULES.items() for x in (k, v[part])])[F.col("rate")]


def thresholds(measured: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Upper cutoffs per group of `by`, a column max_* for each rate, and docs, the group's documents, from sketches: counts per bucket,
    which merge by addition in any order.

    The sketch is built once per group and added up for the language (the first of `by`) and for the corpus. A cutoff is the median plus
    RULES' multiple of the spread, both from the group's quantiles shrunk towards its language's (and the language's towards the corpus's)
    by their numbers of documents, so that there is no size at which a group changes sides; BOUND holds it from above.
    Documents that fail the base rules aren't sketched; a group without others is not in the result.
    """
    r = rates()
    sound = measured.where(~base_failed()).select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), v.alias("x")) for k, v in r.items()])).alias("s"))
    sketch = cut(sound.groupBy(*by, F.col("s.rate").alias("rate"), bucket(F.col("s.x")).alias("b")).agg(F.count("*").alias("n")), "quality-sketch")

    def quantiles(keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys, "rate")
        counts = sketch.groupBy(*keys, "rate", "b").agg(F.sum("n").alias("n"))
        ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy("b"))).withColumn("docs", F.sum("n").over(w))
        reached = lambda percent: F.min(F.when(100 * F.col("upto") >= percent * F.col("docs"), F.col("b")))
        return ranked.groupBy(*keys, "rate").agg(reached(F.lit(50)).alias("mid"), reached(per_rate(0)).alias("high"), F.max("docs").alias("docs"))

    def shrunk(part: str, own: str, wide: str) -> F.Column:
        return F.expr(f"({own}.docs * {own}.{part} + {SHRINK} * {wide}.{part}) div ({own}.docs + {SHRINK})").alias(part)

    def cutoff() -> F.Column:
        return F.col("mid") + per_rate(1) * F.greatest(F.col("high") - F.col("mid"), F.lit(LEAST_SPREAD), F.expr(f"mid div {EVEN}"))

    corpus = quantiles([]).withColumn("cutoff", cutoff()).alias("c")
    lang = quantiles([by[0]]).alias("l").join(F.broadcast(corpus), F.col("l.rate") == F.col("c.rate"))  # the corpus has a row for each rate
    lang = lang.select(F.col(f"l.{by[0]}").alias("__lang"), "l.rate", shrunk("mid", "l", "c"), shrunk("high", "l", "c"), (BOUND * F.col("c.cutoff")).alias("most"))
    lang = lang.withColumn("cutoff", F.least(cutoff(), "most")).alias("l")
    own = quantiles(list(by)).alias("o").join(lang, F.col(f"o.{by[0]}").eqNullSafe(F.col("l.__lang")) & (F.col("o.rate") == F.col("l.rate")))
    own = own.select(*[F.col(f"o.{c}").alias(c) for c in by], "o.rate", "o.docs", shrunk("mid", "o", "l"), shrunk("high", "o", "l"), (BOUND * F.col("l.cutoff")).alias("most"))
    own = own.withColumn("cutoff", F.least(cutoff(), "most"))
    return own.groupBy(*by).agg(*[F.max(F.when(F.col("rate") == k, F.col("cutoff"))).alias(f"max_{k}") for k in r], F.max("docs").alias("docs"))


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(doc_id, *by, FEATURES, base_failed, kept): whole texts judged by the base rules, then by their group's cutoffs.

    base_failed: under 50 words, or over half of the words stand in 3-word windows that the text repeats. kept: false if base_failed, or if
    a rate exceeds the cutoff of its language and source. Null and empty texts fail the base. Null languages and sources are groups of
    their own. Every row is returned once, repeated rows too; an empty table gives none. Other columns are ignored, whatever their names.
    A very long text is measured whole by one task, in time and memory in proportion to it.
    Features are written once and read for both passes; the cutoffs join by broadcast if they are few, else by a shuffle.
    """
    measured = cut(measure_documents(docs, id_col, text_col, by), "quality-features")
    limits = cut(thresholds(measured, by), "quality-limits").alias("t")
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"m.{c}").eqNullSafe(F.col(f"t.{c}"))
    joined = measured.withColumns({f"rate_{k}": v for k, v in rates().items()}).alias("m").join(bounded(limits), same, "left")
    base, kept = verdict()
    return joined.select("m.doc_id", *[F.col(f"m.{c}") for c in by], *[F.col(f"m.{c.split()[0]}") for c in FEATURES.split(", ")], base.alias("base_failed"), kept.alias("kept"))


def verdict() -> tuple[F.Column, F.Column]:
    """(base_failed, kept) over measured rows m joined to cutoffs t."""
    base = base_failed("m.")
    over = F.lit(False)
    for k in RULES:
        over = over | F.coalesce(F.col(f"m.rate_{k}") > F.col(f"t.max_{k}"), F.lit(False))
    return base, ~base & ~over


def filter_documents(docs: DataFrame, text_col: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of docs that judge_documents keeps, with docs' columns; judged by the same cutoffs, from docs itself.

    Texts are measured twice, for the cutoffs and for the verdict, so that no text is shuffled.
    """
    limits = cut(thresholds(cut(measure_documents(docs, text_col=text_col, by=by), "quality-features"), by), "quality-limits").alias("t")
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever docs' columns are named
    plain, at = docs.toDF(*names), docs.columns.index(text_col)
    kinds = ", ".join(f"{n} {t}" for n, t in plain.dtypes)
    measured = map_rows(plain, f"{kinds}, {FEATURES}", lambda *c: [*c, *(zip(*map(measure, c[at]), strict=True) if c[at] else [[]] * 6)])
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"m.{names[docs.columns.index(c)]}").eqNullSafe(F.col(f"t.{c}"))
    joined = measured.withColumns({f"rate_{k}": v for k, v in rates().items()}).alias("m").join(bounded(limits), same, "left")
    return joined.where(verdict()[1]).select(*[F.col(f"m.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)])
