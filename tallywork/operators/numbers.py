"""Identifiers whose digits don't stand together: split by gaps, markup or a line wrap, cut by a replacement, read as list markers, or running into an address.

A text's runs of digits and the joints between them become arrays; windows of nine to eleven digits are checked for all places at once, so the work of a text
is in proportion to its digits. Python only finds places, a batch at a time; what follows is DataFrame work.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ABN_WEIGHTS, ACN_WEIGHTS, MEDICARE_WEIGHTS, TFN_WEIGHTS

#: What may stand between the groups of one written number, up to two of them (fixed values).
SEPARATORS = " \t-/.,‐‑‒–—―−"
#: Words that name an identifier beside a number, and how many characters away on its line (fixed values).
NAMES = ("tfn", "abn", "acn", "medicare", "tax file", "business number", "company number")
REACH = 40
#: Words before a bank account's number, and those between (fixed values).
ACCOUNTS, BETWEEN = ("account", "acct", "acc", "a/c"), ("number", "num", "no")

#: What lies between two runs of digits: part of one number, a wider gap on one line, a line wrap, an amount of money's edge, an end.
JOINED, APART, WRAPPED, MONEY, ENDED = range(5)

#: Texts that a worker looks at together.
SLICE = 64
_TAG = re.compile(r"<[A-Za-z/][^<>\n]*>|&[#A-Za-z][A-Za-z0-9]{0,9};")
_RUN = re.compile(r"\d+")
_DASHES = re.compile("[‐-―−­\\-\0]")
_WRAP = re.compile(r"(?:[ \t*_`~|]|\n(?:[ \t]*>)*)+")
_MONEY = re.compile(r"(?<![\d.,])(?:\d{1,3}(?:,\d{3})+|\d+)\.\d\d(?![\d])")
_NAMED = re.compile(rf"(?<![^\W_])(?:{'|'.join(NAMES)})(?![^\W_])", re.IGNORECASE)
_ACCOUNT = re.compile(rf"(?<![^\W_])(?:{'|'.join(map(re.escape, ACCOUNTS))})[\s:#.,\-=*_`(|\0]*(?:(?<![^\W_])(?:{'|'.join(BETWEEN)})[\s:#.,\-=*_`(|\0]*)?$", re.IGNORECASE)
_MARKER = re.compile(r"(?m)^[ \t>]*\d+[.)](?=\s|\Z)")
_TOKEN = re.compile(rf"\d(?:[{re.escape(SEPARATORS)}]{{0,2}}\d)*")
_DATE = re.compile(r"(?:(\d{4})[-/.](\d\d?)[-/.](\d\d?)|(\d\d?)[-/.](\d\d?)[-/.](\d{4}))(?!\d)")
_AMOUNT = re.compile(r"\d+\.\d+|\d{1,3}(?:,\d{3})+(?:\.\d+)?")
_GAP = rf"[{re.escape(SEPARATORS)}]?(?:[ \t*_]*\n[ \t>*_]*)?[{re.escape(SEPARATORS)}]?"
#: Identifiers that may go on in the next line: behind a name, and bare ones, whose check must hold.
_GROUPS = {"ABN": (2, 3, 3, 3), "MEDICARE": (4, 5, 1), "TFN": (3, 3, 3), "ACN": (3, 3, 3)}
_WRAPPED = [(kind, re.compile(rf"(?<![\d\w])({_GAP.join(rf'\d{{{n}}}' for n in sizes)})(?!\d)")) for kind, sizes in _GROUPS.items()]


#: Characters around a number in which its name stands, at most.
AROUND = 64


def zones(text: str) -> list[tuple[int, int]]:
    """Places around digits: AROUND characters before and two behind, joined where they meet. What holds digits, none of them AROUND apart, ends in one and begins
    less than AROUND before the first, is found there as in the whole text (a search from a place sees what stands before it)."""
    found: list[tuple[int, int]] = []
    for m in _RUN.finditer(text):
        a, e = max(0, m.start() - AROUND), m.end() + 2
        if found and a <= found[-1][1]:
            found[-1] = found[-1][0], e
        else:
            found.append((a, e))
    return found


def unmarked(text: str) -> str:
    """text with tags and character references blanked, place for place; a tag keeps its digits, as a number may stand in an attribute."""
    return _TAG.sub(lambda m: "\0" * len(m[0]) if m[0][0] == "&" else re.sub(r"\D", "\0", m[0]), text)


def joint(between: str) -> int:
    if len(between) <= 2 and not between.strip(SEPARATORS):
        return JOINED
    if "#" in between or any(c.isalnum() for c in between):
        return ENDED
    if "\n" not in between:
        return APART
    marks = _DASHES.sub("", between)
    return WRAPPED if marks.count("\n") == 1 and _WRAP.fullmatch(marks) else ENDED


def _hits(v: np.ndarray) -> dict[int, np.ndarray]:
    """width -> whether the window of digits that starts at each place passes a check of that many digits."""
    dot = lambda w: np.convolve(v, w[::-1], "valid")
    out = {}
    if len(v) >= 9:
        nine = (dot(TFN_WEIGHTS) % 11 == 0) | ((10 - dot((*ACN_WEIGHTS, 0)) % 10) % 10 == v[8:])
        out[9] = nine
    if len(v) >= 10:
        out[10] = (dot((*MEDICARE_WEIGHTS, 0, 0)) % 10 == v[8 : len(v) - 1]) & (v[: len(v) - 9] >= 2) & (v[: len(v) - 9] <= 6)
    if len(v) >= 11:
        medicare = (dot((*MEDICARE_WEIGHTS, 0, 0, 0)) % 10 == v[8 : len(v) - 2]) & (v[: len(v) - 10] >= 2) & (v[: len(v) - 10] <= 6)
        out[11] = ((dot(ABN_WEIGHTS) - 10) % 89 == 0) | medicare
    return out


def passes(digits: str) -> bool:
    found = _hits(np.array([int(c) for c in digits], np.int64)).get(len(digits))
    return bool(found is not None and found[0])


def near_name(text: str, start: int, end: int) -> bool:
    """Whether a word that names an identifier stands within REACH on the line; markup may stand between its words or inside one."""
    sides = text[max(0, start - REACH) : start].rsplit("\n", 1)[-1], text[end : end + REACH].split("\n", 1)[0]
    return any(_NAMED.search(" ".join(side.replace("\0", " ").split())) or _NAMED.search(side.replace("\0", "")) for side in sides)


def split_places(text: str, gone: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Places of runs of digits, not written as one number, that hold a window which passes a check; merged.

    A chain of runs ends at letters, digits elsewhere, `#` or a line break that isn't a wrap. A window that crosses a wrap takes whole runs; one that crosses
    the edge of an amount of money counts beside an identifier's name only. gone: places that were replaced; then windows that are cut by them count, those
    with digits both inside and outside.
    """
    if sum(m.end() - m.start() for m in _RUN.finditer(text)) < 9:  # no window is shorter
        return []
    text = unmarked(text)
    runs = [m.span() for m in _RUN.finditer(text) if m[0].isdecimal()]
    if not runs:
        return []
    starts, ends = np.array(runs).T
    money = np.zeros(len(runs), np.int64)
    for k, m in enumerate(_MONEY.finditer(text), 1):
        i, j = np.searchsorted(starts, m.span())
        money[i:j] = k
    kinds = [joint(text[a:b]) for a, b in zip(ends[:-1].tolist(), starts[1:].tolist(), strict=True)]
    kinds = np.array([MONEY if k != ENDED and (a or b) and a != b else k for k, a, b in zip(kinds, money[:-1].tolist(), money[1:].tolist(), strict=True)], np.int64)
    sizes = ends - starts
    run = np.repeat(np.arange(len(runs)), sizes)
    places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[run]
    v = np.array([int(text[a]) for a in places.tolist()], np.int64)
    first, last = places == starts[run], places == ends[run] - 1
    upto = lambda k: np.concatenate([[0], np.cumsum(np.isin(kinds, k))])[run]
    ended, wrapped, edged, crossed = upto(ENDED), upto(WRAPPED), upto(MONEY), upto((APART, WRAPPED, MONEY))
    inside = None
    if gone is not None:
        hit = np.zeros(len(places) + 1, np.int64)
        for a, b in gone:
            i, j = np.searchsorted(places, (a, b))
            hit[i:j] = 1
        inside = np.concatenate([[0], np.cumsum(hit[:-1])])
    found = []
    for width, ok in _hits(v).items():
        a = np.flatnonzero(ok)
        b = a + width - 1
        good = ended[a] == ended[b]
        good &= (wrapped[a] == wrapped[b]) | (first[a] & last[b])
        if inside is None:
            good &= crossed[a] != crossed[b]
        else:
            within = inside[b + 1] - inside[a]
            good &= (within > 0) & (within < width)
        for i, j in zip(a[good].tolist(), b[good].tolist(), strict=True):
            span = int(starts[run[i]]), int(ends[run[j]])
            if edged[i] == edged[j] or near_name(text, *span):
                found.append(span)
    return merged(found)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def number_places(text: str) -> list[tuple[int, int]]:
    """Written numbers of eight digits or more, or of six or seven behind a word for an account; a date in front is left out, and so are amounts that pass
    no check."""
    found = []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        lead = _DATE.match(m[0])
        if lead:
            y, mo, d = (lead[1], lead[2], lead[3]) if lead[1] else (lead[6], lead[5], lead[4])
            if not pd.isna(pd.to_datetime(f"{y}-{int(mo):02}-{int(d):02}", format="%Y-%m-%d", errors="coerce")):
                rest = m[0][lead.end() :]
                a += len(m[0]) - len(rest.lstrip(SEPARATORS))
        value = text[a:b]
        digits = "".join(c for c in value if c.isdecimal())
        labelled = 6 <= len(digits) <= 7 and _ACCOUNT.search(unmarked(text[max(0, a - REACH) : a]).rsplit("\n", 1)[-1])
        if (len(digits) >= 8 or labelled) and (not _AMOUNT.fullmatch(value) or passes(digits)):
            found.append((a, b))
    return found


def marker_places(text: str) -> list[tuple[int, int]]:
    """Identifiers, behind a name or passing their check, in which a line's list marker stands: the last group may be one, or a digit group. The markers are
    indexed once and looked up by bisection."""
    markers = [m.start() for m in _MARKER.finditer(text)]
    if not markers:
        return []
    found = set()
    for _, pattern in _WRAPPED:
        for m in pattern.finditer(text):
            k = bisect_left(markers, m.start(1))
            inside = k < len(markers) and markers[k] < m.end(1)
            if inside and (passes("".join(c for c in m[1] if c.isdecimal())) or near_name(text, *m.span(1))):
                found.add(m.span(1))
    return sorted(found)


def address_places(text: str, addresses: list[int]) -> list[tuple[int, int]]:
    """Written and split numbers in which an address starts: their last group is taken for a house number."""
    out = []
    for a, b in merged(number_places(text) + split_places(text)) if addresses else []:
        k = bisect_left(addresses, a + 1)
        if k < len(addresses) and addresses[k] < b:
            out.append((a, b))
    return out


def over(spans: list[tuple[int, int]], one: tuple[int, int]) -> bool:
    return any(a < one[1] and one[0] < b for a, b in spans)


def told(text: str, spans: list[tuple[int, int]], one: tuple[int, int]) -> bool:
    """Whether the spans, merged, hold every digit of one."""
    at = lambda i: bisect_left(spans, (i + 1, -1)) - 1
    return all((k := at(i)) >= 0 and spans[k][1] > i for i in range(*one) if text[i].isdecimal())


def scan(documents: DataFrame, find: Callable[[str], Iterable[tuple]], more: str = "") -> DataFrame:
    """(doc_id, kind, start, end, value, line, and the columns `more`) of what find(text) gives as (kind, start, end, ...): all kinds of a search in one pass.
    Null and empty texts give none. A worker holds the texts of SLICE documents as Python objects, and their rows, however large a batch is."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = [x.split()[0] for x in more.split(",") if x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = [b.schema.field("doc_id").type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.string() for _ in names]]
            for at in range(0, b.num_rows, SLICE):
                part, rows = b.slice(at, SLICE), []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if text:
                        breaks = [m.start() for m in re.finditer("\n", text)]
                        rows += [(doc, k, a, e, text[a:e], bisect_left(breaks, a) + 1, *rest) for k, a, e, *rest in find(text)]
                columns = zip(*rows, strict=True) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "kind", "start", "end", "value", "line", *names])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, kind string, start int, end int, value string, line int" + (f", {more}" if more else ""))


def numbers_in(address: str) -> Callable[[str], Iterator[tuple[str, int, int]]]:
    """A search of a text for (kind, start, end) of LONG_NUMBER, ACCOUNT_NUMBER, SPLIT_NUMBER, LIST_MARKER, ADDRESS_NUMBER. address: pattern of an address."""

    def find(text: str) -> Iterator[tuple[str, int, int]]:
        if not _RUN.search(text):
            return
        starts = [m.start() for m in re.finditer(address, text)]
        written, marked = number_places(text), marker_places(text)
        long = [(a, e) for a, e in written if sum(c.isdecimal() for c in text[a:e]) >= 8]
        account = [x for x in written if x not in set(long)]
        # an identifier that may be a list marker halts as such, unless what is left of the number holds one
        long = [x for x in long if not over(marked, x) or passes("".join(c for c in text[slice(*x)] if c.isdecimal()))]
        split = [x for x in split_places(text) if not told(text, merged(written), x) and x not in marked]
        for name, spans in (("LONG_NUMBER", long), ("ACCOUNT_NUMBER", account), ("SPLIT_NUMBER", split), ("LIST_MARKER", marked), ("ADDRESS_NUMBER", address_places(text, starts))):
            for a, e in spans:
                yield name, a, e

    return find


def find_numbers(documents: DataFrame, address: str) -> DataFrame:
    """(doc_id, kind, start, end, value, line) of texts, as numbers_in finds them. Null texts give none."""
    return scan(documents, numbers_in(address))


def cut_numbers(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, kind CUT_NUMBER, start, end, value, line): numbers of which the replaced spans (doc_id, start, end) take only a part."""
    per = spans.groupBy("doc_id").agg(F.collect_list("start").alias("a"), F.collect_list("end").alias("b"))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = [b.schema.field("doc_id").type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
            for at in range(0, b.num_rows, SLICE):
                rows = []
                for doc, text, x, y in zip(*[c.to_pylist() for c in b.slice(at, SLICE).columns], strict=True):
                    if text:
                        rows += [(doc, "CUT_NUMBER", s, e, text[s:e], text.count("\n", 0, s) + 1) for s, e in split_places(text, list(zip(x, y, strict=True)))]
                columns = zip(*rows, strict=True) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "kind", "start", "end", "value", "line"])

    return documents.join(per, "doc_id").select("doc_id", "text", "a", "b").mapInArrow(run, f"doc_id {kind}, kind string, start int, end int, value string, line int")
