"""Token counts of fields and sections from one encoding of the whole document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import codec
from .common import map_rows

RULES = ("first", "last", "most")


def token_spans(path: str, pattern: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, counts): places in characters of the joined texts of each text's tokens, and the tokens of each text; a token of a part of a
    character's bytes spans that character. The texts are encoded each by itself, in one call."""
    bpe = codec(path, pattern)
    ids = bpe.encode_many(texts)
    counts = np.array([len(x) for x in ids], np.int64)
    sizes = bpe.lengths[np.concatenate([np.zeros(0, np.int32), *ids])]
    ends = np.cumsum(sizes)
    starts, whole = ends - sizes, "".join(texts)
    if whole.isascii():
        return starts, ends, counts
    char = np.cumsum((np.frombuffer(whole.encode(), np.uint8) & 0xC0) != 0x80, dtype=np.int32) - 1
    return char[starts], char[ends - 1] + 1, counts


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; bounds: the sections' first characters and, last, the text's length (sections tile the text, or texts one behind another, of
    which each may end in an empty section).

    A token that crosses a boundary counts once: for the section of its first character (`first`), of its last one (`last`), or for the
    one with most of its characters, the earlier of equals (`most`).
    """
    n = len(bounds) - 1
    first, last = np.searchsorted(bounds[:-1], starts, "right") - 1, np.searchsorted(bounds[:-1], ends - 1, "right") - 1
    own = last if rule == "last" else first.copy()
    if rule == "most":
        for k in np.flatnonzero(first != last):
            span = np.arange(first[k], last[k] + 1)
            own[k] = span[np.argmax(np.minimum(bounds[span + 1], ends[k]) - np.maximum(bounds[span], starts[k]))]
    return np.bincount(own, minlength=n)


def count_section_tokens(docs: DataFrame, path: str, pattern: str, fields: tuple[str, ...] = ("text",), rule: str = "first", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, field, section, char_start, char_end, n_tokens, doc_tokens): one row per line of each field.

    A document is its fields joined by newlines, encoded once. A section is a line with the newline after it; sections tile the document,
    so n_tokens adds up to doc_tokens. section counts a field's lines from 0; char_start and char_end are places in the document. A null
    field counts as empty and has one empty section; empty sections have no tokens. Repeated rows are each counted; an empty table gives no
    rows; other columns are ignored, whatever their names. Special tokens' strings are ordinary text here: spans are those of what the
    document says. A very long document is encoded whole by one task, others a slice of documents at a time. A map without a shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(keys, *columns):
        texts, name, section, sizes, lines = [], [], [], [], []
        for values in zip(*columns, strict=True):
            values = [x or "" for x in values]
            before = len(sizes)
            for f, v in zip(fields, values, strict=True):
                found = v.split("\n")
                name += [f] * len(found)
                section += range(len(found))
                sizes += [len(x) + 1 for x in found]
            sizes[-1] -= 1  # no newline after the last line
            lines.append(len(sizes) - before)
            texts.append("\n".join(values))
        bounds = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=bounds[1:])
        starts, ends, counts = token_spans(path, pattern, texts)
        own = attribute(starts, ends, bounds, rule)  # no token crosses from a text to the next
        at = np.repeat(np.cumsum([0, *map(len, texts)])[:-1], lines)
        key = [k for k, n in zip(keys, lines, strict=True) for _ in range(n)]
        return [key, name, section, *[pa.array(x.astype(np.int64)) for x in (bounds[:-1] - at, bounds[1:] - at, own, np.repeat(counts, lines))]]

    return map_rows(docs.select(id_col, *fields), f"doc_id {kind}, field string, section long, char_start long, char_end long, n_tokens long, doc_tokens long", run, texts=4 << 20)


__all__ = ["attribute", "count_section_tokens", "token_spans"]
