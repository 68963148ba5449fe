"""Vector best-fit packing: bins have residual capacities of tokens, documents and attention cost."""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import shared_dir

#: Ids that a task gathers before it packs them: a law of the method, the same at every size.
EPOCH = 1 << 22
#: A bin is given out when it lacks at most this share of its tokens; the pieces of others are packed again with what follows.
SLACK = 1 / 256
#: Texts encoded at once; pieces, and chunks of odd texts, remembered by a Python worker.
BATCH, MEMO, MEMO_CHUNKS = 256, 1_000_000, 100_000
#: Sequence numbers of one task.
PER_TASK = 1 << 40
#: Above every rank; ids that no vocabulary has, between two texts.
NONE, APART = 1 << 40, b"\xff" * 4


class Encoder:
    """Ids of whole texts by a tokenizers file of lower-cased words with an end mark, as the tokenizers library gives them.

    Texts of plain Latin letters and marks, for which lower case is all that the file's normalizer does, are cut together into the pieces of its pattern;
    new pieces are merged together, one merge in every piece at a time, and remembered. Other texts, and those that may hold a special token, go through
    the library by the chunks between spaces, tabs and line feeds, which no token crosses; new ones once.
    """

    #: What the normalizer changes beyond case, or libraries class or split differently.
    odd = re.compile(r"[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]|<\|").search
    #: The pieces of plain texts, and what stands between two texts.
    find = re.compile(r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7]+|\x1c").findall
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        if self.pattern not in [x["pattern"]["Regex"] for x in told["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]:
            raise ValueError(f"{path} cuts words by another pattern")
        vocab, end = told["model"]["vocab"], told["model"]["end_of_word_suffix"]
        shown = [chr(x) for x in (*range(33, 127), *range(161, 173), *range(174, 256))]  # the byte-level alphabet: these bytes show themselves
        rest = [x for x in range(256) if chr(x) not in shown]
        letter = {x: chr(x) for x in range(256) if chr(x) in shown} | {x: chr(256 + n) for n, x in enumerate(rest)}
        self.inner = np.array([vocab[letter[x]] for x in range(256)], np.int64)
        self.last = np.array([vocab[letter[x] + end] for x in range(256)], np.int64)
        pairs = {}
        for rank, m in enumerate(told["model"]["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            pairs.setdefault(vocab[x] << 32 | vocab[y], (rank, vocab[x + y]))
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.zeros(len(told["model"]["merges"]) + 1, np.int64)
        for rank, made in pairs.values():
            self.made[rank] = made
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {"\x1c": APART}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where(b < 0, -1, a << 32 | b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_many(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """(piece, ids): the lowest rank first, leftmost of equal ones; pieces of like length together."""
        raw = [x.encode() for x in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        order, low = np.argsort(lengths, kind="stable"), 0
        while low < len(raw):
            part = order[low : low + max(64, min(8192, (1 << 17) // int(lengths[order[low]])))]
            low += len(part)
            n, sizes, part = len(part), lengths[part], part.tolist()
            width = int(sizes[-1])
            text = np.frombuffer(b"".join([raw[k].ljust(width, b"\0") for k in part]), np.uint8).reshape(n, width)
            ids = np.where(np.arange(width) < sizes[:, None], self.inner[text], -1)
            rows, cols = np.arange(n), np.arange(width)
            ids[rows, sizes - 1] = self.last[text[rows, sizes - 1]]
            ids = np.concatenate([ids, np.full((n, 2), -1)], axis=1)
            ranks = self._rank(ids[:, :-1], ids[:, 1:])
            out, left = np.full((n, width), -1, np.int64), sizes.copy()
            while len(rows):
                at = np.argmin(ranks, axis=1)
                k = np.arange(len(rows))
                best = ranks[k, at]
                on = best < NONE
                if not on.all():
                    out[rows[~on]] = ids[~on, :width]
                    rows, ids, ranks, at, best = rows[on], ids[on], ranks[on], at[on], best[on]
                    k = np.arange(len(rows))
                    if not len(rows):
                        break
                new = self.made[best]
                ids[k, at] = new
                ids[:, :width] = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
                ranks[:, :width] = np.take_along_axis(ranks, cols + (cols >= at[:, None]), axis=1)
                ranks[k, at] = self._rank(new, ids[k, at + 1])
                before = at > 0
                ranks[k[before], at[before] - 1] = self._rank(ids[k[before], at[before] - 1], new[before])
                left[rows] -= 1
            flat, ends = out[cols < left[:, None]].astype("<u4").tobytes(), np.cumsum(left) * 4
            yield from [(pieces[k], flat[a:b]) for k, a, b in zip(part, (ends - 4 * left).tolist(), ends.tolist(), strict=True)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        words, pieces = self.words, self.find("\x1c".join(texts).lower())
        ids = list(map(words.get, pieces))
        new = [k for k, x in enumerate(ids) if x is None]
        words.update(self.merge_many(list({pieces[k] for k in new})))
        for k in new:
            ids[k] = words[pieces[k]]
        out = b"".join(ids).split(APART)
        if len(words) > MEMO:
            words.clear()
            words["\x1c"] = APART
        return out

    def _other(self, texts: list[str]) -> list[bytes]:
        memo, split = self.memo, [x.replace("\n", " ").replace("\t", " ").split(" ") for x in texts]
        new = list(set().union(*split).difference(memo))
        memo.update((x, array("I", e.ids).tobytes()) for x, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True))
        out = [b"".join([memo[x] for x in chunks]) for chunks in split]
        if len(memo) > MEMO_CHUNKS:
            memo.clear()
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids."""
        odd = [n for n, x in enumerate(texts) if self.odd(x)]
        if not odd:
            return self._plain(texts) if texts else []
        found = dict(zip(odd, self._other([texts[n] for n in odd]), strict=True))
        if plain := [n for n in range(len(texts)) if n not in found]:
            found.update(zip(plain, self._plain([texts[n] for n in plain]), strict=True))
        return [found[n] for n in range(len(texts))]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


class VectorBestFit:
    """Bins with residual shares of three capacities: tokens, documents, attention cost (the squares of the pieces' lengths).

    place() takes the bin that has room for a piece in every capacity and is best by `rule`: "norm" leaves the least weighted square norm of
    the residuals, "dot" has the largest weighted dot product of residuals and demand. Of equal ones the oldest; without one a bin is opened.
    """

    def __init__(self, tokens: int, documents: int, attention: int, weights: tuple[float, float, float], rule: str):
        self.caps, self.weights, self.dot = np.array([tokens, documents, attention], np.int64), np.array(weights), {"norm": False, "dot": True}[rule]
        self.left = np.zeros((64, 3), np.int64)
        self.n = 0

    def demand(self, length: int) -> np.ndarray:
        return np.array([length, 1, length * length], np.int64)

    def place(self, length: int) -> int:
        need, left = self.demand(length), self.left[: self.n]
        fits = np.flatnonzero((left >= need).all(axis=1))
        if len(fits):
            if self.dot:
                best = np.argmax((left[fits] / self.caps * (need / self.caps)) @ self.weights)
            else:
                best = np.argmin(((left[fits] - need) / self.caps) ** 2 @ self.weights)
            at = int(fits[best])
        else:
            if (need > self.caps).any():
                raise ValueError(f"a piece of {length} tokens exceeds a capacity of an empty bin")
            if self.n == len(self.left):
                self.left = np.concatenate([self.left, np.zeros_like(self.left)])
            at, self.n = self.n, self.n + 1
            self.left[at] = self.caps
        self.left[at] -= need
        return at


def assign(lengths: np.ndarray, tokens: int, documents: int, attention: int, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> np.ndarray:
    """Bin of each piece, the longest first. Bins that lack room for the shortest piece are set aside, so a search meets open bins only."""
    bins, out, ids = VectorBestFit(tokens, documents, attention, weights, rule), np.zeros(len(lengths), np.int64), np.zeros(64, np.int64)
    shortest, made = int(lengths.min(initial=tokens)), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        before = bins.n
        at = bins.place(int(lengths[k]))
        if bins.n > before:
            if at >= len(ids):
                ids = np.concatenate([ids, np.zeros_like(ids)])
            ids[at] = made
            made += 1
        out[k] = ids[at]
        if (bins.left[at] < bins.demand(shortest)).any():
            last = bins.n - 1
            bins.left[at], ids[at], bins.n = bins.left[last], ids[last], last
    return out


def _schema(key: str, open_: bool) -> T.StructType:
    return T._parse_datatype_string(f"doc_id {key}, piece int, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long" + ", open boolean" * open_)


class _Task:
    """Packs what one task is given, EPOCH ids at a time."""

    def __init__(self, first: int, size: int, documents: int, attention: int, weights, rule: str):
        self.size, self.args, self.sequence = size, (size, documents, attention, weights, rule), first
        self.pieces: list[tuple] = []  # doc_id, piece, start, ids, doc_tokens
        self.held = 0

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.held += len(piece[3]) // 4

    def pack(self, last: bool) -> Iterator[tuple]:
        """Rows of bins that are given out. Others stay, at most half an epoch of ids; last: they are given with open true."""
        pieces = self.pieces
        lengths = np.array([len(p[3]) // 4 for p in pieces], np.int64)
        bins = assign(lengths, *self.args)
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        full = filled >= self.size - int(self.size * SLACK)
        if not last:  # the fullest go too, until half an epoch is left
            order = np.argsort(-filled, kind="stable")
            left = int(filled[~full].sum()) - EPOCH // 2
            for b in order[~full[order]].tolist():
                if left <= 0:
                    break
                full[b], left = True, left - int(filled[b])
        offsets = np.zeros(len(filled), np.int64)
        number = self.sequence + np.cumsum(full) - 1
        self.sequence += int(full.sum())
        self.pieces, self.held = [], 0
        for p, b, n in zip(pieces, bins.tolist(), lengths.tolist(), strict=True):
            if full[b]:
                yield (p[0], p[1], p[2], n, p[3], p[4], int(number[b]), int(offsets[b]), False)
                offsets[b] += n
            elif last:
                yield (p[0], p[1], p[2], n, p[3], p[4], None, None, True)
            else:
                self.add(p)

    def rest(self) -> Iterator[tuple]:
        """Rows of all bins, for the pieces that tasks left open."""
        lengths = np.array([len(p[3]) // 4 for p in self.pieces], np.int64)
        offsets: dict[int, int] = {}
        for p, b, n in zip(self.pieces, assign(lengths, *self.args).tolist(), lengths.tolist(), strict=True):
            yield (p[0], p[1], p[2], n, p[3], p[4], self.sequence + b, offsets.get(b, 0))
            offsets[b] = offsets.get(b, 0) + n
        self.sequence, self.pieces, self.held = self.sequence + int(max(offsets, default=-1)) + 1, [], 0


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def pack_best_fit(
    docs: DataFrame, path: str, size: int = 2048, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm",
    end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids binary, doc_tokens, sequence_id, offset).

    A document is its text's ids by the tokenizers file at `path`, without special tokens, and end_id. Only one with more than `size` ids is cut, into
    pieces of `size` ids, the last of which may be shorter. A sequence holds at most `size` ids, `documents` pieces (default: size, which no sequence
    exceeds) and an attention cost, the sum of the pieces' squared lengths, of `attention` (default: size squared, which no sequence exceeds); a piece goes
    to the sequence with room for it in all three that leaves the least weighted norm ("norm"), or has the largest weighted dot product ("dot"). Capacities
    that an empty sequence can't meet for some piece raise ValueError.

    Each task packs EPOCH ids at a time, longest piece first, and gives out the sequences that are full but for SLACK; what the rest hold is packed again
    with the next ids, and what is left of all tasks is packed together by as many tasks as its ids need. So a task holds about 1.5 * EPOCH ids and one
    batch of texts, whatever the size of the table; no text is shuffled. The first tasks' rows are written once to the shared folder.

    Null and empty texts are the end id alone; repeated rows are packed each; a very long text is many pieces; an empty table gives no rows; other columns
    are ignored, whatever their names. Equal lengths go in the order of the rows. ids: little-endian unsigned 32-bit integers.
    """
    spark, key = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    args = (size, size if documents is None else documents, size * size if attention is None else attention, weights, rule)
    first, final = _schema(key, True), _schema(key, False)

    def start() -> int:
        return (TaskContext.get().partitionId() if TaskContext.get() else 0) * PER_TASK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task, end = encoder(path), _Task(start(), *args), np.array([end_id], "<u4").tobytes()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH):
                    part = batch.slice(at, BATCH)
                    for doc, ids in zip(part.column(0).to_pylist(), code.encode_many([x or "" for x in part.column(1).to_pylist()]), strict=True):
                        ids += end
                        for k in range(0, len(ids), 4 * size):
                            task.add((doc, k // (4 * size), k // 4, ids[k : k + 4 * size], len(ids) // 4))
                            if task.held >= EPOCH:
                                yield from task.pack(False)
            yield from task.pack(True)

        yield from _batches(rows(), to_arrow_schema(first))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task((1 << 62) + start(), *args)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for r in batch.to_pylist():
                    task.add((r["doc_id"], r["piece"], r["start"], r["ids"], r["doc_tokens"]))
                    if task.held >= EPOCH:
                        yield from task.rest()
            yield from task.rest()

        yield from _batches(rows(), to_arrow_schema(final))

    where = f"{shared_dir(spark)}/best-fit-{uuid.uuid4().hex}"
    docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, first).write.partitionBy("open").parquet(where)
    packed = spark.read.schema(first).parquet(where)
    left = packed.where("open").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    rest = packed.where("open").select(*final.names[:6]).coalesce(max(1, -(-left // EPOCH))).mapInArrow(again, final)
    return packed.where("not open").select(*final.names).unionByName(rest)
