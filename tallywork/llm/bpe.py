"""Byte-level BPE as a monoid: halves are encoded apart and joined by re-encoding a growing window around the seam."""

from __future__ import annotations

import base64
import heapq
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_rows

#: Characters of text, bytes of one piece and ids that are handled without a further halving.
LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 8192, 1024, 65_536
#: Bytes of a piece up to which pairs are searched from one end to the other; a longer one keeps them in a heap.
SHORT = 24
#: Chunks remembered by a Python worker, each of at most this many characters; a full memory is emptied.
MEMO, MEMO_CHARS = 500_000, 64
#: Above every rank.
NONE = 1 << 40


class ByteBPE:
    """Encoder and decoder for a rank file (a line is a base64 token and its rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.byte = [self.ranks[bytes([x])] for x in range(256)]
        r = self.ranks
        self.pairs = {r[a] << 32 | r[b]: n for t, n in r.items() for i in range(1, len(t)) if (a := t[:i]) in r and (b := t[i:]) in r}
        keys = np.array(sorted(self.pairs), np.int64)
        self.pair_keys, self.pair_ranks = keys, np.array([self.pairs[x] for x in keys.tolist()], np.int64)
        self.find = regex.compile(pattern).findall
        self.space, self.apart = {"", *regex.findall(r"\s", "".join(map(chr, range(0x3001))))}, regex.compile(r"(?= \S)").split  # no white space is above U+3000
        self.memo: dict[str, bytes] = {}
        sizes = [len(self.tokens.get(n, b"")) for n in range(max(self.tokens) + 1)]
        self.known = np.array([n in self.tokens for n in range(len(sizes))])
        self.lengths, self.starts = np.array(sizes, np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(self.tokens.get(n, b"") for n in range(len(sizes))), np.uint8)

    # -- chunks of a text, pieces of a chunk -----------------------------------------------------------------------

    def chunks(self, text: str) -> list[str]:
        """text cut before every space that another character than white space follows. The pattern ends a match there whatever stands on
        either side, so the joined encodings of neighbouring chunks are the encoding of both: their seam needs no window."""
        return self.apart(text)

    def _unsafe(self, chunks: set[str]) -> set[str]:
        """Those of chunks, got by cutting before every space, that may lie inside a longer one."""
        return {x for x in chunks if x[:1] == " " and x[1:2] in self.space}

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern in a chunk (or any text), from its halves."""
        if len(text) <= LEAF_CHARS:
            return self.find(text)
        half = len(text) // 2
        return self._seam(self.pieces(text[:half]), self.pieces(text[half:]))

    def _seam(self, a: list[str], b: list[str]) -> list[str]:
        """Matches of the joined text. A match depends on at most two characters after its end, so those of a that end three before the
        seam stand; once a new match starts where one of b does, and ends clear of the window's edge, all later ones of b stand."""
        k = 4
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            left, right = "".join(a[i:]), "".join(b[:j])
            window = self.find(left + right)
            if j == len(b):
                return a[:i] + window
            starts, at = {}, len(left)
            for n, x in enumerate(b[:j]):
                starts[at] = n
                at += len(x)
            end = 0
            for n, x in enumerate(window):
                if end >= len(left) and end in starts and end <= at - 3:
                    return a[:i] + window[:n] + b[starts[end] :]
                end += len(x)
            k *= 2

    # -- ids of a piece --------------------------------------------------------------------------------------------

    def _merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals."""
        ranks, n = self.ranks, len(piece)
        if n <= SHORT:
            get, ids = self.pairs.get, [self.byte[x] for x in piece]
            pairs = [get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
            while pairs and (low := min(pairs)) != NONE:
                i = pairs.index(low)
                ids[i : i + 2] = (low,)
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = get(low << 32 | ids[i + 1], NONE)
                if i:
                    pairs[i - 1] = get(ids[i - 1] << 32 | low, NONE)
            return ids
        right, left, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = right[i] if end[i] else n
            if j >= n or end[j] != to or not end[i]:
                continue
            end[i], right[i], end[j] = to, right[j], 0
            if right[j] < n:
                left[right[j]] = i
                if (r := ranks.get(piece[i : end[right[j]]])) is not None:
                    heapq.heappush(heap, (r, i, end[right[j]]))
            if left[i] >= 0 and (r := ranks.get(piece[left[i] : to])) is not None:
                heapq.heappush(heap, (r, left[i], to))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = right[i]
        return out

    def _tree(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self._merge(piece)
        half = len(piece) // 2
        return self._join(self._tree(piece[:half]), self._tree(piece[half:]))

    def _join(self, a: list[int], b: list[int]) -> list[int]:
        """Re-encode k ids on either side, k four times as many until the outermost ones come out unchanged: ids are then neighbours that were
        encoded side by side before, and a sequence whose neighbours all encode to themselves is the encoding of its bytes."""
        k = 2
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            window = self._merge(b"".join(self.tokens[x] for x in a[i:] + b[:j]))
            if (i == 0 or window[0] == a[i]) and (j == len(b) or window[-1] == b[j - 1]):
                return a[:i] + window + b[j:]
            k *= 4

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self._tree(piece)

    def _merge_many(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids, as bytes, of pieces of at most SHORT bytes: as _merge, one merge in every piece at a time."""
        found: dict[bytes, bytes] = {}
        by_size = sorted(pieces, key=len)
        for low in range(0, len(by_size), 8192):
            part = by_size[low : low + 8192]
            n, width = len(part), max(len(part[-1]), 2)
            raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in part), np.uint8).reshape(n, width)
            sizes = np.array([len(x) for x in part])
            ids = np.where(np.arange(width) < sizes[:, None], np.array(self.byte, np.int64)[raw], -1)
            ids = np.concatenate([ids, np.full((n, 1), -1)], axis=1)
            ranks = self._rank_pairs(ids[:, :-1], ids[:, 1:])
            rows, cols = np.arange(n), np.arange(width)
            out_ids, out_sizes = np.full((n, width), -1, np.int64), sizes.copy()
            while len(rows):
                at = np.argmin(ranks, axis=1)
                lowest = ranks[np.arange(len(rows)), at]
                on = lowest < NONE
                if not on.all():
                    out_ids[rows[~on]] = ids[~on, :width]
                    rows, ids, ranks, at, lowest = rows[on], ids[on], ranks[on], at[on], lowest[on]
                    if not len(rows):
                        break
                k = np.arange(len(rows))
                ids[k, at] = lowest
                ids[:, :width] = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
                ranks[:, :-1] = np.take_along_axis(ranks, cols[:-1] + (cols[:-1] >= at[:, None]), axis=1)
                ranks[:, -1] = NONE
                ranks[k, at] = self._rank_pairs(lowest, ids[k, at + 1])
                left = at > 0
                ranks[k[left], at[left] - 1] = self._rank_pairs(ids[k[left], at[left] - 1], lowest[left])
                out_sizes[rows] -= 1
            flat, ends = out_ids[np.arange(width) < out_sizes[:, None]].astype(np.int32).tobytes(), np.cumsum(out_sizes) * 4
            for x, start, end in zip(part, (ends - 4 * out_sizes).tolist(), ends.tolist(), strict=True):
                found[x] = flat[start:end]
        return found

    def _rank_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where(b < 0, -1, a << 32 | b)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    # -- whole texts -----------------------------------------------------------------------------------------------

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: its chunks' ids, in order. A new chunk's pieces are encoded once for all texts."""
        memo = self.memo
        split = [self.chunks(x) if "\0" in x else x.replace(" ", "\0 ").split("\0") for x in texts]
        new = set().union(*split).difference(memo)
        doubtful = self._unsafe(new)
        if doubtful:
            for n, chunks in enumerate(split):
                if not doubtful.isdisjoint(chunks):
                    split[n] = self.chunks(texts[n])
            new = set().union(*split).difference(memo)
        pieces = {x: [p.encode() for p in self.pieces(x)] for x in new}
        ids = {p: b"" for ps in pieces.values() for p in ps}
        short = [p for p in ids if len(p) <= SHORT and p not in self.ranks]
        ids |= self._merge_many(short) if len(short) > 64 else {p: array("i", self._merge(p)).tobytes() for p in short}
        for p, x in ids.items():
            if not x:
                ids[p] = array("i", self.encode_piece(p)).tobytes()
        for x, ps in pieces.items():
            memo[x] = b"".join([ids[p] for p in ps])
        out = [np.frombuffer(b"".join([memo[x] for x in chunks]), np.int32) for chunks in split]
        for x in {x for x in new if len(x) > MEMO_CHARS} | self._unsafe(new):  # what is remembered is taken for a whole chunk
            del memo[x]
        if len(memo) > MEMO:
            memo.clear()
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids) -> bytes:
        """Bytes of ids, concatenated up the tree; an id without a token raises KeyError."""
        ids = np.asarray(ids, np.int64)
        if len(ids) > LEAF_IDS:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.known) and self.known[ids].all()):
            raise KeyError(f"ids without a token among {len(ids)}")
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.bytes[at].tobytes()


@lru_cache(2)
def codec(path: str, pattern: str) -> ByteBPE:
    """One per Python worker."""
    return ByteBPE(path, pattern)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """An Arrow list<int32> from arrays."""
    at = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) and, if asked for, decoded binary, the ids' bytes: each whole text's ids, each match of the pattern by
    itself, without special tokens.

    Null or empty text: no ids. A repeated row gives a repeated row; other columns are ignored, whatever their names; an empty table gives
    no rows. A map without a shuffle: a task holds one slice of texts at a time, and a very long text whole.
    """

    def run(keys, texts):
        bpe = codec(path, pattern)
        ids = bpe.encode_many([x or "" for x in texts])
        return [keys, lists(ids), *([pa.array([bpe.decode(x) for x in ids], pa.binary())] if decoded else [])]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col), F.col(text_col)), f"doc_id {kind}, ids array<int>" + ", decoded binary" * decoded, run)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded (doc_id, ids) with decoded binary; null ids: empty."""

    kind = encoded.schema["doc_id"].dataType.simpleString()
    out = T._parse_datatype_string(f"doc_id {kind}, ids array<int>, decoded binary")

    def run(batches):
        schema, bpe = to_arrow_schema(out), codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, valid = part.column(1), part.column(1).is_valid().to_pylist()
                texts = [bpe.decode(ids[n].values.to_numpy() if ok else []) for n, ok in enumerate(valid)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, out)
