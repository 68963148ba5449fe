"""Sum-of-squares online packing of documents into token windows."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Ids after which the windows that are open exchange pieces, as they do at a partition's end: a law of the method, the same at every size,
#: which bounds what a task holds to so many ids and one document.
EPOCH = 1 << 20
#: Pieces of one batch given out.
GIVEN = 512
#: Strings of byte_bpe_50k.json that are tokens of their own, with their ids.
SPECIAL = {"<|endoftext|>": 50256}
#: Sequence numbers of one partition.
PER_PARTITION = 1 << 40

#: A piece: row of its document, first id's place in the document, ids as little-endian 32-bit integers.
Piece = tuple[int, int, bytes]


@lru_cache(2)
def encoder(path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()) -> Callable[[str], list[int]]:
    """One per Python worker, from a rank file; a string in special is its token wherever it stands in a text."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
    names = [x for x, _ in special]
    return lambda text: coder.encode(text, allowed_special="all") if any(x in text for x in names) else coder.encode_ordinary(text)


class Packer:
    """Windows of `size` ids. level[h] counts the open windows that hold h ids; a document goes to the level at which the sum of squared
    counts grows least. Only open windows are held."""

    def __init__(self, size: int):
        self.size = size
        self.level = np.zeros(size + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]

    def place(self, row: int, ids: bytes) -> Iterator[list[Piece]]:
        """Take a document's ids; yields the windows that become full. What exceeds a window fills windows of its own first."""
        n, width = len(ids) // 4, 4 * self.size
        whole = n // self.size
        for k in range(whole):
            yield [(row, k * self.size, ids[k * width : (k + 1) * width])]
        n -= whole * self.size
        if not n:
            return
        level, room = self.level, self.size - n
        cost = np.empty(room + 1, np.int64)  # of starting from level h, for which h + n is the new level
        cost[:room] = 2 * level[n : n + room] + 1
        cost[room] = 0  # a full window is no level
        cost[1:] -= 2 * level[1 : room + 1] - 1
        cost[1:][level[1 : room + 1] == 0] = np.iinfo(np.int64).max
        h = room - int(np.argmin(cost[::-1]))  # of equal ones the fullest
        window = self.open[h].pop() if h else []
        if h:
            level[h] -= 1
        window.append((row, whole * self.size, ids[whole * width :]))
        if h + n == self.size:
            yield window
            return
        level[h + n] += 1
        self.open[h + n].append(window)

    def pour(self, keep: bool = False) -> Iterator[list[Piece]]:
        """Empty all open windows into full ones, cutting pieces where a window ends; keep: the last one stays open, else it is given too."""
        window, held = [], 0
        pieces = [p for level in reversed(self.open) for w in level for p in w]
        self.__init__(self.size)
        for row, start, ids in pieces:
            while ids:
                part, ids = ids[: 4 * (self.size - held)], ids[4 * (self.size - held) :]
                window.append((row, start, part))
                start += len(part) // 4
                held += len(part) // 4
                if held == self.size:
                    yield window
                    window, held = [], 0
        if window and keep:
            self.level[held] = 1
            self.open[held].append(window)
        elif window:
            yield window


def pack_documents(
    docs: DataFrame, path: str, pattern: str, size: int = 1024, end_id: int = 0, special: dict[str, int] = SPECIAL, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids binary, doc_tokens, sequence_id, offset).

    Each document's ids and end_id after them are packed into sequences of at most `size` ids. Every id lies in one piece; a document's
    pieces are numbered by start, a sequence's by offset, both without gaps from 0. Documents that fit stay whole, but for what windows
    exchange that are open after EPOCH ids or at a partition's end: they are poured together, so a partition leaves one sequence with
    padding at most. Null and empty texts are the end id alone; repeated rows are packed each; a text longer than a sequence fills some by
    itself; an empty table gives no rows; other columns are ignored, whatever their names. A string in special gives its id. Each input
    partition is packed by itself while it is read: no shuffle, and a task holds one batch and the windows opened within EPOCH ids.
    ids: little-endian unsigned 32-bit integers.
    """
    key = docs.schema[id_col].dataType
    kind = T._parse_datatype_string(f"doc_id {key.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, encode, packer, end = to_arrow_schema(kind), encoder(path, pattern, tuple(special.items())), Packer(size), np.array([end_id], "<u4").tobytes()
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) * PER_PARTITION
        pa.default_memory_pool().release_unused()  # a reused worker keeps what earlier stages' batches took
        held: dict[int, list] = {}  # row -> id, ids in all, ids not yet given out
        row, placed, out = 0, 0, []

        def give(windows: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for window in windows:
                at = 0
                for r, start, ids in window:
                    doc = held[r]
                    out.append((doc[0], start, len(ids) // 4, ids, doc[1], sequence, at))
                    at += len(ids) // 4
                    doc[2] -= len(ids) // 4
                    if not doc[2]:
                        del held[r]
                sequence += 1

        def full() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return got

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array(encode(text.as_py() or ""), "<u4").tobytes() + end
                held[row] = [doc, len(ids) // 4, len(ids) // 4]
                give(packer.place(row, ids))
                row, placed = row + 1, placed + len(ids) // 4
                if placed >= EPOCH:
                    give(packer.pour(keep=True))
                    placed = 0
                if len(out) >= GIVEN:
                    yield full()
        give(packer.pour())
        if out:
            yield full()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, kind)
