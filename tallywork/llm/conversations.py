"""Conversation structure repair: least edits that give a legal order of roles, by divide and conquer over four states."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut

#: Costs of the edits; a truncated row that stays adds TRUNCATED (fixed values).
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a segment: the part of a conversation that one task turns into a table of costs, or into edits.
SEGMENT = 1 << 16
#: White space of the contract.
SPACES = " \t\n\x0b\x0c\r"
#: A row is kind * 4 + flag. Kinds: system, user, assistant, other; flags: sound, truncated, blank, duplicate.
SOUND, CUT_OFF, BLANK, DUPLICATE = range(4)

#: What may be done between two boundaries: for each state before, {state after: (cost, tie)}; ties are compared for one state before only.
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
Element = Sequence[dict[int, tuple[int, object]]]


def _step(code: int) -> Element:
    """Of one row: inserts before it, then its edit; the tie is the text of the edits."""
    kind, flag = divmod(code, 4)
    extra, found = TRUNCATED if flag == CUT_OFF else 0, []
    for start in range(4):
        best: dict[int, tuple[int, str]] = {}
        state, cost, text = start, 0, ""
        for _ in range(3):  # a third insert comes back to a state at a greater cost
            then = 3 if state == 2 else 2
            moves = [(state, DELETE, "D")]
            if flag in (SOUND, CUT_OFF):
                moves.append((then, REROLE + extra, "R"))
                if (kind, state) in ((0, 0), (1, 0), (1, 1), (1, 3), (2, 2)):
                    moves.append((kind + 1, extra, "K"))
            for to, more, letter in moves:
                move = (cost + more, text + letter)
                if to not in best or move < best[to]:
                    best[to] = move
            state, cost, text = then, cost + INSERT, text + "I"
        found.append(best)
    return found


STEPS = [_step(code) for code in range(16)]
#: The end of a conversation, which is reached from nothing or after an assistant.
END: Element = [{0: (0, "")}, {0: (2 * INSERT, "II")}, {0: (INSERT, "I")}, {0: (0, "")}]


def forward(elements: Sequence[Element], start: int) -> dict[int, tuple[int, int]]:
    """{state: (least cost, rank)} behind elements; rank orders the states by their least edits' text.

    Edits that end in one row and reach different states differ, and neither text starts the other: a text decides the state, and each ends in an edit
    of the row. So the order of two states' texts holds whatever follows.
    """
    at = {start: (0, 0)}
    for e in elements:
        best: dict[int, tuple[int, int, object]] = {}
        for p, (cost, rank) in at.items():
            for q, (more, tie) in e[p].items():
                move = (cost + more, rank, tie)
                if q not in best or move < best[q]:
                    best[q] = move
        order = sorted(best, key=lambda q: best[q][1:])
        at = {q: (best[q][0], n) for n, q in enumerate(order)}
    return at


def backward(elements: Sequence[Element], end: int) -> dict[int, int]:
    """{state: least cost from it, before elements, to end}."""
    to = {end: 0}
    for e in reversed(elements):
        to = {p: min(costs) for p in range(4) if (costs := [cost + to[q] for q, (cost, _) in e[p].items() if q in to])}
    return to


def crossings(elements: Sequence[Element], start: int, end: int) -> list[int]:
    """States at all boundaries, start and end included: forward and backward costs meet in the middle; of the cheapest crossings that with the least text."""
    if len(elements) <= 1:
        return [start, end] if elements else [start]
    mid = len(elements) // 2
    ahead, behind = forward(elements[:mid], start), backward(elements[mid:], end)
    middle = min((q for q in ahead if q in behind), key=lambda q: (ahead[q][0] + behind[q], ahead[q][1]))
    return crossings(elements[:mid], start, middle)[:-1] + crossings(elements[mid:], middle, end)


def table(codes: bytes) -> Element:
    """A segment as one element; ties are ranks."""
    steps = [STEPS[x] for x in codes]
    return [forward(steps, p) for p in range(4)]


def edits(codes: bytes, start: int, end: int, last: bool) -> str:
    """The least edits of a segment between two states; last: with the conversation's end."""
    steps = [STEPS[x] for x in codes] + [END] * last
    path = crossings(steps, start, end)
    return "".join([e[p][q][1] for e, p, q in zip(steps, path, path[1:], strict=False)])


@lru_cache(1 << 16)
def short_table(codes: bytes) -> Element:
    """table, remembered."""
    return table(codes)


@lru_cache(1 << 16)
def short_edits(codes: bytes, start: int, end: int, last: bool) -> str:
    """edits, remembered."""
    return edits(codes, start, end, last)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    return (r for batch in batches for k in range(0, batch.num_rows, 1024) for r in batch.slice(k, 1024).to_pylist())


def _mapped(rows: DataFrame, schema: T.StructType, fn) -> DataFrame:
    """rows through fn, an iterator of rows to an iterator of rows."""

    def run(batches):
        arrow, out = to_arrow_schema(schema), []
        for row in fn(_stream(batches)):
            out.append(row)
            if len(out) == 1024:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def damage(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after the contract's damage, conversations of the dropped ones): nulls become one space, then by crc32(conv_id:turn) % 20 a row is dropped (0), loses
    its text (1), its `[.!?]` (2), comes twice (3) or becomes the user's (4)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    held = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    kept = held.where("h != 0").select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
    return kept, held.where("h = 0").select("conv_id")


def repair_conversations(rows: DataFrame, also: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    A conversation's rows stand by turn, nulls first; those of one turn by role, then by the digest of their text; equal rows beside each other. A row's first
    fault counts: blank (nothing but white space), duplicate (role and text stood earlier), truncated (its last character that isn't white space is none of
    `.!?`). illegal: neighbours whose roles' initials aren't su, ua or au. gaps: missing turns between the least and the greatest.

    Edits: K keeps a row at no cost, R makes it the user's or assistant's (3), D deletes it (4; blank and duplicate rows must go), I inserts an empty row of
    the user or assistant (3); a truncated row that stays adds 3. audit is the cheapest list of edits after which the initials are `(s?(ua)+)?`, of equal ones the
    least text; it fixes the roles. repaired_sha256: of the repaired rows `role:text`, joined by line feeds. `also` has conversations (conv_id) to be returned though
    they have no rows: zeros, no edits, the digest of nothing.

    Null roles and texts count as one space; a null conversation is a conversation; an empty table gives no rows; other columns are ignored, whatever
    their names. A gap above a long's range is the largest long.

    Rows are codes of one byte in segments of at most SEGMENT rows over range partitions; each segment is a table of four by four costs, Hirschberg's
    crossings over a conversation's tables give the states at the segments' ends, and within each segment, wherever it lies, the same recursion gives its
    edits. So no task holds the rows of a conversation, but for the audit that is returned, one byte a row; its digest is taken by one task, which streams
    the rows. Texts are shuffled once; repeated rows are counted before any shuffle of single rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(" "))
    named = rows.select(F.col(conv_col).alias("grp"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("digest"))
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    flag = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT_OFF)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    key = ["grp", "turn", "role", "digest"]
    coded = named.select(*key, (kind * 4 + flag).alias("code"))
    counted = cut(coded.groupBy(*key, "code").agg(F.count("*").alias("n")), "repair-counts")
    earliest = counted.groupBy("grp", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("t"))
    marks = earliest.select("grp", F.col("t.turn").alias("turn"), "role", "digest", F.lit(-1).alias("code"), F.lit(0).cast("long").alias("n"))
    parts = counted.unionByName(marks)
    if also is not None:
        parts = parts.unionByName(also.select(F.col(conv_col).alias("grp")).distinct().select("grp", *[F.lit(None).cast(counted.schema[c].dataType).alias(c) for c in key[1:]], F.lit(-2).alias("code"), F.lit(0).cast("long").alias("n")))
    grp = rows.schema[conv_col].dataType.simpleString()
    order = [F.col(c).asc_nulls_first() for c in key]
    cuts = T._parse_datatype_string(f"grp {grp}, seq long, codes binary, low long, high long, turns long")

    def segments(stream: Iterator[dict]) -> Iterator[dict]:
        seq = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for g, of in groupby(stream, key=lambda r: r["grp"]):
            codes, low, high, turns, mark = bytearray(), None, None, 0, None

            def row():
                return {"grp": g, "seq": seq, "codes": bytes(codes[:SEGMENT]), "low": low, "high": high, "turns": turns}  # noqa: B023

            for r in of:
                at = (r["turn"], r["role"], r["digest"])
                if r["code"] < 0:
                    mark = at if r["code"] == -1 else mark
                    continue
                code, again = r["code"], r["code"] if r["code"] % 4 == BLANK else r["code"] // 4 * 4 + DUPLICATE
                if r["turn"] is not None and r["turn"] != high:
                    low, high, turns = r["turn"] if low is None else low, r["turn"], turns + 1
                codes.append(code if at == mark else again)
                left = r["n"] - 1
                while left or len(codes) >= SEGMENT:
                    more = min(left, SEGMENT - len(codes)) if len(codes) < SEGMENT else 0
                    codes += bytes([again]) * more
                    left -= more
                    if len(codes) >= SEGMENT:
                        yield row()
                        seq, codes, low, high, turns = seq + 1, codes[SEGMENT:], r["turn"], r["turn"], int(r["turn"] is not None)
            yield row()
            seq += 1

    held = cut(_mapped(parts.repartitionByRange(*order).sortWithinPartitions(*order, "n"), cuts, segments), "repair-segments")
    sums = T._parse_datatype_string(f"grp {grp}, seq long, costs array<long>, ranks array<int>, kinds binary, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long")

    def summed(stream: Iterator[dict]) -> Iterator[dict]:
        for r in stream:
            codes = r["codes"]
            t = short_table(codes) if len(codes) <= 64 else table(codes)
            kinds, flags = codes.translate(bytes(x // 4 % 4 for x in range(256))), codes.translate(bytes(x % 4 for x in range(256)))
            legal = sum(kinds.count(x) for x in (b"\0\1", b"\1\2", b"\2\1"))
            yield {
                "grp": r["grp"], "seq": r["seq"], "costs": [t[p][q][0] if q in t[p] else -1 for p in range(4) for q in range(4)], "ranks": [t[p][q][1] if q in t[p] else -1 for p in range(4) for q in range(4)],
                "kinds": kinds[:1] + kinds[-1:], "blank": flags.count(BLANK), "duplicate": flags.count(DUPLICATE), "truncated": flags.count(CUT_OFF), "illegal": max(len(codes) - 1, 0) - legal,
                "low": r["low"], "high": r["high"], "turns": r["turns"],
            }

    states = T._parse_datatype_string(f"grp {grp}, seq long, start int, end int, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")

    def met(stream: Iterator[dict]) -> Iterator[dict]:
        for g, of in groupby(stream, key=lambda r: r["grp"]):
            tables, seqs, counts, edge, low, high, turns = [], [], [0, 0, 0, 0], b"", None, None, 0
            for r in of:
                seqs.append(r["seq"])
                tables.append([{q: (r["costs"][4 * p + q], r["ranks"][4 * p + q]) for q in range(4) if r["costs"][4 * p + q] >= 0} for p in range(4)])
                counts = [a + r[c] for a, c in zip(counts, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
                if r["kinds"]:
                    counts[3] += bool(edge) and edge + r["kinds"][:1] not in (b"\0\1", b"\1\2", b"\2\1")
                    edge = r["kinds"][1:]
                if r["low"] is not None:
                    turns += r["turns"] - (high == r["low"])
                    low, high = r["low"] if low is None else low, r["high"]
            path = crossings([*tables, END], 0, 0)
            gaps = min(high - low + 1 - turns, 2**63 - 1) if low is not None else 0
            cost = forward([*tables, END], 0)[0][0]
            for n, seq in enumerate(seqs):
                end = n == len(seqs) - 1
                yield {"grp": g, "seq": seq, "start": path[n], "end": path[n + 1], "last": end, "gaps": gaps, "blank": counts[0], "duplicate": counts[1], "truncated": counts[2], "illegal": counts[3], "cost": cost}

    crossed = cut(_mapped(_mapped(held.repartition("grp", "seq"), sums, summed).repartition("grp").sortWithinPartitions("grp", "seq"), states, met), "repair-states")
    pieces = T._parse_datatype_string(f"grp {grp}, seq long, letters string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")

    def lettered(stream: Iterator[dict]) -> Iterator[dict]:
        for r in stream:
            f = short_edits if len(r["codes"]) <= 64 else edits
            letters = f(r["codes"], r["start"], r["end"], False)
            if r["last"]:
                letters += END[r["end"]][0][1]
            yield {**{c: r[c] for c in pieces.names if c != "letters"}, "letters": letters}

    joined = crossed.join(held.select(F.col("grp").alias("g"), F.col("seq").alias("s"), "codes"), F.col("seq") == F.col("s")).drop("g", "s")  # seq is one of a kind
    letters = _mapped(joined, pieces, lettered)
    both = named.select("grp", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("seq"), "turn", "role", "digest", "text").unionByName(letters.withColumn("rank", F.lit(0)), allowMissingColumns=True)
    out = T._parse_datatype_string(f"conv_id {grp}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")

    def rebuilt(stream: Iterator[dict]) -> Iterator[dict]:
        for g, of in groupby(stream, key=lambda r: r["grp"]):
            parts, found, at, place, hashed, audit, odd = [], None, 0, 0, sha256(), "", 0

            def say(role, text, hashed=hashed):
                if place:  # noqa: B023
                    hashed.update(b"\n")
                hashed.update(f"{role}:{text}".encode())

            def begin():
                nonlocal audit, odd
                audit = "".join(parts)  # noqa: B023
                odd = (len(audit) - audit.count("D")) % 2  # a system row leads an odd number

            def turn():
                return "assistant" if (place - odd) % 2 else "user"  # noqa: B023

            for r in of:
                if not r["rank"]:
                    parts.append(r["letters"])
                    found = found or r
                    continue
                if not audit:
                    begin()
                while audit[at] == "I":
                    say(turn(), "")
                    at, place = at + 1, place + 1
                if audit[at] != "D":
                    say(turn() if audit[at] == "R" else r["role"], r["text"])
                    place += 1
                at += 1
            if not audit:
                begin()
            for _ in audit[at:]:
                say(turn(), "")
                place += 1
            yield {"conv_id": g, **{c: found[c] for c in out.names[1:7]}, "audit": audit, "repaired_sha256": hashed.hexdigest()}

    return _mapped(both.repartition("grp").sortWithinPartitions("grp", "rank", "seq", *order[1:]), out, rebuilt)
