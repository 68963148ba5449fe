"""Minimax contiguous partition of ordered atomic groups over shards."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Hex digits of a group's key by which one refinement splits a range of keys (16 ** 3 parts).
DIGITS = 3
#: Groups of at least 1 / HEAVY of all bytes stand alone and come first; there are at most HEAVY.
HEAVY = 4096
#: Parts of a shard within which rows are numbered.
PARTS = 1024


@dataclass(frozen=True)
class Unit:
    """A range of keys (all that start with `prefix`), or one group: `atomic`."""

    prefix: str
    size: int
    atomic: bool


def greedy(units: list[Unit], capacity: int, loose: bool) -> list[int] | None:
    """Sizes before each cut when shards are filled in order, None if a group exceeds the capacity. loose: ranges may be cut anywhere,
    which no real cut beats; else only between units, which real cuts reach at least."""
    ends, at = [0], 0
    for u in units:
        if at + u.size > ends[-1] + capacity:
            if loose and not u.atomic:
                while at + u.size > ends[-1] + capacity:
                    ends.append(ends[-1] + capacity)
            elif u.size > capacity:
                return None
            else:
                ends.append(at)
        at += u.size
    return ends[1:]


def least(units: list[Unit], shards: int, loose: bool) -> int:
    """The smallest capacity at which greedy filling needs at most `shards`, by binary search."""
    total = sum(u.size for u in units)
    low, high = -(-total // shards), total
    while low < high:
        mid = (low + high) // 2
        cuts = greedy(units, mid, loose)
        if cuts is not None and len(cuts) < shards:
            high = mid
        else:
            low = mid + 1
    return low


def unsettled(units: list[Unit], shards: int) -> list[int]:
    """Ranges in which a cut of the best partition may fall."""
    low, high = least(units, shards, True), least(units, shards, False)
    first, last = greedy(units, low, False), greedy(units, high, True)
    starts, at = [], 0
    for u in units:
        starts.append(at)
        at += u.size
    if first is None or not units:
        return [n for n, u in enumerate(units) if not u.atomic]
    found: set[int] = set()
    for j in range(shards - 1):
        a = first[j] if j < len(first) else at
        b = last[j] if j < len(last) else at
        a, b = min(a, b), max(a, b)
        for n in range(max(0, bisect_right(starts, a) - 1), min(len(units), bisect_right(starts, b))):
            if not units[n].atomic and a <= starts[n] + units[n].size and starts[n] <= b:
                found.add(n)
    return sorted(found)


def split(groups: DataFrame, shards: int) -> tuple[dict[str, int], list[str], int]:
    """(shard of each heavy group's key, keys at which the later shards of the light groups start, first shard of the light groups).

    groups: (key string of hex digits, bytes long), written. The driver holds at most HEAVY groups and the sizes of key ranges; ranges in
    which a cut may fall are refined by DIGITS digits at a time until only single groups are left there.
    """
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    heavy = [Unit(r["key"], r["bytes"], True) for r in groups.where(F.col("bytes") * HEAVY >= total).orderBy("key").collect()] if total else []
    light = groups.where(F.col("bytes") * HEAVY < total)
    shard_of, at = {}, 0
    for u in sorted(heavy, key=lambda u: (-u.size, u.prefix)):  # a group above the share of each left shard gets one by itself
        if shards - at > 1 and u.size * (shards - at) >= total:
            shard_of[u.prefix] = at
            total -= u.size
            at += 1
        else:
            break
    rest, left = [u for u in heavy if u.prefix not in shard_of], shards - at

    def ranges(of: DataFrame, digits: int) -> list[Unit]:
        rows = of.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("bytes").alias("n"), F.count("*").alias("k"), F.min("key").alias("key")).collect()
        return sorted((Unit(r["key"] if r["k"] == 1 else r["p"], r["n"], r["k"] == 1) for r in rows), key=lambda u: u.prefix)

    units = rest + ranges(light, DIGITS)
    while bad := {units[n].prefix for n in unsettled(units, left)}:
        parts: dict[str, list[Unit]] = {}
        for width in {len(x) for x in bad}:
            for u in ranges(light.where(F.substring("key", 1, width).isin(*[x for x in bad if len(x) == width])), width + DIGITS):
                parts.setdefault(u.prefix[:width], []).append(u)
        units = [x for u in units for x in (parts[u.prefix] if not u.atomic and u.prefix in bad else [u])]
    cuts, size, starts, light_first = greedy(units, least(units, left, False), False) or [], 0, [], None
    for n, u in enumerate(units):
        fresh = bool(cuts) and size == cuts[0]
        if fresh:
            cuts.pop(0)
            at += 1
        if n < len(rest):
            shard_of[u.prefix] = at
        elif light_first is None:
            light_first = at
        elif fresh:
            starts.append(u.prefix)
        size += u.size
    return shard_of, starts, min(at, shards - 1) if light_first is None else light_first


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): whole groups of equal texts in `shards` shards of nearly equal bytes.

    Groups are ordered (heavy ones first, then by the SHA-256 of the text) and cut into contiguous runs with the smallest possible largest
    run, found by binary search over capacities that are checked greedily; a group larger than an even share has a shard to itself. So
    law is `bytes`, and grown_shard is null. size: UTF-8 bytes plus 1. Null texts form one group, apart from the empty text's, with size 1
    and CRC 0. slot numbers a shard's rows from 0 without gaps. An empty table gives no rows; repeated rows have slots of their own. Other
    columns are ignored, whatever their names; a very long text is a group like any other, and is hashed whole by one task.
    Rows of one hot group are numbered in PARTS parts; no task holds a shard.
    """
    text = F.col(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.sha2(text, 256), F.lit("")).alias("key"),
        ),
        "shard-rows",
    )
    shard_of, starts, light_first = split(cut(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups"), shards)
    light = F.lit(light_first)
    for key in starts:
        light = light + (F.col("key") >= key).cast("int")
    if shard_of:
        table = rows.sparkSession.createDataFrame(sorted(shard_of.items()), "key string, own int")
        rows = rows.join(F.broadcast(table), "key", "left")  # at most HEAVY rows
    else:
        rows = rows.withColumn("own", F.lit(None).cast("int"))
    rows = rows.select("doc_id", "size", "text_crc32", F.coalesce("own", light).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "key"), F.lit(PARTS)).alias("part"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("n", within)
        .join(F.broadcast(parts), ["shard", "part"])  # shards * PARTS rows
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
