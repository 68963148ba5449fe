"""Helpers shared by the operators: written cuts of a plan, batch mapping and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A table of at most this many rows may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bits of a bitmap of ids at most (64 MB).
MOST_BITS = 1 << 29
#: Edges that one task joins at a time.
CHUNK = 1 << 18
#: Folder of a local application without a checkpoint folder.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local session may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tallywork-")
    return _LOCAL[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and a lost executor costs only later stages."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (a written table) with a broadcast hint if it has at most `rows` rows; else with one for a shuffled join, which AQE may split. Left to itself Spark
    goes by the bytes of compressed files, and the driver builds tables of millions of rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def among(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame | None:
    """rows with a column __in, true for all whose id is in ids (a written table with a column doc_id) and for about one in 16 of the others: a
    bitmap of hashed ids, 16 to 32 bits each, joined by broadcast. None if it would have more than MOST_BITS."""
    n = ids.count()
    bits = 1 << max(15, (16 * n - 1).bit_length())
    if bits > MOST_BITS:
        return None
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    maps = ids.select(place(F.col("doc_id")).alias("h")).groupBy(F.expr(f"h div {1 << 15}").alias("__bucket")).agg(F.bitmap_construct_agg(F.expr(f"h % {1 << 15}")).alias("__bits"))
    held = rows.withColumn("__h", place(F.col(id_col))).withColumn("__bucket", F.expr(f"__h div {1 << 15}"))
    byte = F.conv(F.hex(F.expr(f"substring(__bits, cast(__h % {1 << 15} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = held.join(F.broadcast(cut(maps, "bitmap")), "__bucket", "left")  # MOST_BITS / 8 bytes at most
    return found.withColumn("__in", F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(__h % 8 as int))")) != 0, F.lit(False))).drop("__h", "__bucket", "__bits")


def matching(rows: DataFrame, ids: DataFrame, how: str, id_col: str = "doc_id") -> DataFrame:
    """rows that have (how: left_semi) or lack (left_anti) their id in ids, a written table with a column doc_id. Rows that a bitmap of ids
    tells apart aren't shuffled."""
    told, names = among(rows, ids, id_col), rows.columns
    found = bounded(ids.select(F.col("doc_id").alias("__id")))

    def joined(part: DataFrame) -> DataFrame:
        return part.alias("r").join(found, F.col(f"r.{id_col}") == F.col("__id"), how).select(*[F.col(f"r.{c}") for c in names])

    if told is None:
        return joined(rows)
    hit = joined(told.where("__in").drop("__in"))
    return hit if how == "left_semi" else hit.unionByName(told.where("not __in").drop("__in"))


def slices(batch: pa.RecordBatch, rows: int = 1024, texts: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """batch in parts of at most `rows` rows and about `texts` bytes."""
    step = max(1, min(rows, int(batch.num_rows * texts / max(batch.nbytes, 1)) or 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_rows(df: DataFrame, schema: str, fn: Callable[..., list], rows: int = 1024, texts: int = 16 << 20) -> DataFrame:
    """Apply fn to lists of df's columns, a slice of at most `rows` rows and about `texts` bytes at a time; fn returns one list or Arrow array per column."""
    kind = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for batch in batches:
            for part in slices(batch, rows, texts):
                cols = fn(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, roots): the ends of the edges a-b that aren't the smallest of their component, and that smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, top = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(a):
        np.minimum.at(top, np.maximum(top[a], top[b]), np.minimum(top[a], top[b]))  # ids are sorted, so the smaller place is the smaller id
        while not np.array_equal(up := top[top], top):
            top = up
        apart = top[a] != top[b]
        a, b = a[apart], b[apart]
    lower = top < np.arange(len(ids))
    return ids[lower], ids[top[lower]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that join the same ids as those of edges: of each partition, CHUNK at a time, one for every id to the smallest that it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            got = roots(*[np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], ["u", "v"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield solved(held)
                held = []
        if held:
            yield solved(held)

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (src long, dst long): one row (id, component) per id that has an edge to another, component the smallest id reachable.

    Edges child -> parent (child > parent) are contracted, about CHUNK in a task: what few tasks see needs few rounds, and fewer than CHUNK edges none.
    Otherwise small-star and large-star steps alternate with it. Each step is a grouped minimum and a shuffled join of written tables, so AQE may split a
    large star. Stops when every child has one parent and no parent has a parent, which the steps reach in a logarithmic number of rounds. Loops and
    repeated edges are ignored.
    """
    a, b = F.col("src").cast("long"), F.col("dst").cast("long")
    e = cut(contracted(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")), name)
    while True:
        tasks = -(-e.count() // CHUNK)
        e = cut(contracted(e.coalesce(max(1, tasks))), name)
        if tasks <= 1:
            break
        low = cut(e.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x")), name)
        if low.where("x > m").limit(1).count():
            wide = e.join(low.where("x > m").select("u", "m").hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            small, done = cut(low.where("x = m").select("u", F.col("m").alias("v")).unionByName(wide).distinct(), name), False
        else:
            small, done = low.select("u", F.col("m").alias("v")), True
        up = cut(small.groupBy("u").agg(F.min("v").alias("m")).join(small.select(F.col("v").alias("u")).distinct().hint("merge"), "u", "left_semi").withColumnRenamed("u", "v"), name)
        if up.limit(1).count():
            e = cut(small.join(up.hint("merge"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).where("u > v").distinct(), name)
        else:
            e = small
            if done:
                break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
