"""Tables written to the folder that driver and executors share, and read again: lineage ends there, and what is read twice is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of a local application without a checkpoint folder.
_LOCAL: dict[str, str] = {}
#: Rows of a table that may be broadcast, about 100 bytes each.
FEW = 200_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session, whose executors are the driver, may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tallywork-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df from a Parquet table that it is written to."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """df (written, or declared) with a broadcast hint if it has at most `rows` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
