"""Sinks: partitioned Parquet tables, and CSV exports with safe text and canonical amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import formula_safe, money_text
from ..operators.close import integrity


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ("report_date",)) -> None:
    """A whole Parquet table, in place of what was there, partitioned by its period (publish_table adds periods); rows of a period are brought together first, so a period has few files, split if large."""
    keys = [c for c in by if c in df.columns]
    (df.hint("rebalance", *keys).write.partitionBy(*keys) if keys else df.write).mode("overwrite").parquet(path)


def write_pack(tables: dict[str, DataFrame], path: str, by: tuple[str, ...] = ("report_date",)) -> None:
    """A pack's tables, each in a folder of its name."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}", by)


def publish_table(df: DataFrame, path: str, run: str, order: int, periods: DataFrame, by: tuple[str, ...] = ("report_date",)) -> None:
    """Rows of one run for its periods (the columns `by`): they stand beside those of other periods and runs, and read_published() gives the run of the highest
    order for each period. Other periods are left as they are; a period of the run without rows has none from then on.

    A run's folders are replaced as a whole (dynamic partition overwrite), so a repeated attempt leaves no double rows; what an attempt wrote counts only once
    the run's periods are recorded, last.
    """
    one = df.withColumn("run", F.lit(run))
    one.hint("rebalance", *by, "run").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "run").parquet(path)
    told = periods.select(*by).distinct().select(*by, F.lit(order).cast("long").alias("order"), F.lit(run).alias("run"))
    told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}.runs")


def read_published(spark: SparkSession, path: str, schema: T.StructType, by: tuple[str, ...] = ("report_date",)) -> DataFrame:
    """The rows of the last run of each period. schema: of the published rows; with it a path to which only empty runs were published is read too."""
    kinds = [f"`{c}` {schema[c].dataType.simpleString()}" for c in by]
    runs = spark.read.schema(", ".join([*kinds, "`order` long", "run string"])).parquet(f"{path}.runs")
    last = runs.groupBy(*by).agg(F.max_by("run", F.struct("order", "run")).alias("run"))
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("run", T.StringType())])).parquet(path)
    return rows.join(last, [*by, "run"], "left_semi").select(*schema.names)


def publish_pack(tables: dict[str, DataFrame], path: str, run: str, order: int, periods: DataFrame, by: tuple[str, ...] = ("report_date",)) -> None:
    """A pack's tables of one run, each in a folder of its name."""
    for name, df in tables.items():
        publish_table(df, f"{path}/{name}", run, order, periods, by)


def export_csv(df: DataFrame, path: str, line: str = "\n", compression: str = "none") -> None:
    """CSV with a header: text that a spreadsheet might run is quoted by an apostrophe, decimals are canonical."""
    out = [(money_text(c) if t.startswith("decimal") else formula_safe(c) if t == "string" else F.col(c).cast("string")).alias(c) for c, t in df.dtypes]
    df.select(*out).write.mode("overwrite").option("header", True).option("lineSep", line).option("compression", compression).option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)


#: Headings of a canonical trial balance by column.
HEADINGS = {"report_date": "ReportDate", "tenant": "Tenant", "section": "Section", "account_id": "AccountID", "account_name": "AccountName", "account_code": "AccountCode", "debit": "Debit", "credit": "Credit", "ytd_debit": "YTDDebit", "ytd_credit": "YTDCredit"}


def export_trial_balance(tb: DataFrame, path: str) -> None:
    """One folder per tenant and date of canonical CSV, with a byte order mark and CRLF; totals are proved first, and a difference stops the export."""
    bad = integrity(tb).limit(1).count()
    if bad:
        raise ValueError("debits and credits differ; nothing was exported")
    t = tb.select(*[F.col(c).alias(h) for c, h in HEADINGS.items()], F.concat_ws("_", "tenant", F.date_format("report_date", "yyyyMMdd")).alias("batch"))
    text = [(money_text(h) if h in ("Debit", "Credit", "YTDDebit", "YTDCredit") else formula_safe(h) if h != "ReportDate" else F.date_format(h, "yyyy-MM-dd")).alias(h) for h in HEADINGS.values()]
    text[0] = text[0].alias("\ufeff" + next(iter(HEADINGS.values())))  # each file's header comes first, so its first heading carries the mark
    # a batch's rows meet in one task, so that a batch is one file: a trial balance has an account per row
    t.select(*text, "batch").repartition("batch").sortWithinPartitions("batch", "AccountID").write.mode("overwrite").partitionBy("batch").option("header", True).option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def publish(tb: DataFrame, found: DataFrame, refusals: DataFrame, queries: DataFrame, path: str) -> None:
    """The close pack: exceptions, client queries, trial balance and refusals as tables."""
    write_pack({"exceptions": found, "client_queries": queries, "trial_balance": tb}, path)
    write_table(refusals, f"{path}/refusals", ())
