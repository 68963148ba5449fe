"""Queries of the sources: files written from the driver's tables, with planted faults, and read again under their contracts.

A nation's customers are the rows of one file of each kind. Some nations' files have a fault that must refuse them: an empty required cell, a
repeated key, another heading, a surplus cell. The raw text and the value that is
expected for it are expressions that Spark and DuckDB share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import readers
from ..sources.staging import new_path
from .derive import in_cents, table

Q, S = {}, {}

#: Ids of the survey by source.
SOURCES = {
    "trial_balance": "S02, S29", "account_mapping": "S03", "mapping_policy": "S04", "balance_policy": "S05", "gst_mapping": "S06", "gst_settlements": "S07", "gst_settlements_by_side": "S07", "subledger": "S08", "contacts": "S09",
    "transactions": "S11, S12, V09, V17", "decisions": "S14", "open_items": "S20", "activity_statement": "S20", "gst_control_gl": "S20", "bank_rec": "S20", "tie_out_matrix": "S20", "fs_mapping": "S20", "prior_findings": "S20",
    "dim_account": "S30", "dim_entity": "S30", "dim_benchmark": "S30", "fact_gl": "S30", "fact_budget": "S30", "fact_payroll": "S30", "grant_ledger": "S31", "grant_allocations": "S31", "grant_receipts": "S31", "grant_contributions": "S31",
    "review_run": "S35", "review_exception": "S35", "review_evidence": "S35",
}

#: n numbers a file's rows by customer, r from 1 within its file k of m rows.
BASE_SQL = "base AS (SELECT c_custkey AS n, c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS m FROM customer)"
#: One row per file and label, for a file that may hold each label once.
LABELS_SQL = "base AS (SELECT n, k, row_number() OVER (PARTITION BY k ORDER BY n) AS r, count(*) OVER (PARTITION BY k) AS m FROM (SELECT min(c_custkey) AS n, c_nationkey AS k FROM customer GROUP BY c_nationkey, c_custkey % 3))"


def base(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(f"WITH {sql} SELECT * FROM base".replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))


#: Columns whose value another one decides: (raw, canonical) by source and column.
SPECIAL = {
    ("gst_mapping", "gst_class"): ("CASE WHEN k % 12 >= 6 AND m > 1 THEN (CASE r % 2 WHEN 1 THEN 'gst_collected' ELSE 'gst_paid' END) WHEN r = 1 THEN 'gst' ELSE 'taxable_sales' END",) * 2,
    ("dim_account", "sub_class"): ("CASE {n} % 5 WHEN 0 THEN 'Current Assets' WHEN 1 THEN 'Current Liabilities' WHEN 2 THEN 'Equity' WHEN 3 THEN 'Operating Revenue' ELSE 'Cost of Sales' END",) * 2,
    ("dim_account", "report_section"): ("CASE WHEN {n} % 5 IN (3, 4) THEN 'Profit and Loss' ELSE 'Balance Sheet' END",) * 2,
    ("dim_entity", "abn"): ("'51 824 753 556'",) * 2,
    ("dim_benchmark", "turnover_range"): ("concat('$', CAST({n} AS STRING), 'k-$', CAST({n} AS STRING), '.5m')",) * 2,
    ("dim_benchmark", "gross_profit_low"): ("'10.25'", "'1025'"), ("dim_benchmark", "gross_profit_avg"): ("'20'", "'2000'"), ("dim_benchmark", "gross_profit_high"): ("'100.00'", "'10000'"),
    ("fact_gl", "is_intercompany"): ("CASE WHEN {n} % 5 = 0 THEN 'FALSE' ELSE 'true' END", "CASE WHEN {n} % 5 = 0 THEN 'false' ELSE 'true' END"),
    ("fact_payroll", "compliance_status"): ("'ON_TIME'",) * 2, ("fact_payroll", "sgc_shortfall"): ("'0'",) * 2, ("fact_payroll", "gic_nominal_interest"): ("'0.00'", "'0'"),
}


# -- cells -------------------------------------------------------------------------------------------------------------


def _cents(name: str, n: str, signed: bool) -> str:
    size = f"({n} * 7919 + {sum(map(ord, name)) * 13}) % 1000003"
    return f"(CASE WHEN {n} % 4 = 0 THEN -1 ELSE 1 END * ({size}))" if signed else f"({size})"


def _money(cents: str) -> str:
    c = f"abs({cents})"
    return f"concat(CASE WHEN {cents} < 0 THEN '-' ELSE '' END, CAST(CAST(floor({c} / 100) AS BIGINT) AS STRING), '.', lpad(CAST({c} % 100 AS STRING), 2, '0'))"


def cell(contract: readers.Contract, name: str, guard: Callable, n: str = "n") -> tuple[str, str]:
    """(raw text, canonical value) of a column as SQL over the row number n and the file number k: amounts in cents, all else as text."""
    source = next(k for k, v in readers.CONTRACTS.items() if v is contract)
    if (source, name) in SPECIAL:
        return tuple(x.replace("{n}", n) for x in SPECIAL[source, name])
    if isinstance(guard, readers.optional):
        raw, value = cell(contract, name, guard.guard, n)
        return tuple(f"CASE WHEN {n} % 5 = 0 THEN '' ELSE {x} END" for x in (raw, value))
    if guard is readers.digest:
        return (f"lpad(CAST({n} AS STRING), 64, '0')",) * 2
    if name in ("debit", "credit", "amount") and contract.also:  # one side of two, whose difference is the amount
        c = {"debit": f"(CASE WHEN {n} % 2 = 0 THEN {n} * 7 + 1 ELSE 0 END)", "credit": f"(CASE WHEN {n} % 2 = 1 THEN {n} * 7 + 1 ELSE 0 END)", "amount": f"(CASE WHEN {n} % 2 = 0 THEN 1 ELSE -1 END * ({n} * 7 + 1))"}[name]
        return _money(c), f"CAST({c} AS STRING)"
    if guard is readers.amount or guard is readers.money:
        c = _cents(name, n, guard is readers.amount)
        return (_money(c) if guard is readers.money else f"CASE WHEN {n} % 3 = 0 AND {c} >= 0 THEN concat('$', {_money(c)}) ELSE {_money(c)} END"), f"CAST({c} AS STRING)"
    if guard is readers.iso_date:
        when = "'2024-06-30'" if name in contract.single else f"concat('2024-', lpad(CAST({n} % 12 + 1 AS STRING), 2, '0'), '-{'01' if name == 'period_date' else '15'}')"
        return when, when
    if isinstance(guard, readers.one_of):
        value = "CASE " + " ".join(f"WHEN {n} % {len(guard.values)} = {i} THEN '{v}'" for i, v in enumerate(guard.values)) + " END"
        return value, value
    if guard is readers.yes_no:
        return tuple(f"CASE WHEN {n} % 2 = 0 THEN '{a}' ELSE '{b}' END" for a, b in (("yes", "no"), ("true", "false")))
    if guard is readers.whole:
        return (f"CAST({n} AS STRING)",) * 2
    if guard is readers.full_weight:
        return "'1'", "'1.0000'"
    if guard is readers.currency:
        return "'AUD'", "'AUD'"
    if guard is readers.identity:
        return (f"concat('id.', CAST({n} AS STRING))",) * 2
    value = f"concat('T', CAST(k AS STRING))" if name in contract.single else f"concat('{name} ', CAST({n} AS STRING), ', \"x\"')"
    return value, value


def shown(name: str, kind: T.DataType) -> Column:
    """A typed value as its canonical text."""
    if isinstance(kind, T.DecimalType):
        return (F.col(name) if kind.scale == 4 else in_cents(name)).cast("string")
    return F.col(name).cast("string")


def write_files(rows: DataFrame, path: str) -> None:
    """rows (file, seq, value) as text, a file of its own for each `file`: a file's rows meet in one task, in order."""
    rows.repartition("file").sortWithinPartitions("file", "seq").drop("seq").write.option("lineSep", "\n").partitionBy("file").text(path)


def file_no(file: Column) -> Column:
    return F.regexp_extract(file, r"/file=(\d+)/", 1).cast("int")


def csv_query(name: str) -> None:
    contract = readers.CONTRACTS[name]
    sql = LABELS_SQL if name == "activity_statement" else BASE_SQL
    columns = list(contract.columns.items())
    required = next(c for _, (c, _, empty) in columns if not empty)

    def load(spark: SparkSession, sf_dir: str) -> DataFrame:
        quoted = lambda x: f"concat('\"', replace({x}, '\"', '\"\"'), '\"')"
        cells = []
        for _, (c, guard, _) in columns:
            raw = cell(contract, c, guard)[0]
            if c in contract.key:  # in some files the second row has the first one's key
                raw = f"CASE WHEN k % 6 = 2 AND r = 2 THEN {cell(contract, c, guard, 'first')[0]} ELSE {raw} END"
            cells.append(quoted(f"CASE WHEN k % 6 = 1 AND r = 1 THEN '' ELSE {raw} END" if c == required else raw))
        rows = base(spark, sf_dir, sql).selectExpr("*", "min(n) OVER (PARTITION BY k) AS first")
        lines = rows.selectExpr("k AS file", "r AS seq", f"concat(concat_ws(',', {', '.join(cells)}), CASE WHEN k % 6 = 4 AND r = 1 THEN ',surplus' ELSE '' END) AS value")
        heads = [h for h, _ in columns]
        wrong = ",".join(["Other", *heads[1:]])
        head = rows.where("r = 1").select(F.col("k").alias("file"), F.lit(0).cast("long").alias("seq"), F.when(F.col("k") % 6 == 3, wrong).otherwise(",".join(heads)).alias("value"))
        path = new_path(spark, f"files-{name}")
        write_files(head.unionByName(lines.withColumn("seq", F.col("seq").cast("long"))), path)
        accepted, refusals = readers.read_csv(spark, f"{path}/*", contract)
        kinds = {f.name: f.dataType for f in accepted.schema}
        line = F.concat_ws("|", *[F.coalesce(shown(c, kinds[c]), F.lit("")) for _, (c, _, _) in columns])
        no = lambda kind: F.lit(None).cast(kind)
        ok = accepted.select(file_no(F.col("file")).alias("file"), line.alias("line"), no("string").alias("code"), no("string").alias("field"), F.lit(1).cast("long").alias("n"))
        bad = refusals.groupBy(file_no(F.col("file")).alias("file"), "code", F.col("column").alias("field")).agg(F.count("*").alias("n"))
        return ok.unionByName(bad.select("file", no("string").alias("line"), "code", "field", "n"))

    values = ", ".join(cell(contract, c, guard)[1] for _, (c, guard, _) in columns)
    passes = f"(k % 6 IN (0, 5){'' if not contract.key else ' OR (k % 6 = 2 AND m < 2)'}{' OR k % 6 = 2' if not contract.key else ''})"
    refused = [f"SELECT k, NULL, 'VALUE', '{required}', 1 FROM base WHERE k % 6 = 1 AND r = 1", "SELECT k, NULL, 'HEADER', NULL, 1 FROM base WHERE k % 6 = 3 AND r = 1", "SELECT k, NULL, 'WIDTH', NULL, 1 FROM base WHERE k % 6 = 4 AND r = 1"]
    if contract.key:
        refused.append(f"SELECT k, NULL, 'REPEATED_KEY', '{contract.key[-1]}', 2 FROM base WHERE k % 6 = 2 AND r = 1 AND m > 1")
    load.__name__ = f"load_{name}"
    load.__doc__ = f"{SOURCES[name]}: files of all nations under the contract, refused where a fault is planted (K10)."
    Q[load.__name__] = load
    S[load.__name__] = f"WITH {sql.replace('STRING', 'VARCHAR')} SELECT CAST(k AS INTEGER) AS file, concat_ws('|', {values}) AS line, NULL AS code, NULL AS field, CAST(1 AS BIGINT) AS n FROM base WHERE {passes} UNION ALL " + " UNION ALL ".join(refused)


for source in SOURCES:
    csv_query(source)


def digest_query() -> None:
    contract = readers.CONTRACTS["prior_findings"]
    heads = ",".join(contract.columns)
    line = "concat('F', CAST(n AS STRING), ',slot ', CAST(n AS STRING), ',', CASE WHEN k % 3 = 0 AND r = 1 THEN 'LOST' ELSE 'OPEN' END)"

    def captured_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The digest of each file's bytes stands beside what was read from them, in accepted rows and in refusals."""
        rows = base(spark, sf_dir, BASE_SQL)
        head = rows.where("r = 1").select(F.col("k").alias("file"), F.lit(0).cast("long").alias("seq"), F.lit(heads).alias("value"))
        path = new_path(spark, "files-digests")
        write_files(head.unionByName(rows.selectExpr("k AS file", "CAST(r AS BIGINT) AS seq", f"{line} AS value")), path)
        accepted, refusals = readers.read_csv(spark, f"{path}/*", contract)
        ok = accepted.groupBy("file", "sha256").agg(F.count("*").alias("n"), F.lit(None).cast("string").alias("code"))
        bad = refusals.groupBy("file", "sha256", "code").agg(F.count("*").alias("n"))
        return ok.unionByName(bad).select(file_no(F.col("file")).alias("file"), "sha256", "n", "code")

    Q[captured_digests.__name__] = captured_digests
    S[captured_digests.__name__] = f"""WITH {BASE_SQL}, f AS (SELECT k, count(*) AS n, sha256('{heads}' || chr(10) || string_agg({line} || chr(10), '' ORDER BY r)) AS d FROM base GROUP BY k)
      SELECT CAST(k AS INTEGER) AS file, d AS sha256, CASE WHEN k % 3 = 0 THEN 1 ELSE n END AS n, CASE WHEN k % 3 = 0 THEN 'VALUE' END AS code FROM f""".replace("AS STRING", "AS VARCHAR")


digest_query()
