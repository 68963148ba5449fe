"""CSV sources and reports for many files at once: everything is read as text, guarded, and returned as (accepted, refusals).

A file with any refusal is refused as a whole, as one bad row makes a whole export doubtful; other files go on.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import AMOUNT, MONEY, abn_valid, accounting_number, clean_text, exact_money, iso_date, turnover_bounds, yes_no
from .documents import capture
from .staging import few, staged

Guard = Callable[[Column], Column]


def text(c: Column) -> Column:
    return clean_text(c)


@dataclass(frozen=True)
class optional:  # noqa: N801
    """Empty text passes as null."""

    guard: Guard

    def __call__(self, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", self.guard(c))


class one_of:  # noqa: N801
    def __init__(self, *values: str):
        self.values = values

    def __call__(self, c: Column) -> Column:
        return F.when(c.isin(*self.values), c)


def whole(c: Column) -> Column:
    return c.try_cast("long")


def full_weight(c: Column) -> Column:
    """A consolidation weight, which must be one."""
    return F.when(c.try_cast("decimal(9,4)") == 1, c.try_cast("decimal(9,4)"))


amount: Guard = lambda c: accounting_number(c, AMOUNT)
money: Guard = lambda c: exact_money(c).cast(MONEY)


@dataclass(frozen=True)
class Contract:
    """A CSV's columns: heading -> (name, guard, may be empty); key: columns unique per file; single: columns with one value per file; ordered: headings stand as declared."""

    columns: dict[str, tuple]
    key: tuple[str, ...] = ()
    single: tuple[str, ...] = ()
    ordered: bool = False
    also: tuple[tuple[str, Callable[[], Column]], ...] = field(default=())
    #: Conditions over all rows of a file, false where it has none.
    whole: tuple[tuple[str, Callable[[], Column]], ...] = field(default=())


#: Classes of tax (fixed values).
GST = ("taxable_sales", "creditable_purchases", "non_creditable", "gst_free", "input_taxed", "bas_excluded", "mixed", "gst", "gst_collected", "gst_paid")


def one_way() -> Column:
    """Every account of tax has the one class, or they are split by side and both sides have some."""
    has = lambda c: F.bool_or(F.col("gst_class") == c)
    sided = has("gst_collected") | has("gst_paid")
    return F.when(has("gst"), ~sided).otherwise(has("gst_collected") & has("gst_paid"))


TB = Contract(
    {"ReportDate": ("report_date", iso_date, False), "Tenant": ("tenant", text, False), "Section": ("section", text, False), "AccountID": ("account_id", text, False), "AccountName": ("account_name", text, False), "AccountCode": ("account_code", optional(text), True),
     "Debit": ("debit", amount, False), "Credit": ("credit", amount, False), "YTDDebit": ("ytd_debit", amount, False), "YTDCredit": ("ytd_credit", amount, False)},
    key=("tenant", "account_id"), single=("tenant", "report_date"),
)
one_positive = ("ONE_SIDE", lambda: ((F.col("debit") > 0) != (F.col("credit") > 0)) & (F.col("debit") >= 0) & (F.col("credit") >= 0))
identity: Guard = lambda c: F.when(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,79}$"), c)
currency: Guard = lambda c: F.when(c.rlike("^[A-Z]{3}$"), c)

digest: Guard = lambda c: F.when(c.rlike("^[0-9a-f]{64}$"), c)
turnover: Guard = lambda c: F.when(turnover_bounds(c)[0] < turnover_bounds(c)[1], c)
valid_abn: Guard = lambda c: F.when(abn_valid(c), c)
logical: Guard = lambda c: F.when(F.lower(c).isin("true", "false"), F.lower(c) == "true")

#: Sub-classes of accounts by class (fixed values).
BY_CLASS = {
    "Asset": ("Current Assets", "Non-Current Assets"), "Liability": ("Current Liabilities", "Non-Current Liabilities"), "Equity": ("Equity",), "Revenue": ("Operating Revenue", "Intercompany Revenue"),
    "Expense": ("Cost of Sales", "Operating Expenses"),
}
SUB_CLASSES = tuple(x for v in BY_CLASS.values() for x in v)


def classified() -> Column:
    """The sub-class is one of the class's, and the report section the class's."""
    fits = F.lit(False)
    for k, v in BY_CLASS.items():
        fits = fits | (F.col("class") == k) & F.col("sub_class").isin(*v)
    return fits & ((F.col("report_section") == "Profit and Loss") == F.col("class").isin("Revenue", "Expense"))


def counterparty() -> Column:
    """An intercompany line names another entity, other lines none need."""
    other = F.col("intercompany_entity_id")
    return ~F.col("is_intercompany") | (other.isNotNull() & (other != F.col("entity_id")))


def dated() -> Column:
    return (F.col("statutory_due_date") >= F.col("pay_date")) & (F.col("fund_receipt_date") >= F.col("remittance_date")) & (F.col("remittance_date") >= F.col("pay_date"))


def on_time() -> Column:
    return (F.col("compliance_status") == "LATE_BREACH") == (F.col("fund_receipt_date") > F.col("statutory_due_date"))


def estimated() -> Column:
    """No charge or interest before payday super began on 1 July 2026, nor on receipts in time."""
    free = (F.col("pay_date") < F.lit("2026-07-01").cast("date")) | (F.col("compliance_status") == "ON_TIME")
    return ~free | (F.col("sgc_shortfall") == 0) & (F.col("gic_nominal_interest") == 0)


#: Contracts by source name: heading -> (column, guard, may be empty). Headings and allowed values are fixed values of the file formats.
CONTRACTS = {
    "trial_balance": TB,
    "account_mapping": Contract({"AccountID": ("account_id", text, False), "ReviewGroup": ("review_group", text, False)}, key=("account_id",)),
    "mapping_policy": Contract({"Section": ("section", text, False), "ReviewGroup": ("review_group", text, False)}, key=("section", "review_group")),
    "balance_policy": Contract({"AccountID": ("account_id", text, False), "ExpectedBalance": ("expected_balance", one_of("debit", "credit", "nil", "any"), False), "ExpectMovement": ("expect_movement", yes_no, False)}, key=("account_id",), whole=(("NO_ROWS", lambda: F.count("*") > 0),)),
    "gst_mapping": Contract({"AccountID": ("account_id", text, False), "GSTClass": ("gst_class", one_of(*GST), False)}, key=("account_id",), whole=(("SIDES", one_way),)),
    "gst_settlements": Contract({"Reference": ("reference", text, False), "Amount": ("amount", amount, False)}, key=("reference",)),
    "gst_settlements_by_side": Contract({"Reference": ("reference", text, False), "Amount": ("amount", amount, False), "Side": ("side", one_of("collected", "paid"), False)}, key=("reference",)),
    "subledger": Contract({"Tenant": ("tenant", text, False), "AccountID": ("account_id", text, False), "SubledgerBalance": ("subledger_balance", amount, False)}, key=("tenant", "account_id")),
    "contacts": Contract({"ContactID": ("contact_id", text, False), "Name": ("name", text, False), "ABN": ("abn", optional(text), True)}, key=("contact_id",)),
    "transactions": Contract({"Tenant": ("tenant", text, False), "AccountID": ("account_id", text, False), "Currency": ("currency", currency, False), "TransactionID": ("transaction_id", identity, False), "Date": ("date", iso_date, False), "Reference": ("reference", optional(text), True), "Description": ("description", optional(text), True), "Debit": ("debit", money, False), "Credit": ("credit", money, False)}, key=("tenant", "account_id", "transaction_id"), single=("currency",), also=(one_positive,)),
    "decisions": Contract({"Group": ("group", text, False), "TransactionID": ("transaction_id", identity, False), "Decision": ("decision", optional(one_of("accept", "reject")), True), "Note": ("note", optional(text), True)}, key=("transaction_id",)),
    "open_items": Contract({"ItemID": ("item_id", text, False), "Severity": ("severity", one_of("BLOCKING", "EXPLAIN", "TRIVIAL"), False), "Owner": ("owner", optional(text), True), "DueDate": ("due_date", iso_date, False), "Status": ("status", one_of("OPEN", "CLEARED"), False), "Description": ("description", text, False), "Resolution": ("resolution", optional(text), True)}, key=("item_id",)),
    "activity_statement": Contract({"Label": ("label", one_of("1A", "1B", "GST_OPENING"), False), "Amount": ("amount", amount, False)}, key=("label",)),
    "gst_control_gl": Contract({"Date": ("date", iso_date, False), "AccountID": ("account_id", text, False), "AccountName": ("account_name", text, False), "Debit": ("debit", amount, False), "Credit": ("credit", amount, False), "Description": ("description", optional(text), True)}),
    "bank_rec": Contract({"AccountID": ("account_id", text, False), "StatementBalance": ("statement_balance", amount, False), "GLBalance": ("gl_balance", amount, False)}, key=("account_id",)),
    "tie_out_matrix": Contract({"StatementLine": ("statement_line", text, False), "StatementAmount": ("statement_amount", amount, False), "WorkpaperRef": ("workpaper_ref", optional(text), True), "SourceFile": ("source_file", optional(text), True), "Status": ("status", one_of("TIED", "EXCEPTION", "UNSUPPORTED"), False)}, key=("statement_line",)),
    "fs_mapping": Contract({"StatementLine": ("statement_line", text, False), "AccountID": ("account_id", text, False), "NormalBalance": ("normal_balance", one_of("debit", "credit"), False)}, key=("account_id",)),
    "prior_findings": Contract({"FindingCode": ("finding_code", text, False), "Slot": ("slot", text, False), "Status": ("status", one_of("OPEN", "CLOSED"), False)}, key=("finding_code", "slot")),
    "dim_account": Contract({"AccountCode": ("account_code", text, False), "AccountName": ("account_name", text, False), "Class": ("class", one_of("Asset", "Liability", "Equity", "Revenue", "Expense"), False), "SubClass": ("sub_class", one_of(*SUB_CLASSES), False), "ReportSection": ("report_section", one_of("Profit and Loss", "Balance Sheet"), False), "BalanceSheetGroup": ("balance_sheet_group", optional(text), True), "CashFlowCategory": ("cash_flow_category", optional(text), True), "NormalBalance": ("normal_balance", one_of("Debit", "Credit"), False), "SortOrder": ("sort_order", whole, False)}, key=("account_code",), ordered=True, also=(("CLASSIFICATION", classified),)),
    "dim_entity": Contract({"EntityID": ("entity_id", text, False), "LegalName": ("legal_name", text, False), "TradingName": ("trading_name", text, False), "ABN": ("abn", optional(valid_abn), True), "ACN": ("acn", optional(text), True), "TaxStructure": ("tax_structure", optional(text), True), "EntityRole": ("entity_role", optional(text), True), "ANZSIC_Code": ("anzsic_code", text, False), "Currency": ("currency", one_of("AUD"), False), "ConsolidationWeight": ("consolidation_weight", full_weight, False)}, key=("entity_id",), ordered=True),
    "dim_benchmark": Contract({"ANZSIC_Code": ("anzsic_code", text, False), "TurnoverRange": ("turnover_range", turnover, False), "GrossProfitPct_Low": ("gross_profit_low", money, False), "GrossProfitPct_Avg": ("gross_profit_avg", money, False), "GrossProfitPct_High": ("gross_profit_high", money, False), "TotalExpensesPct_Avg": ("total_expenses_avg", money, False), "RentPct_Avg": ("rent_avg", money, False), "MotorVehiclePct_Avg": ("motor_vehicle_avg", money, False), "LabourPct_Avg": ("labour_avg", money, False)},
        key=("anzsic_code", "turnover_range"), ordered=True, also=(("BOUNDS", lambda: (F.col("gross_profit_low") <= F.col("gross_profit_avg")) & (F.col("gross_profit_avg") <= F.col("gross_profit_high")) & (F.col("gross_profit_high") <= 100)),)),
    "fact_gl": Contract({"JournalID": ("journal_id", text, False), "LineNumber": ("line_number", whole, False), "PostingDate": ("posting_date", iso_date, False), "EntityID": ("entity_id", text, False), "AccountCode": ("account_code", text, False), "Debit": ("debit", money, False), "Credit": ("credit", money, False), "Amount": ("amount", amount, False), "Description": ("description", optional(text), True), "IntercompanyEntityID": ("intercompany_entity_id", optional(text), True), "IsIntercompany": ("is_intercompany", logical, False)},
        key=("journal_id", "line_number"), ordered=True, also=(("AMOUNT", lambda: F.col("amount") == F.col("debit") - F.col("credit")), ("INTERCOMPANY", counterparty))),
    "fact_budget": Contract({"PeriodDate": ("period_date", iso_date, False), "EntityID": ("entity_id", text, False), "AccountCode": ("account_code", text, False), "BudgetAmount": ("budget_amount", amount, False)}, key=("period_date", "entity_id", "account_code"), ordered=True, also=(("MONTH_START", lambda: F.trunc("period_date", "month") == F.col("period_date")),)),
    "fact_payroll": Contract({"EventID": ("event_id", text, False), "EmployeeID": ("employee_id", text, False), "EntityID": ("entity_id", text, False), "EmployeeName": ("employee_name", text, False), "PayDate": ("pay_date", iso_date, False), "GrossEarnings": ("gross_earnings", money, False), "QualifyingEarnings_CodeQ": ("qualifying_earnings", money, False), "SuperLiability_CodeL": ("super_liability", money, False), "SuperFundUSI": ("super_fund_usi", text, False), "SuperFundName": ("super_fund_name", text, False), "RemittanceDate": ("remittance_date", iso_date, False), "FundReceiptDate": ("fund_receipt_date", iso_date, False), "StatutoryDueDate": ("statutory_due_date", iso_date, False), "ComplianceStatus": ("compliance_status", one_of("ON_TIME", "LATE_BREACH"), False), "SGC_Shortfall": ("sgc_shortfall", money, False), "GIC_NominalInterest": ("gic_nominal_interest", money, False)},
        key=("event_id",), ordered=True, also=(("DATES", dated), ("STATUS", on_time), ("ESTIMATE", estimated))),
    "review_run": Contract({"RunID": ("run_id", digest, False), "Entity": ("entity", text, False), "Tenant": ("tenant", text, False), "Period": ("period", iso_date, False), "Basis": ("basis", text, False), "Currency": ("currency", currency, False), "CloseStatus": ("close_status", optional(text), True), "ReadinessStatus": ("readiness_status", optional(text), True), "PriorPeriod": ("prior_period", optional(iso_date), True), "AbsoluteThreshold": ("absolute_threshold", optional(amount), True), "PercentageThreshold": ("percentage_threshold", optional(text), True), "ControlsNotRun": ("controls_not_run", optional(text), True), "ReadinessControlsNotRun": ("readiness_controls_not_run", optional(text), True), "Acknowledgement": ("acknowledgement", optional(text), True), "UnmappedExceptions": ("unmapped_exceptions", optional(text), True), "SourceTBHash": ("source_tb_hash", optional(text), True), "SourceGLHash": ("source_gl_hash", optional(text), True), "Verification": ("verification", optional(text), True), "Boundary": ("boundary", optional(text), True)}, key=("run_id",), ordered=True),
    "review_exception": Contract({"RunID": ("run_id", digest, False), "Entity": ("entity", text, False), "Tenant": ("tenant", text, False), "Period": ("period", iso_date, False), "Basis": ("basis", text, False), "Currency": ("currency", currency, False), "ExceptionKey": ("exception_key", text, False), "Control": ("control", text, False), "Status": ("status", text, False), "AccountID": ("account_id", optional(text), True), "Account": ("account", optional(text), True), "Current": ("current", optional(amount), True), "Prior": ("prior", optional(amount), True), "Difference": ("difference", optional(amount), True), "Threshold": ("threshold", optional(amount), True), "Reason": ("reason", optional(text), True), "Action": ("action", optional(text), True), "Question": ("question", optional(text), True), "EvidenceRequested": ("evidence_requested", optional(text), True), "EvidenceState": ("evidence_state", optional(text), True)}, key=("run_id", "exception_key"), ordered=True),
    "review_evidence": Contract({"RunID": ("run_id", digest, False), "Entity": ("entity", text, False), "Tenant": ("tenant", text, False), "Period": ("period", iso_date, False), "Basis": ("basis", text, False), "Currency": ("currency", currency, False), "ExceptionKey": ("exception_key", text, False), "AccountID": ("account_id", text, False), "TransactionID": ("transaction_id", text, False), "Date": ("date", iso_date, False), "Reference": ("reference", optional(text), True), "Description": ("description", optional(text), True), "Amount": ("amount", amount, False)}, key=("run_id", "exception_key", "transaction_id"), ordered=True),
    "grant_ledger": Contract({"ledger_id": ("ledger_id", text, False), "date": ("date", iso_date, False), "description": ("description", text, False), "amount": ("amount", money, False), "cash_paid": ("cash_paid", money, False), "evidence": ("evidence", optional(text), True)}, key=("ledger_id",), ordered=True),
    "grant_allocations": Contract({"allocation_id": ("allocation_id", text, False), "ledger_id": ("ledger_id", text, False), "grant_id": ("grant_id", text, False), "budget_line": ("budget_line", text, False), "amount": ("amount", money, False), "cash_allocated": ("cash_allocated", money, False), "approved": ("approved", yes_no, False), "evidence": ("evidence", optional(text), True)}, key=("allocation_id",), ordered=True),
    "grant_receipts": Contract({"receipt_id": ("receipt_id", text, False), "grant_id": ("grant_id", text, False), "date": ("date", iso_date, False), "amount": ("amount", money, False), "evidence": ("evidence", optional(text), True)}, key=("receipt_id",), ordered=True),
    "grant_contributions": Contract({"contribution_id": ("contribution_id", text, False), "grant_id": ("grant_id", text, False), "date": ("date", iso_date, False), "kind": ("kind", one_of("interest", "cash_contribution", "in_kind"), False), "amount": ("amount", money, False), "evidence": ("evidence", optional(text), True)}, key=("contribution_id",), ordered=True),
}

def records(spark: SparkSession, path: str, headings: list[str]) -> DataFrame:
    """(file, at, _c0…, wide): records of CSV files, all text; wide: the record has more or fewer fields than the headings.

    The scan reads positions; the header record of each file tells what they are.
    """
    names = [f"_c{i}" for i in range(len(headings))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "corrupt"]])
    raw = spark.read.schema(schema).option("header", False).option("quote", '"').option("escape", '"').option("columnNameOfCorruptRecord", "corrupt").csv(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))  # blocks of a file may be read in any order
    return raw.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.regexp_replace("_c0", "^\\x{FEFF}", "").alias("_c0"), *names[1:], F.col("corrupt").isNotNull().alias("wide"))


def captured_records(spark: SparkSession, path: str, headings: list[str]) -> DataFrame:
    """records(), and sha256, the digest of the bytes that these records were parsed from: a file's bytes are read once, hashed and parsed by one task, which
    holds them. at numbers a file's records from 0; blank lines are none. Bytes that aren't UTF-8 stand as U+FFFD."""
    names = [f"_c{i}" for i in range(len(headings))]
    kind = T._parse_datatype_string("file string, sha256 string, at struct<block:long,n:long>, " + ", ".join(f"{n} string" for n in names) + ", wide boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, wanted = to_arrow_schema(kind), len(names)
        csv.field_size_limit(1 << 30)
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                digest, text = sha256(data).hexdigest(), io.TextIOWrapper(io.BytesIO(data), "utf-8-sig", "replace", newline="")
                out: list[dict] = []
                for n, cells in enumerate(r for r in csv.reader(text) if r):
                    row = {"file": file, "sha256": digest, "at": {"block": 0, "n": n}, "wide": len(cells) != wanted}
                    out.append(row | dict(zip(names, cells, strict=False)))
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content").mapInArrow(run, kind)


def read_csv(spark: SparkSession, path: str, contract: Contract, widths: bool = True, captured: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted, refusals) of all files of a path: typed rows with `file` and `sha256`; (file, sha256, row, code, column).

    captured: the digest is that of the very bytes that were parsed, and a file is held by one task; without it files of any size are scanned in parts, once:
    their records are written, and so is what was judged of them; sha256 is null.

    Codes: HEADER, WIDTH, VALUE, REPEATED_KEY, SEVERAL_VALUES and the contract's own. Headings may stand in any order unless the contract
    declares it; surplus, missing or repeated headings refuse the file. Only the header records and refused files' names are grouped.
    """
    heads = list(contract.columns)
    cells = [f"_c{i}" for i in range(len(heads))]
    if captured:
        raw = captured_records(spark, path, heads)
        first = raw.groupBy("file").agg(F.min_by(F.struct(*cells, "wide"), "at").alias("h"), F.min("at").alias("first"), F.min("sha256").alias("sha256"))
    else:
        raw = staged(records(spark, path, heads), "csv-records").withColumn("sha256", F.lit(None).cast("string"))
        # numbers are grouped by hash, text would be sorted: a minimum of each block, then of each file
        least = raw.groupBy("file", F.col("at.block").alias("block")).agg(F.min("at.n").alias("n")).groupBy("file").agg(F.min(F.struct("block", "n")).alias("at"))
        first = raw.join(few(staged(least, "csv-first")), ["file", "at"]).select("file", F.struct(*cells, "wide").alias("h"), F.col("at").alias("first"), "sha256")
    head = first.select("file", "sha256", "first", F.array(*[F.col(f"h.{c}") for c in cells]).alias("names"), F.col("h.wide").alias("over"))
    names, wanted = (F.col("names"), heads) if contract.ordered else (F.array_sort("names"), sorted(heads))
    ok = F.coalesce(~F.col("over") & (names == F.array(*[F.lit(h) for h in wanted])), F.lit(False))
    head = head.withColumns({"ok": ok, "places": F.array(*[F.array_position("names", h).cast("int") - 1 for h in heads])})
    if not captured:
        head = staged(head, "csv-heads")
    data = raw.drop("sha256").join(head.hint("shuffle_hash") if captured else few(head), "file").where(F.col("at") != F.col("first"))
    data = data.select("file", "sha256", F.col("at.n").alias("row"), "ok", "wide", "places", F.array(*cells).alias("cells"))
    data = data.select("file", "sha256", "row", "ok", "wide", *[F.get("cells", F.get("places", F.lit(i))).alias(c) for i, c in enumerate(cells)])
    # a step for each: Spark computes what is used several times once only if it stands in a step of its own
    data = data.select("*", *[guard(F.col(c)).alias(name) for c, (name, guard, _) in zip(cells, contract.columns.values(), strict=True)])
    issues = []
    if widths:
        issues.append(F.when(F.col("ok") & F.col("wide"), F.struct(F.lit("WIDTH").alias("code"), F.lit(None).cast("string").alias("column"))))
    for c, (name, _, empty) in zip(cells, contract.columns.values(), strict=True):
        bad = F.coalesce(c, F.lit("")) != "" if empty else F.lit(True)
        issues.append(F.when(F.col("ok") & bad & F.col(name).isNull(), F.struct(F.lit("VALUE").alias("code"), F.lit(name).alias("column"))))
    issues += [F.when(F.col("ok") & ~F.coalesce(c(), F.lit(True)), F.struct(F.lit(code).alias("code"), F.lit(None).cast("string").alias("column"))) for code, c in contract.also]
    rows = data.select("file", "sha256", "row", "ok", *[name for name, _, _ in contract.columns.values()], F.filter(F.array(*issues), lambda x: x.isNotNull()).alias("issues"))
    if not captured:
        rows = staged(rows, "csv-judged")
    refusals = rows.select("file", "row", F.explode("issues").alias("x")).select("file", "row", "x.code", "x.column")
    if contract.key:
        known = rows.where("ok").select("file", "row", *contract.key)
        if not captured:  # rows whose key stands once are told by a hash, so that few are brought together
            known = known.withColumn("hash", F.xxhash64("file", *contract.key))
            known = known.join(few(staged(known.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "csv-repeated")), "hash", "left_semi")
        many = known.withColumn("many", F.count("*").over(Window.partitionBy("file", *contract.key))).where("many > 1")
        refusals = refusals.unionByName(many.select("file", "row", F.lit("REPEATED_KEY").alias("code"), F.lit(contract.key[-1]).alias("column")))
    for c in contract.single:
        several = rows.where("ok").select("file", c).distinct().groupBy("file").agg(F.min(c).alias("a"), F.max(c).alias("b")).where("a <> b")
        refusals = refusals.unionByName(several.select("file", F.lit(None).cast("long").alias("row"), F.lit("SEVERAL_VALUES").alias("code"), F.lit(c).alias("column")))
    for code, c in contract.whole:
        fine = head.where("ok").select("file").join(rows.groupBy("file").agg(c().alias("fine")), "file", "left").where(~F.coalesce("fine", F.lit(False)))
        refusals = refusals.unionByName(fine.select("file", F.lit(None).cast("long").alias("row"), F.lit(code).alias("code"), F.lit(None).cast("string").alias("column")))
    bare = head.where("not ok").select("file", F.lit(0).cast("long").alias("row"), F.lit("HEADER").alias("code"), F.lit(None).cast("string").alias("column"))
    refusals = refusals.unionByName(bare)
    refused = refusals.select("file").distinct()
    accepted = rows.join(refused if captured else few(staged(refused, "csv-refused")), "file", "left_anti").select("file", "sha256", *[name for name, _, _ in contract.columns.values()])
    return accepted, refusals.join(head.select("file", "sha256"), "file").select("file", "sha256", "row", "code", "column")


def of_folder(file: Column, name: str) -> Column:
    """The value of a folder name=value of a path, as Spark names folders of partitions: a URI whose special characters were escaped before."""
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return plain(plain(F.regexp_extract(file, f"/{name}=([^/]*)/", 1)))


def read_sets(spark: SparkSession, path: str, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(accepted, refusals) of policy files in folders path/tenant=.../from=...: rows with tenant and effective_from, a date, in place of the file's name. A
    file's refusal leaves the tenant with the set before it. Code FOLDER: the folders name no tenant, or no ISO date."""
    rows, refusals = read_csv(spark, f"{path}/*/*", contract)
    placed = rows.withColumns({"tenant": clean_text(of_folder(F.col("file"), "tenant")), "effective_from": iso_date(of_folder(F.col("file"), "from"))})
    lost = F.col("tenant").isNull() | F.col("effective_from").isNull()
    bad = placed.where(lost).select("file", "sha256", F.lit(None).cast("long").alias("row"), F.lit("FOLDER").alias("code"), F.lit(None).cast("string").alias("column")).distinct()
    return placed.where(~lost).drop("file", "sha256"), refusals.unionByName(bad)


CELLS = "array<struct<Value:string,Attributes:array<struct<Id:string,Value:string>>>>"
REPORT = f"Reports array<struct<ReportType:string,ReportTitles:array<string>,Rows:array<struct<RowType:string,Title:string,Cells:{CELLS},Rows:array<struct<RowType:string,Cells:{CELLS}>>>>>>"


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, row_type, cells map<string,string>, account_id): nested trial-balance reports as flat rows, headings from the header row."""
    doc = spark.read.schema(REPORT).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), F.get("Reports", F.lit(0)).alias("r"))
    head = F.get(F.filter("r.Rows", lambda x: x["RowType"] == "Header"), F.lit(0))["Cells"]
    rows = doc.select("file", F.transform(head, lambda c: c["Value"]).alias("names"), F.explode("r.Rows").alias("s")).where("s.RowType = 'Section'")
    rows = rows.select("file", "names", F.col("s.Title").alias("section"), F.explode("s.Rows").alias("x"))
    attr = F.get(F.filter(F.flatten(F.transform("x.Cells", lambda c: F.coalesce(c["Attributes"], F.array().cast("array<struct<Id:string,Value:string>>")))), lambda a: a["Id"] == "account"), F.lit(0))["Value"]
    cells = F.when(F.size("names") == F.size("x.Cells"), F.map_from_arrays("names", F.transform("x.Cells", lambda c: c["Value"])))
    return rows.select("file", "section", F.col("x.RowType").alias("row_type"), cells.alias("cells"), attr.alias("account_id"))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, cells): records of report-shaped CSVs in file order, with as many cells as each has. A report is one file of some pages, split by
    line within its task; a cell doesn't hold a line break. A quote that isn't closed leaves the rest of its line as one cell."""
    f = capture(spark, path).select("file", F.posexplode(F.split(F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "\n$", ""), "\n", -1)).alias("pos", "line"))  # a final line break ends a record
    # a cell is quoted, with quotes doubled, or runs to the next comma; every match takes the comma before it, so an empty first cell isn't lost
    raw = F.regexp_extract_all(F.concat(F.lit(","), "line"), F.lit(r',("(?:[^"]|"")*"(?=,|$)|[^,]*)'), 1)
    return f.select("file", "pos", F.transform(raw, lambda c: F.when(c.rlike(r'(?s)^".*"$'), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)).alias("cells"))
