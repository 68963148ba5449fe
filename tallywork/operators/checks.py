"""Checks of star-schema sources, reports and evidence against each other; each returns rows of issues."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import abn_valid, account_parts, formula_safe, long_date

#: From this date on, contributions are due by business days after pay day.
PAYDAY_START = "2026-07-01"


def check_thresholds(absolute: str, fraction: str) -> None:
    """Refuse thresholds that are not finite, negative, or a fraction over one, before anything is planned."""
    a, f = Decimal(absolute), Decimal(fraction)
    if not (a.is_finite() and f.is_finite()) or a < 0 or not 0 <= f <= 1:
        raise ValueError("thresholds must be finite and not negative, the fraction at most 1")


def threshold_issue(absolute: Column, fraction: Column) -> Column:
    """THRESHOLD or FRACTION where texts of thresholds break the rule of check_thresholds, else null."""
    finite = lambda c: c.rlike(r"^[+-]?\d+(\.\d+)?$")
    a, f = absolute.try_cast("decimal(28,10)"), fraction.try_cast("decimal(28,10)")
    return F.when(~F.coalesce(finite(absolute) & (a >= 0), F.lit(False)), "THRESHOLD").when(~F.coalesce(finite(fraction) & (f >= 0) & (f <= 1), F.lit(False)), "FRACTION")


def issues(df: DataFrame, keys: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """(keys, issue) for each rule whose condition holds."""
    return df.select(*keys, F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())).alias("issue"))


def require_rows(df: DataFrame, required: list[str], keys: list[str]) -> DataFrame:
    """(keys, issue): BLANK_<column> of required columns, REPEATED_KEY. Repeats are counted by grouping, so a hot key is one row."""
    blank = issues(df, keys, [(f"BLANK_{c}", F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "") for c in required])
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys, F.lit("REPEATED_KEY").alias("issue"))
    return blank.unionByName(twice)


def chart_issues(accounts: DataFrame) -> DataFrame:
    """(account_code, issue) of chart rows (account_code, class, sub_class, report_section, normal_balance): balance-sheet classes report in the balance sheet, others in profit and loss; sides follow the class."""
    sheet = F.col("class").isin("Assets", "Liabilities", "Equity")
    debit = F.col("class").isin("Assets", "Expenses")
    known = F.col("class").isin("Assets", "Liabilities", "Equity", "Revenue", "Expenses")
    return issues(accounts, ["account_code"], [("UNKNOWN_CLASS", ~known), ("SECTION", known & (sheet != (F.col("report_section") == "Balance Sheet"))), ("NORMAL_BALANCE", known & (F.col("normal_balance") != F.when(debit, "debit").otherwise("credit"))), ("NO_SUB_CLASS", F.coalesce("sub_class", F.lit("")) == "")])


def entity_issues(entities: DataFrame, industries: DataFrame) -> DataFrame:
    """(entity_id, issue) of entities (entity_id, abn, anzsic_code, currency, consolidation_weight)."""
    e = entities.join(industries.select("anzsic_code", F.lit(True).alias("known")).distinct(), "anzsic_code", "left")
    return issues(e, ["entity_id"], [("UNKNOWN_INDUSTRY", F.col("known").isNull()), ("INVALID_ABN", ~abn_valid("abn")), ("CURRENCY", F.col("currency") != "AUD"), ("WEIGHT", F.col("consolidation_weight") != 1)])


def budget_issues(budget: DataFrame, entities: DataFrame, accounts: DataFrame, start: str, end: str) -> DataFrame:
    """(entity_id, account_code, period_date, issue) of budget rows."""
    b = budget.join(entities.select("entity_id", F.lit(True).alias("e")).distinct(), "entity_id", "left").join(accounts.select("account_code", F.col("report_section").alias("s")), "account_code", "left")
    d = F.col("period_date")
    return issues(b, ["entity_id", "account_code", "period_date"], [("UNKNOWN_ENTITY", F.col("e").isNull()), ("UNKNOWN_ACCOUNT", F.col("s").isNull()), ("NOT_PROFIT_AND_LOSS", F.col("s") == "Balance Sheet"), ("NOT_MONTH_START", F.trunc(d, "month") != d), ("OUTSIDE_HORIZON", ~d.between(F.lit(start).cast("date"), F.lit(end).cast("date")))])


def payroll_issues(events: DataFrame) -> DataFrame:
    """(event_id, issue) of pay events (event_id, pay_date, gross, qualifying, liability, remitted, received, due_date)."""
    return issues(events, ["event_id"], [("NEGATIVE", (F.col("gross") < 0) | (F.col("liability") < 0)), ("QUALIFYING_OVER_GROSS", F.col("qualifying") > F.col("gross")), ("RECEIVED_BEFORE_REMITTED", F.col("received") < F.col("remitted")), ("DUE_BEFORE_PAY", F.col("due_date") < F.col("pay_date"))])


def payroll_basis(events: DataFrame) -> DataFrame:
    """events with `regime` (PAYDAY from PAYDAY_START on, else QUARTERLY) and `basis` (ACTUAL if received, else ESTIMATE)."""
    return events.withColumns({"regime": F.when(F.col("pay_date") >= F.lit(PAYDAY_START).cast("date"), "PAYDAY").otherwise("QUARTERLY"), "basis": F.when(F.col("received").isNull(), "ESTIMATE").otherwise("ACTUAL")})


def aged_metadata(titles: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, issue): title rows (file, entity, as_at, basis, sha256, footer_record, records) against the manifest's."""
    rows = manifest.join(titles.withColumn("here", F.lit(True)).select("file", "here"), "file", "left").where("here is null").select("file", F.lit("MISSING_FILE").alias("issue"))
    t = titles.select("file", *[F.col(c).alias(f"t_{c}") for c in ("entity", "as_at", "basis", "sha256", "footer_record")])
    both = manifest.join(t, "file")
    return issues(both, ["file"], [(n, ~F.col(c).eqNullSafe(F.col(f"t_{c}"))) for n, c in (("ENTITY", "entity"), ("CUT_OFF", "as_at"), ("BASIS", "basis"), ("DIGEST", "sha256"), ("FOOTER", "footer_record"))]).unionByName(rows)


def evidence_requests(exceptions: DataFrame) -> DataFrame:
    """(file, record, request): what to ask for, from exception texts (file, text) that name records by `record <n>`; a text without one asks about the file (null record)."""
    numbers = F.regexp_extract_all("text", F.lit(r"record (\d+)"), 1)
    e = exceptions.withColumn("record", F.explode_outer(numbers))
    kind = F.when(F.col("text").contains("footer"), "Report with its footer").when(F.col("text").contains("control"), "Control account reconciliation").otherwise("Invoice or receipt")
    return e.select("file", F.col("record").cast("int").alias("record"), kind.alias("request")).distinct()


def report_identity(reports: DataFrame, wanted: str) -> DataFrame:
    """(file, issue) of reports (file, type, titles array, columns array): another type, not one `As at` title of the wanted date, missing columns."""
    at = F.filter(F.transform("titles", lambda t: F.regexp_extract(t, r"^As at (.*)$", 1)), lambda t: t != "")
    need = F.array(*[F.lit(c) for c in ("Account", "Debit", "Credit", "YTD Debit", "YTD Credit")])
    return issues(reports, ["file"], [("REPORT_TYPE", F.col("type") != "TrialBalance"), ("TITLES", F.size(at) != 1), ("DATE", (F.size(at) == 1) & ~F.coalesce(long_date(F.get(at, F.lit(0))) == F.lit(wanted).cast("date"), F.lit(False))), ("COLUMNS", F.size(F.array_except(need, "columns")) > 0)])


def canonical_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, issues): flat report rows (file, tenant, report_date, section, account, account_id, debit, credit, ytd_debit, ytd_credit) in canonical form; missing and repeated account ids are refused."""
    key = F.lower(F.trim("account_id"))
    r = rows.withColumn("n", F.count("*").over(Window.partitionBy("file", key)))
    bad = issues(r, ["file", "account"], [("MISSING_ID", F.coalesce(key, F.lit("")) == ""), ("REPEATED_ID", (F.coalesce(key, F.lit("")) != "") & (F.col("n") > 1))])
    name, code = account_parts("account")
    good = r.join(bad.select("file").distinct(), "file", "left_anti")
    return good.select("report_date", "tenant", "section", "account_id", formula_safe(name).alias("account_name"), code.alias("account_code"), "debit", "credit", "ytd_debit", "ytd_credit"), bad


def tb_summary(tb: DataFrame) -> DataFrame:
    """(tenant, report_date, accounts, movement, ytd, balanced) per trial balance."""
    g = tb.groupBy("tenant", "report_date").agg(F.count("*").alias("accounts"), *[F.sum(c).alias(c) for c in ("debit", "credit", "ytd_debit", "ytd_credit")])
    return g.select("tenant", "report_date", "accounts", F.col("debit").alias("movement"), F.col("ytd_debit").alias("ytd"), ((F.col("debit") == F.col("credit")) & (F.col("ytd_debit") == F.col("ytd_credit"))).alias("balanced"))


def line_mapping(detail: DataFrame, mapping: DataFrame) -> DataFrame:
    """(file, source_row, issue): mapping rows must cover the detail exactly, once each."""
    d, m = detail.select("file", "source_row", F.lit(1).alias("d")), mapping.groupBy("file", "source_row").agg(F.count("*").alias("m"))
    return issues(d.join(m, ["file", "source_row"], "full_outer"), ["file", "source_row"], [("NOT_MAPPED", F.col("m").isNull()), ("NOT_IN_DETAIL", F.col("d").isNull()), ("MAPPED_TWICE", F.col("m") > 1)])


def finding_evidence(found: DataFrame, queries: DataFrame, totals: DataFrame) -> DataFrame:
    """Findings (tenant, account_id, report_date) with their question's id, and `explained`: every amount of the window is in the driver evidence."""
    k = ["tenant", "account_id", "report_date"]
    j = found.join(queries.select(*k, "query_id"), k, "left").join(totals.select(*k, "unexplained", "n", "drivers"), k, "left")
    return j.withColumn("explained", F.coalesce((F.col("unexplained") == 0) & (F.col("n") == F.col("drivers")), F.lit(False))).select(*k, "query_id", "explained")


def evidence_population(evidence: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, issue): evidence rows that the source lacks, source rows that the evidence lacks, as often as they stand there. Both sides meet once, by all
    columns; a row with a null is lacked, as it equals none."""
    both = evidence.select(*columns, F.lit(1).alias("e"), F.lit(0).alias("s")).unionByName(source.select(*columns, F.lit(0).alias("e"), F.lit(1).alias("s")))
    n = both.groupBy(*columns).agg(F.sum("e").cast("int").alias("e"), F.sum("s").cast("int").alias("s"))
    bare = F.greatest(F.lit(False), *[F.col(c).isNull() for c in columns])
    issues = F.concat(F.when(bare | (F.col("s") == 0), F.array_repeat(F.lit("NOT_IN_SOURCE"), F.col("e"))).otherwise(F.array()), F.when(bare | (F.col("e") == 0), F.array_repeat(F.lit("NOT_IN_EVIDENCE"), F.col("s"))).otherwise(F.array()))
    return n.select(*columns, F.explode(issues).alias("issue"))
