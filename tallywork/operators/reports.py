"""Report-shaped tables and keyed comparisons: headers, footers, sections, subtotals, two-sided reconciliation, cell differences, aged ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import AMOUNT, account_parts, accounting_number


def promote_header(records: DataFrame, first: str) -> DataFrame:
    """(file, pos, header, cells): records after the first whose first cell is `first`; files without one are left out. records: (file, pos, cells array<string>)."""
    at = records.where(F.trim(F.get("cells", F.lit(0))) == first).groupBy("file").agg(F.min_by("cells", "pos").alias("header"), F.min("pos").alias("at"))
    return records.join(at, "file").where(F.col("pos") > F.col("at")).select("file", "pos", F.transform("header", F.trim).alias("header"), "cells")


def named_cells(promoted: DataFrame) -> DataFrame:
    """(file, pos, row map<string,string>): cells by header name; a record of another width is refused (null row), never padded."""
    row = F.when(F.size("header") == F.size("cells"), F.map_from_arrays("header", "cells"))
    return promoted.select("file", "pos", row.alias("row"))


def footer(records: DataFrame, label: str = "Total", last: str = "Percentage of total") -> DataFrame:
    """records with is_footer: the terminal `label` row, or the pair of it and `last`; a contact of that name elsewhere is no footer."""
    w = Window.partitionBy("file").orderBy(F.col("pos").desc())
    name = F.get("cells", F.lit(0))
    r = records.withColumns({"back": F.row_number().over(w), "end": F.first(name).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    flag = F.when(F.col("end") == last, ((F.col("back") == 1) | (F.col("back") == 2) & (name == label))).otherwise((F.col("back") == 1) & (name == label))
    return r.withColumn("is_footer", F.coalesce(flag, F.lit(False))).drop("back", "end")


def fill_sections(rows: DataFrame) -> DataFrame:
    """Rows (file, pos, label, amount) with the section they stand under; section rows have no amount. Section totals go."""
    w = Window.partitionBy("file").orderBy("pos")
    s = rows.withColumn("section", F.last(F.when(F.col("amount").isNull(), F.col("label")), ignorenulls=True).over(w))
    return s.where(F.col("amount").isNotNull() & (F.col("section").isNull() | (F.col("label") != F.concat(F.lit("Total "), "section"))))


def subtotal_proof(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """(file, section, total, summed): sections whose total differs from their rows, or that lack one side."""
    s = rows.groupBy("file", "section").agg(F.sum("amount").alias("summed"))
    return s.join(totals, ["file", "section"], "full_outer").where(~F.col("summed").eqNullSafe(F.col("total"))).select("file", "section", "total", "summed")


def choose_pair(rows: DataFrame, ytd: bool) -> DataFrame:
    """Rows with debit and credit taken from the year-to-date or the period pair."""
    return rows.withColumns({"debit": F.col("ytd_debit" if ytd else "period_debit"), "credit": F.col("ytd_credit" if ytd else "period_credit")})


def tenants_chosen(tenants: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (wanted, ask) with the id of the tenant (id, name) that has it as its id, else of the only one whose name contains it; several or none: null.

    Tenants are compared with each ask, as names are searched for a part: both are short lists of one organisation.
    """
    by_id, by_name = F.lower("id") == F.lower("ask"), F.lower("name").contains(F.lower(F.col("ask")))
    c = asked.join(tenants, by_id | by_name).groupBy("wanted", "ask").agg(F.max(F.when(by_id, F.col("id"))).alias("own"), F.count("*").alias("n"), F.max("id").alias("one"))
    return asked.join(c.select("wanted", F.coalesce("own", F.when(F.col("n") == 1, F.col("one"))).alias("id")), "wanted", "left")


def tenant_selection(tenants: DataFrame, wanted: str) -> DataFrame:
    """The tenant (id, name) of that id, else the only one whose name contains it; several or none: no row."""
    asked = tenants.sparkSession.createDataFrame([("x", wanted)], "wanted string, ask string")
    return tenants.join(tenants_chosen(tenants, asked).select("id"), "id", "left_semi").select("id", "name")


def clean_key(key: Column) -> Column:
    """A key without invisible characters and outer space, in upper case."""
    return F.upper(F.trim(F.regexp_replace(key, r"[\x{A0}\x{200B}-\x{200D}\x{FEFF}\p{Cc}]", "")))


def keyed_comparison(left: DataFrame, right: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """(key, left, right, difference, state): (key, amount) tables, repeated keys summed per side; ONLY_LEFT, ONLY_RIGHT, DIFFERENT, EQUAL."""
    s = lambda d, n: d.groupBy(clean_key(F.col("key")).alias("key")).agg(F.sum("amount").alias(n))
    j = s(left, "left").join(s(right, "right"), "key", "full_outer")
    d = F.coalesce("left", F.lit(0)) - F.coalesce("right", F.lit(0))
    state = F.when(F.col("right").isNull(), "ONLY_LEFT").when(F.col("left").isNull(), "ONLY_RIGHT").when(F.abs(d) > F.lit(tolerance).cast("decimal(19,4)"), "DIFFERENT").otherwise("EQUAL")
    return j.select("key", "left", "right", d.alias("difference"), state.alias("state"))


def cell_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(book, sheet, cell, change) of formula cells: ADDED, REMOVED, CHANGED."""
    k = ["book", "sheet", "cell"]
    j = before.select(*k, F.col("formula").alias("a")).join(after.select(*k, F.col("formula").alias("b")), k, "full_outer")
    return j.where(~F.col("a").eqNullSafe(F.col("b"))).select(*k, F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").otherwise("CHANGED").alias("change"))


def new_links(before: DataFrame, after: DataFrame) -> DataFrame:
    """(book, link): external workbooks ([name]) that formulas name only afterwards, case ignored."""
    links = lambda d: d.select("book", F.explode(F.regexp_extract_all(F.lower("formula"), F.lit(r"\[([^\]]+)\]"), 1)).alias("link")).distinct()
    return links(after).join(links(before), ["book", "link"], "left_anti")


def aged_ties(rows: DataFrame, buckets: list[str], control: DataFrame) -> DataFrame:
    """(file, tie, difference): rows against their total, columns against the footer, footer against the control balance; ties within half a cent are left out.

    rows: (file, is_footer, buckets…, total); control: (file, balance).
    """
    line = sum((F.col(b) for b in buckets), F.lit(0))
    own = rows.where(F.abs(line - F.col("total")) >= F.lit("0.005").cast("decimal(19,4)")).select("file", F.lit("row").alias("tie"), (line - F.col("total")).alias("difference"))
    cols = [*buckets, "total"]
    sums = rows.groupBy("file").agg(*[F.sum(F.when(~F.col("is_footer"), F.col(c))).alias(f"s_{c}") for c in cols], *[F.sum(F.when(F.col("is_footer"), F.col(c))).alias(f"f_{c}") for c in cols])
    stack = ", ".join(f"'{c}', s_{c} - f_{c}" for c in cols)
    column = sums.selectExpr("file", f"stack({len(cols)}, {stack}) as (tie, difference)")
    ledger = sums.join(control, "file").select("file", F.lit("control").alias("tie"), (F.col("f_total") - F.col("balance")).alias("difference"))
    return own.unionByName(column).unionByName(ledger).where(F.abs("difference") >= F.lit("0.005").cast("decimal(19,4)"))


#: Headings of report-shaped exports (fixed values).
AGED_BUCKETS = ("< 1 Month", "1 Month", "2 Months", "3 Months", "Older", "Total")
PAYDAY = (
    "row", "employee_id", "qe_day", "pathway", "due_date", "verdict", "days_late", "lateness_measured_to", "sg_amount", "final_shortfall", "notional_earnings", "uplift_best_case", "uplift_worst_case",
    "sgc_estimate_low", "sgc_estimate_high", "caveats", "notes", "unassessable_between",
)
ACCOUNT_TRANSACTIONS = ("Date", "Source", "Description", "Reference", "Debit", "Credit", "Running Balance", "Gross", "GST")


def aged_report(records: DataFrame, first: str = "Contact") -> tuple[DataFrame, DataFrame]:
    """(rows, refusals) of aged summaries: (file, pos, label, row map<string,string>, is_footer) after the header; (file, code) of files without a header,
    without a bucket, or with a record of another width."""
    found = promote_header(records, first).where(F.exists("cells", lambda c: F.trim(c) != ""))
    flat = footer(found)
    rows = flat.select("file", "pos", F.get("cells", F.lit(0)).alias("label"), "is_footer", F.when(F.size("header") == F.size("cells"), F.map_from_arrays("header", "cells")).alias("row"), "header")
    lacking = ~F.forall(F.array(*[F.lit(b) for b in AGED_BUCKETS]), lambda b: F.array_contains(F.col("header"), b))
    bad = rows.select("file", F.when(lacking, "HEADER").when(F.col("row").isNull(), "WIDTH").alias("code")).where("code is not null")
    bad = bad.unionByName(records.select("file").distinct().join(found.select("file"), "file", "left_anti").select("file", F.lit("NO_HEADER").alias("code"))).distinct()
    return rows.drop("header").join(bad, "file", "left_anti"), bad


#: Labels of a spreadsheet's export of separate columns, and the names that they stand for (fixed values).
TB_LABELS = {"Account": "Account Name", "Debit - Year to date": "YTD Debit", "Credit - Year to date": "YTD Credit"}


def trial_balance_report(records: DataFrame, ytd: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, refusals) of report-shaped trial balances: (file, pos, account_code, account_name, debit, credit), and (file, code).

    The header is the first record whose first cell is `Account` (code and name in one cell) or `Account Code` (a cell each). ytd: take the year-to-date
    pair, or the period's; None: year to date where a file has it. Blank records and those of `Total` go; an empty amount is nil. Codes: NO_HEADER, PAIR
    (the file lacks the pair), WIDTH (a record of another width), AMOUNT. records: (file, pos, cells array<string>).
    """
    first = F.trim(F.get("cells", F.lit(0)))
    head = records.where(first.isin("Account", "Account Code")).groupBy("file").agg(F.min_by("cells", "pos").alias("h"), F.min("pos").alias("at"))
    head = head.withColumn("h", F.transform("h", F.trim)).withColumn("apart", F.get("h", F.lit(0)) == "Account Code")
    named = F.create_map(*[F.lit(x) for kv in TB_LABELS.items() for x in kv])
    head = head.withColumn("h", F.when(F.col("apart"), F.transform("h", lambda x: F.coalesce(named[x], x))).otherwise(F.col("h")))
    has = lambda *names: F.forall(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(F.col("h"), n))
    late, period = has("YTD Debit", "YTD Credit"), has("Debit", "Credit")
    take = F.when(late, F.lit(True)).when(period, F.lit(False)) if ytd is None else F.when(late if ytd else period, F.lit(ytd))
    head = head.withColumn("ytd", take)
    body = records.join(head, "file").where((F.col("pos") > F.col("at")) & F.exists("cells", lambda c: F.trim(c) != ""))
    cell = lambda name: F.trim(F.coalesce(F.get("cells", F.array_position("h", name).cast("int") - 1), F.lit("")))
    whole, code = cell("Account"), cell("Account Code")
    name = F.when(F.col("apart"), cell("Account Name")).otherwise(whole)
    amount = lambda side: F.when(F.col("ytd"), cell(f"YTD {side}")).otherwise(cell(side))
    number = lambda c: F.when(c == "", F.lit(0).cast(AMOUNT)).otherwise(accounting_number(c))
    rows = body.select("file", "pos", "apart", "ytd", (F.size("cells") != F.size("h")).alias("odd"), F.when(F.col("apart"), code).alias("code"), name.alias("name"), amount("Debit").alias("d"), amount("Credit").alias("c"))
    rows = rows.withColumns({"debit": number(F.col("d")), "credit": number(F.col("c")), "kept": (F.concat(F.coalesce("code", F.lit("")), "name") != "") & (F.col("name") != "Total") & (F.coalesce("code", F.lit("")) != "Total")})
    wrong = F.when(F.col("ytd").isNull(), 2).when(F.col("odd"), 1).when(F.col("kept") & (F.col("debit").isNull() | F.col("credit").isNull()), 0)
    bad = rows.groupBy("file").agg(F.max(wrong).alias("w")).where("w is not null").select("file", F.element_at(F.array(F.lit("AMOUNT"), F.lit("WIDTH"), F.lit("PAIR")), F.col("w") + 1).alias("code"))
    bad = bad.unionByName(records.select("file").distinct().join(head, "file", "left_anti").select("file", F.lit("NO_HEADER").alias("code")))
    own, tail = account_parts("name")
    shown = rows.where("kept").join(bad, "file", "left_anti")
    return shown.select("file", "pos", F.nullif(F.when(F.col("apart"), F.col("code")).otherwise(tail), F.lit("")).alias("account_code"), F.when(F.col("apart"), F.col("name")).otherwise(own).alias("account_name"), "debit", "credit"), bad


def payday_report(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, refusals) of payday reports: (file, pos, row, note) with the provenance that the terminal NOTE record gives; (file, code) of files with other
    headings, a record of another width, or a NOTE record that is missing, empty, repeated or not the last."""
    full = records.where(F.exists("cells", lambda c: F.trim(c) != ""))
    c = lambda n: F.get("cells", F.lit(PAYDAY.index(n)))
    is_note = F.coalesce(c("employee_id") == "NOTE", F.lit(False)) & (F.size("cells") == len(PAYDAY))
    by = full.groupBy("file").agg(
        F.min_by("cells", "pos").alias("head"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.max(F.when(is_note, F.col("pos"))).alias("at"), F.count_if(is_note).alias("notes"), F.max(F.when(is_note, c("notes"))).alias("note"),
        F.count_if(F.size("cells") != len(PAYDAY)).alias("odd"),
    )
    code = F.when(F.col("head") != F.array(*[F.lit(h) for h in PAYDAY]), "HEADER").when(F.col("odd") > 0, "WIDTH").when(F.coalesce(F.trim("note"), F.lit("")) == "", "NOTE_MISSING").when((F.col("notes") > 1) | (F.col("at") != F.col("last")), "NOTE_NOT_LAST")
    by = by.withColumn("code", code)
    rows = full.join(by.where("code is null").select("file", "first", "last", "note"), "file").where("pos > first and pos < last")
    return rows.select("file", "pos", F.map_from_arrays(F.array(*[F.lit(h) for h in PAYDAY]), "cells").alias("row"), "note"), by.where("code is not null").select("file", "code")


def account_transactions(records: DataFrame, account: str) -> tuple[DataFrame, DataFrame]:
    """(detail, refusals): (file, pos, row) of the section of one account, and (file, code) of files whose header stands other than once, whose section isn't
    there once and complete, with another width, or whose subtotal differs from the detail's sums of debit and credit (in text of two places)."""
    n, label = len(ACCOUNT_TRANSACTIONS), F.get("cells", F.lit(0))
    cell = lambda h: F.get("cells", F.lit(ACCOUNT_TRANSACTIONS.index(h)))
    filled = records.where(F.exists("cells", lambda c: c != ""))
    heads = filled.groupBy("file").agg(F.count_if(F.col("cells") == F.array(*[F.lit(h) for h in ACCOUNT_TRANSACTIONS])).alias("heads"), F.max(F.when(F.col("cells") == F.array(*[F.lit(h) for h in ACCOUNT_TRANSACTIONS]), F.col("pos"))).alias("header"))
    body = filled.join(heads, "file").where("pos > header")
    opens = (label == account) & ~F.exists(F.slice("cells", 2, n), lambda c: c != "")
    closes = label == f"Total {account}"
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    body = body.withColumns({"opened": F.sum(opens.cast("int")).over(w), "closed": F.sum(closes.cast("int")).over(w), "is_open": opens, "is_close": closes})
    inside = body.where("opened > closed and not is_open")
    detail = inside.where(label != "Opening Balance")
    number = lambda h: F.coalesce(cell(h).try_cast("decimal(28,2)"), F.lit(0).cast("decimal(28,2)"))
    sums = detail.groupBy("file").agg(F.sum(number("Debit")).alias("d"), F.sum(number("Credit")).alias("c"))
    total = body.where("is_close").groupBy("file").agg(F.max(number("Debit")).alias("td"), F.max(number("Credit")).alias("tc"))
    state = heads.join(body.groupBy("file").agg(F.max("opened").alias("o"), F.max("closed").alias("x"), F.count_if(F.size("cells") != n).alias("odd")), "file", "left").join(sums, "file", "left").join(total, "file", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(28,2)"))
    code = F.when(F.col("heads") != 1, "HEADER").when(F.coalesce("odd", F.lit(0)) > 0, "WIDTH").when((F.coalesce("o", F.lit(0)) != 1) | (F.coalesce("x", F.lit(0)) != 1), "SECTION").when((zero("d") != zero("td")) | (zero("c") != zero("tc")), "SUBTOTAL")
    state = state.withColumn("code", code)
    rows = detail.join(state.where("code is null").select("file"), "file", "left_semi").select("file", "pos", F.map_from_arrays(F.array(*[F.lit(h) for h in ACCOUNT_TRANSACTIONS]), "cells").alias("row"))
    return rows, state.where("code is not null").select("file", "code")
