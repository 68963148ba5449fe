"""Readers and writers on small files."""

import json
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallywork.operators import reports
from tallywork.sources import readers, writers

HEAD = "ReportDate,Tenant,Section,AccountID,AccountName,AccountCode,Debit,Credit,YTDDebit,YTDCredit"
ROW = '2026-06-30,T1,Assets,100,"Bank, main",090,"1,000.50",0,$1000.50,0'


def files(tmp_path, **texts):
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(tmp_path)


def codes(refusals):
    return {(r["file"].rsplit("/", 1)[-1].removesuffix(".csv"), r["code"], r["column"]) for r in refusals.collect()}


def test_trial_balance(spark, tmp_path):
    turned = "Tenant,ReportDate,Section,AccountID,AccountName,AccountCode,Debit,Credit,YTDDebit,YTDCredit\nT2,2026-06-30,Assets,100,Bank,,1,0,1,0\n"
    path = files(
        tmp_path, good=f"﻿{HEAD}\n{ROW}\n", turned=turned, short=f"{HEAD}\n{ROW.rsplit(',', 1)[0]}\n", surplus=f"{HEAD}\n{ROW},x\n", header=f"{HEAD},Extra\n{ROW},1\n", missing=f"{HEAD.removesuffix(',YTDCredit')}\n{ROW.rsplit(',', 1)[0]}\n",
        exponent=f"{HEAD}\n{ROW.replace('$1000.50', '1e3')}\n", day=f"{HEAD}\n{ROW.replace('06-30', '06-31')}\n", twice=f"{HEAD}\n{ROW}\n{ROW}\n", tenants=f"{HEAD}\n{ROW}\n{ROW.replace('T1', 'T2')}\n", blank=f"{HEAD}\n{ROW.replace('T1', '')}\n",
    )
    accepted, refusals = readers.read_csv(spark, path, readers.TB)
    got = {r["file"].rsplit("/", 1)[-1]: r for r in accepted.collect()}
    assert set(got) == {"good.csv", "turned.csv"}
    good = got["good.csv"]
    assert (good["account_name"], good["account_code"], good["debit"], good["ytd_debit"], good["report_date"]) == ("Bank, main", "090", Decimal("1000.5000000000"), Decimal("1000.5000000000"), date(2026, 6, 30))
    found = codes(refusals)
    assert found >= {("surplus", "WIDTH", None), ("header", "HEADER", None), ("missing", "HEADER", None), ("exponent", "VALUE", "ytd_debit"), ("day", "VALUE", "report_date"), ("twice", "REPEATED_KEY", "account_id"), ("tenants", "SEVERAL_VALUES", "tenant"), ("blank", "VALUE", "tenant")}
    assert any(f == "short" for f, _, _ in found)


@pytest.mark.parametrize("name", sorted(readers.CONTRACTS))
def test_every_contract_refuses_another_header(spark, tmp_path, name):
    path = files(tmp_path, bad="a,b\n1,2\n", empty=",".join(readers.CONTRACTS[name].columns) + "\n")
    accepted, refusals = readers.read_csv(spark, path, readers.CONTRACTS[name])
    assert accepted.count() == 0 and codes(refusals) == {("bad", "HEADER", None)} | {("empty", code, None) for code, _ in readers.CONTRACTS[name].whole}


def test_transactions_have_one_side(spark, tmp_path):
    head = "Tenant,AccountID,Currency,TransactionID,Date,Reference,Description,Debit,Credit\n"
    path = files(tmp_path, good=head + "T,1,AUD,a.1,2026-06-30,,,1.50,0\n", both=head + "T,1,AUD,a1,2026-06-30,,,1,1\n", id=head + "T,1,AUD,-a,2026-06-30,,,1,0\n", places=head + "T,1,AUD,a,2026-06-30,,,1.001,0\n")
    accepted, refusals = readers.read_csv(spark, path, readers.CONTRACTS["transactions"])
    assert [r["debit"] for r in accepted.collect()] == [Decimal("1.50")]
    assert codes(refusals) >= {("both", "ONE_SIDE", None), ("id", "VALUE", "transaction_id"), ("places", "VALUE", "debit")}


def test_ordered_headings(spark, tmp_path):
    path = files(tmp_path, bad="grant_id,receipt_id,date,amount,evidence\nG,R,2026-01-01,1,\n", good="receipt_id,grant_id,date,amount,evidence\nR,G,2026-01-01,1,\n")
    accepted, refusals = readers.read_csv(spark, path, readers.CONTRACTS["grant_receipts"])
    assert accepted.count() == 1 and codes(refusals) == {("bad", "HEADER", None)}


def test_captured_digests(spark, tmp_path):
    """A file's digest stands with its rows and its refusals; quoted line breaks, a byte order mark and blank lines are read."""
    import hashlib

    texts = {"good": '\ufeffFindingCode,Slot,Status\r\n"a ""b""","x y",OPEN\r\n\r\nc,d,CLOSED', "bad": "FindingCode,Slot,Status\na,b,LOST\nc,d\n", "bare": "Slot,Status\n", "empty": ""}
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.csv").write_text(text, encoding="utf-8", newline="")
    digest = {name: hashlib.sha256(text.encode()).hexdigest() for name, text in texts.items()}
    accepted, refusals = readers.read_csv(spark, f"{tmp_path}/*", readers.CONTRACTS["prior_findings"])
    assert {(r["sha256"], r["finding_code"], r["slot"], r["status"]) for r in accepted.collect()} == {(digest["good"], 'a "b"', "x y", "OPEN"), (digest["good"], "c", "d", "CLOSED")}
    assert {(r["sha256"], r["row"], r["code"], r["column"]) for r in refusals.collect()} == {(digest["bad"], 1, "VALUE", "status"), (digest["bad"], 2, "WIDTH", None), (digest["bad"], 2, "VALUE", "status"), (digest["bare"], 0, "HEADER", None)}
    same, other = readers.read_csv(spark, f"{tmp_path}/*", readers.CONTRACTS["prior_findings"], captured=False)
    assert same.drop("sha256", "file").collect() == accepted.drop("sha256", "file").collect() and {r["code"] for r in other.collect()} == {"VALUE", "WIDTH", "HEADER"}


def test_scanned_files_are_parsed_once(spark, tmp_path, monkeypatch):
    """without captured, later steps read what was written; nothing sorts a file's rows, and repeated keys, empty ones too, are refused as before."""
    made, staged = {}, readers.staged
    monkeypatch.setattr(readers, "staged", lambda df, name: (made.update({name: df._jdf.queryExecution().executedPlan().toString()}), staged(df, name))[1])
    head = "TransactionID,Tenant,AccountID,Currency,Date,Reference,Description,Debit,Credit\n"
    line = lambda i, cur="AUD", t="T": f"{i},{t},1,{cur},2026-06-30,,,1.50,0\n"
    path = files(tmp_path, good=head + "".join(line(f"a{i}") for i in range(50)), twice=head + line("a") + line("b") + line("a"), blank=head + line("a", t="") + line("a", t=""), several=head + line("a") + line("b", "NZD"), header="a,b\n")
    accepted, refusals = readers.read_csv(spark, path, readers.CONTRACTS["transactions"], captured=False)
    assert "FileScan csv" not in accepted._jdf.queryExecution().executedPlan().toString() and "Sort" not in made["csv-judged"]
    assert sum("FileScan csv" in plan for plan in made.values()) == 1
    assert accepted.count() == 50 and {r["file"].rsplit("/", 1)[-1] for r in accepted.select("file").distinct().collect()} == {"good.csv"}
    other = readers.read_csv(spark, path, readers.CONTRACTS["transactions"])[1]
    found = sorted((r["file"].rsplit("/", 1)[-1], r["code"], r["column"] or "") for r in refusals.collect())
    assert found == sorted((r["file"].rsplit("/", 1)[-1], r["code"], r["column"] or "") for r in other.collect())
    assert {c for _, c, _ in found} == {"REPEATED_KEY", "VALUE", "SEVERAL_VALUES", "HEADER"} and found.count(("twice.csv", "REPEATED_KEY", "transaction_id")) == found.count(("blank.csv", "REPEATED_KEY", "transaction_id")) == 2


def test_gst_files(spark, tmp_path):
    """One class for all, or both sides."""
    for name, classes in {"one": ["gst", "gst_free"], "both": ["gst_collected", "gst_paid"], "mixed": ["gst", "gst_paid"], "half": ["gst_paid"], "none": ["mixed"], "bare": []}.items():
        (tmp_path / f"tenant={name} Pty, Ltd" / "from=2024-07-01").mkdir(parents=True)
        (tmp_path / f"tenant={name} Pty, Ltd" / "from=2024-07-01" / "f.csv").write_text("AccountID,GSTClass\n" + "".join(f"{i},{c}\n" for i, c in enumerate(classes)))
    (tmp_path / "tenant=x" / "from=July").mkdir(parents=True)
    (tmp_path / "tenant=x" / "from=July" / "f.csv").write_text("AccountID,GSTClass\n1,gst\n")
    accepted, refusals = readers.read_sets(spark, str(tmp_path), readers.CONTRACTS["gst_mapping"])
    assert {(r["tenant"], str(r["effective_from"]), r["gst_class"]) for r in accepted.collect()} == {("one Pty, Ltd", "2024-07-01", c) for c in ("gst", "gst_free")} | {("both Pty, Ltd", "2024-07-01", c) for c in ("gst_collected", "gst_paid")}
    assert sorted(r["code"] for r in refusals.collect()) == ["FOLDER", "SIDES", "SIDES", "SIDES", "SIDES"]


def test_published_runs(spark, tmp_path):
    """June, then July; then June again with less, and a month whose rows are gone."""
    rows = lambda *x: spark.createDataFrame(x, "report_date string, n int")
    path, schema = str(tmp_path / "t"), rows(("", 0)).schema
    read = lambda: sorted(tuple(r) for r in writers.read_published(spark, path, schema).collect())
    june, july = rows(("2024-06-30", 1), ("2024-06-30", 2)), rows(("2024-07-31", 3))
    writers.publish_table(june, path, "a", 1, june)
    writers.publish_table(july, path, "b", 2, july)
    assert read() == [("2024-06-30", 1), ("2024-06-30", 2), ("2024-07-31", 3)]
    writers.publish_table(july, path, "b", 2, july)  # repeated
    writers.publish_table(rows(("2024-06-30", 9)), path, "c", 3, rows(("2024-06-30", 0), ("2024-07-31", 0)))
    assert read() == [("2024-06-30", 9)]


def test_trial_balance_reports(spark):
    def read(lines, ytd=None):
        records = spark.createDataFrame([("f", n, line.split(",")) for n, line in enumerate(lines)], "file string, pos int, cells array<string>")
        good, bad = reports.trial_balance_report(records, ytd)
        return [(r["account_code"], r["account_name"], str(r["debit"].normalize()), str(r["credit"].normalize())) for r in good.orderBy("pos").collect()], [r["code"] for r in bad.collect()]

    both = ["Trial Balance", "Accountable Plumbing", "Account,Debit,Credit,YTD Debit,YTD Credit", "Bank (090),1,,5.50,", ",,,,", "Total Tools,,2,,3", "Rent (Sydney),1,1,1,1", "GST1 - GST,0,1,0,4", "Total,2,2,9,9"]
    assert read(both) == ([("090", "Bank", "5.5", "0"), (None, "Total Tools", "0", "3"), (None, "Rent (Sydney)", "1", "1"), ("GST1", "GST", "0", "4")], [])
    assert read(both, False)[0][0] == ("090", "Bank", "1", "0")
    assert read(["Account Code,Account,Debit - Year to date,Credit - Year to date", "090,Bank,1,", ",Card,,1", "Total,,1,1"]) == ([("090", "Bank", "1", "0"), (None, "Card", "0", "1")], [])
    assert read(["Account Code,Account Name,Debit,Credit", "1,A,1,"], True) == ([], ["PAIR"])
    assert read(["Account,Debit,Credit", "A,1"])[1] == ["WIDTH"] and read(["Account,Debit,Credit", "A,TBC,1"])[1] == ["AMOUNT"] and read(["Accounts,Debit"])[1] == ["NO_HEADER"]


def test_nested_report(spark, tmp_path):
    cell = lambda v, a=None: {"Value": v, "Attributes": [{"Id": "account", "Value": a}] if a else []}
    report = {"Reports": [{"ReportType": "TrialBalance", "ReportTitles": ["Trial Balance"], "Rows": [
        {"RowType": "Header", "Cells": [cell("Account"), cell("Debit")]},
        {"RowType": "Section", "Title": "Assets", "Rows": [{"RowType": "Row", "Cells": [cell("Bank (090)", "id1"), cell("5.00", "id1")]}, {"RowType": "SummaryRow", "Cells": [cell("Total"), cell("5.00")]}]},
    ]}]}
    (tmp_path / "r.json").write_text(json.dumps(report))
    rows = readers.read_report(spark, str(tmp_path)).collect()
    assert [(r["section"], r["row_type"], r["cells"], r["account_id"]) for r in rows] == [("Assets", "Row", {"Account": "Bank (090)", "Debit": "5.00"}, "id1"), ("Assets", "SummaryRow", {"Account": "Total", "Debit": "5.00"}, None)]


def test_report_shaped_csv(spark, tmp_path):
    path = files(tmp_path, aged='Aged receivables\nDemo\n\nContact,Current,Total\nTotal,1,1\n"B, Ltd",2,2\nTotal,3,3\nPercentage of total,100,100')
    rows = readers.read_positions(spark, path)
    flat = reports.named_cells(reports.promote_header(rows, "Contact"))
    assert [r["row"]["Contact"] for r in flat.orderBy("pos").collect()] == ["Total", "B, Ltd", "Total", "Percentage of total"]
    flags = {r["pos"]: r["is_footer"] for r in reports.footer(rows).collect()}
    assert [p for p, f in flags.items() if f] and {p for p, f in flags.items() if f} == {6, 7}


def test_export_and_read_again(spark, tmp_path):
    rows = [(date(2026, 6, 30), "T1", "Assets", "100", "=Bank", "090", "10.00", "0", "10.00", "0"), (date(2026, 6, 30), "T1", "Equity", "900", "Owner", "900", "0", "10.00", "0", "10.00")]
    tb = spark.createDataFrame(rows, "report_date date, tenant string, section string, account_id string, account_name string, account_code string, debit string, credit string, ytd_debit string, ytd_credit string")
    tb = tb.withColumns({c: F.col(c).cast("decimal(28,10)") for c in ("debit", "credit", "ytd_debit", "ytd_credit")})
    writers.export_trial_balance(tb, f"{tmp_path}/out")
    accepted, refusals = readers.read_csv(spark, f"{tmp_path}/out/*", readers.TB)
    assert refusals.count() == 0 and {(r["account_id"], r["account_name"], str(r["debit"])) for r in accepted.collect()} == {("100", "'=Bank", "10.0000000000"), ("900", "Owner", "0E-10")}
    with pytest.raises(ValueError):
        writers.export_trial_balance(tb.where("account_id = '100'"), f"{tmp_path}/bad")
    writers.write_pack({"exceptions": tb}, f"{tmp_path}/pack")
    assert spark.read.parquet(f"{tmp_path}/pack/exceptions").count() == 2


def test_trial_balance_files_have_mark_and_crlf(spark, tmp_path):
    row = (date(2026, 6, 30), "T1", "Assets", "100", "Bank", "090", "0", "0", "0", "0")
    tb = spark.createDataFrame([row], "report_date date, tenant string, section string, account_id string, account_name string, account_code string, debit string, credit string, ytd_debit string, ytd_credit string")
    writers.export_trial_balance(tb.withColumns({c: F.col(c).cast("decimal(28,10)") for c in ("debit", "credit", "ytd_debit", "ytd_credit")}), f"{tmp_path}/out")
    (file,) = (tmp_path / "out").glob("*/*.csv")
    raw = file.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfReportDate,Tenant,") and raw.count(b"\r\n") == raw.count(b"\n") == 2
    accepted, refusals = readers.read_csv(spark, f"{tmp_path}/out/*", readers.TB)
    assert accepted.count() == 1 and refusals.count() == 0


def test_export_csv_compressed(spark, tmp_path):
    """an export may be compressed, and is read under its contract as before."""
    heads = list(readers.CONTRACTS["contacts"].columns)
    df = spark.range(3).select(*[F.concat(F.lit("a, "), F.col("id").cast("string")).alias(h) for h in heads])
    writers.export_csv(df, str(tmp_path / "zip"), compression="gzip")
    assert list((tmp_path / "zip").glob("*.csv.gz")) and not list((tmp_path / "zip").glob("*.csv"))
    assert readers.records(spark, str(tmp_path / "zip"), heads).where("_c0 like 'a, %'").count() == 3


def test_captured_files_are_decoded_as_they_are_read(spark, tmp_path, monkeypatch):
    """a captured file's text is never held whole beside its bytes; a byte order mark goes, and bytes that aren't UTF-8 stand as U+FFFD."""
    import inspect

    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfx,y\r\n\"1\r\n2\",\xff\n\n3\n")
    rows = readers.captured_records(spark, str(tmp_path), ["x", "y"]).orderBy("at.n").collect()
    assert [(r["_c0"], r["_c1"], r["wide"]) for r in rows] == [("x", "y", False), ("1\r\n2", "�", False), ("3", None, True)]
    assert "StringIO" not in inspect.getsource(readers.captured_records)
