"""Seeded conditions on small tables, the golden close case, and invariance to other tenants."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallywork.functions import columns as C
from tallywork.operators import calendar, clearing, close, gate, grants, reports, schedules
from tallywork.operators.policies import effective, everywhere, in_force, policy_runs

TB = "report_date date, tenant string, section string, account_id string, account_name string, account_code string, debit string, credit string, ytd_debit string, ytd_credit string"
GOLDEN = [("100", "Assets", "1000", 15000, 0, 120000, 0, 105000, 0), ("110", "Assets", "1100", 12000, 0, 85000, 0, 73000, 0), ("200", "Liabilities", "2000", 0, 9000, 0, 65000, 0, 56000), ("300", "Revenue", "4000", 0, 14000, 0, 130000, 0, 116000), ("400", "Expenses", "5000", 8000, 0, 80000, 0, 72000, 0), ("500", "Expenses", "6000", 12000, 0, 90000, 0, 78000, 0), ("900", "Equity", "3000", 0, 24000, 0, 180000, 0, 156000)]


def trial_balance(spark, tenant="T"):
    rows = []
    for a, s, c, d, cr, yd, yc, pd, pc in GOLDEN:
        rows.append((date(2026, 7, 31), tenant, s, a, f"Account {a}", c, str(d), str(cr), str(yd), str(yc)))
        rows.append((date(2026, 6, 30), tenant, s, a, f"Account {a}", c, "0", "0", str(pd), str(pc)))
    return spark.createDataFrame(rows, TB).withColumns({c: F.col(c).cast(C.AMOUNT) for c in ("debit", "credit", "ytd_debit", "ytd_credit")})


def review(tb, spark):
    pairs = close.pair_periods(tb)
    mapped = everywhere(spark.createDataFrame([(a, "G") for a, *_ in GOLDEN if a != "500"], "account_id string, review_group string"), tb)
    sub = spark.createDataFrame([("T", date(2026, 7, 31), "110", "85000"), ("T", date(2026, 7, 31), "200", "-64750")], "tenant string, report_date date, account_id string, b string").select("tenant", "report_date", "account_id", F.col("b").cast(C.AMOUNT).alias("subledger_balance"))
    now = tb.where("report_date = '2026-07-31'")
    return close.enrich(close.union([close.integrity(now), close.period_comparison(pairs), close.period_variance(pairs, "10000", "0.10"), close.account_metadata(pairs), close.financial_year_reset(pairs), close.mapping(now, mapped), close.subledger(now, sub)]), mapped)


def test_golden_close(spark):
    found = review(trial_balance(spark), spark)
    assert {(r["control"], r["account_id"]) for r in found.collect()} == {("financial_year_reset", None), *(("period_variance", a) for a in ("100", "110", "300", "500", "900")), ("account_mapping", "500"), ("subledger_reconciliation", "200")}
    assert found.where("control = 'subledger_reconciliation'").first()["difference"] == Decimal("-250")
    assert close.overall_status(trial_balance(spark), found).where("report_date = '2026-07-31'").first()["status"] == "REVIEW"
    queries = close.client_queries(found).collect()
    assert len(queries) == 7 and len({q["query_id"] for q in queries}) == 7


def test_another_tenant_changes_nothing(spark):
    one = review(trial_balance(spark), spark).where("tenant = 'T'").collect()
    two = review(trial_balance(spark).unionByName(trial_balance(spark, "U").withColumn("debit", F.col("debit") + 1)), spark).where("tenant = 'T'").collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


@pytest.mark.parametrize(("cents", "blocked"), [("0", 0), ("0.01", 1)])
def test_integrity(spark, cents, blocked):
    tb = trial_balance(spark).withColumn("debit", F.when((F.col("account_id") == "100") & (F.col("report_date") == F.lit("2026-07-31").cast("date")), F.col("debit") + F.lit(cents).cast(C.AMOUNT)).otherwise(F.col("debit")))
    # the fixture's movements of June are nil; July's balance
    assert close.integrity(tb).count() == blocked


def test_absent_is_not_nil(spark):
    tb = trial_balance(spark).where("not (account_id = '400' and report_date = '2026-07-31')")
    assert [r["reason"] for r in close.period_comparison(close.pair_periods(tb)).collect()] == ["account is absent from the current period"]
    policy = spark.createDataFrame([("210", "nil", False), ("211", "any", True)], "account_id string, expected_balance string, expect_movement boolean")
    assert {r["account_id"] for r in close.balance_policy(tb.where("report_date = '2026-07-31'"), everywhere(policy, tb.where("report_date = '2026-07-31'"))).collect()} == {"211"}


@pytest.mark.parametrize(("text", "want"), [("1,234.50", "1234.5"), ("$-5", None), ("-$5", "-5"), ("1e3", None), ("12,34", None), ("+7", "7"), ("", None), (" 1", None), ("1.", None)])
def test_accounting_number(spark, text, want):
    got = spark.createDataFrame([(text,)], "x string").select(C.accounting_number("x")).first()[0]
    assert got == (None if want is None else Decimal(want))


def test_identifiers(spark):
    row = spark.range(1).select(C.abn_valid(F.lit("51 824 753 556")), C.abn_valid(F.lit("51824753557")), C.abn_valid(F.lit("99900000180")), C.tfn_valid(F.lit("123456782")), C.acn_valid(F.lit("004085616")), C.medicare_valid(F.lit("2123456701")), C.bsb_shape(F.lit("063-000"))).first()
    assert tuple(row) == (True, False, True, True, True, True, True)


def test_display_and_dates(spark):
    row = spark.range(1).select(C.money_text(F.lit("1234.5").cast(C.AMOUNT)), C.money_text(F.lit("-0.125").cast(C.AMOUNT)), C.money_text(F.lit("100").cast(C.AMOUNT)), C.money_display(F.lit("-1234.5").cast(C.AMOUNT)), C.formula_safe(F.lit(" =1")), C.formula_safe(F.lit("-5"), numbers=True), C.financial_year(F.lit("2026-07-01").cast("date")), C.financial_year_end(F.lit("2026-06-30").cast("date")), C.long_date(F.lit("30 June 2026")), C.clean_text(F.lit("a​b"))).first()
    assert tuple(row) == ("1234.50", "-0.125", "100.00", "(1,234.50)", "' =1", "-5", 2027, date(2026, 6, 30), date(2026, 6, 30), None)


def test_clearing_suggestions(spark):
    rows = [("a", "Batch", 30, 0), ("b", "Batch", 0, 20), ("c", "Batch", 0, 10), ("d", "Odd", 5, 0), ("e", "Odd", 0, 4), ("f", "", 1, 0), ("g", "", 0, 1), ("h", "One", 0, 0)]
    items = spark.createDataFrame([("T", "1", "AUD", i, date(2026, 7, 1), r, d, c) for i, r, d, c in rows], "tenant string, account_id string, currency string, transaction_id string, date date, reference string, debit int, credit int")
    assert [(r["reference"], r["ids"]) for r in clearing.suggest_matches(items).collect()] == [("Batch", ["a", "b", "c"])]
    assert clearing.repeated_ids(items.unionByName(items.limit(1))).count() == 1


def test_previous_start(spark):
    d = lambda x: F.lit(x).cast("date")
    row = spark.range(1).select(clearing.previous_start(d("2026-07-01"), d("2026-07-31")), clearing.previous_start(d("2026-07-01"), d("2026-09-30")), clearing.previous_start(d("2026-07-06"), d("2026-07-12"))).first()
    assert tuple(row) == (date(2026, 6, 1), date(2026, 4, 1), date(2026, 6, 29))


def test_migration_weights(spark):
    money = lambda *rows: spark.createDataFrame([("T", i, a, Decimal(x)) for i, a, x in rows], "tenant string, item_id string, account string, amount decimal(18,2)")
    mapping = spark.createDataFrame([("T", "1", "A", Decimal("0.333333")), ("T", "1", "B", Decimal("0.666667"))], "tenant string, source_account string, target_account string, weight decimal(7,6)")
    got = {(r["account"], r["state"]) for r in schedules.migration(money(("i", "1", "3.00")), mapping, money(("i", "B", "2.00"), ("i", "C", "0.00"))).collect()}
    assert got == {("A", "MISSING"), ("B", "DIFFERENT"), ("C", "UNEXPECTED")}
    assert schedules.mapping_issues(mapping, money(("i", "1", "1.00"), ("j", "9", "1.00"))).collect()[0]["issue"] == "UNMAPPED_ACCOUNT"


def test_earnings_have_28_digits(spark):
    rows = spark.createDataFrame([(Decimal("1000.00"), date(2023, 12, 30), date(2024, 1, 2)), (Decimal("5.00"), date(2024, 1, 2), date(2024, 1, 2)), (Decimal("5.00"), date(2024, 1, 2), None)], "base decimal(18,2), due date, received date")
    got = [r["earnings"] for r in calendar.notional_earnings(rows, {(2023, 4): "10", (2024, 1): "12"}).collect()]
    want = (Decimal(1000) * (1 + Decimal(10) / 100 / 365) * (1 + Decimal(12) / 100 / 366) ** 2 - 1000).quantize(Decimal("0.01"))
    assert got == [want, Decimal("0.00"), Decimal("0.00")]


def test_gate(spark):
    c = spark.range(1).select(gate.first_three(F.array(*[F.lit(x) for x in "abcde"])).alias("a"), gate.first_three(F.array(F.lit("x"))).alias("b")).first()
    assert tuple(c) == ("a, b, c and 2 more", "x")


def test_grants(spark):
    d = Decimal
    ledger = spark.createDataFrame([("L1", date(2026, 1, 1), d(100), d(100)), ("L4", date(2026, 1, 1), d(50), d(0))], "ledger_id string, date date, amount decimal(18,2), cash_paid decimal(18,2)")
    a = spark.createDataFrame([("A1", "L1", "G", "x", d(60), d(60), True, "e"), ("A4", "L1", "G", "x", d(40), d(40), False, ""), ("A5", "L9", "H", "x", d(1), d(1), True, "e")], "allocation_id string, ledger_id string, grant_id string, budget_line string, amount decimal(18,2), cash decimal(18,2), approved boolean, evidence string")
    g = spark.createDataFrame([("G", date(2025, 7, 1), date(2025, 12, 31))], "grant_id string, start date, end date")
    assert {tuple(r) for r in grants.allocation_issues(a, ledger, g).collect()} == {("A1", "OUTSIDE_AGREEMENT_PERIOD"), ("A4", "OUTSIDE_AGREEMENT_PERIOD"), ("A4", "UNAPPROVED_ALLOCATION"), ("A4", "MISSING_ALLOCATION_EVIDENCE"), ("A5", "UNKNOWN_LEDGER"), ("A5", "UNKNOWN_GRANT")}
    assert {(r["ledger_id"], r["state"]) for r in grants.ledger_tieout(ledger, a).collect()} == {("L1", "FULL"), ("L4", "NONE")}


def test_footer_is_not_a_contact_named_total(spark):
    rows = [("f", i, [n, v]) for i, (n, v) in enumerate([("A", "1"), ("Total", "2"), ("B", "3"), ("Total", "6")])]
    got = reports.footer(spark.createDataFrame(rows, "file string, pos int, cells array<string>")).where("is_footer").collect()
    assert [r["pos"] for r in got] == [3]


def test_tenant_selection(spark):
    t = spark.createDataFrame([("a1", "Alpha One"), ("a2", "Alpha Two"), ("b", "Beta")], "id string, name string")
    assert [reports.tenant_selection(t, x).count() for x in ("A2", "beta", "alpha", "none")] == [1, 1, 0, 0]


def test_policies_by_tenant(spark):
    """One account id, two tenants: each by its own set, and by the set of the date."""
    day = lambda x: date.fromisoformat(x)
    tb = trial_balance(spark).unionByName(trial_balance(spark, "U"))
    periods = tb.select("tenant", "report_date").distinct()
    sets = [("T", day("2026-01-01"), "110", "A"), ("T", day("2026-07-01"), "110", "B"), ("T", day("2026-07-01"), "200", "B"), ("U", day("2026-07-31"), "110", "C"), ("V", day("2020-01-01"), "110", "D"), ("T", day("2027-01-01"), "110", "E")]
    mapped = effective(spark.createDataFrame(sets, "tenant string, effective_from date, account_id string, review_group string"), periods)
    assert {(r["tenant"], str(r["report_date"]), r["account_id"], r["review_group"]) for r in mapped.collect()} == {("T", "2026-06-30", "110", "A"), ("T", "2026-07-31", "110", "B"), ("T", "2026-07-31", "200", "B"), ("U", "2026-07-31", "110", "C")}
    missing = {(r["tenant"], str(r["report_date"])) for r in close.mapping(tb, mapped).where("account_id = '200'").collect()}
    assert missing == {("T", "2026-06-30"), ("U", "2026-07-31")}  # U has no set in June, so nothing is said of it
    assert {(r["tenant"], str(r["report_date"]), r["state"]) for r in policy_runs(periods, {"account_mapping": mapped}).collect()} == {("T", "2026-06-30", "RAN"), ("T", "2026-07-31", "RAN"), ("U", "2026-06-30", "SKIPPED"), ("U", "2026-07-31", "RAN")}
    assert in_force(periods.limit(0), mapped.withColumn("effective_from", F.col("report_date"))).collect() == []
