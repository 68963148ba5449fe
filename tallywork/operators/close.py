"""Close controls over canonical trial balances; each returns rows of one `exceptions` schema."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import AMOUNT, TOTAL, abn_valid, financial_year, fraction_units, listed, times
from .checks import check_thresholds
from .policies import covered

ACCOUNT = ["tenant", "report_date", "account_id"]

FIELDS = {
    "control": "string", "status": "string", "tenant": "string", "report_date": "date", "account_id": "string", "account_code": "string", "account_name": "string", "review_group": "string", "current_value": TOTAL,
    "prior_value": TOTAL, "difference": TOTAL, "threshold": TOTAL, "percentage_change": TOTAL, "reason": "string", "reviewer_action": "string",
}


def exceptions(df: DataFrame, control: str, reason: Column | str, action: str, status: str = "REVIEW", **columns: Column) -> DataFrame:
    """df's rows as exceptions; fields that are neither given nor columns of df are null."""
    given = {"control": F.lit(control), "status": F.lit(status), "reason": F.lit(reason) if isinstance(reason, str) else reason, "reviewer_action": F.lit(action), **columns}
    return df.select(*[(given[c] if c in given else F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()])


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def net(df: DataFrame) -> DataFrame:
    return df.withColumns({"ytd_net": (F.col("ytd_debit") - F.col("ytd_credit")).cast(AMOUNT), "current_net": (F.col("debit") - F.col("credit")).cast(AMOUNT)})


def integrity(tb: DataFrame) -> DataFrame:
    """BLOCKED where a tenant and period's debits and credits differ, for movements and for year-to-date amounts."""
    sums = tb.groupBy("tenant", "report_date").agg(*[F.sum(c).alias(c) for c in ("debit", "credit", "ytd_debit", "ytd_credit")])
    rows = sums.selectExpr("tenant", "report_date", "stack(2, 'movement', debit, credit, 'year-to-date', ytd_debit, ytd_credit) as (kind, dr, cr)").where("dr <> cr")
    return exceptions(rows, "trial_balance_integrity", F.concat("kind", F.lit(" debits and credits differ")), "Correct the source and export it again", "BLOCKED", current_value=F.col("dr"), prior_value=F.col("cr"), difference=F.col("dr") - F.col("cr"))


def pair_periods(tb: DataFrame) -> DataFrame:
    """One row per (tenant, report_date, account_id) seen in a period or the tenant's one before: structs cur and pri, either may be null, and prior_date."""
    w = Window.partitionBy("tenant").orderBy("report_date")
    dates = tb.select("tenant", "report_date").distinct().withColumn("prior_date", F.lag("report_date").over(w)).where("prior_date is not null")
    row = F.struct("account_code", "account_name", "section", "debit", "credit", "ytd_debit", "ytd_credit", "ytd_net", "current_net")
    keyed = net(tb)
    cur = keyed.join(dates, ["tenant", "report_date"]).select("tenant", "report_date", "account_id", row.alias("cur"))
    pri = keyed.withColumnRenamed("report_date", "prior_date").join(dates, ["tenant", "prior_date"]).select("tenant", "report_date", "account_id", row.alias("pri"))
    return cur.join(pri, ["tenant", "report_date", "account_id"], "full_outer").join(dates, ["tenant", "report_date"])


def _sides(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({c: F.coalesce(f"cur.{c}", f"pri.{c}") for c in ("account_code", "account_name", "section")})


def period_comparison(pairs: DataFrame) -> DataFrame:
    """Accounts that left the trial balance and accounts that are new in it."""
    one = _sides(pairs.where("cur is null or pri is null"))
    reason = F.when(F.col("cur").isNull(), "account is absent from the current period").otherwise("account is new in the current period")
    return exceptions(one, "period_comparison", reason, "Confirm the account's change", current_value=F.col("cur.ytd_net"), prior_value=F.col("pri.ytd_net"))


def period_variance(pairs: DataFrame, absolute: float | str, fraction: str) -> DataFrame:
    """Year-to-date changes at or over both thresholds; the fraction is compared by multiplication in whole units, so it is exact. A prior of zero has
    no percentage; percentage_change is the change over the prior, without sign."""
    check_thresholds(str(absolute), fraction)
    two = _sides(pairs.where("cur is not null and pri is not null"))
    c, p, limit = F.col("cur.ytd_net"), F.col("pri.ytd_net"), F.lit(str(absolute)).cast(AMOUNT)
    change = (c - p).cast(TOTAL)
    over = (F.abs(change) >= limit) & (times(F.abs(change), 10**8) >= times(F.abs(p), fraction_units(fraction))) & (change != 0)
    sign = F.when((c > 0) & (p < 0) | (c < 0) & (p > 0), "balance changed sign").when(p == 0, "balance from nil").otherwise("movement over both thresholds")
    return exceptions(two.where(over), "period_variance", sign, "Explain the movement", current_value=c, prior_value=p, difference=change, threshold=limit, percentage_change=F.try_divide(F.abs(change).cast("decimal(27,10)"), F.abs(p).cast("decimal(27,10)")))


def account_metadata(pairs: DataFrame) -> DataFrame:
    """Accounts whose code, name or section changed."""
    two = _sides(pairs.where("cur is not null and pri is not null"))
    what = listed([(f"account {n}" if n != "section" else n, ~F.col(f"cur.{c}").eqNullSafe(F.col(f"pri.{c}"))) for n, c in (("code", "account_code"), ("name", "account_name"), ("section", "section"))], " and ")
    changed = two.withColumn("what", what).where("what <> ''")
    return exceptions(changed, "account_metadata", F.concat("what", F.lit(" changed")), "Confirm the account's identity", current_value=F.col("cur.ytd_net"), prior_value=F.col("pri.ytd_net"))


def financial_year_reset(pairs: DataFrame) -> DataFrame:
    """One exception per tenant and period whose prior period lies in another financial year."""
    dates = pairs.select("tenant", "report_date", "prior_date").distinct().where(financial_year("report_date") != financial_year("prior_date"))
    return exceptions(dates, "financial_year_reset", "the periods lie in different financial years", "Compare across the reset with care")


def mapping(tb: DataFrame, mapped: DataFrame) -> DataFrame:
    """Accounts without a review group, in periods that have a mapping. mapped: (tenant, report_date, account_id, review_group), a policy by period."""
    return exceptions(covered(net(tb), mapped).join(mapped, ACCOUNT, "left_anti"), "account_mapping", "account has no review group", "Map the account", current_value=F.col("ytd_net"))


def mapping_compatibility(tb: DataFrame, mapped: DataFrame, policy: DataFrame) -> DataFrame:
    """Mapped accounts whose section the policy (tenant, report_date, section, review_group) doesn't permit for the group, in periods that have a policy; the
    reason lists what it permits."""
    period = ["tenant", "report_date"]
    permitted = policy.groupBy(*period, "section").agg(F.array_join(F.sort_array(F.collect_set("review_group")), ", ").alias("permitted"))
    bad = covered(net(tb).join(mapped, ACCOUNT), policy).join(policy, [*period, "section", "review_group"], "left_anti").join(permitted, [*period, "section"], "left")
    return exceptions(bad, "mapping_compatibility", F.concat(F.lit("section permits: "), F.coalesce("permitted", F.lit("nothing"))), "Correct the mapping", current_value=F.col("ytd_net"))


def balance_policy(tb: DataFrame, policy: DataFrame) -> DataFrame:
    """Accounts on the wrong side or without an expected movement; an absent account counts as nil. policy: (tenant, report_date, account_id, expected_balance,
    expect_movement)."""
    full = policy.join(net(tb), ACCOUNT, "left")
    n, m, e = F.coalesce("ytd_net", F.lit(0)), F.coalesce("current_net", F.lit(0)), F.col("expected_balance")
    wrong = F.when(((e == "debit") & (n < 0)) | ((e == "credit") & (n > 0)) | ((e == "nil") & (n != 0)), F.concat(F.lit("balance is not "), e))
    still = F.when(F.col("expect_movement") & (m == 0), F.lit("no movement where one is expected"))
    rows = full.withColumn("why", F.explode(F.filter(F.array(wrong, still), lambda x: x.isNotNull())))
    return exceptions(rows, "balance_policy", F.col("why"), "Review the balance", current_value=n)


def subledger(tb: DataFrame, balances: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Subledger balances (tenant, report_date, account_id, subledger_balance) that differ from the ledger by more than the tolerance, or have no account."""
    both = balances.join(net(tb), ["tenant", "report_date", "account_id"], "left").withColumn("gap", F.col("ytd_net") - F.col("subledger_balance"))
    bad = both.where(F.col("ytd_net").isNull() | (F.abs("gap") > F.lit(tolerance).cast(AMOUNT)))
    reason = F.when(F.col("ytd_net").isNull(), "subledger account is not in the trial balance").otherwise("subledger and ledger differ")
    return exceptions(bad, "subledger_reconciliation", reason, "Reconcile the subledger", current_value=F.col("ytd_net"), prior_value=F.col("subledger_balance"), difference=F.col("gap"), threshold=F.lit(tolerance))


def reconciliation_coverage(tb: DataFrame, balances: DataFrame, equity: DataFrame, sections: tuple[str, ...] = ("assets", "liabilities", "equity")) -> DataFrame:
    """Balance-sheet accounts with a balance that neither a subledger nor the equity reconciliation (tenant, account_id) ties."""
    open_ = net(tb).where((F.col("ytd_net") != 0) & F.lower("section").isin(*sections))
    bare = open_.join(balances.select("tenant", "report_date", "account_id"), ["tenant", "report_date", "account_id"], "left_anti").join(equity.select("tenant", "account_id"), ["tenant", "account_id"], "left_anti")
    return exceptions(bare, "reconciliation_coverage", "nothing reconciles this balance", "Obtain support", current_value=F.col("ytd_net"))


def gst_sums(tb: DataFrame, classes: DataFrame, settlements: DataFrame) -> DataFrame:
    """Per tenant and period: movements by class (credit positive for sales and tax), settlements, and the difference times ten, for exactness. classes:
    (tenant, report_date, account_id, gst_class)."""
    cls = net(tb).join(classes, ACCOUNT)
    by = lambda *names: F.sum(F.when(F.col("gst_class").isin(*names), F.col("current_net")).otherwise(0))
    s = cls.groupBy("tenant", "report_date").agg((-by("taxable_sales")).alias("sales"), by("creditable_purchases").alias("purchases"), (-by("gst", "gst_collected", "gst_paid")).alias("recorded"), (-by("gst", "gst_collected")).alias("collected"), by("gst_paid").alias("paid"))
    paid = settlements.groupBy("tenant", "report_date").agg(F.sum("amount").alias("settled"))
    return s.join(paid, ["tenant", "report_date"], "left").withColumn("settled", F.coalesce("settled", F.lit(0))).withColumn("tenfold", 10 * (F.col("recorded") + F.col("settled")) - F.col("sales") + F.col("purchases"))


def gst_reasonableness(tb: DataFrame, classes: DataFrame, settlements: DataFrame, absolute: str, fraction: str) -> DataFrame:
    """Recorded tax and settlements against a tenth of sales less purchases, beyond absolute + fraction x (|collected| + |paid|), exactly."""
    check_thresholds(absolute, fraction)
    s, base = gst_sums(tb, classes, settlements), F.abs("collected") + F.abs("paid")
    whole = lambda c: c.cast("decimal(37,10)")
    # 10^8 x |tenfold| against 10^9 x room, the base tenfold before it is multiplied
    over = s.where(times(F.abs("tenfold"), 10**8) > whole(F.lit(Decimal(absolute) * 10**9)) + whole(times(10 * base, fraction_units(fraction))))
    room = (whole(F.lit(Decimal(absolute) * 10**8)) + whole(times(base, fraction_units(fraction)))) / F.lit(10**8).cast("decimal(9,0)")
    return exceptions(over, "gst_reasonableness", "recorded tax differs from a tenth of the taxable amounts", "Review the tax coding", current_value=F.col("recorded"), difference=F.col("tenfold") / 10, threshold=room)


def gst_sides(tb: DataFrame, classes: DataFrame, settlements: DataFrame) -> DataFrame:
    """(tenant, report_date, side, difference): tax collected and paid each against a tenth of sales and purchases; settlements are signed by side."""
    s = gst_sums(tb, classes, settlements.limit(0))
    by = settlements.groupBy("tenant", "report_date").agg(*[F.sum(F.when(F.col("side") == x, F.col("amount")).otherwise(0)).alias(f"set_{x}") for x in ("collected", "paid")])
    both = s.join(by, ["tenant", "report_date"], "left").fillna(0, ["set_collected", "set_paid"])
    return both.selectExpr("tenant", "report_date", "stack(2, 'collected', 10 * (collected + set_collected) - sales, 'paid', 10 * (paid - set_paid) - purchases) as (side, tenfold)").selectExpr("tenant", "report_date", "side", "tenfold / 10 as difference")


def gst_not_run(tb: DataFrame, classes: DataFrame) -> DataFrame:
    """Periods in which accounts without a tax class, or of class mixed, moved, with their names: the tax control says nothing there."""
    moved = covered(net(tb).where("current_net <> 0"), classes).join(classes, ACCOUNT, "left").where("gst_class is null or gst_class = 'mixed'")
    names = moved.groupBy("tenant", "report_date").agg(F.array_join(F.sort_array(F.collect_set("account_name")), ", ").alias("names"))
    return exceptions(names, "gst_not_run", F.concat(F.lit("not classed: "), "names"), "Class the accounts")


def contact_register(contacts: DataFrame) -> DataFrame:
    """(tenant, contact_id, issue): an invalid ABN, a valid ABN on several contacts, a name that others share but for case and spacing."""
    c = contacts.withColumns({"valid": abn_valid("abn"), "key": F.lower(F.regexp_replace("name", r"\s", "")), "digits": F.translate("abn", " ", "")})
    bad = c.where("abn <> '' and not valid").select("tenant", "contact_id", F.lit("INVALID_ABN").alias("issue"))

    def shared(of: DataFrame, key: str, issue: str) -> DataFrame:
        many = of.groupBy("tenant", key).agg(F.count("*").alias("n")).where("n > 1")
        return of.join(many, ["tenant", key], "left_semi").select("tenant", "contact_id", F.lit(issue).alias("issue"))

    return union([bad, shared(c.where("valid"), "digits", "SHARED_ABN"), shared(c, "key", "SHARED_NAME")])


def equity_reconciliation(pairs: DataFrame, movements: DataFrame) -> DataFrame:
    """(tenant, report_date, account_id, opening, movement, closing, difference): opening plus movements against closing, credit positive; account_id null is the total.

    pairs: equity accounts of pair_periods; movements: (tenant, report_date, account_id, debit, credit).
    """
    m = movements.join(pairs.select("tenant", "report_date").distinct(), ["tenant", "report_date"], "left_semi").groupBy("tenant", "report_date", "account_id").agg((F.sum("credit") - F.sum("debit")).alias("movement"))
    own = pairs.select("tenant", "report_date", "account_id", (-F.coalesce("pri.ytd_net", F.lit(0))).alias("opening"), (-F.coalesce("cur.ytd_net", F.lit(0))).alias("closing"))
    both = own.join(m, ["tenant", "report_date", "account_id"], "full_outer").fillna(0, ["opening", "closing", "movement"])
    total = both.groupingSets([["tenant", "report_date", "account_id"], ["tenant", "report_date"]], "tenant", "report_date", "account_id").agg(*[F.sum(c).alias(c) for c in ("opening", "movement", "closing")])
    return total.withColumn("difference", F.col("opening") + F.col("movement") - F.col("closing"))


def equity_result_issues(reconciled: DataFrame, stored: DataFrame) -> DataFrame:
    """(tenant, report_date, account_id, issue): results of equity_reconciliation against stored ones (the same columns); account_id null is the total.
    NOT_STORED and UNKNOWN rows, and OPENING, MOVEMENT, CLOSING or DIFFERENCE where the figure isn't the recomputed one."""
    keys, figures = ["tenant", "report_date"], ["opening", "movement", "closing", "difference"]
    a, b = reconciled.withColumn("here", F.lit(True)).alias("a"), stored.withColumn("here", F.lit(True)).alias("b")
    both = a.join(b, [*[F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], F.col("a.account_id").eqNullSafe(F.col("b.account_id"))], "full_outer")
    one = F.when(F.col("b.here").isNull(), F.array(F.lit("NOT_STORED"))).when(F.col("a.here").isNull(), F.array(F.lit("UNKNOWN")))
    unlike = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c.upper())) for c in figures]), lambda x: x.isNotNull())
    named = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in (*keys, "account_id")]
    return both.select(*named, F.explode(F.coalesce(one, unlike)).alias("issue"))


def contact_exceptions(contacts: DataFrame, periods: DataFrame) -> DataFrame:
    """contact_register's issues as exceptions of the tenant's last period (tenant, report_date): the register is the state then."""
    last = periods.groupBy("tenant").agg(F.max("report_date").alias("report_date"))
    return exceptions(contact_register(contacts).join(last, "tenant"), "contact_register", F.concat("issue", F.lit(" "), "contact_id"), "Correct the register")


def equity_exceptions(reconciled: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Accounts of equity_reconciliation whose opening plus movements differ from the closing by more than the tolerance; totals are left out."""
    bad = reconciled.where(F.col("account_id").isNotNull() & (F.abs("difference") > F.lit(tolerance).cast(AMOUNT)))
    return exceptions(bad, "equity_reconciliation", "opening plus movements differ from the closing", "Complete the movement schedule", current_value=F.col("closing"), prior_value=F.col("opening"), threshold=F.lit(tolerance))


def evidence_exceptions(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """evidence_issues as exceptions of the evidence's tenant and period."""
    who = evidence.select("evidence_id", "tenant", "report_date", "label")
    return exceptions(evidence_issues(evidence, sources).join(who, "evidence_id"), "calculation_evidence", F.concat("label", F.lit(": "), "issue"), "Repeat the calculation")


def enrich(found: DataFrame, mapped: DataFrame) -> DataFrame:
    """Exceptions with the review group that their account has in their period."""
    return found.drop("review_group").join(mapped.select(*ACCOUNT, "review_group"), ACCOUNT, "left").select(*FIELDS)


def ordered(found: DataFrame) -> DataFrame:
    """Exceptions with `ordinal` in the canonical order of their tenant and period: blocked ones first, then control, account and reason."""
    w = Window.partitionBy("tenant", "report_date").orderBy(F.col("status") != "BLOCKED", "control", F.coalesce("account_id", F.lit("")), "reason")
    return found.withColumn("ordinal", F.row_number().over(w))


def required_controls(runs: DataFrame, required: DataFrame) -> DataFrame:
    """Required controls (control) that a period's runs (tenant, report_date, control, state) skipped or failed; a control without a run counts as skipped."""
    periods = runs.select("tenant", "report_date").distinct().crossJoin(F.broadcast(required.select("control")))  # a declared, small list
    state = periods.join(runs, ["tenant", "report_date", "control"], "left").withColumn("state", F.coalesce("state", F.lit("SKIPPED"))).where("state <> 'RAN'")
    return exceptions(state, "required_controls", F.concat_ws(" ", "control", F.lower("state")), "Run the control", "BLOCKED")


def controls_not_run(runs: DataFrame) -> DataFrame:
    """(tenant, report_date, not_run, relied_on): names of the controls that didn't run and that ran, joined in order."""
    names = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("control")))), ", ")
    return runs.groupBy("tenant", "report_date").agg(names(F.col("state") != "RAN").alias("not_run"), names(F.col("state") == "RAN").alias("relied_on"))


def overall_status(periods: DataFrame, found: DataFrame) -> DataFrame:
    """(tenant, report_date, status): BLOCKED over REVIEW over PASS."""
    rank = found.groupBy("tenant", "report_date").agg(F.max(F.when(F.col("status") == "BLOCKED", 2).otherwise(1)).alias("n"))
    both = periods.select("tenant", "report_date").distinct().join(rank, ["tenant", "report_date"], "left")
    return both.select("tenant", "report_date", F.when(F.col("n") == 2, "BLOCKED").when(F.col("n") == 1, "REVIEW").otherwise("PASS").alias("status"))


#: Question and evidence asked for by control (own wording); {n} is the account's name.
QUESTIONS = {
    "period_variance": ("What caused the movement in {n}?", "Transaction listing"),
    "period_comparison": ("Why did {n} appear or disappear?", "Chart of accounts"),
    "account_metadata": ("Why was {n} renamed or moved?", "Chart change record"),
    "account_mapping": ("Where is {n} reported?", "Mapping decision"),
    "mapping_compatibility": ("Is the group of {n} right?", "Mapping decision"),
    "balance_policy": ("Why is the balance of {n} unusual?", "Account reconciliation"),
    "subledger_reconciliation": ("Why does the subledger of {n} differ?", "Subledger report"),
    "reconciliation_coverage": ("What supports the balance of {n}?", "Account reconciliation"),
}


def client_queries(found: DataFrame) -> DataFrame:
    """One question per exception with an account, with a stable id: Q- and twelve hex digits over the length-prefixed identity."""
    sized = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    parts = [sized(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("control", "tenant", "report_date", "account_id", "reason")]
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in QUESTIONS.items() for x in (k, v[i])])[F.col("control")]
    asked = found.where(F.col("account_id").isNotNull() & F.col("control").isin(*QUESTIONS))
    return asked.select(
        F.concat(F.lit("Q-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)).alias("query_id"), "control", "tenant", "report_date", "account_id", "account_code", "account_name", "review_group", "difference",
        F.replace(pick(0), F.lit("{n}"), F.coalesce("account_name", "account_id")).alias("question"), pick(1).alias("evidence_requested"),
    )


def evidence_issues(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """(evidence_id, issue) of calculation evidence (evidence_id, label, status, period_end, report_date, rate_tables, sha256, accepted): not computed, wrong period, no rate table, digest unknown to sources (sha256), repeated label."""
    e = evidence.join(sources.select("sha256", F.lit(True).alias("known")).distinct(), "sha256", "left")
    e = e.withColumn("same", F.count("*").over(Window.partitionBy("report_date", "label")))
    issues = [("NOT_COMPUTED", F.col("status") != "computed"), ("NOT_ACCEPTED", ~F.col("accepted")), ("WRONG_PERIOD", F.col("period_end") != F.col("report_date")), ("NO_RATE_TABLE", F.col("rate_tables") == 0), ("UNKNOWN_DIGEST", F.col("known").isNull()), ("REPEATED_LABEL", F.col("same") > 1)]
    return e.select("evidence_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in issues]), lambda x: x.isNotNull())).alias("issue"))
