"""Workpaper readiness: completeness of packs, tax and bank tie-outs, statement mapping, document controls; findings for all packs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = {"pack": "string", "code": "string", "status": "string", "slot": "string", "reason": "string"}

#: Slots of each engagement profile: required or not.
PROFILES = [
    ("bas", "trial_balance", True), ("bas", "activity_statement", True), ("bas", "gst_control_gl", True), ("bas", "bank_rec", False), ("bas", "open_items", True), ("bas", "self_review", True), ("bas", "prior_findings", False),
    ("month_end", "trial_balance", True), ("month_end", "prior_trial_balance", True), ("month_end", "bank_rec", True), ("month_end", "open_items", True), ("month_end", "self_review", True), ("month_end", "prior_findings", False),
    ("year_end", "trial_balance", True), ("year_end", "prior_trial_balance", True), ("year_end", "bank_rec", True), ("year_end", "tie_out_matrix", True), ("year_end", "fs_mapping", False), ("year_end", "open_items", True), ("year_end", "self_review", True), ("year_end", "prior_findings", False),
]
CENT = "decimal(18,2)"


def findings(df: DataFrame, code: str | Column, slot: str | Column, reason: str | Column, status: str | Column = "NOT_READY") -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    given = {"pack": F.col("pack"), "code": lit(code), "status": lit(status), "slot": lit(slot), "reason": lit(reason)}
    return df.select(*[given[c].cast(t).alias(c) for c, t in FIELDS.items()])


def missing_artefacts(packs: DataFrame, slots: DataFrame, sources: DataFrame) -> DataFrame:
    """Required slots without a source or with an empty one. packs: (pack, profile); slots: (profile, slot, required); sources: (pack, slot, size)."""
    need = packs.join(F.broadcast(slots.where("required")), "profile").join(sources, ["pack", "slot"], "left")  # the profiles are a declared table
    bad = need.where("size is null or size = 0")
    return findings(bad, F.when(F.col("size").isNull(), "MISSING_ARTEFACT").otherwise("EMPTY_ARTEFACT"), F.col("slot"), F.concat_ws(" ", "slot", F.when(F.col("size").isNull(), "is missing").otherwise("is empty")), "BLOCKED")


def activity_statement(statements: DataFrame, postings: DataFrame, tolerance: str = "0") -> DataFrame:
    """Tax payable (1A - 1B) against the control account's movement, credit positive; whole-dollar labels may hide up to 99 cents; a missing label is a break. statements: (pack, label, amount)."""
    s = statements.groupBy("pack").agg(*[F.max(F.when(F.col("label") == x, F.col("amount"))).alias(n) for x, n in (("1A", "a"), ("1B", "b"))])
    m = postings.groupBy("pack").agg(F.sum(F.col("credit") - F.col("debit")).alias("m"))
    d = s.join(m, "pack", "left").fillna(0, ["m"]).withColumn("d", F.col("a") - F.col("b") - F.col("m"))
    whole = (F.col("a") == F.floor("a")) & (F.col("b") == F.floor("b"))
    over = (F.abs("d") > F.lit(tolerance).cast(CENT)) & ~(whole & (F.abs("d") < 1))
    reason = F.when(F.col("d").isNull(), "label 1A or 1B is missing").otherwise(F.concat(F.lit("differs by "), F.col("d").cast(CENT).cast("string")))
    return findings(d.where(F.col("d").isNull() | over), "TIEOUT_BREAK", F.when(F.col("d").isNull(), "activity_statement").otherwise("gst_control_gl"), reason)


def control_accounts_missing(postings: DataFrame, tb: DataFrame) -> DataFrame:
    """(pack, account_id): control accounts with postings that the trial balance lacks."""
    return postings.select("pack", "account_id").distinct().join(tb.select("pack", "account_id"), ["pack", "account_id"], "left_anti")


def gst_roll_forward(opening: DataFrame, postings: DataFrame, tb: DataFrame) -> DataFrame:
    """(pack, opening, movement, closing, difference) where the control accounts don't roll forward; packs with a missing control account are left to that finding."""
    lost = control_accounts_missing(postings, tb).select("pack").distinct()
    m = postings.groupBy("pack").agg(F.sum(F.col("credit") - F.col("debit")).alias("movement"))
    close = tb.join(postings.select("pack", "account_id").distinct(), ["pack", "account_id"], "left_semi").groupBy("pack").agg(F.sum(-F.col("net")).alias("closing"))
    d = opening.join(lost, "pack", "left_anti").join(m, "pack").join(close, "pack").withColumn("difference", F.col("opening") + F.col("movement") - F.col("closing"))
    return d.where("difference <> 0").select("pack", "opening", "movement", "closing", "difference")


def difference_hints(breaks: DataFrame, postings: DataFrame) -> DataFrame:
    """(pack, difference, hint, posting_id): a posting of the difference's size, or of half of it, or digits that may be transposed (cents divide by nine).

    breaks: (pack, difference); postings: (pack, posting_id, net), matched by equality on the amounts that would explain the break.
    """
    b = breaks.select("pack", "difference", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.lit("SAME_SIZE").alias("hint"), (-F.col("difference")).cast(CENT).alias("net")), F.struct(F.lit(2).alias("rank"), F.lit("DOUBLE").alias("hint"), (-F.col("difference") / 2).cast(CENT).alias("net")))).alias("x")).select("pack", "difference", "x.*")
    b = b.where("rank = 1 or net * 2 = -difference")
    hit = b.join(postings.withColumn("net", F.col("net").cast(CENT)), ["pack", "net"]).groupBy("pack", "difference").agg(F.min(F.struct("rank", "posting_id", "hint")).alias("m"))
    nine = F.pmod((F.col("difference") * 100).cast("long"), F.lit(9)) == 0
    out = breaks.join(hit, ["pack", "difference"], "left")
    return out.select("pack", "difference", F.when(F.col("m").isNotNull(), F.col("m.hint")).when(nine, "TRANSPOSED").alias("hint"), F.col("m.posting_id").alias("posting_id"))


def bank_reconciliation(banks: DataFrame, tb: DataFrame, tolerance: str = "0") -> DataFrame:
    """Bank rows (pack, account_id, statement_balance, gl_balance): statement against ledger, ledger against trial balance, account absent."""
    b = banks.join(tb.select("pack", "account_id", "net"), ["pack", "account_id"], "left")
    room = F.lit(tolerance).cast(CENT)
    codes = F.array(F.when(F.col("net").isNull(), "BANK_ACCOUNT_ABSENT").when(F.abs(F.col("gl_balance") - F.col("net")) > room, "BANK_TB_DIFFERENCE"), F.when(F.abs(F.col("statement_balance") - F.col("gl_balance")) > room, "BANK_STATEMENT_DIFFERENCE"))
    return findings(b.withColumn("code", F.explode(F.filter(codes, lambda x: x.isNotNull()))), F.col("code"), "bank_rec", F.concat(F.lit("account "), "account_id"))


def tie_out(matrix: DataFrame) -> DataFrame:
    """Tie-out rows that are unsupported or excepted, and tied ones that name no workpaper or source."""
    bare = (F.coalesce("workpaper_ref", F.lit("")) == "") | (F.coalesce("source_file", F.lit("")) == "")
    code = F.when((F.col("status") == "UNSUPPORTED") | (F.col("status") == "TIED") & bare, "TIEOUT_UNSUPPORTED").when(F.col("status") == "EXCEPTION", "TIEOUT_BREAK")
    return findings(matrix.withColumn("code", code).where("code is not null"), F.col("code"), "tie_out_matrix", F.col("statement_line"))


def statement_lines(matrix: DataFrame, mapping: DataFrame, tb: DataFrame) -> DataFrame:
    """(pack, statement_line, statement_amount, computed, state): amounts of the mapped accounts, signed by the line's normal balance; a line with an unknown account is not computed.

    States: UNMAPPED_LINE, UNKNOWN_ACCOUNT, DIFFERENT, EQUAL.
    """
    m = mapping.join(tb.select("pack", "account_id", "net"), ["pack", "account_id"], "left")
    sign = F.when(F.col("normal_balance") == "credit", -1).otherwise(1)
    s = m.groupBy("pack", "statement_line").agg(F.sum(F.col("net") * sign).alias("computed"), F.bool_or(F.col("net").isNull()).alias("lost"))
    j = matrix.join(s, ["pack", "statement_line"], "left")
    state = F.when(F.col("lost").isNull(), "UNMAPPED_LINE").when(F.col("lost"), "UNKNOWN_ACCOUNT").when(F.col("computed") != F.col("statement_amount"), "DIFFERENT").otherwise("EQUAL")
    return j.select("pack", "statement_line", "statement_amount", F.when(~F.col("lost"), F.col("computed")).alias("computed"), state.alias("state"))


def unmapped_accounts(mapping: DataFrame, tb: DataFrame) -> DataFrame:
    """Accounts with a balance that no statement line takes."""
    return tb.where("net <> 0").join(mapping.select("pack", "account_id"), ["pack", "account_id"], "left_anti")


def open_items(items: DataFrame) -> DataFrame:
    """Open items (pack, item_id, severity, status, resolution) that block and have no resolution, and cleared ones without one."""
    bare = F.coalesce("resolution", F.lit("")) == ""
    code = F.when((F.col("status") == "OPEN") & (F.col("severity") == "BLOCKING") & bare, "OPEN_ITEM_BLOCKING").when((F.col("status") == "CLEARED") & bare, "OPEN_ITEM_INCOMPLETE")
    return findings(items.withColumn("code", code).where("code is not null"), F.col("code"), "open_items", F.col("item_id"))


def self_review(reviews: DataFrame) -> DataFrame:
    """Reviews (pack, preparer, reviewer, prepared_on, period_end, assertions map<string,boolean>): assertions not made, the preparer as reviewer, a review before the period's end."""
    no = F.array_sort(F.map_keys(F.map_filter("assertions", lambda k, v: ~F.coalesce(v, F.lit(False)))))
    same = F.lower(F.trim("preparer")) == F.lower(F.trim("reviewer"))
    codes = [("SELF_REVIEW_INCOMPLETE", F.size(no) > 0), ("REVIEWER_IS_PREPARER", same), ("REVIEWED_EARLY", F.col("prepared_on") < F.col("period_end"))]
    rows = reviews.withColumn("no", F.array_join(no, ", ")).withColumn("code", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in codes]), lambda x: x.isNotNull())))
    return findings(rows, F.col("code"), "self_review", F.when(F.col("code") == "SELF_REVIEW_INCOMPLETE", F.col("no")).otherwise(F.lower(F.col("code"))))


def period_order(packs: DataFrame) -> DataFrame:
    """Packs (pack, tb_date, prior_date, period_start, period_end, first_posting, last_posting): prior not before current, dates other than declared, postings outside the period."""
    codes = [("PERIOD_ORDER", F.col("prior_date") >= F.col("tb_date")), ("PERIOD_BINDING", F.col("tb_date") != F.col("period_end")), ("POSTING_OUTSIDE_PERIOD", (F.col("first_posting") < F.col("period_start")) | (F.col("last_posting") > F.col("period_end")))]
    rows = packs.withColumn("code", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in codes]), lambda x: x.isNotNull())))
    return findings(rows, F.col("code"), "trial_balance", F.lower(F.col("code")), "BLOCKED")


def mark_repeats(found: DataFrame, prior: DataFrame) -> DataFrame:
    """Findings with `repeat`: the prior findings (pack, code, slot, status) hold the same one open; the reason says so."""
    open_ = prior.where("status = 'OPEN'").select("pack", "code", "slot", F.lit(True).alias("repeat")).distinct()
    j = found.join(open_, ["pack", "code", "slot"], "left").withColumn("repeat", F.coalesce("repeat", F.lit(False)))
    return j.withColumn("reason", F.when(F.col("repeat"), F.concat("reason", F.lit(" (repeated)"))).otherwise(F.col("reason")))


def pack_status(packs: DataFrame, found: DataFrame) -> DataFrame:
    """(pack, status): BLOCKED over NOT_READY over READY."""
    rank = found.groupBy("pack").agg(F.max(F.when(F.col("status") == "BLOCKED", 2).otherwise(1)).alias("n"))
    return packs.join(rank, "pack", "left").select("pack", F.when(F.col("n") == 2, "BLOCKED").when(F.col("n") == 1, "NOT_READY").otherwise("READY").alias("status"))


def first_three(names: Column) -> Column:
    """The first three names and how many more there are."""
    return F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.when(F.size(names) > 3, F.concat(F.lit(" and "), (F.size(names) - 3).cast("string"), F.lit(" more"))).otherwise(""))


def observations(documents: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(doc_id, field, page, line, value): lines `Label: value`, with up to six # before, of form-feed separated pages; page and line count from 1."""
    pages = documents.select("doc_id", F.posexplode(F.split("text", "\f", -1)).alias("page", "p"))
    lines = pages.select("doc_id", (F.col("page") + 1).alias("page"), F.posexplode(F.split("p", "\n", -1)).alias("line", "l"))
    pattern = rf"^#{{0,6}} *({'|'.join(labels)}):(.*)$"
    hit = lines.where(F.col("l").rlike(pattern))
    return hit.select("doc_id", F.regexp_extract("l", pattern, 1).alias("field"), "page", (F.col("line") + 1).alias("line"), F.trim(F.regexp_extract("l", pattern, 2)).alias("value"))


def prefill(observed: DataFrame) -> DataFrame:
    """(doc_id, field, value): fields with exactly one observation."""
    return observed.groupBy("doc_id", "field").agg(F.count("*").alias("n"), F.max("value").alias("value")).where("n = 1").drop("n")


def document_controls(documents: DataFrame) -> DataFrame:
    """(pack, doc_id, code) of documents (pack, doc_id, sha256, entity, pack_entity, reviewed, amount, gst): another entity's, not reviewed, the same bytes as an earlier one, tax of the wrong sign or above an eleventh."""
    w = Window.partitionBy("pack", "sha256").orderBy("doc_id")
    a, g = F.col("amount"), F.col("gst")
    codes = [("CONTEXT_MISMATCH", F.col("entity") != F.col("pack_entity")), ("REVIEW_REQUIRED", ~F.col("reviewed")), ("DUPLICATE_BYTES", F.col("n") > 1), ("GST_SIGN", F.signum(a) * F.signum(g) < 0), ("GST_SIZE", F.abs(g) * 11 > F.abs(a))]
    d = documents.withColumn("n", F.row_number().over(w))
    return d.select("pack", "doc_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in codes]), lambda x: x.isNotNull())).alias("code"))
