"""JSON documents under a tree of guards: a text is parsed once as VARIANT, each member is held against its guard, and a refusal names its path.

VARIANT refuses members that appear twice, at any depth. Values are guarded as they stand, without a conversion: a number is no text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import MONEY, exact_money, iso_date
from .staging import staged

Guard = Callable[[Column], Column]
FAULT = "array<struct<path:string,code:string>>"


def fault(path: Column | str, code: str) -> Column:
    return F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(code).alias("code"))


def some(*faults: Column) -> Column:
    """Those of the faults that aren't null."""
    return F.filter(F.array(*faults), lambda x: x.isNotNull())


def is_kind(v: Column, kind: str) -> Column:
    """Whether v is a STRING, BIGINT or BOOLEAN as it stands; false for a member that isn't there."""
    return F.schema_of_variant(v).eqNullSafe(kind)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value evaluated once however often `of` uses it."""
    return F.element_at(F.transform(F.array(value), of), 1)


class Node:
    """A guard of one value. faults(v, path): what is wrong in a VARIANT; schema(): the type of what passes."""

    def faults(self, v: Column, path: Column) -> Column:
        raise NotImplementedError

    def schema(self) -> T.DataType:
        raise NotImplementedError


class Leaf(Node):
    """A guard that finds one fault at most: wrong(v, path), null if there is none. An object gathers its leaves' faults at once."""

    def wrong(self, v: Column, path: Column) -> Column:
        raise NotImplementedError

    def faults(self, v, path):
        return some(self.wrong(v, path))


@dataclass(frozen=True)
class Text(Leaf):
    """A text for which the guard gives a value."""

    guard: Guard

    def wrong(self, v, path):
        return F.when(~is_kind(v, "STRING"), fault(path, "TYPE")).when(let(F.try_variant_get(v, "$", "string"), lambda c: self.guard(c)).isNull(), fault(path, "VALUE"))

    def schema(self):
        return T.StringType()


@dataclass(frozen=True)
class Number(Leaf):
    """A whole number from low to high."""

    low: int
    high: int

    def wrong(self, v, path):
        return F.when(~is_kind(v, "BIGINT"), fault(path, "TYPE")).when(~F.try_variant_get(v, "$", "long").between(self.low, self.high), fault(path, "VALUE"))

    def schema(self):
        return T.LongType()


@dataclass(frozen=True)
class Flag(Leaf):
    def wrong(self, v, path):
        return F.when(~is_kind(v, "BOOLEAN"), fault(path, "TYPE"))

    def schema(self):
        return T.BooleanType()


@dataclass(frozen=True)
class Any(Node):
    """Anything; kept as JSON text."""

    def faults(self, v, path):
        return F.array().cast(FAULT)

    def schema(self):
        return T.StringType()


@dataclass(frozen=True)
class Struct(Node):
    """An object with exactly these members; maybe: members that may be absent; open: others may stand beside them.

    Its members are taken apart once: a VARIANT that is taken from another is built anew, with all that lies in it.
    """

    members: dict[str, Node]
    maybe: frozenset[str] = frozenset()
    open: bool = False

    def faults(self, v, path):
        at = lambda k: F.concat(path, F.lit("."), k)

        def member(value: Column, k: str, node: Node) -> Column:
            found, lost = (node.wrong, lambda x: x) if isinstance(node, Leaf) else (node.faults, some)
            absent = lost(F.when(F.lit(k not in self.maybe), fault(at(F.lit(k)), "MEMBER")))
            return F.when(value.isNull(), absent).otherwise(found(value, at(F.lit(k))))

        def of(held: Column) -> Column:
            known, found = F.array(*[F.lit(k) for k in self.members]), []
            if not self.open:
                found.append(F.transform(F.array_except(F.map_keys(held), known), lambda k: F.struct(at(k).alias("path"), F.lit("MEMBER").alias("code"))))
            each = {k: let(held[k], lambda value: member(value, k, node)) for k, node in self.members.items()}  # noqa: B023
            leaves = [c for k, c in each.items() if isinstance(self.members[k], Leaf)]
            found += [some(*leaves)] if leaves else []
            found += [c for k, c in each.items() if not isinstance(self.members[k], Leaf)]
            return F.when(held.isNull(), some(fault(path, "TYPE"))).otherwise(F.concat(*found))

        return let(F.try_variant_get(v, "$", "map<string,variant>"), of)

    def schema(self):
        return T.StructType([T.StructField(k, n.schema()) for k, n in self.members.items()])


@dataclass(frozen=True)
class Rows(Node):
    """A list of at least `least` values; key: members that together stand once; distinct: the values themselves do."""

    of: Node
    least: int = 0
    key: tuple[str, ...] = ()
    distinct: bool = False

    def faults(self, v, path):
        def name(x: Column) -> Column:
            parts = [F.try_variant_get(x, f"$.{k}" if k else "$", "string") for k in self.key or ("",)]
            return parts[0] if len(parts) == 1 else F.to_json(F.array(*parts))

        def of(rows: Column) -> Column:
            found = [F.flatten(F.transform(rows, lambda x, i: self.of.faults(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))]
            if self.least:
                found.append(some(F.when(F.size(rows) < self.least, fault(path, "TOO_FEW"))))
            if self.key or self.distinct:
                found.append(let(F.transform(rows, name), lambda names: some(F.when(F.size(F.array_distinct(names)) < F.size(names), fault(path, "REPEATED_KEY")))))
            return F.when(rows.isNull(), some(fault(path, "TYPE"))).otherwise(F.concat(*found))

        return let(F.try_variant_get(v, "$", "array<variant>"), of)

    def schema(self):
        return T.ArrayType(self.of.schema())


@dataclass(frozen=True)
class Named(Node):
    """An object with names of its own, each with the same kind of value."""

    of: Node
    least: int = 0

    def faults(self, v, path):
        def of(held: Column) -> Column:
            each = F.flatten(F.transform(F.map_entries(held), lambda e: self.of.faults(e["value"], F.concat(path, F.lit("."), e["key"]))))
            return F.when(held.isNull(), some(fault(path, "TYPE"))).otherwise(F.concat(some(F.when(F.size(held) < self.least, fault(path, "TOO_FEW"))), each))

        return let(F.try_variant_get(v, "$", "map<string,variant>"), of)

    def schema(self):
        return T.MapType(T.StringType(), self.of.schema())


@dataclass(frozen=True)
class Document:
    """A kind of document: its root, rules over the whole (path, code, condition of doc), and over each row of a list (list, path within, code, condition
    of row and doc). Rules are asked only where every guard passes."""

    root: Struct
    rules: tuple[tuple[str, str, Callable[[Column], Column]], ...] = ()
    each: tuple[tuple[str, str, str, Callable[[Column, Column], Column]], ...] = ()


# -- guards ------------------------------------------------------------------------------------------------------------


def plain(c: Column) -> Column:
    """Text that isn't empty, without white space outside and control characters inside."""
    return F.when((c != "") & ~c.rlike(r"^\s|\s$|[\x00-\x1f]"), c)


def perhaps(guard: Guard) -> Guard:
    """Empty text passes."""
    return lambda c: F.when(c == "", c).otherwise(guard(c))


def form(pattern: str) -> Guard:
    return lambda c: F.when(c.rlike(pattern), c)


def amount(c: Column) -> Column:
    """Signed money of at most two places."""
    return F.when(c.rlike(r"^-?\d{1,16}(\.\d{1,2})?$"), c.try_cast(MONEY))


def positive(c: Column) -> Column:
    return F.when(exact_money(c) > 0, c)


def stripped(most: int) -> Guard:
    """Text that isn't blank, at most so long without white space outside."""
    return lambda c: F.when(F.length(F.regexp_replace(c, r"^\s+|\s+$", "")).between(1, most) & ~c.rlike(r"[\x00-\x08\x0b-\x1f]"), c)


date, text, blank, money, signed = Text(iso_date), Text(plain), Text(perhaps(plain)), Text(exact_money), Text(amount)
digest, currency, identity = Text(form("^[0-9a-f]{64}$")), Text(form("^[A-Z]{3}$")), Text(form(r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,79}$"))
#: A weight above 0 and at most 1, of six places.
weight = Text(lambda c: F.when(c.rlike(r"^(1|0\.\d{1,6}|1\.0{1,6})$") & (c.try_cast("decimal(9,6)") > 0), c))
#: Words in lower case, joined by single hyphens.
slug = Text(form("^[a-z0-9]+(-[a-z0-9]+)*$"))
version = Number(1, 1)


def const(value: str) -> Text:
    return Text(lambda c: F.when(c == value, c))


def texts(names: str, of: Node = text) -> dict[str, Node]:
    return dict.fromkeys(names.split(), of)


def _money(c: Column) -> Column:
    return c.try_cast(MONEY)


def _one_side(row: Column, debit: str = "debit", credit: str = "credit") -> Column:
    return (_money(row[debit]) > 0) != (_money(row[credit]) > 0)


def _sum(rows: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(rows, F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + of(x)).cast("decimal(38,6)"))


def _weights_are_whole(doc: Column) -> Column:
    """Each source account's weights sum to one."""
    of = lambda m: _sum(F.filter(doc["mapping"], lambda x: x["source_account"] == m["source_account"]), lambda x: x["weight"].try_cast("decimal(9,6)"))
    return F.forall(doc["mapping"], lambda m: of(m) == 1)


ITEM = Struct({**texts("Tenant AccountID"), "Currency": currency, "TransactionID": identity, "Date": date, **texts("Reference Description", blank), **texts("Debit Credit", money)})
CARRIED = Struct({**texts("row_id item_id account reference tax_code"), "amount": signed})
REPORT = Struct({"name": const("Trial Balance"), "as_at": date, "basis": const("accrual"), "currency": const("AUD"), "tracking_filters": Rows(Any()), "include_drafts": Flag()})

#: The kinds (member names, formats and constants are fixed values of the file formats).
DOCUMENTS = {
    "reviewer_note": Document(Struct({"reviewer_initials": Text(stripped(12)), "reviewed_on": date, "comment": Text(stripped(1 << 20))})),
    "self_review": Document(
        Struct({"preparer_initials": Text(stripped(12)), "prepared_on": date, "engagement_type": text, "period_end": date, "period_start": date, "assertions": Struct(texts("pack_complete tie_outs_done open_items_listed variances_explained self_reviewed", Flag()))}, maybe=frozenset({"period_start"})),
        (("$.prepared_on", "BEFORE_PERIOD_END", lambda d: d["prepared_on"] >= d["period_end"]), ("$.period_start", "ORDER", lambda d: d["period_start"].isNull() | (d["period_start"] <= d["period_end"])), ("$.period_start", "PROFILE", lambda d: d["period_start"].isNull() | (d["engagement_type"] == "bas"))),
    ),
    "opening_items": Document(
        Struct({"schema": const("clearing-carry-v1"), "identity": Struct({**texts("Tenant AccountID"), "Currency": currency}), "period_end": date, "balance": signed, "items": Rows(ITEM, key=("TransactionID",)), "notes": Named(text)}),
        (
            ("$.balance", "SUM", lambda d: _sum(d["items"], lambda x: (_money(x["Debit"]) - _money(x["Credit"])).cast("decimal(20,2)")) == _money(d["balance"])),
            ("$.notes", "UNKNOWN_ITEM", lambda d: F.size(F.array_except(F.map_keys(d["notes"]), F.transform(d["items"], lambda x: x["TransactionID"]))) == 0),
        ),
        (
            ("items", "", "IDENTITY", lambda x, d: (x["Tenant"] == d["identity"]["Tenant"]) & (x["AccountID"] == d["identity"]["AccountID"]) & (x["Currency"] == d["identity"]["Currency"])),
            ("items", "Date", "AFTER_PERIOD_END", lambda x, d: x["Date"] <= d["period_end"]), ("items", "", "ONE_SIDE", lambda x, d: _one_side(x, "Debit", "Credit")),
        ),
    ),
    "expenses": Document(
        Struct({"schema_version": version, "tenant": text, "currency": currency, "cutoff": date,
            "invoices": Rows(Struct({**texts("invoice_id supplier reference"), "amount": Text(positive), "evidence": blank}), 1, ("invoice_id",)),
            "claims": Rows(Struct({**texts("claim_id invoice_id employee"), "amount": Text(positive), "approved": Flag()}), 0, ("claim_id",)),
            "payments": Rows(Struct({**texts("payment_id claim_id reference"), "amount": Text(positive), "date": date}), 0, ("payment_id",)), "ledger_balance": signed}),
        (), (("payments", "date", "AFTER_CUTOFF", lambda x, d: x["date"] <= d["cutoff"]),),
    ),
    "migration": Document(
        Struct({"schema_version": version, "tenant": text, "currency": currency, "cutoff": date, "mapping": Rows(Struct({**texts("mapping_id source_account target_account"), "weight": weight}), 0, ("mapping_id",)), "before": Rows(CARRIED, 1, ("row_id",)), "after": Rows(CARRIED, 0, ("row_id",))}),
        (("$.mapping", "WEIGHTS", _weights_are_whole), ("$.mapping", "REPEATED_PAIR", lambda d: F.size(F.array_distinct(F.transform(d["mapping"], lambda x: F.struct(x["source_account"], x["target_account"])))) == F.size(d["mapping"]))),
    ),
    "interentity": Document(
        Struct({"schema_version": version, "currency": currency, "cutoff": date, "entities": Rows(text, 2, distinct=True), "records": Rows(Struct({**texts("row_id entity counterparty account reference evidence"), "date": date, "amount": signed, "disputed": Flag()}), 1, ("row_id",))}),
        (), (("records", "", "ENTITIES", lambda x, d: F.array_contains(d["entities"], x["entity"]) & F.array_contains(d["entities"], x["counterparty"]) & (x["entity"] != x["counterparty"])), ("records", "date", "AFTER_CUTOFF", lambda x, d: x["date"] <= d["cutoff"])),
    ),
    "equity_schedule": Document(
        Struct({"schema_version": version, "tenant": text, "opening_date": date, "closing_date": date, "currency": currency, "basis": const("ledger_equity"), **texts("prior_source_sha256 current_source_sha256", digest), "equity_account_ids": Rows(text, 1, distinct=True), "complete": Flag(),
            "movements": Rows(Struct({**texts("movement_id account_id description evidence_reference"), "date": date, "debit": money, "credit": money}), 0, ("movement_id",))}),
        (("$.closing_date", "ORDER", lambda d: d["closing_date"] > d["opening_date"]),),
        (
            ("movements", "account_id", "UNKNOWN_ACCOUNT", lambda x, d: F.array_contains(d["equity_account_ids"], x["account_id"])), ("movements", "date", "OUTSIDE_INTERVAL", lambda x, d: (d["opening_date"] < x["date"]) & (x["date"] <= d["closing_date"])),
            ("movements", "", "ONE_SIDE", lambda x, d: _one_side(x)),
        ),
    ),
    "calculation_evidence": Document(
        Struct({"schema": Text(form("^[a-z]+(-[a-z]+)*-evidence/1$")), "calculation_sha256": digest, "calculation": Struct({
            "label": slug, "call": Struct(texts("calculator period status"), open=True), "upstream": Struct({"manifest": Struct({"rate_table_uris": Rows(Struct({"uri": text}, open=True))}, open=True), "advisory": Struct({"notes": Rows(text)}, open=True)}, frozenset({"manifest", "advisory"}), True),
            "normalised": Struct({"values": Named(Text(form(r"^-?\d+(\.\d+)?$")))}, open=True), "validation": Struct({"accepted": Flag(), "findings": Rows(text)}, frozenset({"accepted", "findings"}), True), "synthetic_input": Flag()},
            frozenset({"upstream", "normalised", "validation", "synthetic_input"}), True)}, open=True),
    ),
    "coding_assertions": Document(
        Struct({"schema_version": version, "tenant": text, "currency": currency, "period_start": date, "period_end": date, **texts("original_sha256 current_sha256", digest),
            "expectations": Rows(Struct({**texts("original_account_id transaction_id current_account_id"), **texts("expected_account_id purpose evidence_reference", blank)}), 0, ("original_account_id", "transaction_id"))}),
        (("$.period_start", "ORDER", lambda d: d["period_start"] <= d["period_end"]),),
    ),
    "responses": Document(Struct({"schema_version": version, "pack_sha256": digest, "responses": Rows(Struct({**texts("query_id explanation evidence_reference reviewer", Text(stripped(1 << 20))), "reviewed_on": date}), 0, ("query_id",))})),
    "source_manifest": Document(Struct({"schema_version": Text(form(r"^[a-z]+(-[a-z]+)*-manifest\.v1$")), "mode": const("synthetic"), "source_system": text, "entity_ref": text, "report": REPORT, "export": Struct({"schema": Text(form(r"-tb-csv\.v1$")), "csv": text, "sha256": Text(form("^[0-9a-fA-F]{64}$")), "generated_at": Text(form(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)$"))})})),
    "review_context": Document(Struct({"schema_version": Text(form(r"^[a-z]+(-[a-z]+)*-context\.v1$")), "mode": const("synthetic"), **texts("current_manifest prior_manifest")})),
    "review_policy": Document(
        Struct({"schema_version": Text(form(r"^[a-z]+(-[a-z]+)*-policy\.v1$")), "policy_id": text, "operations": Struct({"trial_balance_variance": Struct({"allowed_sections": Rows(Text(lambda c: c)), **texts("minimum_absolute_delta minimum_percent_delta", Text(form(r"^\d{1,18}(\.\d{1,10})?$"))), "max_results": Number(1, 100)})}),
            "model_projection": Rows(text)}),
        (("$.model_projection", "VALUE", lambda d: d["model_projection"] == F.array(*[F.lit(x) for x in "finding_id evidence_ref account_ref section current_ytd_net prior_ytd_net delta percent_change review_reason".split()])),),
    ),
    "review_request": Document(Struct({"schema_version": Text(form(r"^[a-z]+(-[a-z]+)*-request\.v1$")), "request_id": text, "operation": const("trial_balance_variance"), "section": text, "policy_id": text})),
    "agreements": Document(
        Struct({"schema_version": version, "entity": text, "currency": currency, "ledger_start": date, "ledger_end": date, "amount_basis": text,
            "agreements": Rows(Struct({"grant_id": text, "start": date, "end": date, "opening_cash": money, "opening_unspent_funding": money, "budget": Named(money, 1), "agreement_evidence": text}), 1, ("grant_id",))}),
        (("$.ledger_start", "ORDER", lambda d: d["ledger_start"] <= d["ledger_end"]),), (("agreements", "start", "ORDER", lambda x, d: x["start"] <= x["end"]),),
    ),
    "entity_map": Document(
        Struct({"schema_version": version, "entries": Rows(Struct({"value": text, "placeholder": Text(form(r"^(CLIENT|PERSON|STAFF|ENTITY)_\d{2,}$")), "kind": Text(form("^(client|person|staff|entity)$")), "added": date}), 0, ("placeholder",))}),
        (), (("entries", "placeholder", "KIND", lambda x, d: F.upper(x["kind"]) == F.regexp_extract(x["placeholder"], "^[A-Z]+", 0)), ("entries", "value", "PLACEHOLDER", lambda x, d: ~x["value"].rlike(r"(?i)\b(CLIENT|PERSON|STAFF|ENTITY|TFN|ABN|ACN|BSB|MEDICARE|EMAIL|PHONE)_\d{2,}"))),
    ),
}


def _row_faults(doc: Column, rows: str, within: str, code: str, rule: Callable[[Column, Column], Column]) -> Column:
    """Faults of a rule over the rows of one list."""
    at = lambda i: F.concat(F.lit(f"$.{rows}["), i.cast("string"), F.lit("]" + ("." + within if within else "")))
    return F.filter(F.transform(doc[rows], lambda x, i: F.when(~F.coalesce(rule(x, doc), F.lit(False)), fault(at(i), code))), lambda x: x.isNotNull())


def judged(files: DataFrame, kind: Document) -> DataFrame:
    """files (file, sha256, text) with doc, typed, and faults, an array of (path, code), empty where the document passes.

    One parse of a text, and no shuffle: a document is one row. NOT_JSON: it doesn't parse; DUPLICATE_MEMBER: it does, but for a member that appears twice.
    """
    v = F.try_parse_json("text")
    f = files.withColumn("v", v)
    broken = F.when(F.get_json_object("text", "$").isNull(), some(fault("$", "NOT_JSON"))).otherwise(some(fault("$", "DUPLICATE_MEMBER")))
    f = f.withColumn("faults", F.when(F.col("v").isNull(), broken).otherwise(kind.root.faults(F.col("v"), F.lit("$"))))
    f = f.withColumn("doc", F.when(F.size("faults") == 0, F.from_json("text", kind.root.schema())))
    doc, more = F.col("doc"), []
    for path, code, rule in kind.rules:
        more.append(some(F.when(~F.coalesce(rule(doc), F.lit(False)), fault(path, code))))
    more += [_row_faults(doc, *x) for x in kind.each]
    if more:
        f = f.withColumn("faults", F.when(doc.isNotNull(), F.concat(*more)).otherwise(F.col("faults")))
    return f.drop("v")


def capture(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, text): each file once, its digest bound to the bytes that are parsed. A document is one row, so a file is held whole by its task."""
    f = spark.read.format("binaryFile").load(path)
    return _captured(f.select(F.col("path").alias("file"), "content"))


def _captured(f: DataFrame) -> DataFrame:
    return f.select("file", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


def store(files: DataFrame, path: str) -> None:
    """files (file, content) as a store: a Parquet table of names and bytes, many documents to a file. A folder of small files costs its listing a call for each.

    Guards cost more than bytes, so every core has a part of the store, however small it is.
    """
    files.select("file", "content").repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "file").write.parquet(path)


def capture_stored(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, text) of a store, as capture() gives them of files."""
    return _captured(spark.read.schema("file string, content binary").parquet(path))


def read_json(spark: SparkSession, path: str, name: str, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, refusals) of the documents of one kind: (file, sha256, doc), and (file, sha256, path, code) for every fault of those refused. stored: path
    is a store, else files. What was judged is written once: a filter over it would be moved below the parse, which would then run for every guard."""
    f = staged(judged((capture_stored if stored else capture)(spark, path), DOCUMENTS[name]).drop("text"), f"judged-{name}")
    good = F.size("faults") == 0
    return f.where(good).select("file", "sha256", "doc"), f.where(~good).select("file", "sha256", F.explode("faults").alias("x")).select("file", "sha256", "x.path", "x.code")


def items(accepted: DataFrame, array: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of one list of accepted documents, with `file` and kept members."""
    return accepted.select("file", *[F.col(f"doc.{c}").alias(c) for c in keep], F.inline(F.col(f"doc.{array}")))


# -- documents against other tables ------------------------------------------------------------------------------------


def opening_period_issues(opening: DataFrame, periods: DataFrame) -> DataFrame:
    """(file, path, code): opening items (accepted) whose period isn't the one before the period they open (tenant, account_id, currency, period_start), or which
    open none."""
    o = opening.select("file", *[F.col(f"doc.identity.{a}").alias(b) for a, b in (("Tenant", "tenant"), ("AccountID", "account_id"), ("Currency", "currency"))], iso_date("doc.period_end").alias("period_end"))
    met = o.join(periods, ["tenant", "account_id", "currency"], "left").groupBy("file").agg(F.count("period_start").alias("n"), F.bool_or(F.date_add("period_end", 1) == F.col("period_start")).alias("follows"))
    code = F.when(F.col("n") == 0, "UNKNOWN_IDENTITY").when(~F.col("follows"), "NOT_PRECEDING")
    return met.select("file", F.lit("$.period_end").alias("path"), code.alias("code")).where("code is not null")


def response_issues(responses: DataFrame, packs: DataFrame) -> DataFrame:
    """(file, path, code): responses (accepted) to packs (pack_sha256, query_id, report_date): the pack isn't known, the query isn't in it, or the answer is
    older than the close."""
    known = packs.select("pack_sha256").distinct().withColumn("known", F.lit(True))
    docs = responses.select("file", F.col("doc.pack_sha256").alias("pack_sha256"), "doc.responses").join(known, "pack_sha256", "left")
    bare = docs.where("known is null").select("file", F.lit("$.pack_sha256").alias("path"), F.lit("UNKNOWN_PACK").alias("code"))
    rows = docs.where("known").select("file", "pack_sha256", F.posexplode("responses").alias("i", "x")).select("file", "pack_sha256", "i", "x.query_id", iso_date("x.reviewed_on").alias("reviewed_on"))
    met = rows.join(packs, ["pack_sha256", "query_id"], "left")
    at = lambda m: F.concat(F.lit("$.responses["), F.col("i").cast("string"), F.lit(f"].{m}"))
    lost = met.where("report_date is null").select("file", at("query_id").alias("path"), F.lit("UNKNOWN_QUERY").alias("code"))
    early = met.where("reviewed_on < report_date").select("file", at("reviewed_on").alias("path"), F.lit("BEFORE_CLOSE").alias("code"))
    return bare.unionByName(lost).unionByName(early)


def context_issues(contexts: DataFrame, manifests: DataFrame, exports: DataFrame) -> DataFrame:
    """(file, path, code) of review contexts (accepted), whose manifests (accepted, found by their file's name) are bound to exports (name, sha256, report_date):
    a manifest or export that isn't there, another digest or date than the manifest declares, and two manifests that can't be compared: other entity,
    basis, currency, filters or drafts, not in order, or in different financial years but for the same day."""
    base = lambda c: F.regexp_extract(c, "[^/]*$", 0)
    m = manifests.select(base("file").alias("name"), "doc").alias("m").join(exports.alias("e"), base("m.doc.export.csv") == F.col("e.name"), "left")
    m = m.select(F.col("m.name").alias("name"), "doc", F.col("e.sha256").alias("sha256"), F.col("e.report_date").alias("report_date"))
    c = contexts.select("file", base("doc.current_manifest").alias("current"), base("doc.prior_manifest").alias("prior"))
    sides = {s: m.select(F.col("name").alias(s), F.struct("doc", "sha256", "report_date").alias(f"{s}_m")) for s in ("current", "prior")}
    both = c.join(sides["current"], "current", "left").join(sides["prior"], "prior", "left")
    found = []
    for s in ("current", "prior"):
        x, path = F.col(f"{s}_m"), f"$.{s}_manifest"
        found.append(F.when(x.isNull(), fault(path, "UNKNOWN_MANIFEST")).when(x["sha256"].isNull(), fault(path, "UNKNOWN_EXPORT")).when(F.lower(x["doc"]["export"]["sha256"]) != x["sha256"], fault(path, "DIGEST")).when(iso_date(x["doc"]["report"]["as_at"]) != x["report_date"], fault(path, "DATE")))
    a, b = F.col("current_m.doc"), F.col("prior_m.doc")
    for k in ("basis", "currency", "tracking_filters", "include_drafts"):
        found.append(F.when(~a["report"][k].eqNullSafe(b["report"][k]), fault(f"$.report.{k}", "MISMATCH")))
    now, then = iso_date(a["report"]["as_at"]), iso_date(b["report"]["as_at"])
    year = lambda d: F.year(d) + (F.month(d) >= 7).cast("int")
    found += [F.when(a["entity_ref"] != b["entity_ref"], fault("$.entity_ref", "MISMATCH")), F.when(then >= now, fault("$.report.as_at", "ORDER"))]
    found.append(F.when((year(now) != year(then)) & (F.date_format(now, "MMdd") != F.date_format(then, "MMdd")), fault("$.report.as_at", "FINANCIAL_YEARS")))
    return both.select("file", F.explode(F.when(F.col("current_m").isNull() | F.col("prior_m").isNull(), some(*found[:2])).otherwise(some(*found))).alias("x")).select("file", "x.path", "x.code")


def request_issues(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """(file, path, code): review requests (accepted) whose policy isn't among policies (accepted), or doesn't allow their section."""
    p = policies.select(F.col("doc.policy_id").alias("policy_id"), F.col("doc.operations.trial_balance_variance.allowed_sections").alias("allowed"))
    r = requests.select("file", F.col("doc.policy_id").alias("policy_id"), F.col("doc.section").alias("section")).join(p, "policy_id", "left")
    code = F.when(F.col("allowed").isNull(), fault("$.policy_id", "UNKNOWN_POLICY")).when(~F.array_contains("allowed", F.col("section")), fault("$.section", "NOT_ALLOWED"))
    return r.select("file", code.alias("x")).where("x is not null").select("file", "x.path", "x.code")
