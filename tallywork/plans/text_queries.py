"""Queries of pseudonymisation over documents and conversations, and of a file round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ABN_WEIGHTS, ACN_WEIGHTS, MEDICARE_WEIGHTS, TFN_WEIGHTS
from ..operators import numbers, redact
from ..sources import readers, writers
from ..sources.staging import new_path, staged
from .derive import TB_SQL, in_cents, table, tb

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


#: An entity map: value, placeholder, kind.
ENTITIES = [("the and", "CLIENT_01", "CLIENT"), ("und der", "CLIENT_02", "CLIENT"), ("of the", "CLIENT_03", "CLIENT")]


def _sum(weights: tuple[int, ...], less: int = 0) -> str:
    return "(" + " + ".join(f"(CAST(substr(d, {i + 1}, 1) AS INT) - {less if i == 0 else 0}) * {w}" for i, w in enumerate(weights)) + ")"


VALUES_SQL = "x AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for k, (p, _) in redact.PATTERNS.items()) + "), named AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}', 1)) AS value FROM documents" for k, p in redact.LABELLED.items()) + "), v AS (SELECT *, replace(replace(value, ' ', ''), '-', '') AS d FROM x)"
VALID_SQL = f"CASE kind WHEN 'ABN' THEN {_sum(ABN_WEIGHTS, 1)} % 89 = 0 WHEN 'TFN' THEN {_sum(TFN_WEIGHTS)} % 11 = 0 WHEN 'ACN' THEN (10 - {_sum(ACN_WEIGHTS)} % 10) % 10 = CAST(substr(d, 9, 1) AS INT) WHEN 'MEDICARE' THEN {_sum(MEDICARE_WEIGHTS)} % 10 = CAST(substr(d, 9, 1) AS INT) ELSE true END"


#: A text and what is found in it: kind, value, line.
SPLITS = [
    ("123 / 456 / 782", ("SPLIT_NUMBER", "123 / 456 / 782", 1)), ("123,   456,   782", ("SPLIT_NUMBER", "123,   456,   782", 1)), ("123; 456; 782", ("SPLIT_NUMBER", "123; 456; 782", 1)), ("(123) (456) (782)", ("SPLIT_NUMBER", "123) (456) (782", 1)),
    ("| 123 | 456 | 782 |", ("SPLIT_NUMBER", "123 | 456 | 782", 1)), ("123~~456~~782", ("SPLIT_NUMBER", "123~~456~~782", 1)), ("123&nbsp;456&nbsp;782", ("SPLIT_NUMBER", "123&nbsp;456&nbsp;782", 1)), ("123&#160;456&#160;782", ("SPLIT_NUMBER", "123&#160;456&#160;782", 1)), ("123&456&782;", ("SPLIT_NUMBER", "123&456&782", 1)),
    ("<td>123</td><td>456</td><td>782</td>", ("SPLIT_NUMBER", "123</td><td>456</td><td>782", 1)), ("9123   456   782", ("SPLIT_NUMBER", "9123   456   782", 1)), ("951   824   753   556", ("SPLIT_NUMBER", "951   824   753   556", 1)), ("1. 63   095   645   545", ("SPLIT_NUMBER", "1. 63   095   645   545", 1)),
    ("Notes\n123   456\n782", ("SPLIT_NUMBER", "123   456\n782", 2)), ("51 824\n753557. next", None), ("TFN: 1234.56   782", ("SPLIT_NUMBER", "1234.56   782", 1)), ("1234.56   782 (TFN)", ("SPLIT_NUMBER", "1234.56   782", 1)), ("T<span>F</span>N: 1234.56   782", ("SPLIT_NUMBER", "1234.56   782", 1)), ("tax<br>file number 1234.56   782", ("SPLIT_NUMBER", "1234.56   782", 1)),
    ("$1234.56   $782.00", None), ("| 1234.56 | 782.00 |", None), ("1234.56\n782.00", None), ("1234 5678", ("LONG_NUMBER", "1234 5678", 1)), ("15/03/2024 12345678", ("LONG_NUMBER", "12345678", 1)), ("2024-03-15", None), ("$12,345,678.90", None),
    ("Account number 123456", ("ACCOUNT_NUMBER", "123456", 1)), ("a\n\nAcct: 123 456", ("ACCOUNT_NUMBER", "123 456", 3)), ("A/C # 1234567", ("ACCOUNT_NUMBER", "1234567", 1)), ("ref 123456", None), ("TFN 123 456\n782. Next", ("LIST_MARKER", "123 456\n782", 1)), ("12345 678\nAa Ct", ("ADDRESS_NUMBER", "12345 678", 1)),
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"WITH {VALUES_SQL} SELECT doc_id, kind, value FROM v WHERE {VALID_SQL} UNION ALL SELECT doc_id, kind, value FROM named")
def identifier_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E01 as values, V20, V21: in Catalyst only."""
    return redact.identifier_values(documents(spark, sf_dir))


@query()
def identifier_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with placeholders."""
    return redact.placeholders(redact.structured_spans(documents(spark, sf_dir))).select("doc_id", "kind", "start", "end", "placeholder")


@query()
def replacement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements of all kinds, those of the entity map too."""
    return redact.redact(documents(spark, sf_dir), ENTITIES)[2]


@query()
def residual_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What halts a document after replacement."""
    return redact.redact(documents(spark, sf_dir), ENTITIES)[1].select("doc_id", "kind", "value", "line", "n")


@query()
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that may go out."""
    return redact.redact(documents(spark, sf_dir), ENTITIES)[0].select("doc_id", "text")


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("WITH c(i, kind, value, line) AS (VALUES " + ", ".join(f"({i}, '{x[0]}', {_sql_text(x[1])}, {x[2]})" for i, (_, x) in enumerate(SPLITS) if x) + f") SELECT doc_id, kind, value, line FROM documents JOIN c ON doc_id % {len(SPLITS)} = i")
def split_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's letters behind a planted number, split, wrapped, marked up, beside money or a label, a list marker, before an address, or none."""
    cases = spark.createDataFrame([(i, t, (x or ("", "", 0))[0]) for i, (t, x) in enumerate(SPLITS)], "i int, planted string, wanted string")
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\p{N}#&<>]", "")  # nothing of its own is found, but for addresses
    d = documents(spark, sf_dir).withColumn("i", (F.col("doc_id") % len(SPLITS)).cast("int")).join(F.broadcast(cases), "i")  # a declared list
    # a full stop ends the planted number: else letters such as "St St" would make it a house number
    planted = d.select("doc_id", F.concat("planted", F.lit("\n\n.\n"), letters).alias("text"))
    found = numbers.find_numbers(planted, redact.RESIDUAL["ADDRESS"])
    address = F.when(F.col("kind") == "LONG_NUMBER", F.col("doc_id") % len(SPLITS) != len(SPLITS) - 1).otherwise(True)  # the last case is both
    return found.where(address).select("doc_id", "kind", "value", "line")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'MISSING' WHEN doc_id % 7 = 0 THEN 'CHANGED' ELSE 'SAME' END AS state FROM documents")
def disclosure_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records against texts of which some are gone or changed."""
    d = documents(spark, sf_dir)
    later = d.where("doc_id % 5 <> 0").withColumn("text", F.concat("text", F.when(F.col("doc_id") % 7 == 0, "x").otherwise("")))
    return redact.recheck(redact.disclosure(d, "0" * 64, "reviewer", "sent"), later)


@query("SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations")
def restored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations after replacement and restoring are as before."""
    d = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    spans = redact.placeholders(redact.structured_spans(d))
    # a value's first spelling comes back, so values that differ in spacing alone are left as they are
    w = spans.groupBy("doc_id", "placeholder").agg(F.min("value").alias("value"), F.max("value").alias("other")).where("value = other")
    exact = spans.join(w.select("doc_id", "placeholder"), ["doc_id", "placeholder"], "left_semi")
    return redact.restore(redact.replace_spans(d, exact), w).select("doc_id", "text")


@query("SELECT doc_id, CAST(0 AS BIGINT) AS n_left FROM documents")
def verify_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers left in each redacted text: none."""
    d = documents(spark, sf_dir)
    done = redact.replace_spans(d, redact.placeholders(redact.structured_spans(d)))
    left = redact.verify(done, redact.placeholders(redact.structured_spans(d)).select("doc_id", "placeholder")).where("issue = 'IDENTIFIER_LEFT'").groupBy("doc_id").agg(F.count("*").alias("n"))
    return d.join(left, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_left"))


def _round_trip(spark: SparkSession, balances: DataFrame) -> DataFrame:
    path = new_path(spark, "trial-balance-files")
    writers.export_trial_balance(balances, path)
    accepted, _ = readers.read_csv(spark, f"{path}/*", readers.TB)
    return accepted.select("tenant", "report_date", "account_id", in_cents("ytd_debit").alias("ytd_debit"), in_cents("ytd_credit").alias("ytd_credit"))


@query(f"WITH {TB_SQL} SELECT tenant, report_date, account_id, greatest(ytd, 0) AS ytd_debit, greatest(-ytd, 0) AS ytd_credit FROM tb")
def all_trial_balance_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trial balances of every tenant and date written as canonical CSV, a folder each, and read again under guards."""
    return _round_trip(spark, tb(spark, sf_dir))


# -- pseudonymisation from end to end ----------------------------------------------------------------------------------

#: A planted text, what goes out for it (None: it halts), and what comes back.
PLANTED = [
    ("Pay 51 824 753 556 and 51824753556 now", "Pay ABN_01 and ABN_01 now", "Pay 51 824 753 556 and 51 824 753 556 now"), ("mail a.b@c.example.com, x@y.example.org, a.b@c.example.com", "mail EMAIL_01, EMAIL_02, EMAIL_01", "mail a.b@c.example.com, x@y.example.org, a.b@c.example.com"),
    ("TFN 123 456 782, ABN 51 824 753 556", "TFN TFN_01, ABN ABN_01", "TFN 123 456 782, ABN 51 824 753 556"), ("for acme *PTY*\nltd and acme", "for CLIENT_01 and CLIENT_02", "for acme *PTY*\nltd and acme"), ("call (02) 1234 5678 or 063-000", "call PHONE_01 or BSB_01", "call (02) 1234 5678 or 063-000"),
    ("ABN: 51 824 753 557", "ABN: ABN_01", "ABN: 51 824 753 557"), ("plain words", "plain words", "plain words"), ("<td>123</td><td>456</td><td>782</td>", None, None), ("met Jane Citizen", None, None), ("carried ABN_01", None, None), ("born 3 June 1980", None, None), ("at 12 Smith Court", None, None),
    ("Straße AG paid", "CLIENT_03 paid", "Straße AG paid"), ("STRASSE ag paid", "CLIENT_03 paid", "STRASSE ag paid"),
]
MAP = [("Acme Pty Ltd", "CLIENT_01", "CLIENT"), ("Acme", "CLIENT_02", "CLIENT"), ("Straße AG", "CLIENT_03", "CLIENT")]
#: Letters of a document in which nothing is found, and the same as SQL.
LETTERS = r"[^a-zéèêçñäöüßáíóúà ]"
LETTERS_SQL = f"regexp_replace(lower(coalesce(text, '')), '{LETTERS}', '', 'g')"


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(PLANTED)], "i int, planted string")
    d = documents(spark, sf_dir).withColumn("i", (F.col("doc_id") % len(PLANTED)).cast("int")).join(F.broadcast(cases), "i")  # a declared list
    made = d.select("doc_id", F.concat("planted", F.lit("\n\n"), F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), LETTERS, "")).alias("text"))
    return staged(made, "planted")  # a redaction reads it four times


def _cases(which: int) -> str:
    return "c(i, t) AS (VALUES " + ", ".join(f"({i}, {_sql_text(x[which])})" for i, x in enumerate(PLANTED) if x[which]) + ")"


@query(f"WITH {_cases(1)} SELECT doc_id, t || chr(10) || chr(10) || {LETTERS_SQL} AS text FROM documents JOIN c ON doc_id % {len(PLANTED)} = i")
def planted_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's letters behind a planted text; what goes out, with placeholders in order and halted documents left out."""
    return redact.redact(_planted(spark, sf_dir), MAP)[0].select("doc_id", "text")


@query(f"WITH c(i, kind, value, line) AS (VALUES (7, 'SPLIT_NUMBER', '123</td><td>456</td><td>782', 1), (8, 'PERSON', 'Jane Citizen', 1), (9, 'PLACEHOLDER', 'ABN_01', 1), (10, 'DATE', '3 June 1980', 1), (11, 'ADDRESS', '12 Smith Court', 1), (11, 'PERSON', 'Smith Court', 1)) SELECT doc_id, kind, value, line, CAST(1 AS BIGINT) AS n FROM documents JOIN c ON doc_id % {len(PLANTED)} = i WHERE value <> 'Smith Court'")
def planted_halts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What halts the planted documents, once a value and line."""
    return redact.redact(_planted(spark, sf_dir), MAP)[1].select("doc_id", "kind", "value", "line", "n")


#: Replacements of a planted text by kind.
COUNTED = [(0, "ABN", 2), (1, "EMAIL", 3), (2, "TFN", 1), (2, "ABN", 1), (3, "CLIENT", 2), (4, "PHONE", 1), (4, "BSB", 1), (5, "ABN", 1), (12, "CLIENT", 1), (13, "CLIENT", 1)]


@query("WITH c(i, kind, n) AS (VALUES " + ", ".join(f"({i}, '{k}', {n})" for i, k, n in COUNTED) + f") SELECT doc_id, kind, CAST(n AS BIGINT) AS n FROM documents JOIN c ON doc_id % {len(PLANTED)} = i")
def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements by document and kind, identifiers of every kind and the entity map's."""
    return redact.redact(_planted(spark, sf_dir), MAP)[2].select("doc_id", "kind", "n")


@query(f"WITH {_cases(2)} SELECT doc_id, t || chr(10) || chr(10) || {LETTERS_SQL} AS text FROM documents JOIN c ON doc_id % {len(PLANTED)} = i")
def planted_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of what went out are replaced by their first values again, those of identifiers and of the map."""
    d = _planted(spark, sf_dir)
    own, once, named = redact.replacements(d, MAP)
    first = lambda spans: spans.groupBy("doc_id", "placeholder").agg(F.min_by("value", "start").alias("value"))
    return redact.restore(redact.redacted(d, own, once, named)[0], first(own).unionByName(first(named))).select("doc_id", "text")


@query(f"WITH {_cases(1)}, k AS (SELECT doc_id FROM documents JOIN c ON doc_id % {len(PLANTED)} = i) SELECT doc_id, 'IDENTIFIER_LEFT' AS issue, '51 824 753 556' AS value FROM k WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'UNKNOWN_PLACEHOLDER', 'CLIENT_77' FROM k WHERE doc_id % 5 = 0")
def planted_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers and unknown placeholders that were put into redacted texts are all found, and nothing else."""
    d = _planted(spark, sf_dir)
    own, once, named = redact.replacements(d, MAP)
    leak = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "\nsee 51 824 753 556").otherwise(""), F.when(F.col("doc_id") % 5 == 0, "\nof CLIENT_77").otherwise(""))
    known = own.select("doc_id", "placeholder").unionByName(named.select("doc_id", "placeholder")).distinct()
    return redact.verify(redact.redacted(d, own, once, named)[0].withColumn("text", leak), known).select("doc_id", "issue", "value")


INTERVALS_SQL = "s AS (SELECT user_id AS doc_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) // 600 AS a, CAST(floor(epoch(ts)) AS BIGINT) // 600 + 1 + event_id % 9 AS b, event_id % 3 AS priority FROM events)"


@query(f"""WITH RECURSIVE {INTERVALS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, b DESC, priority, event_id) AS n FROM s),
  kept(doc_id, n, a, b, event_id, taken, upto) AS (SELECT doc_id, n, a, b, event_id, true, b FROM o WHERE n = 1 UNION ALL
    SELECT o.doc_id, o.n, o.a, o.b, o.event_id, o.a >= k.upto, CASE WHEN o.a >= k.upto THEN o.b ELSE k.upto END FROM kept k JOIN o ON o.doc_id = k.doc_id AND o.n = k.n + 1)
  SELECT doc_id, a AS "start", b AS "end" FROM kept WHERE taken""")
def arbitrated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans of ten minutes and more of their user; of those that overlap the earliest, then the longest, stays."""
    e = table(spark, sf_dir, "events").withColumn("slot", F.expr("unix_timestamp(ts) div 600"))
    spans = e.select(F.col("user_id").alias("doc_id"), F.col("slot").alias("start"), (F.col("slot") + 1 + F.col("event_id") % 9).alias("end"), (F.col("event_id") % 3).alias("priority"), F.lit("EVENT").alias("kind"), F.col("event_id").cast("string").alias("value"), F.lit(1).alias("line"))
    return redact.arbitrate(spans).select("doc_id", "start", "end")


@query(f"""WITH {INTERVALS_SQL.replace("event_id,", "event_id, event_type,", 1)}, f AS (SELECT *, min(a) OVER (PARTITION BY doc_id, event_type) AS first FROM s), v AS (SELECT doc_id, event_type, min(first) AS first FROM f GROUP BY ALL),
  k AS (SELECT doc_id, event_type, row_number() OVER (PARTITION BY doc_id ORDER BY first, event_type) AS n, count(*) OVER (PARTITION BY doc_id, first) AS same FROM v)
  SELECT doc_id, a AS "start", dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS n FROM f""")
def placeholder_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value's number is that of its first appearance among its document's values."""
    e = table(spark, sf_dir, "events")
    spans = e.select(F.col("user_id").alias("doc_id"), F.expr("unix_timestamp(ts) div 600").alias("start"), F.lit("EVENT").alias("kind"), F.col("event_type").alias("value"))
    return redact.placeholders(spans).select("doc_id", "start", F.regexp_extract("placeholder", r"\d+$", 0).cast("long").alias("n"))
