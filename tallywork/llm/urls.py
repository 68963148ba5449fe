"""URL rules by hashed host-suffix and path-prefix expressions, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a digest that are compared before the whole digest.
SHORT = 4


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path): between the first :// and /, ?, # or the end, A-Z in lower case; then up to ?, # or the end. Null or no ://: both empty."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of pages; rules: (host, path, verdict), a host without a leading dot.

    A rule fits its host and all subdomains if the path starts with its path (compared as given). Of several, the one with the longest
    host and path together wins, then the longer host, then block over allow. Without a rule, rule is null and verdict the default (the
    list blocks nothing it doesn't name). Null urls have empty host and path. Rules with a null host, path or verdict fit nothing.
    Repeated rows are each returned; an empty table gives no rows; other columns of pages are ignored, whatever their names; a very long
    url is expanded like any other.

    Each URL is expanded to its host's suffixes; where one is a rule's host, to its path's prefixes of the lengths that this host's rules
    have, be they few or many. The SHA-256 of each expression is joined by its first bytes, then compared as a whole. Hosts and rules are
    broadcast if few, else joined by a shuffle; matches of a URL meet again by row.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    digest = lambda text: F.unhex(F.sha2(text, 256))
    listed = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("listed")).dropna().distinct()
    listed = listed.withColumn("full", digest(F.concat("rule_host", F.lit("\n"), "rule_path"))).withColumn("short", F.substring("full", 1, SHORT))
    hosts = listed.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    hosts = hosts.select("lengths", digest(F.col("rule_host")).alias("full")).withColumn("short", F.substring("full", 1, SHORT))

    labels = F.split("host", "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    seen = rows.select("*", F.explode(F.array_distinct(suffixes)).alias("suffix")).withColumn("digest", digest(F.col("suffix"))).withColumn("start", F.substring("digest", 1, SHORT))
    known = seen.join(bounded(hosts), F.col("start") == F.col("short"), "left")
    fitting = F.when(F.col("digest") == F.col("full"), F.filter("lengths", lambda n: n <= F.length("path")))
    tried = known.select("page_id", "host", "path", "row", "suffix", F.explode_outer(fitting).alias("n"))
    tried = tried.withColumn("digest", digest(F.concat("suffix", F.lit("\n"), F.expr("substring(path, 1, n)")))).withColumn("start", F.substring("digest", 1, SHORT))
    found = tried.join(bounded(listed), F.col("start") == F.col("short"), "left")
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.length("rule_host").alias("h"), F.col("listed").alias("listed"), F.concat("rule_host", "rule_path").alias("rule"))
    best = found.groupBy("page_id", "host", "path", "row").agg(F.max(F.when(F.col("digest") == F.col("full"), rank)).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.listed", F.lit(default)).alias("verdict"))
