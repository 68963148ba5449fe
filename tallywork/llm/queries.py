"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .bestfit import pack_best_fit
from .bpe import encode_documents
from .conversations import damage, repair_conversations
from .embeddings import link_embeddings
from .jaccard import jaccard_components
from .licenses import scan_licenses
from .linededup import dedup_lines
from .merkle import prove
from .packing import pack_documents
from .quality import judge_documents
from .sharding import shard_documents
from .tokencounts import count_section_tokens
from .urls import judge_urls

#: The rules of op5_url_filters: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = encode_documents(table(spark, sf_dir, "documents"), path, pattern, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"), "text")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the rank file holds the vocabulary of byte_bpe_50k.json, with the same ids
    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    spans = F.col("base_spans")
    return found.select(
        "doc_id", "n_words", F.size(spans).cast("long").alias("n_base"), F.array_min(spans).cast("long").alias("first_word"), F.array_max(spans).cast("long").alias("last_word"), "base_labels", "labels", "score"
    )


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), percent=90, size=3)


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(*damage(table(spark, sf_dir, "conversations")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return prove(table(spark, sf_dir, "documents"), tampered).drop("copied")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_byte_bpe, op2_sharding, op3_line_dedup, op4_quality_rules, op5_url_filters, op6_packing, op7_embedding_neardup, op8_token_counts, op9_license_scans, op10_ngram_jaccard, op11_best_fit, op12_conversation_repair, op13_merkle_manifest, pipeline)}


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return {"op4_quality_rules": sql.QUALITY, "op5_url_filters": sql.URLS.replace("{rules}", rules), "op7_embedding_neardup": sql.EMBEDDINGS, "op10_ngram_jaccard": sql.JACCARD, "op12_conversation_repair": sql.REPAIR, "op13_merkle_manifest": sql.MERKLE}
