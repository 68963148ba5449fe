"""From raw documents to training sequences: quality rules, line dedup, n-gram Jaccard join, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of
documents. run() applies them in order, each written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm.common import cut, matching
from tallywork.llm.jaccard import jaccard_components
from tallywork.llm.linededup import dedup_lines
from tallywork.llm.packing import pack_documents
from tallywork.llm.quality import filter_documents

#: SQL has no form of winnowing, of components or of packing; the stages are tested against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts fail; null languages and sources are groups of their own; each of repeated rows is judged
    alike; an empty table stays empty. Other columns stay as they are, whatever their names."""
    return filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that repeat earlier runs; a document that loses all its words so goes. n_chars follows the text. Null and empty texts lose
    nothing and stay; rows equal in doc_id and text come out alike; other columns stay as they are, whatever their names."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # dedup_lines replaces columns named like its own
    cleaned = dedup_lines(docs.toDF(*own.values()), id_col=own["doc_id"], text_col=own["text"])
    text = F.col(own["text"])
    words = cleaned.where((F.col("n_removed") == 0) | text.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    words = words.withColumn(own["n_chars"], F.length(text).cast(docs.schema["n_chars"].dataType))
    return words.select(*[F.col(n).alias(c) for c, n in own.items()])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (four fifths of their five-word shingles in common, or more) the document with the smallest doc_id;
    rows that share a doc_id are one document. Null, empty and wordless texts are no duplicates of anything and stay; other columns stay as they are."""
    gone = cut(jaccard_components(docs).where("doc_id != component_id").select("doc_id").distinct(), "pipeline-copies")
    return matching(docs, gone, "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of at most 1024 tokens. Null and empty texts are the end id alone; each of repeated rows is packed."""
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
