"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; its result is written as Parquet and read again as the next one's
docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import byte_bpe, decontaminate, line_dedup, quality_rules, simhash
from causeway.llm.common import drop_path, written
from causeway.llm.queries import digest


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail; ``n_chars`` follows the text."""
    return quality_rules.clean(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of windows that stand before; ``n_chars`` follows the text."""
    return line_dedup.drop_repeated_lines(docs).select(docs.columns).withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of them and of the bytes they decode to."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(docs, vocabulary, public_tokenizers.PATTERN)
    return digest(byte_bpe.decode(ids, vocabulary, public_tokenizers.PATTERN))


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("simhash_near_dedup", near_duplicate_stage), ("decontaminate", benchmark_stage), ("byte_bpe", encoding_stage)]

#: SQL can express neither fingerprints nor alignment; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            drop_path(spark, before)
        before = docs._scratch_path
    return docs
