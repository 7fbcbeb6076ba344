"""Registered queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import alignment, byte_bpe, common, decontaminate, licenses, line_dedup, quality_classifier, quality_rules, resampling, simhash, suffix_tree, topk, url_filter, wavelet
from causeway.llm.oracles import ORACLE_SQL  # noqa: F401

#: The end id that follows each document in operator 2's files.
END_ID = 2
#: The rules of operator 4's query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("clean_text")


def op2_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch_path(spark, "wavelet")
    wavelet.write_shards(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), END_ID, added_tokens=True)
    out = common.written(wavelet.read_shards(spark, folder).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "wavelet-digests")
    common.drop_path(spark, folder)
    return out


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.apply_rules(_table(spark, sf_dir, "pages"), rules)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, _table(spark, sf_dir, "labels"), common.crc32_of_id(F.col("id")) % 5 != 0)
    return quality_classifier.score(docs, model).select("doc_id", (common.crc32_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), figures=("n_lines", "n_removed")).select("doc_id", "n_lines", "n_removed", "text")


def op7_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = common.crc32_of_id(F.col("doc_id")) % 10 != 0
    out = suffix_tree.score(_table(spark, sf_dir, "documents"), training)
    return out.select("doc_id", (~F.col("in_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(_table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return digest(byte_bpe.decode(ids, vocabulary, public_tokenizers.PATTERN))


def digest(decoded: DataFrame) -> DataFrame:
    """Digests of encoded and decoded texts."""
    return decoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_copies(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree.

    A document is ``source/lang/<doc_id>.txt``.  Short documents are the
    licence files of the directories: ``source/lang/LICENSE-<doc_id>`` up to
    60 words, ``source/LICENSE-<doc_id>`` up to 30.
    """
    words = F.size(common.words_of(F.col("text")))
    name = F.concat(F.lit("LICENSE-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    path = F.when(words <= 30, F.concat_ws("/", "source", name)).when(words <= 60, F.concat_ws("/", "source", "lang", name)).otherwise(F.concat_ws("/", "source", "lang", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))))
    files = _table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan(files).drop("text")


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest_of = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep={"groups_sha256": digest_of})


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.draw(resampling.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))).drop("n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_wavelet_shards, op3_simhash_near_dedup, op4_url_filter, op5_quality_classifier, op6_line_dedup, op7_suffix_tree_lm, op8_byte_bpe, op9_decontaminate, op10_license_scan, op11_top_k, op12_token_alignment, op13_resampling)
}
