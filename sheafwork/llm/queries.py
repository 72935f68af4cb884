"""The registered queries of the training-data operators: thin wrappers with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheafwork.llm import bpe, media, packing, pii, quality, sharding, simhash, unigram, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(_table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_report(_table(spark, sf_dir, "documents"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.language_id(_table(spark, sf_dir, "documents"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_digest(_table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(_table(spark, sf_dir, "documents"))


_ALL = (
    op1_simhash_near_dedup,
    op2_token_counts,
    op3_personal_data,
    op4_warc_round_trip,
    op5_language_id,
    op6_bpe_round_trip,
    op7_quality_rules,
    op8_best_fit_packing,
    op9_sharding,
    op10_media_columns,
)
QUERIES = {f.__name__: f for f in _ALL}

#: The other operators cannot be stated in SQL; tests/llm holds them against brute force, exact round trips or held-out accuracy.
ORACLE_SQL = {
    "op4_warc_round_trip": warc.ROUND_TRIP_SQL,
    "op7_quality_rules": "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ("
    + quality.REPORT_SQL.format(docs="documents")
    + ")",
    "op9_sharding": sharding.DIGEST_SQL,
}
