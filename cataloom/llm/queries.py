"""Queries opN_<name>: every operator over its whole table, with production parameters; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_cnn, decontam, hilbert, line_crf, quotes, secret_scan, simhash, token_counts, warc

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.ordered(_read(spark, sf_dir, "documents"))


def op2_byte_pair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return bpe.tokenize(docs.select("doc_id", "text"), bpe.Vocabulary.read()).select("doc_id", "tokens", "n_tokens", "exact")


def op3_entropy_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.findings(_read(spark, sf_dir, "documents"))


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.threads(quotes.quoted_conversations(_read(spark, sf_dir, "conversations")))


def op5_warc_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve(warc.captures_of_pages(_read(spark, sf_dir, "pages")))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return byte_cnn.identify(docs, byte_cnn.fit(docs))


def op8_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return line_crf.retained(docs, line_crf.fit(docs, _read(spark, sf_dir, "labels")))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every prefix; besides, what fits the usual context of 512 tokens and what 1,000 characters cost, read from the steps."""
    own = token_counts.counts(_read(spark, sf_dir, "documents"), bpe.Vocabulary.read())
    return own.withColumns({"chars_in_512_tokens": token_counts.within(F.col("steps"), 512), "tokens_in_1000_chars": token_counts.count_at(F.col("steps"), 1000)})


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_hilbert_sharding": hilbert.sql(), "op4_quotation_linking": quotes.sql(), "op5_warc_revisit_resolution": warc.sql(), "op6_benchmark_decontamination": decontam.sql()}
