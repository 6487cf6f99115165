"""The queries of this subpackage, over whole tables of a folder of Parquet files, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontamination, embedding_dedup, language_id, license_scan, ngram_join, packing, quality, sharding, url_filter
from .oracle import ORACLE_SQL  # noqa: F401


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.link(_table(spark, folder, "documents"), k=4, percent=85)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), tokenizer_path())


def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.link(_table(spark, folder, "embeddings"))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(_table(spark, folder, "pages"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(_table(spark, folder, "documents"))


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    calls, results, others = chat_format.from_conversations(_table(spark, folder, "conversations"))
    return chat_format.link(calls, results, chat_format.TOOLS, others).drop("result_turn")


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(_table(spark, folder, "documents"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.digest(decontamination.find(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(_table(spark, folder, "documents"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_join, op2_packing, op3_embedding_dedup, op4_url_filter, op5_language_id, op6_chat_format, op7_sharding, op8_decontamination, op9_license_scan, op10_quality)}
