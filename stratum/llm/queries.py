"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact_dedup, licences, mixing, ngram_join, quality_classifier, quality_rules, sharding, warc

SHARDS = 64
SEED = 20240229


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.apply(_table(spark, sf_dir, "documents"), SHARDS, SEED)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("row_key")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), round_trip=True).drop("text")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_files(_table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": ngram_join.sql(),
        "op3_sharding": sharding.sql(SHARDS, SEED),
        "op5_exact_dedup": exact_dedup.sql(),
        "op7_quality_rules": quality_rules.sql(),
        "op10_warc": warc.sql(),
    }
