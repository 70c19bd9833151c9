"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_repair, decontaminate, exact_dedup, jump_shard, license_fuzzy, ngram_join, oracles, piece_codec, quality_gbdt, secret_scan, warc_zdict
from .shared import table

SHARDS = 8
#: A public model's file; the same path on every machine.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.format_chats(table(spark, sf_dir, "conversations"))


def op2_jump_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shard.assign(table(spark, sf_dir, "documents"), SHARDS)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digest(table(spark, sf_dir, "documents"), MODEL, keep_words=True)


def op7_warc_zdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_zdict.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbdt.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_license_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_fuzzy.scan(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_chat_repair, op2_jump_shard, op3_ngram_join, op4_secret_scan, op5_decontaminate,
    op6_piece_codec, op7_warc_zdict, op8_quality_gbdt, op9_license_fuzzy, op10_exact_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_jump_shard": oracles.OP2, "op3_ngram_join": oracles.OP3, "op5_decontaminate": oracles.OP5, "op7_warc_zdict": oracles.OP7, "op10_exact_dedup": oracles.OP10}
