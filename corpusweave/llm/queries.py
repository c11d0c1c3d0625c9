"""Queries of the training-data operators over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, language_id, mixing, near_dedup, quality_crf, quality_rules, sharding, suffix_dedup, token_files
from .sql import SQL
from .store import documents


def op1_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place_documents(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("matches")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir)).drop("rejected")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = token_files.write_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_files(files)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_passages(documents(spark, sf_dir))


def op8_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chat.format_pairs(chat.reply_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return done.select(F.col("pair_id").alias("conv_id"), F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", "chosen",
                       chat.spans_text(F.col("chosen_mask")).alias("chosen_mask"), "rejected", chat.spans_text(F.col("rejected_mask")).alias("rejected_mask"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), k=3, similarity=85)


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return SQL
