"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``; the last adds ``shard`` and ``virtual_slot``.

Every stage gives an empty result for an empty table, passes columns of any name through (the last replaces ``shard`` and
``virtual_slot``), and reads whole texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusweave.llm import decontaminate, language_id, mixing, near_dedup, sharding
from corpusweave.llm.store import materialize


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score that is not rejected. Texts that are null, empty or without a letter are rejected; repeated rows share a verdict."""
    return language_id.accepted(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more: the one of least doc_id, null
    being the largest, and of repeated rows one. Texts without words are linked with nothing and stay."""
    return near_dedup.deduplicated(docs, k=5, similarity=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of 13 words of a benchmark item, and with less than 5 % of words from items shorter than that.
    Texts without words stay; repeated rows share a verdict."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them: not at all, once or twice. Null sources are one source;
    a text without words goes with its block; repeated rows are taken like any others."""
    return mixing.mixed_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their shard. A null text has the size of its frame; a null doc_id is placed by its text."""
    return sharding.assign_shards(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", keep_one_of_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", assign_shards),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
