"""Checked reading of delimited files, and sinks (SRC3, SNK1-SNK3). Spark's committer makes every write whole or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str, schema: str, key: str, expected: int | None = None) -> DataFrame:
    """A tab-separated table with a header; raises unless ``key`` is unique and never null and, if given, the number of rows is ``expected``."""
    rows = spark.read.csv(path, schema=schema, sep="\t", header=True, quote="", mode="FAILFAST")
    n, known = rows.agg(F.count("*"), F.count_distinct(key)).first()
    if n != known or expected not in (None, n):
        raise ValueError(f"{n} rows, {known} different values of {key}, {expected} expected")
    return rows


def write_tsv(df: DataFrame, path: str) -> None:
    """Tabs, line ends and backslashes in text are not escaped: a value that has one fails the write."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    bad = F.lit(False)
    for c in text:
        bad |= F.coalesce(F.col(c).rlike(r"[\t\r\n\\]"), F.lit(False))
    fine = df.withColumns({c: F.when(bad, F.raise_error(F.lit("a value holds a separator")).cast("string")).otherwise(F.col(c)) for c in text}) if text else df
    fine.write.csv(path, sep="\t", header=True, quote="")


def write_json(df: DataFrame, path: str, key: str | None = None, compressed: bool = False) -> None:
    """Lines of JSON; with ``key`` a folder for each of its values."""
    to = df.write.option("compression", "gzip" if compressed else "none")
    (to.partitionBy(key) if key else to).json(path)


def hashed_name(stem: Column, content: Column, extension: str) -> Column:
    """``stem.<12 hex digits of the content's SHA-256>.extension``; null content counts as empty (SNK3)."""
    return F.concat(stem, F.lit("."), F.substring(F.sha2(F.coalesce(content, F.lit("")), 256), 1, 12), F.lit(f".{extension}"))
