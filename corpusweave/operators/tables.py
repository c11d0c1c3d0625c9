"""Written tables in the shared folder, and places in an order that no single task makes."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_registered: set[str] = set()


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the session's ``spark.checkpoint.dir``, in a local folder only where that is unset and the session is local; all go when the driver ends."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="corpusweave-")
        spark.sparkContext.setCheckpointDir(top)
    top = f"{top.rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    if top not in _registered:
        _registered.add(top)
        atexit.register(_forget, spark, top)
    return f"{top}/{tag}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, tag: str = "table") -> DataFrame:
    """``df`` computed once, written and read back: lineage ends here, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Parts:
    """A table that grows part by part in the shared folder: what is written is never written again."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.top, self.paths = spark, new_path(spark, tag), []

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        self.schema = df.schema
        self.paths.append(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def in_ranges(rows: DataFrame, by: str, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows dealt to ranges of ``by`` (column ``part``), and part, n, before: the rows (or sum of ``weight``) in it and in all ranges before.

    The ranges are written, as they come from a sample and must not be drawn anew; the running sum is over one row a range.
    """
    dealt = cut(rows.repartitionByRange(by).withColumn("part", F.spark_partition_id()), "ranges")
    size = dealt.groupBy("part").agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return dealt, size.withColumn("before", F.coalesce(before, F.lit(0)))
