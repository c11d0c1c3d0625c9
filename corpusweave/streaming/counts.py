"""Daily page counts, batch and streaming (ST1-ST3, SNK5), and request limits (ST6)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RETENTION_DAYS = 90


def page_views(requests: DataFrame) -> DataFrame:
    """requests(ts, method, status, purpose, path) -> those that count, with day and page (ST1)."""
    fine = (F.col("method") == "GET") & F.col("status").isin(200, 304) & ~F.coalesce(F.lower("purpose").contains("prefetch"), F.lit(False))
    path = F.split_part("path", F.lit("?"), F.lit(1))
    page = F.when(path.startswith("/demo"), "demo").otherwise("app")
    return requests.where(fine).select(F.to_date("ts").alias("day"), page.alias("page"), "ts")


def daily(views: DataFrame) -> DataFrame:
    return views.groupBy("day").agg(F.count_if(F.col("page") == "app").alias("app"), F.count_if(F.col("page") == "demo").alias("demo"))


def retained(counts: DataFrame, today: str) -> DataFrame:
    """Days of the last 90 (ST2); malformed days are gone already, bad counts are 0 (ST3)."""
    good = lambda c: F.when(F.col(c) >= 0, F.col(c)).otherwise(F.lit(0)).cast("long")
    return counts.where(F.col("day").isNotNull() & (F.col("day") >= F.date_sub(F.lit(today).cast("date"), RETENTION_DAYS - 1))).select("day", good("app").alias("app"), good("demo").alias("demo"))


def report(counts: DataFrame) -> DataFrame:
    """Per day and in all (SNK5, A15): day null is the grand total."""
    return counts.rollup("day").agg(F.sum("app").cast("long").alias("app"), F.sum("demo").cast("long").alias("demo"), F.sum(F.col("app") + F.col("demo")).cast("long").alias("total"))


def stream_daily(views: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """A query that keeps each day's counts in a table of batches below ``path`` (ST1-ST3); ``stored_counts`` reads it.

    In update mode a batch brings the days it changed, and a day's state goes when the watermark, as long as the
    retention, passes it. A batch is written under its number, over itself if it is tried again, so each counts once;
    after a restart the checkpoint goes on. ``every`` is the time between batches (``5 seconds``); without it the
    query ends with what is there.
    """
    counted = (views.withWatermark("ts", f"{RETENTION_DAYS} days").groupBy(F.window("ts", "1 day"))
               .agg(F.count_if(F.col("page") == "app").alias("app"), F.count_if(F.col("page") == "demo").alias("demo"))
               .select(F.to_date("window.start").alias("day"), "app", "demo"))
    flow = counted.writeStream.outputMode("update").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    return flow.option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def stored_counts(spark: SparkSession, path: str) -> DataFrame:
    """day, app, demo: of each day what its last batch says."""
    rows = spark.read.schema("day date, app long, demo long, batch long").parquet(path)
    return rows.groupBy("day").agg(F.max_by(F.struct("app", "demo"), "batch").alias("c")).select("day", "c.app", "c.demo")


def admitted(requests: DataFrame, per_minute: int = 20) -> DataFrame:
    """requests(client, ts, id) -> id, allowed: a fixed window of so many requests a minute and client (ST6)."""
    from pyspark.sql import Window

    minute = F.date_trunc("minute", "ts")
    order = Window.partitionBy("client", "minute").orderBy("ts", "id")
    return requests.withColumn("minute", minute).withColumn("nth", F.row_number().over(order)).select("id", (F.col("nth") <= per_minute).alias("allowed"))


def bucket_admitted(requests: DataFrame, capacity: int = 8, per_second: int = 1) -> DataFrame:
    """requests(client, ts, id) -> id, allowed: a token bucket per client, full at first (ST6).

    A refusal depends on every request before it, so a client's requests are read in order, with one number kept
    between them: partitions are sorted and streamed, never held. Tokens are counted in millionths, so nothing is rounded.
    """
    one = 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, left, last = object(), 0, 0
        for batch in batches:
            allowed = []
            for who, at in zip(batch.column("client").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if who != client:
                    client, left, last = who, capacity * one, at
                left = min(capacity * one, left + (at - last) * per_second)
                last = at
                allowed.append(left >= one)
                left -= one if left >= one else 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(allowed, pa.bool_())], names=["id", "allowed"])

    rows = requests.select("client", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("id").cast("long").alias("id"))
    return rows.repartition("client").sortWithinPartitions("client", "at", "id").mapInArrow(run, "id long, allowed boolean")
