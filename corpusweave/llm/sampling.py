"""A bounded, repeatable sample of labelled rows, for fitting models on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labelled: DataFrame, rows: int, most_bytes: int) -> pa.Table:
    """docs(doc_id, text), labelled(doc_id, label) -> text, label: the first rows of each label in the order of a hash.

    ``rows`` bounds all labels together, ``most_bytes`` the text of a row; longer ones are not in the sample. Ids are
    chosen from the narrow table: a label's count tells below which hash its first rows lie (with room for six standard
    deviations), so ranking sees little more than is wanted, whatever part of all rows has one label. These at most
    ``rows`` ids (20 a label at least) are broadcast, and only their texts leave the scan.
    """
    known = labelled.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("s_id"), "label")
    counts = known.groupBy("label").agg(F.count("*").alias("n"))
    each = max(20, rows // max(counts.count(), 1))
    share = F.least(F.lit(1.0), F.lit(each + 6 * each ** 0.5 + 20) / F.col("n"))
    known = known.join(counts, "label").where(F.xxhash64("s_id") / float(2 ** 63) < 2 * share - 1).drop("n")
    order = Window.partitionBy("label").orderBy(F.xxhash64("s_id"), "s_id")
    chosen = known.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each)
    fit = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes))
    return fit.join(F.broadcast(chosen), fit["doc_id"] == chosen["s_id"]).select("label", "nth", "text").toArrow().sort_by([("nth", "ascending"), ("label", "ascending"), ("text", "ascending")])
