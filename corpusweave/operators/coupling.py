"""Rarity-weighted coupling of families by the works they share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import cut, in_ranges

#: Ids in a list of a work's families; pairs counted by one task, and at once.
LIST, PAIRS_PER_TASK, PAIRS_AT_ONCE = 512, 1 << 22, 1 << 20


def weights(edges: DataFrame, families: DataFrame) -> DataFrame:
    """edges(family, work), families(family) -> work, df, idf; families without works count too."""
    df = edges.select("family", "work").distinct().groupBy("work").agg(F.count("*").alias("df"))
    n = families.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("work", "df", (1 + F.log((F.col("n") + 1) / (F.col("df") + 1))).alias("idf"))


def weighted_edges(edges: DataFrame, families: DataFrame) -> DataFrame:
    """Distinct edges with their work's weight and frequency, written once: both sides of the self-join and the norms read them."""
    once = cut(edges.select("family", "work").distinct(), "edges")
    return cut(once.join(weights(once, families), "work").select("family", "work", "idf", "df"), "weights")


def _counted(rows: pa.Table, norms: tuple[np.ndarray | pa.Array, np.ndarray], k: int | None) -> pa.Table:
    """fa, fb, shared, score from rows(fa, idf, near) of whole families; with ``k`` only pairs as good as a family's k-th score, ties included."""
    fa, near = rows.column("fa").combine_chunks().dictionary_encode(), rows.column("near").combine_chunks()
    fb = near.flatten().dictionary_encode()
    long, wide = pc.list_value_length(near).to_numpy(), max(1, len(fb.dictionary))
    key = np.repeat(fa.indices.to_numpy().astype(np.int64), long) * wide + fb.indices.to_numpy()
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    shared, dot = np.diff(np.r_[first, len(key)]), np.add.reduceat(np.repeat(rows.column("idf").to_numpy() ** 2, long)[order], first) if len(key) else np.zeros(0)
    a, b = np.divmod(key[first], wide)
    at = lambda found: norms[1][np.searchsorted(norms[0], found.to_numpy()) if isinstance(norms[0], np.ndarray) else pc.index_in(found, norms[0]).to_numpy()]
    score = np.floor(dot / (at(fa.dictionary)[a] * at(fb.dictionary)[b]) * shared / (shared + 2) * 1e6 + 0.5) / 1e6
    if k:
        begins = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else ()
        keep = np.ones(len(a), bool)
        for i, j in zip(begins, [*begins[1:], len(a)], strict=True):
            if j - i > k:
                keep[i:j] = score[i:j] >= np.partition(score[i:j], j - i - k)[j - i - k]
        a, b, shared, score = a[keep], b[keep], shared[keep], score[keep]
    return pa.table({"fa": fa.dictionary.take(pa.array(a)), "fb": fb.dictionary.take(pa.array(b)).cast(fa.dictionary.type), "shared": shared, "score": score})


def _meetings(edges: DataFrame, families: DataFrame, k: int | None = None) -> DataFrame:
    """fa, fb, shared, score for every pair with a common work, fa < fb; with ``k`` in either direction and as ``_counted`` keeps them.

    Each family of a work goes, with the list of the work's others, to the task of its own id, which counts all its pairs:
    so no pair is shuffled, only lists of bare ids. Lists have about ``LIST`` ids, however common a work, and the tasks are
    as many as their pairs ask for. Norms, a number for each family, are sent to all.
    """
    w = weighted_edges(edges, families)
    total, low, high = w.agg(F.coalesce(F.sum(F.col("df") - 1), F.lit(0)), F.min("family"), F.max("family")).first()
    kind = w.schema["family"].dataType
    short = isinstance(kind, T.LongType) and total > 0 and -1 << 31 <= low and high < 1 << 31
    norm = w.where("family IS NOT NULL").groupBy("family").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm")).toArrow().sort_by("family")
    ids = norm.column("family").combine_chunks()
    sent = w.sparkSession.sparkContext.broadcast((ids.to_numpy() if pa.types.is_integer(ids.type) else ids, norm.column("norm").to_numpy()))
    tasks = max(1, -(-total // (PAIRS_PER_TASK * (1 if k else 2))))
    dealt = w.repartition(tasks, "work")
    near = F.col("family").cast("int") if short else F.col("family")
    lists = dealt.groupBy("work", F.pmod(F.xxhash64("family"), F.ceil(F.col("df") / LIST)).alias("part")).agg(F.collect_list(near).alias("near")).select("work", "near")
    met = dealt.where("df > 1").select(F.col("family").alias("fa"), "work", "idf").join(lists.hint("merge"), "work")
    other = lambda x: x != F.col("fa") if k else x > F.col("fa")
    met = met.select("fa", "idf", F.filter("near", other).alias("near")).where(F.size("near") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = [], 0
        for batch in batches:
            held.append(batch)
            ids += len(batch.column("near").flatten())
            if ids < PAIRS_AT_ONCE:
                continue
            rows = pa.Table.from_batches(held)
            last = rows.num_rows - int(pc.sum(pc.equal(rows.column("fa"), rows.column("fa")[-1])).as_py())  # the last family may go on
            if last:
                yield from _counted(rows.slice(0, last), sent.value, k).to_batches(max_chunksize=100_000)
                held = rows.slice(last).to_batches()
                ids = sum(len(b.column("near").flatten()) for b in held)
        if held:
            yield from _counted(pa.Table.from_batches(held), sent.value, k).to_batches(max_chunksize=100_000)

    out = T.StructType([T.StructField("fa", kind), T.StructField("fb", kind), T.StructField("shared", T.LongType()), T.StructField("score", T.DoubleType())])
    return met.repartition(tasks, "fa").sortWithinPartitions("fa").mapInArrow(run, out)


def pairs(edges: DataFrame, families: DataFrame) -> DataFrame:
    """fa < fb, shared, score for every pair with a common work (C4-C6). An equi-join on the work: pairs without one never arise."""
    return _meetings(edges, families)


def nearest(edges: DataFrame, families: DataFrame, k: int = 8) -> DataFrame:
    """``neighbors`` of all pairs: the task that counts a family's pairs leaves out those below its k-th score."""
    return _ranked(_meetings(edges, families, k).withColumnsRenamed({"fa": "family", "fb": "neighbor"}), k)


def _ranked(both: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("family").orderBy(F.desc("score"), F.desc("shared"), "neighbor")
    return both.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def neighbors(scored: DataFrame, k: int = 8) -> DataFrame:
    """Both directions, ranked by score, shared count and id."""
    both = scored.select(F.col("fa").alias("family"), F.col("fb").alias("neighbor"), "shared", "score").unionAll(
        scored.select(F.col("fb").alias("family"), F.col("fa").alias("neighbor"), "shared", "score"))
    return _ranked(both, k)


def isolates(edges: DataFrame, families: DataFrame, scored: DataFrame | None = None, gap: float = 0.13) -> DataFrame:
    """Families without a neighbour and their place in the row below the map.

    Without ``scored`` pairs, the linked are the families of a work that another has as well: no pair need be made.
    """
    if scored is None:
        once = edges.select("family", "work").distinct()
        linked = once.join(once.groupBy("work").count().where("count > 1"), "work", "left_semi").select("family").distinct()
    else:
        linked = scored.select(F.col("fa").alias("family")).union(scored.select(F.col("fb").alias("family"))).distinct()
    alone = families.join(linked, "family", "left_anti")
    # Their number can be large: places come from a range sort with per-range offsets rather than from one window.
    by, ranges = in_ranges(alone, "family")
    total = ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("m"))
    first = ranges.select("part", F.col("before").alias("first"))
    at = by.join(first, "part").withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("family")) - 1 + F.col("first"))
    return at.crossJoin(F.broadcast(total)).select("family", F.col("nth").alias("place"), F.round((F.col("nth") - (F.col("m") - 1) / 2) * gap, 6).alias("x"))


def evidence(edges: DataFrame, families: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen(fa, fb) -> the works a pair shares, rarest first."""
    w = weighted_edges(edges, families)
    a = chosen.join(w.select(F.col("family").alias("fa"), "work", "idf"), "fa")
    both = a.join(w.select(F.col("family").alias("fb"), "work"), ["fb", "work"])
    order = Window.partitionBy("fa", "fb").orderBy(F.desc(F.round("idf", 6)), "work")
    return both.select("fa", "fb", F.row_number().over(order).cast("long").alias("rank"), "work", F.round("idf", 6).alias("idf"))
