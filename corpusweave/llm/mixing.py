"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (native).

Documents fall into blocks of their source. A source's target in words fixes its exact quota of blocks, whole
passes first; the words still missing come from one further block, cut at a document, and what is owed then from the
largest documents left that fit, size by size, until none does. A tree splits the quotas of all sources among the
output shards: at each node the left half's seats are drawn from the node's blocks without replacement, so every
shard's quotas are exact and sum to the sources' quotas. Each shard draws the next blocks of each source's permutation,
disjoint from other shards', and is shuffled locally. A document's copies are the shards it is dealt to.

Blocks grow with the square root of the rows, so neither a block nor a source's list of blocks is ever a large part of
the table. Every draw is a function of the seed, so reruns agree. Edge cases: a null text has no words and is in no
shortage of a target; null sources are one source, the last; a source without words has target 0; repeated rows
are drawn like any others; an empty table gives an empty result; columns of any name pass through ``mixed_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import let, materialize, unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Blocks of a source, for few rows.
BLOCKS = 256
SHARDS = 16
PIECE_WORDS = 1 << 22


def word_count(text: Column) -> Column:
    """Counts borders between space and word, so no array of words is made."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A whole number below 2^32 from the first 8 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("~")) for p in parts))), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, target. One row per source.

    Sources, in order of limit per weight, fill up to ``most`` times their size as long as their part of what is
    left, by weight, is above it; this is where resharing the excess again and again ends.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sizes.withColumn("rank", rank).withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("rank") % len(weights)))
    w = w.withColumn("limit", most * F.col("source_size"))
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), "rank")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = (w.withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0))).withColumn("light", F.coalesce(F.sum("weight").over(before), F.lit(0)))
         .withColumn("all", F.sum("source_size").over(whole)).withColumn("heavy", F.sum("weight").over(whole)))
    level = (F.lit(share) * F.col("all") - F.col("full")) / (F.col("heavy") - F.col("light"))
    w = w.withColumn("level", level).withColumn("open", F.col("weight") * F.col("level") <= F.col("limit"))
    final = F.min(F.struct(F.when(F.col("open"), F.lit(0)).otherwise(F.lit(1)), (F.col("limit") / F.col("weight")), "rank", "level")).over(whole)
    w = w.withColumn("final", final["level"])
    return w.select("source", "rank", "source_size", F.least(F.col("limit").cast("double"), F.col("weight") * F.col("final")).alias("target"))


def quotas(blocks: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    """Per block: its place in the source's permutation, copies drawn whole, and the words a cut block still owes."""
    b = blocks.join(goals, blocks["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    order = Window.partitionBy("rank").orderBy(uniform(F.lit(seed), F.col("rank"), F.col("block")), "block")
    b = b.withColumn("place", F.row_number().over(order) - 1).withColumn("upto", F.sum("words").over(order))
    size = F.greatest(F.col("source_size"), F.lit(1))
    b = b.withColumn("passes", F.floor(F.col("target") / size).cast("int")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    whole = (F.col("upto") <= F.col("rest")) & (F.col("passes") < MOST)
    cut = ~whole & (F.col("upto") - F.col("words") < F.col("rest"))
    return b.select("source", "rank", "source_size", "target", "block", "words", "place", (F.col("passes") + whole.cast("int")).alias("copies"),
                    F.when(cut, F.col("rest") - (F.col("upto") - F.col("words"))).otherwise(F.lit(0.0)).alias("owed"))


def split_tree(quota: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """quota(rank, blocks) -> rank, shard, first, blocks: each shard's exact part of each source's quota.

    A node with seats for n blocks gives its left half the rounded half of them. The left half's composition is
    multivariate hypergeometric: source after source, seats are drawn without replacement from the blocks left.
    The table has a row per source; the tree is an array per row set of that size, unrelated to the documents.
    """
    one = quota.agg(F.sort_array(F.collect_list(F.struct("rank", F.col("blocks").cast("long").alias("blocks")))).alias("q"))

    def seats_taken(k: Column, seats: Column, pool: Column, coin: Column) -> Column:
        """Hypergeometric draw by inverting its distribution: ``seats`` drawn from ``pool`` blocks of which ``k`` count.

        The chances are logarithms, relative to the first, within ten standard deviations of the mean; beyond it they are
        below 1e-20. They are gone over one after another and never stored: for the largest, for the sum, for the place.
        """
        mean = seats * k / F.greatest(pool, F.lit(1))
        spread = 10 * F.sqrt(mean * (1 - k / F.greatest(pool, F.lit(1))) * (pool - seats) / F.greatest(pool - 1, F.lit(1))) + 10
        low = F.greatest(seats - (pool - k), F.lit(0), F.floor(mean - spread)).cast("long")
        high = F.least(seats, k, F.ceil(mean + spread)).cast("long")
        steps = F.when(high > low, F.sequence(low, F.greatest(high - 1, low))).otherwise(F.array().cast("array<bigint>"))
        onward = lambda last, j: last + F.log((k - j) * (seats - j) / ((j + 1) * (pool - k - seats + j + 1)))

        def over(start: Column, step, finish) -> Column:
            """``step(state, logarithm)`` for each chance after the first."""
            begin = F.struct(F.lit(0.0).alias("last"), start.alias("x"))
            return F.aggregate(steps, begin, lambda acc, j: let(onward(acc["last"], j), lambda v: F.struct(v.alias("last"), step(acc["x"], v).alias("x"))), lambda acc: finish(acc["x"]))

        def place(most: Column) -> Column:
            first = F.exp(-most)
            total = over(first, lambda x, v: x + F.exp(v - most), lambda x: x)
            state = lambda run, n: F.struct(run.alias("run"), n.alias("n"))
            return let(coin * total, lambda goal: over(state(first, (first < goal).cast("long")), lambda x, v: let(x["run"] + F.exp(v - most), lambda r: state(r, x["n"] + (r < goal).cast("long"))), lambda x: x["n"]))

        return F.least(low + let(over(F.lit(0.0), F.greatest, lambda x: x), place), high)

    def draw(left_seats: Column, node: Column, tag: Column) -> Column:
        """Left half's blocks by source, drawn source after source from the blocks left."""

        def step(acc: Column, x: Column) -> Column:
            coin = uniform(F.lit(seed), tag, x["rank"]) / float(2 ** 32)
            drawn = seats_taken(x["blocks"], acc["seats"], acc["pool"], coin)
            return let(drawn, lambda d: F.struct((acc["seats"] - d).alias("seats"), (acc["pool"] - x["blocks"]).alias("pool"),
                                                 F.array_append(acc["out"], F.struct(x["rank"].alias("rank"), d.alias("blocks"))).alias("out")))

        pool = F.aggregate(node, F.lit(0).cast("long"), lambda a, x: a + x["blocks"])
        start = F.struct(left_seats.alias("seats"), pool.alias("pool"), F.array().cast("array<struct<rank:int,blocks:bigint>>").alias("out"))
        return F.aggregate(node, start, step, lambda acc: acc["out"])

    def halves(node: Column, tag: Column) -> Column:
        seats = F.floor(F.aggregate(node, F.lit(0).cast("long"), lambda a, x: a + x["blocks"]) / 2).cast("long")
        rest = lambda left: F.zip_with(node, left, lambda x, y: F.struct(x["rank"].alias("rank"), (x["blocks"] - y["blocks"]).alias("blocks")))
        return let(draw(seats, node, tag), lambda left: F.array(left, rest(left)))

    def deeper(nodes: Column, first: int) -> Column:
        return F.flatten(F.transform(nodes, lambda node, i: halves(node, i + first)))

    nodes, level = one.select(F.array("q").alias("nodes")), 1
    while level < n_shards:  # a step for each level, as the analyser goes a bounded number of functions deep
        nodes, level = nodes.select(deeper(F.col("nodes"), level - 1).alias("nodes")), 2 * level
    flat = nodes.select(F.posexplode("nodes").alias("shard", "n")).select("shard", F.explode("n").alias("x")).select("x.rank", "shard", "x.blocks")
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0)))


def block_count(n_rows: int) -> int:
    """Blocks of a source: 256, or the power of two at the square root of the rows, whichever is more."""
    return max(BLOCKS, 1 << math.ceil(math.log2(max(n_rows, 1)) / 2))


def plan(docs: DataFrame, seed: int = 7, n_blocks: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(rows, blocks, number of blocks): rows has a number, doc_id, source, size, key, block, source_size, target and copies for each row of ``docs``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = materialize(rows.withColumn("key", uniform(F.lit(seed), F.col("doc_id"))), "mix-rows")  # written, so that a row keeps its number
    n_blocks = n_blocks or block_count(rows.count())
    rows = rows.withColumn("block", (F.col("key") % n_blocks).cast("int"))
    totals = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    goals = targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")))
    blocks = materialize(quotas(totals, goals, seed), "mix-blocks")
    b = blocks.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "source_size", "target", "copies", "owed", "place")
    tagged = rows.join(b, rows["source"].eqNullSafe(b["b_source"]) & (rows["block"] == b["b_block"])).drop("b_source", "b_block")
    return tagged, blocks, n_blocks


def fill(tagged: DataFrame) -> DataFrame:
    """row, doc_id, source, size, block of each row taken once more than its block is drawn.

    First the rows of the cut block, in key order, as long as they fit what its source is owed. What is owed then is less
    than the words of one document: it is filled from the rows left of that block and of the undrawn blocks after it, the
    largest first that fit. One fold per source goes over the sizes (not the rows) of at most that many words and says how
    many rows of each are taken; blocks in their order say which.
    """
    mine = ["row", "doc_id", "source", "size", "block", "place", "key"]
    order = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    first = tagged.where("owed > 0").withColumn("upto", F.sum(F.when(F.col("size") <= F.col("owed"), F.col("size")).otherwise(0)).over(order))
    first = materialize(first.withColumn("fits", (F.col("size") <= F.col("owed")) & (F.col("upto") <= F.col("owed"))), "mix-first")
    left = first.groupBy(F.col("source").alias("s_source")).agg((F.max("owed") - F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0))).alias("left"), F.max("place").alias("cut_place"))
    pool = first.where("NOT fits").select(*mine).unionByName(tagged.where("owed <= 0").select(*mine))
    pool = pool.join(left, pool["source"].eqNullSafe(left["s_source"])).where("place >= cut_place AND size BETWEEN 1 AND left").drop("s_source", "cut_place")
    counts = materialize(pool.groupBy("source", "size", "block", "place").agg(F.count("*").alias("n"), F.max("left").alias("left")), "mix-pool")
    sizes = counts.groupBy("source", "size").agg(F.sum("n").alias("n"), F.max("left").alias("left"))
    sizes = sizes.groupBy("source").agg(F.max("left").alias("left"), F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    fitting = lambda x, owed: F.least(x["n"], F.floor(owed / x["size"])).cast("long")
    none = F.array().cast("array<struct<size:bigint,n:bigint>>")
    taken = F.aggregate("sizes", F.struct(F.col("left").alias("left"), none.alias("out")), lambda acc, x: let(fitting(x, acc["left"]), lambda n: F.when(
        n > 0, F.struct((acc["left"] - n * x["size"]).alias("left"), F.array_append(acc["out"], F.struct(x["size"].alias("size"), n.alias("n"))).alias("out"))).otherwise(acc)), lambda acc: acc["out"])
    taken = sizes.select(F.col("source").alias("s_source"), F.explode(taken).alias("x")).select("s_source", F.col("x.size").alias("s_size"), F.col("x.n").alias("wanted"))
    each = counts.join(taken, counts["source"].eqNullSafe(taken["s_source"]) & (counts["size"] == taken["s_size"]))
    before = Window.partitionBy("source", "size").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("here", F.least("n", F.col("wanted") - F.coalesce(F.sum("n").over(before), F.lit(0)))).where("here > 0")
    each = each.select(F.col("source").alias("e_source"), F.col("size").alias("e_size"), F.col("block").alias("e_block"), "here")
    pool = pool.join(each, pool["source"].eqNullSafe(each["e_source"]) & (pool["size"] == each["e_size"]) & (pool["block"] == each["e_block"]))
    nth = F.row_number().over(Window.partitionBy("source", "size", "block").orderBy("key", "doc_id", "row"))
    more = pool.withColumn("nth", nth).where("nth <= here")
    return first.where("fits").select(*mine[:5]).unionByName(more.select(*mine[:5]))


def shard_plan(blocks: DataFrame, n_shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """source, block, copy, out_shard: where each drawn block of each pass goes. A row per block and pass."""
    drawn = blocks.withColumn("n", F.col("copies") + (F.col("owed") > 0).cast("int")).where("n > 0")
    quota = drawn.groupBy("rank").agg(F.sum("n").alias("blocks"))
    tree = split_tree(quota, n_shards, seed).where("blocks > 0")
    each = drawn.select("source", "rank", "block", "place", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    order = Window.partitionBy("rank").orderBy(uniform(F.lit(seed + 2), F.col("rank"), F.col("block"), F.col("copy")), "block", "copy")
    each = each.withColumn("seat", F.row_number().over(order) - 1)
    t = tree.withColumnRenamed("rank", "t_rank")
    at = (each["rank"] == t["t_rank"]) & (each["seat"] >= t["first"]) & (each["seat"] < t["first"] + t["blocks"])
    return each.join(t, at).select("source", "block", "copy", F.col("shard").alias("out_shard"))


def block_seats(blocks: DataFrame, n_shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """source, block, shards: the shard of each drawn pass of a block, in the order of passes. A row per drawn block."""
    each = F.sort_array(F.collect_list(F.struct("copy", "out_shard")))
    return shard_plan(blocks, n_shards, seed).groupBy("source", "block").agg(F.transform(each, lambda x: x["out_shard"]).alias("shards"))


def last_seats(blocks: DataFrame, seats: DataFrame) -> DataFrame:
    """l_source, last: the shard of each source's cut block, where the rows go that fill up its target."""
    cut = blocks.where("owed > 0").select(F.col("source").alias("l_source"), F.col("block").alias("l_block"), "copies")
    same = cut["l_source"].eqNullSafe(seats["s_source"]) & (cut["l_block"] == seats["s_block"])
    return cut.join(seats, same).select("l_source", F.get("shards", F.col("copies")).alias("last"))


def dealt(docs: DataFrame, n_shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """Every row of ``docs`` as in ``plan``, with the shards that its copies are dealt to; a row that is not taken has none."""
    tagged, blocks, _ = plan(docs, seed)
    seats = materialize(block_seats(blocks, n_shards, seed), "mix-seats").withColumnsRenamed({"source": "s_source", "block": "s_block"})
    more = fill(tagged)
    last = last_seats(blocks, seats)
    more = more.join(last, more["source"].eqNullSafe(last["l_source"])).select(F.col("row").alias("m_row"), "last")
    rows = tagged.join(seats, tagged["source"].eqNullSafe(seats["s_source"]) & (tagged["block"] == seats["s_block"]), "left").drop("s_source", "s_block")
    rows = rows.join(more, rows["row"] == more["m_row"], "left")
    whole = F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), F.col("copies"))
    return rows.withColumn("shards", F.concat(whole, F.array_compact(F.array("last")))).drop("copies", "m_row", "last")


def mix_counts(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0 to 2) and taken for every row of ``docs``, from the shards it is dealt to."""
    rows = dealt(docs, seed=seed).withColumn("copies", F.size("shards"))
    return rows.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies",
                       (F.col("copies") * F.col("size")).cast("long").alias("taken"), "key", "block")


def order_key(seed: int, doc_id: Column, copy: Column) -> Column:
    return uniform(F.lit(seed + 3), doc_id, copy)


def mix(docs: DataFrame, n_shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """doc_id, copy, out_shard, order_key: the mix itself, one row per document and copy taken."""
    each = dealt(docs, n_shards, seed).select("doc_id", "source", "size", F.posexplode("shards").alias("at", "out_shard")).withColumn("copy", F.col("at") + 1)
    return each.select("doc_id", "source", "size", "copy", "out_shard", order_key(seed, F.col("doc_id"), F.col("copy")).alias("order_key"))


def mixed_documents(docs: DataFrame, seed: int = 7, n_blocks: int | None = None, n_shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, shard after shard, each shard shuffled.

    A document's block says how often it is taken and where to, and the table of blocks has a row per source and block. Only
    documents of blocks with rows that fill up a source's target are joined by id; of repeated rows as many are taken as were
    counted. Texts are moved once, to their shard: partitions are equal pieces of a shard, in its order.
    """
    tagged, blocks, n_blocks = plan(docs.select("doc_id", "source", "text"), seed, n_blocks)
    seats = materialize(block_seats(blocks, n_shards, seed), "mix-seats").withColumnsRenamed({"source": "s_source", "block": "s_block"})
    extra = materialize(fill(tagged), "mix-extra")
    marks = extra.select(F.col("source").alias("x_source"), F.col("block").alias("x_block"), F.lit(True).alias("filled")).distinct()
    name = {c: unused(docs, f"mix_{c}") for c in ("at", "source", "block", "copies", "filled", "shards", "id", "from", "size", "n", "words", "nth", "copy", "shard", "key")}
    named = lambda c: F.col(name[c])
    b = blocks.join(seats, blocks["source"].eqNullSafe(seats["s_source"]) & (blocks["block"] == seats["s_block"]), "left")
    b = b.join(marks, b["source"].eqNullSafe(marks["x_source"]) & (b["block"] == marks["x_block"]), "left")
    b = materialize(b.select(F.col("source").alias(name["source"]), F.col("block").alias(name["block"]), F.col("copies").alias(name["copies"]), F.coalesce("filled", F.lit(False)).alias(name["filled"]),
                             F.slice("shards", F.lit(1), F.col("copies")).alias(name["shards"])), "mix-seats")
    placed = docs.withColumn(name["at"], (uniform(F.lit(seed), F.col("doc_id")) % n_blocks).cast("int"))
    placed = placed.join(b, placed["source"].eqNullSafe(b[name["source"]]) & (placed[name["at"]] == b[name["block"]]))
    last = last_seats(blocks, seats)
    more = extra.groupBy(F.col("doc_id").alias(name["id"]), F.col("source").alias(name["from"]), F.col("size").alias(name["size"])).agg(F.count("*").alias(name["n"]))
    more = materialize(more.join(last, more[name["from"]].eqNullSafe(last["l_source"])).drop("l_source").withColumnRenamed("last", name["shard"]), "mix-more")
    filled = placed.where(named("filled")).withColumn(name["words"], word_count(F.col("text")))
    filled = filled.join(more, filled["doc_id"].eqNullSafe(more[name["id"]]) & filled["source"].eqNullSafe(more[name["from"]]) & (filled[name["words"]] == more[name["size"]]))
    same = Window.partitionBy(name["id"], name["from"], name["size"]).orderBy(F.md5("text"))
    filled = filled.withColumn(name["nth"], F.row_number().over(same)).where(named("nth") <= named("n"))
    whole = placed.where(named("copies") > 0).select(*docs.columns, F.posexplode(named("shards")).alias(name["copy"], name["shard"]))
    filled = filled.select(*docs.columns, named("copies").alias(name["copy"]), named("shard"))
    return in_shards(whole.unionByName(filled), blocks, n_shards, seed, name).select(*docs.columns)


def in_shards(mixed: DataFrame, blocks: DataFrame, n_shards: int, seed: int, name: dict[str, str]) -> DataFrame:
    """Rows with their shard and copy (from 0), dealt to the pieces of their shard by the order key and put in its order."""
    words = blocks.agg(F.sum(F.col("copies") * F.col("words") + F.col("owed"))).first()[0] or 0
    pieces = 1 + int(words // (n_shards * PIECE_WORDS))
    mixed = mixed.withColumn(name["key"], order_key(seed, F.col("doc_id"), F.col(name["copy"]) + 1))
    piece = (F.col(name["shard"]) * pieces + F.floor(F.col(name["key"]) * pieces / float(2 ** 32))).cast("int")
    return mixed.repartitionById(n_shards * pieces, piece).sortWithinPartitions(name["key"], "doc_id", name["copy"])
