"""Sharding by fixed virtual slots (native).

Every record hashes into one of ``n_slots`` virtual slots, whatever the number of shards. Bytes are
summed per slot, and a versioned slot-to-shard map, stored as a table, says where each slot lives.
Rebalancing edits that map: it never touches records, and slots that fit stay where they are.

Edge cases: a null text has 8 bytes (its frame) and checksum 0; a null doc_id hashes by the text's checksum;
repeated rows keep separate places; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import let, materialize

N_SLOTS = 8192
FRAME_BYTES = 8


def size_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + FRAME_BYTES


def checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")))


def virtual_slot(doc_id: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    """Depends on the record alone. Records of one doc_id with other texts spread over slots."""
    return F.pmod(F.xxhash64(doc_id, checksum(text)), F.lit(n_slots)).cast("int")


def slot_totals(records: DataFrame) -> DataFrame:
    """records(virtual_slot, size) -> bytes and rows per slot; partial sums are made before the shuffle."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(totals: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1: slots dealt round-robin. Every slot is listed, empty ones too."""
    slots = totals.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return slots.join(totals, "virtual_slot", "left").select(
        F.lit(1).alias("version"), "virtual_slot", (F.col("virtual_slot") % n_shards).alias("shard"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def edit_map(current: DataFrame, n_shards: int, version: int, only_into: int | None = None) -> DataFrame:
    """The next version: slots, heaviest first, stay while their shard is below its even share of all bytes;
    the others go to the lightest shard, or to ``only_into``, a shard that is being added.

    The map has a fixed number of rows (the slots), so the greedy pass runs over one array of that length.
    """
    slot = F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "shard", "bytes", "rows")
    one = current.agg(F.sort_array(F.collect_list(slot)).alias("slots"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    share = F.ceil(F.col("total") / n_shards)

    def place(acc: Column, s: Column) -> Column:
        load = acc["load"]
        fits = F.get(load, s["shard"]) + s["bytes"] <= share
        lightest = (F.array_position(load, F.array_min(load)) - 1).cast("int")
        goes = F.when(fits, s["shard"]).otherwise(lightest if only_into is None else F.lit(only_into))
        return let(goes, lambda to: F.struct(
            F.transform(load, lambda x, i: x + F.when(i == to, s["bytes"]).otherwise(F.lit(0))).alias("load"),
            F.array_append(acc["placed"], to).alias("placed")))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("load"), F.array().cast("array<int>").alias("placed"))
    placed = F.aggregate("slots", start, place, lambda acc: acc["placed"])
    return (one.select(F.explode(F.arrays_zip("slots", placed.alias("placed"))).alias("x"))
            .select(F.lit(version).alias("version"), "x.slots.virtual_slot", F.col("x.placed").alias("shard"), "x.slots.bytes", "x.slots.rows"))


def stored_map(totals: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Versions 1 (round-robin) and 2 (edited to even bytes), written as one table in the shared folder."""
    first = first_map(totals, n_shards, n_slots)
    return materialize(first.unionByName(edit_map(first, n_shards, 2)), "slot-map")


def latest(slot_map: DataFrame) -> DataFrame:
    return slot_map.where(F.col("version") == slot_map.agg(F.max("version")).first()[0])


def place_documents(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard, without gaps), grown_shard, virtual_slot, map_version.

    The law is ``bytes``. Places are numbered within each virtual slot and offset by the slots before it in the
    shard, so no task ever orders a whole shard. The map that is broadcast has ``n_slots`` rows at any input size.
    """
    text = F.col("text")
    rows = materialize(docs.select("doc_id", size_bytes(text).alias("size"), checksum(text).alias("text_crc32"),
                                   virtual_slot(F.col("doc_id"), text, n_slots).alias("virtual_slot")), "shard-rows")
    places = latest(stored_map(slot_totals(rows), n_shards, n_slots))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = places.select("version", "virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("nth", F.row_number().over(within) - 1).join(F.broadcast(places), "virtual_slot")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("nth")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version")))


def assign_shards(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` and ``virtual_slot``, which replace columns of these names; texts are not shuffled."""
    docs = docs.drop("shard", "virtual_slot")
    tagged = docs.withColumn("virtual_slot", virtual_slot(F.col("doc_id"), F.col("text"), n_slots))
    totals = slot_totals(tagged.select("virtual_slot", size_bytes(F.col("text")).alias("size")))
    places = latest(stored_map(totals, n_shards, n_slots)).select("virtual_slot", "shard")
    return tagged.join(F.broadcast(places), "virtual_slot").select(*docs.columns, "shard", "virtual_slot")
