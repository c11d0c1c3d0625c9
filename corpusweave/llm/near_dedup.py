"""MinHash near-duplicates with SuperMinHash signatures.

1. Each text's set of word shingles gets a SuperMinHash signature: one correlated permutation of ranks per element,
   stopped early once later ranks cannot lower any component. Equal sets are one node from here on.
2. Signatures are cut into bands; nodes with a common band are candidates. In each bucket every node is compared
   with the least one only, on the full sets; verified links give first components.
3. Buckets that still hold several components are searched once more for links between components, in tiles of bounded
   size. Signatures, which miss a true link with a chance below 1e-10, choose the pairs, first to tell which texts are
   needed at all, and full sets decide.
4. Verified links are merged (union-find as star contraction on tables).

No pair inside a component found so far is made, so large groups of copies cost their size. A set is identified by
64 bits: under one chance collision is expected below some billion distinct texts. The banding misses a link at the
threshold with a chance below 1e-6. A task holds a slice of a text's elements, a tile, and one text's set at most.

Edge cases: null and blank texts have no set and are linked with nothing; texts shorter than a shingle are one
shingle; repeated rows are copies of each other; a null doc_id is never the id of a component that has another; an
empty table gives an empty result; columns of any name pass through ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .store import materialize, unused

SIGNATURE = 120
#: Similarity in hundredths -> words of the signature in a band.
BAND_ROWS = ((85, 5), (70, 4), (0, 3))
#: Elements of sets worked on at once.
SLICE = 1 << 17
#: Bytes of texts unpacked at once, and nodes and shingles of a block of a bucket.
RAW = 2 << 20
TILE = 2048
TILE_SHINGLES = 1 << 19
#: Rows of one or two numbers that are sent to every executor: 32 MB. More are joined by a shuffle.
SENT_ROWS = 1 << 21
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within each row, and where each row's set starts."""
    hashes, starts = tb.words(column, tb.SPACED)
    n = np.diff(starts)
    with np.errstate(over="ignore"):
        def joined(at: np.ndarray, width: int) -> np.ndarray:
            h = np.full(len(at), width, np.uint64) * _GOLD
            for j in range(width):
                h = tb.mixed(h * np.uint64(5) + hashes[at + j])
            return h

        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        edge = np.concatenate([[0], np.cumsum(count)])
        h = np.empty(edge[-1], np.uint64)
        for part in tb.runs(np.where(n >= k, count, 0), SLICE):
            own = part.start + np.flatnonzero(n[part] >= k)
            if len(own) == 1:  # perhaps a very long text
                i = own[0]
                for a in range(0, int(count[i]), SLICE):
                    z = min(a + SLICE, int(count[i]))
                    h[edge[i] + a:edge[i] + z] = joined(starts[i] + np.arange(a, z), k)
            elif len(own):
                h[tb.spread(edge[own], count[own])] = joined(tb.spread(starts[own], count[own]), k)
        for width in range(1, k):
            if len(row := np.flatnonzero(n == width)):
                h[edge[row]] = joined(starts[row], width)
    del hashes
    if len(n) == 1:
        h.sort()
        new = np.ones(len(h), bool)
        np.not_equal(h[1:], h[:-1], out=new[1:])
        h = h[new]
        return h, np.array([0, len(h)])
    row = np.repeat(np.arange(len(n)), count)
    by = np.argsort(h)
    by = by[np.argsort(row[by].astype(np.uint16) if len(n) < 65536 else row[by], kind="stable")]
    h, row = h[by], row[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def super_min_hash(elements: np.ndarray, starts: np.ndarray, m: int = SIGNATURE) -> np.ndarray:
    """A row of ``m`` components per set, 2^64-1 throughout for an empty one.

    Element e gives component p_e(j) the value j + r_e(j), p_e being a random permutation made step by step. A set is
    done after step j once its largest component is below j + 1. Steps run over all elements of a slice at once; as a
    union's components are the least of its parts', slices of a set go on lowering the same components.
    """
    out = np.full((len(starts) - 1, m), np.iinfo(np.uint64).max, np.uint64)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for a in range(0, len(elements), SLICE):
        row = rows[a:a + SLICE]
        _lower(out[row[0]:row[-1] + 1], row - row[0], elements[a:a + SLICE].copy(), m)
    return out


def _lower(out: np.ndarray, row: np.ndarray, x: np.ndarray, m: int) -> None:
    swapped = None
    flat = out.reshape(-1)
    with np.errstate(over="ignore"):
        for j in range(m):
            x = tb.mixed(x + _GOLD)
            value = (np.uint64(j) << np.uint64(32)) | (x >> np.uint64(32))
            pick = (j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64))
            if swapped is None:
                slot = pick
            else:
                each = np.arange(len(x))
                slot = swapped[each, pick].astype(np.int64)
                swapped[each, pick] = swapped[:, j]
                swapped[:, j] = slot
            np.minimum.at(flat, row * m + slot, value)
            if j + 1 == m:
                break
            stay = (out.max(axis=1) >= np.uint64(j + 1) << np.uint64(32))[row]
            if not stay.any():
                break
            row, x = row[stay], x[stay]
            if swapped is None:
                swapped = np.tile(np.arange(m, dtype=np.uint8), (len(x), 1))
                pick = pick[stay]
                swapped[np.arange(len(x)), pick] = 0
                swapped[:, 0] = pick
            elif not stay.all():
                swapped = swapped[stay]


def band_rows(similarity: int) -> int:
    return next(r for least, r in BAND_ROWS if similarity >= least)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A key per band; the band's number is part of it."""
    b = signature.shape[1] // rows
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(1, b + 1, dtype=np.uint64) * _GOLD, (len(signature), b)).copy()
        for j in range(rows):
            keys = tb.mixed(keys * np.uint64(5) + signature[:, j:b * rows:rows])
    return keys


SIGNED = "doc_id long, digest long, n_shingles long, node long, bands array<long>, brief binary, packed binary"


def signed(docs: DataFrame, k: int, similarity: int) -> DataFrame:
    """doc_id, the text's digest, set size, node (the set's identity; null for no words), band keys, a byte per component, and the compressed text."""
    per_band = band_rows(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for batch in tb.pieces(batches, limit=RAW):
            sets, starts = shingle_sets(batch.column("text"), k)
            n = np.diff(starts)
            sig = super_min_hash(sets, starts)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mixed(sets ^ _GOLD), dtype=np.uint64)])
            del sets
            with np.errstate(over="ignore"):
                node = tb.mixed(total[starts[1:]] - total[starts[:-1]] + n.astype(np.uint64)).view(np.int64)
            keys = bands(sig, per_band)
            some = np.where(n > 0, keys.shape[1], 0)
            keys_at = np.concatenate([[0], np.cumsum(some)])
            brief = np.ascontiguousarray(tb.mixed(sig.reshape(-1)).astype(np.uint8).reshape(sig.shape))
            raw, at = tb.text_bytes(batch.column("text"))
            packed = [pack.compress(raw[a:z].tobytes()) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), batch.column("digest"), pa.array(n, pa.int64()), pa.array(node, pa.int64(), mask=n == 0),
                pa.ListArray.from_arrays(pa.array(keys_at, pa.int32()), pa.array(keys[n > 0].reshape(-1).view(np.int64))),
                pa.array([x.tobytes() for x in brief], pa.binary()), pa.array(packed, pa.binary())],
                names=["doc_id", "digest", "n_shingles", "node", "bands", "brief", "packed"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(tb.tidied(run), SIGNED)


def unpacked_sets(packed: list[bytes], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sets, starts) of packed texts, unpacked a bounded number of bytes at a time."""
    unpack = zstandard.ZstdDecompressor()
    size = np.array([zstandard.frame_content_size(x) for x in packed], np.int64)
    for part in tb.runs(size, RAW):
        yield part.start, *shingle_sets(pa.array([unpack.decompress(x) for x in packed[part]], pa.large_binary()), k)


def in_common(x: np.ndarray, y: np.ndarray) -> int:
    return int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())


def alike(n: Column, m: Column, similarity: int) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return 100 * F.least(n, m) >= similarity * F.greatest(n, m)


def sent(keys: DataFrame) -> DataFrame:
    """keys, a written table, marked to be sent to the rows they are joined with if they are few, so that these rows are not moved."""
    return F.broadcast(keys) if keys.count() <= SENT_ROWS else keys


def only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows(node, ...) whose node is in wanted(node)."""
    return rows.join(sent(materialize(wanted.distinct(), "wanted")), "node", "left_semi")


def one_text(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows(node, packed, ...), wanted(node) -> node, packed: one text for each node that is wanted."""
    return only(rows.select("node", "packed"), wanted).groupBy("node").agg(F.first("packed").alias("packed"))


def verified(pairs: DataFrame, rows: DataFrame, k: int, similarity: int) -> DataFrame:
    """pairs(u, v) whose full sets reach the similarity. A hub u goes before the texts compared with it, once for each ``TILE`` of them.

    Places are settled on the narrow table first, so texts are joined to them once.
    """
    hub = materialize(pairs.groupBy("u").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")), "hubs")
    none = F.lit(None).cast("long").alias("v")
    places = pairs.join(hub, "u").select(F.col("v").alias("node"), "u", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"), "v")
    places = places.unionByName(hub.select(F.col("u").alias("node"), "u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), none))
    places = materialize(places, "places")
    rows = one_text(rows, places.select("node")).join(places, "node").select("u", "part", "v", "packed")
    rows = rows.repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, np.uint64)
        for batch in batches:
            u, v = batch.column("u"), batch.column("v")
            us, vs = [], []
            for first, sets, at in unpacked_sets(batch.column("packed").to_pylist(), k):
                for i in range(len(at) - 1):
                    y, other = sets[at[i]:at[i + 1]], v[first + i].as_py()
                    if other is None:
                        x = y.copy()
                        continue
                    common = in_common(x, y)
                    if 100 * common >= similarity * (len(x) + len(y) - common):
                        us.append(u[first + i].as_py())
                        vs.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return rows.mapInArrow(tb.tidied(run), "u long, v long")


def tiled(rows: DataFrame) -> DataFrame:
    """rows(key, node, root, size) -> the same with keys, block, low and high, for buckets of several roots; of buckets with the same nodes one.

    A bucket is cut into blocks of about ``TILE`` nodes or ``TILE_SHINGLES`` shingles, and each pair of blocks is a group of
    its own, so no task holds a bucket. A root with more than half a block has blocks of its own, and pairs of these are
    left out: a large component costs its size, however many small ones are in the bucket. ``keys`` has all the node's buckets.
    """
    weight = F.greatest(F.count("*") / TILE, F.sum("size") / TILE_SHINGLES).alias("weight")
    roots = rows.groupBy("key", "root").agg(weight, F.bit_xor(F.xxhash64("node")).alias("mark"), F.count("*").alias("n"))
    small = F.sum(F.when(F.col("weight") <= 0.5, F.col("weight"))).alias("small")
    open_ = roots.groupBy("key").agg(F.count("*").alias("roots"), small, F.bit_xor("mark").alias("mark"), F.sum("n").alias("n")).where("roots > 1")
    open_ = open_.groupBy("mark", "n").agg(F.min(F.struct("key", "small")).alias("o")).select("o.key", "o.small")
    roots = roots.drop("mark", "n").join(open_, "key").withColumn("own", F.col("weight") > 0.5)
    roots = roots.select("key", "root", "own", F.greatest(F.ceil(F.when(F.col("own"), F.col("weight")).otherwise(F.col("small"))), F.lit(1)).cast("int").alias("parts"))
    roots = materialize(roots, "roots")
    name = lambda own, root, nth: F.concat_ws(":", F.when(own, root.cast("string")).otherwise(F.lit("-")), nth)
    blocks = roots.select("key", "own", F.when(F.col("own"), F.col("root")).alias("whose"), "parts").distinct()
    blocks = blocks.select("key", "whose", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("nth"))
    blocks = blocks.select("key", "whose", name(F.col("whose").isNotNull(), F.col("whose"), F.col("nth")).alias("block"))
    other = blocks.select("key", F.col("whose").alias("other_whose"), F.col("block").alias("other"))
    pairs = blocks.join(other, "key").where(F.coalesce(F.col("whose") != F.col("other_whose"), F.lit(True)))
    pairs = pairs.select("key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    nth = F.pmod(F.when(F.col("own"), F.xxhash64("node")).otherwise(F.xxhash64("root")), F.col("parts"))
    cut = materialize(rows.join(roots, ["key", "root"]).withColumn("block", name(F.col("own"), F.col("root"), nth)).drop("own", "parts"), "open")
    keys = cut.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    return cut.join(pairs, ["key", "block"]).join(keys, "node")


class Tile:
    """The nodes of a tile, and the pairs of different roots that signatures let through; they miss a link at the threshold with a chance below 1e-10."""

    def __init__(self, table: pa.Table, similarity: int):
        self.similarity = similarity
        self.node, self.root = table.column("node").to_numpy(), table.column("root").to_numpy()
        self.size = table.column("size").to_numpy()
        _, self.block = np.unique(np.array(table.column("block").to_pylist(), object), return_inverse=True)
        self.brief = np.frombuffer(b"".join(table.column("brief").to_pylist()), np.uint8).reshape(len(self.node), SIGNATURE)

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        lone = not self.block.any()
        for i in range(len(self.node) - 1):
            rest = slice(i + 1, None)
            far = self.root[rest] != self.root[i]
            if not lone:
                far &= self.block[rest] != self.block[i]
            far &= 100 * np.minimum(self.size[rest], self.size[i]) >= self.similarity * np.maximum(self.size[rest], self.size[i])
            j = i + 1 + np.flatnonzero(far)
            if len(j):
                j = j[(self.brief[j] == self.brief[i]).sum(axis=1) >= least_matches(self.similarity)]
            if len(j):
                yield i, j


def least_matches(similarity: int) -> int:
    return SIGNATURE * max(similarity - 25, 0) // 100


def promising(tiles: DataFrame, similarity: int) -> DataFrame:
    """node of those with a pair to look at in a tile of (key, node, root, size, brief, block); no text is moved for the others."""
    def run(table: pa.Table) -> pa.Table:
        tile = Tile(table, similarity)
        on = np.zeros(len(tile.node), bool)
        for i, j in tile.pairs():
            on[i] = True
            on[j] = True
        return pa.table({"node": pa.array(tile.node[on])})

    return tiles.groupBy("key", "low", "high").applyInArrow(run, "node long").distinct()


def between(tiles: DataFrame, k: int, similarity: int) -> DataFrame:
    """Verified links between different roots in a tile of (key, node, root, size, brief, keys, block, packed): at most one per root less one.

    Full sets decide. Pairs that are connected by then are passed over, and each pair is looked at in the least bucket it shares.
    """
    def run(key: tuple, table: pa.Table) -> pa.Table:
        tile, here = Tile(table, similarity), key[0].as_py()
        keys = [frozenset(x) for x in table.column("keys").to_pylist()]
        sets: list[np.ndarray] = []
        for _, h, at in unpacked_sets(table.column("packed").to_pylist(), k):
            sets += [h[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]
        names, of = np.unique(tile.root, return_inverse=True)
        parent = list(range(len(names)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        us, vs = [], []
        for i, j in tile.pairs():
            for o in j.tolist():
                a, b = find(of[i]), find(of[o])
                if a == b or min(keys[i] & keys[o]) < here:
                    continue
                common = in_common(sets[i], sets[o])
                if 100 * common >= similarity * (len(sets[i]) + len(sets[o]) - common):
                    parent[a] = b
                    us.append(tile.node[i])
                    vs.append(tile.node[o])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return tiles.groupBy("key", "low", "high").applyInArrow(run, "u long, v long")


def resembling(pairs: DataFrame, briefs: DataFrame, similarity: int) -> DataFrame:
    """pairs(u, v) that signatures let through."""
    briefs = materialize(only(briefs, pairs.select(F.col("u").alias("node")).union(pairs.select("v"))), "briefs")
    both = pairs.join(briefs.select(F.col("node").alias("v"), F.col("brief").alias("bv")), "v").join(briefs.select(F.col("node").alias("u"), F.col("brief").alias("bu")), "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for c in ("bu", "bv"))
            yield batch.select(["u", "v"]).filter(pa.array((a == b).sum(axis=1) >= least_matches(similarity)))

    return both.select("u", "v", "bu", "bv").mapInArrow(tb.tidied(run), "u long, v long")


def grouped(docs: DataFrame, k: int, similarity: int) -> DataFrame:
    """doc_id, digest, n_shingles, node and first: of the row's component the least row, as (no doc_id, doc_id, digest).

    Equal sets are one node before bands are made, so a group of exact copies costs one node's bands. Texts are moved
    for pairs only that sizes and signatures let through.
    """
    rows = materialize(signed(docs, k, similarity), "signed")
    some = rows.where("node IS NOT NULL")
    nodes = materialize(some.groupBy("node").agg(F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("brief").alias("brief"),
                                                 F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "digest")).alias("first")), "nodes")
    bucket = Window.partitionBy("key")
    keyed = nodes.select(F.explode("bands").alias("key"), "node", "size")
    hub, most = F.min(F.struct("node", "size")).over(bucket), F.max("node").over(bucket)
    bucketed = keyed.withColumns({"hub": hub, "most": most}).where("hub.node < most")
    bucketed = materialize(bucketed.select("key", "node", "size", F.col("hub.node").alias("u"), F.col("hub.size").alias("u_size")), "buckets")
    stars = bucketed.where(F.col("node") != F.col("u")).where(alike(F.col("size"), F.col("u_size"), similarity))
    briefs = nodes.select("node", "brief")
    stars = materialize(stars.select("u", F.col("node").alias("v")).distinct(), "near")
    stars = materialize(resembling(stars, briefs, similarity), "stars")
    links = materialize(verified(stars, some, k, similarity), "links")
    roots = components(links)
    named = bucketed.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    tiles = materialize(tiled(named), "tiles")
    hopeful = materialize(promising(tiles.join(only(briefs, tiles.select("node")), "node"), similarity), "promising")
    left = tiled(only(named, hopeful)).join(only(briefs, hopeful), "node")
    late = materialize(between(left.join(one_text(some, hopeful), "node"), k, similarity), "links")
    if late.limit(1).count():
        roots = components(links.unionByName(late))
    ids = nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = ids.groupBy("root").agg(F.min("first").alias("first"))
    named = materialize(ids.drop("first").join(least, "root").select("node", "first"), "components")
    return rows.select("doc_id", "digest", "n_shingles", "node").join(named, "node", "left")


def near_duplicates(docs: DataFrame, k: int = 5, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``; ``similarity`` in hundredths."""
    component = F.coalesce("first.doc_id", "doc_id")
    return grouped(docs, k, similarity).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, similarity: int = 80) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns, and all rows without words.

    The row of least doc_id stays, null being the largest; of rows that share it the one whose text has the least hash; and
    of repeated rows, which share both, one. Rows that share a doc_id but are not alike are told apart by their texts.
    """
    done = materialize(grouped(docs, k, similarity).where("node IS NOT NULL").select("doc_id", "digest", "first"), "grouped")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    i, d = (unused(docs, c) for c in ("near_id", "near_digest"))
    row = lambda t: t.select(F.col("doc_id").alias(i), F.col("digest").alias(d))
    again = row(done.where(own)).groupBy(i, d).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    again = materialize(again, "again")
    gone = materialize(row(done.where(~own)).distinct().unionByName(again), "gone")
    own_digest = unused(docs, "near_own")
    told = docs.withColumn(own_digest, F.xxhash64("text"))
    same = told["doc_id"].eqNullSafe(F.col(i)) & (told[own_digest] == F.col(d))
    single = told.join(sent(gone), same, "left_anti").select(*docs.columns)
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    first = told.join(sent(again), same, "left_semi").groupBy(F.col("doc_id").alias(i), F.col(own_digest).alias(d)).agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias("row"))
    return single.unionByName(first.select(*(F.col("row")[c].alias(c) for c in docs.columns)))
