"""Removal of repeated passages by a bounded suffix array with bucket-pointer refinement.

A byte goes if it lies in a 50-byte string that also starts in a document with a smaller doc_id. That needs the order
of suffixes to depth 50 only: which suffixes share a bucket at that depth, and the least doc_id of the bucket.

* Only one 24-byte gram stands for a window of 50 bytes: the one of least hash among its 27, a choice that the window's
  bytes alone decide, so equal windows meet at the same gram and offset. Grams go to tasks by their hash.
* Grams of one chunk only are singletons and never move: chunks send the grams' names (5 bytes), and get back a bit for each.
* In a task, the texts around its shared grams get initial buckets of 8-byte grams, one for every suffix. Each bucket's
  suffixes are then sorted on the identifiers of the buckets that their pointers, ``depth`` bytes on, lead to. The new
  identifiers are what the next round's pointers lead to, so 8 bytes become 16, 32 and 50 with three sorts; a suffix alone in
  its bucket is in no further one. Equal texts around a gram are refined once, for the least doc_id among them.

Texts are stored once, in compressed chunks of whole documents; a text longer than ``PART`` bytes is cut into parts that
overlap by 49 bytes on either side and joined again at the end, part by part. Results go back to chunks by their number.
A gram's name has 64 bits. Edge cases: null and short texts lose nothing; equal doc_ids don't remove each other's text; null
doc_ids are larger than all others; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .store import materialize

LENGTH = 50
GRAM = 24
SIDE = LENGTH - GRAM
NO_ID = 2**63 - 1
BUCKET_BYTES = 1 << 20
#: Bytes of a chunk, and texts around grams that are refined together.
PART = 1 << 20
TOGETHER = 1 << 12
_MIX = np.random.default_rng(50).integers(1, 2**63, 2 * SIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


STORED = "chunk long, n_bytes long, ids binary, sizes binary, packed binary, text long, part int, skip int, own int"


def chunks(docs: DataFrame) -> DataFrame:
    """Whole documents in chunks of bounded size, in the shared folder; ``text`` numbers a long text, of whose part ``own`` bytes from ``skip`` on are its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, task, nth = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        names = [x.split()[0] for x in STORED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        for batch in tb.pieces(batches, limit=PART):
            raw, starts = tb.text_bytes(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()
            first = (task << 32) | nth
            for part in range(0, max(len(raw), 1), PART if len(ids) == 1 else max(len(raw), 1)):
                low, high = (max(part - LENGTH + 1, 0), min(part + PART + LENGTH - 1, len(raw))) if len(ids) == 1 else (0, len(raw))
                long = len(ids) == 1 and len(raw) > PART
                size = np.diff(starts) if not long else np.array([high - low])
                row = ((task << 32) | nth, high - low, ids.astype("<i8").tobytes(), size.astype("<i8").tobytes(), pack.compress(raw[low:high].tobytes()),
                       *((first, part // PART, part - low, min(PART, len(raw) - part)) if long else (None,) * 4))
                nth += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=names)

    return materialize(docs.select("doc_id", "text").mapInArrow(run, STORED), "chunks", "uncompressed")


class Chunk:
    """The suffixes of a chunk that stand for its windows: gram, place, and the least and largest offset of a window before it."""

    def __init__(self, ids: bytes, sizes: bytes, packed: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))])
        data = zstandard.ZstdDecompressor().decompress(packed)
        self.raw = np.frombuffer(data, np.uint8)
        n = len(data) - LENGTH + 1
        none = np.zeros(0, np.int64)
        self.place, self.low, self.high, self.doc, self.gram = none, none, none, none, np.zeros(0, np.uint64)
        size = np.diff(self.starts)
        long = size >= LENGTH
        if not long.any():
            return
        edge = np.zeros(n + 1, np.int8)
        edge[self.starts[:-1][long]] += 1
        edge[self.starts[1:][long] - LENGTH + 1] -= 1
        valid = np.cumsum(edge[:n], dtype=np.int8) > 0
        eight = tb.mixed(np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).copy())
        with np.errstate(over="ignore"):
            name = eight[:-16] * np.uint64(5) + eight[8:-8]
            name = tb.mixed(name * np.uint64(5) + eight[16:])
        del eight
        least = (name & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(name), dtype=np.uint64)
        width = 1
        while 2 * width <= SIDE + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = SIDE + 1 - width
        least = np.minimum(least[:len(least) - rest], least[rest:])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del least
        new = valid.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        ends = valid.copy()
        ends[:-1] &= new[1:] | ~valid[1:]
        first, last = np.flatnonzero(new), np.flatnonzero(ends)
        self.place = at[first]
        self.low, self.high = self.place - last, self.place - first
        self.doc = np.searchsorted(self.starts, first, side="right") - 1
        self.gram = name[self.place]

    def buckets(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chunk's grams in order, how often each occurs, and where each bucket's begin."""
        grams, count = np.unique(self.gram, return_counts=True)
        return grams, count, np.searchsorted(grams >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))

    def shared(self, bits: int, told: list) -> None:
        """Keep the suffixes whose gram is in another place too; then join those of equal context."""
        grams, count, at = self.buckets(bits)
        flag = count > 1
        for bucket, mask in told:
            own = slice(at[bucket], at[bucket + 1])
            flag[own] |= np.unpackbits(np.frombuffer(mask, np.uint8), count=at[bucket + 1] - at[bucket]).astype(bool)
        keep = flag[np.searchsorted(grams, self.gram)]
        self.place, self.low, self.high, self.doc, self.gram = (x[keep] for x in (self.place, self.low, self.high, self.doc, self.gram))
        n = len(self.place)
        padded = np.concatenate([np.zeros(SIDE, np.uint8), self.raw, np.zeros(LENGTH, np.uint8)])
        step = np.arange(SIDE)
        left, right = self.place[:, None] + step, self.place[:, None] + (SIDE + GRAM) + step
        self.context = np.concatenate([np.where(SIDE - step <= self.high[:, None], padded[left], 0), np.where(step < SIDE - self.low[:, None], padded[right], 0)], axis=1).astype(np.uint8)
        print_ = fingerprint(self.gram, self.low, self.high, self.context)
        order = np.lexsort((self.ids[self.doc], print_, self.gram))
        new = np.ones(n, bool)
        g, p = self.gram[order], print_[order]
        new[1:] = (g[1:] != g[:-1]) | (p[1:] != p[:-1])
        self.of = np.empty(n, np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.first = order[new]  # of equal contexts the one of the least doc_id


def fingerprint(gram: np.ndarray, low: np.ndarray, high: np.ndarray, context: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = gram + low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + high.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for j in range(context.shape[1]):
            total = total + tb.mixed(context[:, j].astype(np.uint64) + _MIX[j])
    return tb.mixed(total)


RECORD = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("low", "u1"), ("high", "u1"), ("context", "u1", (2 * SIDE,))])


def packed_records(chunk: Chunk, bits: int) -> Iterator[tuple[int, bytes]]:
    rec = np.zeros(len(chunk.first), RECORD)
    for name, x in (("gram", chunk.gram), ("doc", chunk.ids[chunk.doc]), ("low", chunk.low), ("high", chunk.high), ("context", chunk.context)):
        rec[name] = x[chunk.first]
    bucket = (rec["gram"] >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    pack = zstandard.ZstdCompressor(level=1)
    for part, b in zip(np.split(rec, cut), bucket[np.concatenate([[0], cut])] if len(bucket) else (), strict=False):
        # column by column, which packs better
        yield int(b), pack.compress(b"".join(np.ascontiguousarray(part[c]).tobytes() for c in RECORD.names))


def unpacked_records(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // RECORD.itemsize
    rec, at = np.zeros(n, RECORD), 0
    for c in RECORD.names:
        kind = RECORD[c]
        rec[c] = np.frombuffer(raw, kind.base, n * max(1, int(np.prod(kind.shape))), at).reshape((n, *kind.shape))
        at += n * kind.itemsize
    return rec


def refine(bucket: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    """Sort each bucket's suffixes on the identifiers of the buckets that their pointers lead to: the identifiers of the
    parts. A suffix alone in its bucket is not sorted again."""
    several = np.bincount(bucket)[bucket] > 1
    live, alone = np.flatnonzero(several), np.flatnonzero(~several)
    out = np.empty(len(bucket), np.int64)
    parts, out[live] = np.unique(bucket[live] * (int(pointer.max(initial=0)) + 1) + pointer[live], return_inverse=True)
    out[alone] = len(parts) + np.arange(len(alone))
    return out


def window_buckets(text: np.ndarray) -> np.ndarray:
    """The bucket at depth 50 of each suffix of each row (76 bytes) that is as long."""
    width = text.shape[1] - 7
    word = np.zeros((len(text), width), np.uint64)
    for j in range(8):
        word |= text[:, j:j + width].astype(np.uint64) << np.uint64(8 * j)
    _, bucket = np.unique(word.ravel(), return_inverse=True)
    bucket = bucket.reshape(len(text), width)
    for pointer in (8, 16, LENGTH - 32):  # the buckets reached have 8, 16 and 32 bytes
        width = bucket.shape[1] - pointer
        bucket = refine(bucket[:, :width].ravel(), bucket[:, pointer:].ravel()).reshape(len(text), width)
    return bucket


def window_minima(gram: np.ndarray, low: np.ndarray, n: np.ndarray, context: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Least doc_id with the same 50 bytes, for each window of each context (``n`` windows from offset ``low`` on).

    The gram's own bytes are the same in all its contexts, and its name, spread over them, stands for them.
    """
    names = np.ascontiguousarray(np.stack([tb.mixed(gram + np.uint64(j)) for j in range(GRAM // 8)], axis=1)).view(np.uint8)
    text = np.concatenate([context[:, :SIDE], names.reshape(len(gram), GRAM), context[:, SIDE:]], axis=1)
    row = np.repeat(np.arange(len(n)), n)
    bucket = window_buckets(text)[row, SIDE - tb.spread(low, n)]
    least = np.full(int(bucket.max(initial=0)) + 1, NO_ID)
    np.minimum.at(least, bucket, doc[row])
    return least[bucket]


def all_minima(gram: np.ndarray, low: np.ndarray, n: np.ndarray, context: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """``window_minima``, gram by gram (they are in order), a bounded number of contexts at a time or those of one gram."""
    edge = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(gram)))
    out = [np.zeros(0, np.int64)]
    for part in tb.runs(size, TOGETHER):
        own = slice(edge[part.start], edge[part.stop - 1] + size[part.stop - 1])
        out.append(window_minima(gram[own], low[own], n[own], context[own], doc[own]))
    return np.concatenate(out)


def judged(rec: np.ndarray) -> np.ndarray:
    """For each record the offsets, as bits, of its windows that also start in a smaller document."""
    low, high = rec["low"].astype(np.int64), rec["high"].astype(np.int64)
    print_ = fingerprint(rec["gram"], low, high, rec["context"])
    order = np.lexsort((rec["doc"], print_, rec["gram"]))
    g, p = rec["gram"][order], print_[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (p[1:] != p[:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    one = order[new]
    least = rec["doc"][one]
    full = ((np.int64(1) << (high + 1)) - (np.int64(1) << low))
    out = np.where(least[of] < rec["doc"], full, 0)
    grams = rec["gram"][one]
    several = np.zeros(len(one), bool)
    several[1:] |= grams[1:] == grams[:-1]
    several[:-1] |= grams[1:] == grams[:-1]
    c = one[several]
    if len(c):
        n = high[c] - low[c] + 1
        minima = all_minima(rec["gram"][c], low[c], n, rec["context"][c], rec["doc"][c])
        at = np.zeros(len(one), np.int64)
        at[several] = np.cumsum(n) - n
        mine = np.flatnonzero(several[of])
        m = high[mine] - low[mine] + 1
        row = np.repeat(mine, m)
        step = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
        bit = (minima[at[of[row]] + step] < rec["doc"][row]).astype(np.int64) << (low[row] + step)
        out[mine] = np.add.reduceat(bit, np.cumsum(m) - m)
    return out.astype(np.uint32)


def _told(column: pa.Array) -> list[list[tuple[int, bytes]]]:
    return [[(x["bucket"], x["mask"]) for x in row or []] for row in column.to_pylist()]


def _by_chunk(replies: DataFrame, name: str) -> DataFrame:
    return replies.groupBy(F.col("chunk").alias(f"{name}_chunk")).agg(F.collect_list(F.struct("bucket", "mask")).alias(name))


def removed_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    stored = chunks(docs)
    total = stored.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(max((total // BUCKET_BYTES).bit_length(), 5), 31)  # 31 are for 2 PB
    shift = np.uint64(max(64 - bits - 40, 0))
    masks = "chunk long, bucket int, mask binary"

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, ids, sizes, packed in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ids", "sizes", "packed")), strict=True):
                grams, _, at = Chunk(ids, sizes, packed).buckets(bits)
                short = np.ascontiguousarray(((grams >> shift) & np.uint64(2**40 - 1)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
                some = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), key)), pa.array(some, pa.int32()), pa.array([short[at[b]:at[b + 1]].tobytes() for b in some.tolist()], pa.binary())], names=["chunk", "bucket", "mask"])

    def meet(table: pa.Table) -> pa.Table:
        blobs = table.column("mask").to_pylist()
        size = np.array([len(b) // 5 for b in blobs])
        wide = np.zeros((size.sum(), 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
        _, which, count = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
        again = np.split(count[which] > 1, np.cumsum(size)[:-1])
        some = np.array([x.any() for x in again])
        return pa.table({"chunk": table.column("chunk").filter(pa.array(some)), "bucket": table.column("bucket").filter(pa.array(some)), "mask": pa.array([np.packbits(x).tobytes() for x, y in zip(again, some, strict=True) if y], pa.binary())})

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, ids, sizes, packed, told in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ids", "sizes", "packed")), _told(batch.column("shared")), strict=True):
                c = Chunk(ids, sizes, packed)
                c.shared(bits, told)
                sent = list(packed_records(c, bits)) if len(c.first) else []
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(sent), pa.int64()), pa.array([b for b, _ in sent], pa.int32()), pa.array([x for _, x in sent], pa.binary())], names=["chunk", "bucket", "mask"])

    def judge(table: pa.Table) -> pa.Table:
        recs = [unpacked_records(x) for x in table.column("mask").to_pylist()]
        out = np.split(judged(np.concatenate(recs)), np.cumsum([len(r) for r in recs])[:-1])
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "mask": pa.array([x.astype("<u4").tobytes() for x in out], pa.binary())})

    done_schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text long, part int, kept binary, first boolean, last boolean"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("ids", "sizes", "packed", "text", "part", "skip", "own"))
            for ids, sizes, packed, text, part, skip, own, told, verdicts in zip(*cols, _told(batch.column("shared")), _told(batch.column("verdicts")), strict=True):
                c = Chunk(ids, sizes, packed)
                c.shared(bits, told)
                yield cut(c, gone_bytes(c, verdicts), (text, part, skip, own))

    def gone_bytes(c: Chunk, verdicts: list) -> np.ndarray:
        mask = np.zeros(len(c.first), np.int64)
        bucket = (c.gram[c.first] >> np.uint64(64 - bits)).astype(np.int64)
        for b, data in verdicts:
            a, z = np.searchsorted(bucket, [b, b + 1])
            mask[a:z] = np.frombuffer(data, "<u4")
        own = c.ids[c.doc]
        full = (np.int64(1) << (c.high + 1)) - (np.int64(1) << c.low)
        bits_of = np.where(own > own[c.first][c.of], full, mask[c.of]) if len(c.of) else np.zeros(0, np.int64)
        edge = np.zeros(len(c.raw) + LENGTH + 1, np.int64)
        for o in range(SIDE + 1):
            at = c.place[(bits_of >> o) & 1 > 0] - o
            np.add.at(edge, at, 1)
            np.add.at(edge, at + LENGTH, -1)
        return np.cumsum(edge[:len(c.raw)]) > 0

    def cut(c: Chunk, gone: np.ndarray, place: tuple) -> pa.RecordBatch:
        text, part, skip, own = place
        raw, starts = c.raw, c.starts
        if text is not None:
            raw, gone, starts = raw[skip:skip + own], gone[skip:skip + own], np.array([0, own])
        count = np.concatenate([[0], np.cumsum(gone)])
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        inner = starts[:-1][np.diff(starts) > 0]
        first[inner] = gone[inner]
        spans = np.concatenate([[0], np.cumsum(first)])
        n_removed = count[starts[1:]] - count[starts[:-1]]
        digest, kept = [], [None] * len(n_removed)
        if text is None:
            for a, z, n in zip(starts[:-1].tolist(), starts[1:].tolist(), n_removed.tolist(), strict=True):
                digest.append(hashlib.sha256(raw[a:z][~gone[a:z]].tobytes() if n else raw[a:z]).hexdigest())
        else:
            digest, kept = [None], [zstandard.ZstdCompressor(level=1).compress(raw[~gone].tobytes())]
        side = lambda i: pa.array([bool(gone[i])] if text is not None else [None] * len(kept), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [pa.array(c.ids, pa.int64(), mask=c.ids == NO_ID), pa.array(np.diff(starts)), pa.array(n_removed), pa.array(spans[starts[1:]] - spans[starts[:-1]]), pa.array(digest, pa.string()),
             pa.array([text] * len(kept), pa.int64()), pa.array([part] * len(kept), pa.int32()), pa.array(kept, pa.binary()), side(0), side(-1)], names=[x.split()[0] for x in done_schema.split(", ")])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Long texts from their parts, which come in order; one part is held."""
        held, digest = None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{k: held[k] for k in ("doc_id", "n_bytes", "n_removed", "n_spans")} | {"kept_sha256": digest.hexdigest()}], schema=result)

        result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
        for batch in batches:
            for at in range(batch.num_rows):
                (x,) = batch.slice(at, 1).to_pylist()
                if held and held["text"] != x["text"]:
                    yield closed()
                    held = None
                if held:
                    x |= {k: held[k] + x[k] for k in ("n_bytes", "n_removed")} | {"n_spans": held["n_spans"] + x["n_spans"] - (held["last"] and x["first"])}
                else:
                    digest = hashlib.sha256()
                digest.update(zstandard.ZstdDecompressor().decompress(x.pop("kept")))
                held = x
        if held:
            yield closed()

    told = materialize(stored.mapInArrow(names, masks).groupBy("bucket").applyInArrow(meet, masks), "shared-grams")
    known = stored.join(_by_chunk(told, "shared"), F.col("chunk") == F.col("shared_chunk"), "left")
    verdicts = materialize(known.mapInArrow(records, masks).groupBy("bucket").applyInArrow(judge, masks), "verdicts")
    done = known.join(_by_chunk(verdicts, "verdicts"), F.col("chunk") == F.col("verdicts_chunk"), "left")
    done = materialize(done.mapInArrow(finish, done_schema), "done")
    plain = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    parts = done.where("text IS NOT NULL").repartition("text").sortWithinPartitions("text", "part")
    return done.where("text IS NULL").select(*plain).unionByName(parts.mapInArrow(joined, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
