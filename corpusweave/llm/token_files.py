"""Token ids of a corpus in Simple-8b files, in order of doc_id.

Documents are dealt into ranges of doc_id and sorted within them. Each task tokenizes its range and makes segments:
file images of whole documents. The table of segments in the shared folder is the set of files, written by Spark's
committer, so a lost executor leaves no half file; ``export`` writes them as plain files.

The tokenizers library makes all ids. As byte-pair merges never cross pre-tokens, each distinct pre-token is sent to
the library once per worker and its ids are kept in arrays (at most ``CACHE`` pre-tokens, then afresh); texts that
contain an added token's string go to the library whole, and so do all texts where the tokenizer's file asks for anything
but plain byte-level byte pairs. Pre-tokens are told apart by 64 bits: two of a full cache share a name with a chance
below 1e-6. A long text is encoded in stretches, cut before a blank between two words, where a pre-token always begins.

Edge cases: null and empty texts have the end id alone; repeated rows are written again; null doc_ids come first and
are stored as the least 64-bit number; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import simple8b
from . import textbytes as tb
from .store import materialize

END_ID = 2
SEGMENT = 1 << 20
CACHE = 3_000_000
#: Characters of a long text encoded together.
STRETCH = 1 << 20
NO_ID = -(2**63)
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_BORDER = regex.compile(r"(?<=\S) (?=\S)")


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point, from the patterns of the pre-tokenizer."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
    out = np.zeros(0x110000, np.uint8)
    for pattern, value in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for m in regex.finditer(pattern, every):
            out[m.start():m.end()] = value
    return out


def pre_tokens(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First code point of each pre-token of byte-level BPE; texts don't run together.

    Runs of letters, numbers and other signs take one blank before them. Of a run of white space before something
    else the last one is apart. An apostrophe that starts a run takes the letters of a short English ending.
    """
    n = len(points)
    kind = _classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
    space = kind == _SPACE
    ends = np.ones(n, bool)
    ends[:-1] = start[1:]
    final = edge[1:n + 1]
    last = space & ends & ~final
    start |= last
    blank = last & (points == 32)
    start[1:] &= ~blank[:-1]
    quote = np.flatnonzero((points == 39) & start & ends & ~final)
    if len(quote):
        rest = np.concatenate([points, np.zeros(3, points.dtype)])
        a, b = rest[quote + 1], rest[quote + 2]
        two = np.concatenate([edge, np.ones(2, bool)])[quote + 2]
        pair = ~two & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        one = np.isin(a, [115, 116, 109, 100])
        start[quote[one | pair] + 1] = False
        for at in (quote[one] + 2, quote[pair & ~one] + 3):
            at = at[at < n]
            start[at] = True
    return np.flatnonzero(start)


def stretches(text: str) -> Iterator[str]:
    """A text in parts of ``STRETCH`` characters or a little more, each from a blank between two words on."""
    at = 0
    while len(text) - at > STRETCH and (m := _BORDER.search(text, at + STRETCH)):
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


class Encoder:
    """Ids of texts through the library, one call per distinct pre-token."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        cut, model = made["pre_tokenizer"] or {}, made["model"]
        #: Whether texts part into pre-tokens as ``pre_tokens`` says, and ids depend on nothing else.
        self.plain = (made["normalizer"] is None and made["truncation"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
                      and model["type"] == "BPE" and not model.get("dropout") and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _ask(self, tokens: list[str]) -> list[list[int]]:
        """Pre-tokens of a blank and letters are sent in runs, as they part again in the same places; others alone."""
        out: list[list[int]] = [[]] * len(tokens)
        plain = [i for i, t in enumerate(tokens) if t[0] == " " and t[1:].isalpha()]
        alone = sorted(set(range(len(tokens))) - set(plain))
        for i, e in zip(alone, self.tokenizer.encode_batch([tokens[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = e.ids
        runs = [plain[i:i + 256] for i in range(0, len(plain), 256)]
        for run, e in zip(runs, self.tokenizer.encode_batch(["".join(tokens[i] for i in r) for r in runs], add_special_tokens=False), strict=True):
            ids, at = np.array(e.ids), np.array(e.word_ids)
            parts = np.split(ids, np.flatnonzero(np.diff(at)) + 1)
            if len(parts) != len(run):
                parts = [self.tokenizer.encode(tokens[i], add_special_tokens=False).ids for i in run]
            for i, p in zip(run, parts, strict=True):
                out[i] = p
        return out

    def learn(self, keys: np.ndarray, tokens: list[str]) -> None:
        found = self._ask(tokens)
        count = np.array([len(x) for x in found], np.int64)
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, *(np.asarray(x, np.uint32) for x in found)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.count = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.count, at, count)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each text's."""
        if not self.plain:
            found = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        if all(len(t) <= STRETCH for t in texts) or any(_BORDER.search(a) for a in self.added):
            return self._encode(texts)
        ids, sizes = [np.zeros(0, np.uint32)], []
        for t in texts:
            n = 0
            for part in stretches(t):
                ids.append(self._encode([part])[0])
                n += len(ids[-1])
            sizes.append(n)
        return np.concatenate(ids), np.array(sizes, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        special = {i: self.tokenizer.encode(texts[i], add_special_tokens=False).ids for i in whole}
        plain = ["" if i in special else t for i, t in enumerate(texts)] if special else texts
        joined = "".join(plain)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in plain])]).astype(np.int64)
        if not len(points):
            ids, sizes = np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        else:
            raw = np.frombuffer(joined.encode(), np.uint8)
            byte_at = np.concatenate([np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]])
            begin = pre_tokens(points, starts)
            end = np.append(begin[1:], len(points))
            keys, first_of, which = np.unique(tb.span_hashes(raw, byte_at[begin], byte_at[end], lower=False), return_index=True, return_inverse=True)
            if len(self.keys) > CACHE:
                self.clear()
            at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
            if len(new):
                self.learn(keys[new], [joined[begin[i]:end[i]] for i in first_of[new].tolist()])
                at = np.searchsorted(self.keys, keys)
            n = self.count[at][which]
            upto = np.cumsum(n)
            ids = self.ids[np.arange(upto[-1]) + np.repeat(self.first[at][which] - (upto - n), n)]
            token_at = np.searchsorted(begin, starts)
            sizes = np.diff(np.concatenate([[0], upto])[token_at])
        if special:
            cut = np.split(ids, np.cumsum(sizes)[:-1])
            for i, x in special.items():
                cut[i], sizes[i] = np.array(x, np.uint32), len(x)
            ids = np.concatenate(cut)
        return ids, sizes


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """file, seq, n_ids, image: the segments, written to the shared folder. Files are in order of doc_id, as are segments in a file."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def segment() -> pa.RecordBatch:
            ids, sizes, values = (np.concatenate(x) for x in zip(*held, strict=True))
            image = simple8b.to_image(ids, sizes, values)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(values)], pa.int64()), pa.array([image], pa.binary())], names=["file", "seq", "n_ids", "image"])

        for batch in tb.pieces(batches):
            ids, sizes = coder.encode(["" if x is None else x for x in batch.column("text").to_pylist()])
            sizes = sizes + 1
            values = np.full(sizes.sum(), end_id, np.uint32)
            own = np.ones(len(values), bool)
            own[np.cumsum(sizes) - 1] = False
            values[own] = ids
            held.append((batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(), sizes, values))
            if sum(len(x[2]) for x in held) >= SEGMENT:
                yield segment()
                held, seq = [], seq + 1
        if held:
            yield segment()

    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(run, "file int, seq int, n_ids long, image binary"), "tokens", "uncompressed")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    by_file = files.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    by_file = by_file.select(F.col("file").alias("b_file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    within = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("seq_start"))
    base = base.join(by_file, base["file"] == by_file["b_file"]).select(F.col("file").alias("b_file"), F.col("seq").alias("b_seq"), (F.col("file_start") + F.col("seq_start")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, seq, image in zip(*(batch.column(c).to_pylist() for c in ("file", "seq", "image")), strict=True):
                ids, sizes, values = simple8b.from_image(image)
                data, at = memoryview(values.astype("<u4").tobytes()), np.concatenate([[0], np.cumsum(sizes)])
                crc = [zlib.crc32(data[4 * a:4 * z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), file, np.int32)), pa.array(np.full(len(ids), seq, np.int32)), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(at[:-1]), pa.array(sizes), pa.array(crc, pa.int64())],
                                                 names=["file", "seq", "doc_id", "within", "n_tokens", "ids_crc32"])

    read = files.select("file", "seq", "image").mapInArrow(run, "file int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return (read.join(base, (read["file"] == base["b_file"]) & (read["seq"] == base["b_seq"]))
            .select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"))


def export(files: DataFrame, folder: str) -> None:
    """Each segment as a plain file in a folder that this driver can write; segments come one at a time."""
    for row in files.orderBy("file", "seq").toLocalIterator():
        with open(f"{folder}/{row['file']:06d}-{row['seq']:06d}.s8b", "wb") as f:
            f.write(row["image"])
