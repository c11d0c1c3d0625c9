"""Benchmark decontamination by suffix arrays over the training texts.

Each task turns its documents into shards of bounded size, builds the suffix array of a shard's words (prefix
doubling up to the longest benchmark item), and binary-searches the benchmark's suffixes in it. Equal windows of all
items are searched once: the range of a window gives all its places. At each such place the longest verbatim match is
that of one of the two test suffixes next to it in the order of suffixes, so what a task holds is bounded by its shard
and a benchmark block, however many items share a passage and however often a text repeats it. Nothing is shuffled.

The benchmark goes to the executors in blocks of at most ``BLOCK_BYTES``. A single block stays in a worker; several are
read one after another for each group of shards, so a worker never holds two.

``clean_documents`` removes each document with a window of ``window`` words of an item. An item with fewer words is
one window, often a common phrase, so it removes a document only where such hits are 5 % of its words or more.

Edge cases: null and blank texts have no words and are clean; items without words never match; repeated rows are
judged alike; null item ids are written as ``null``; an empty benchmark hits nothing; columns of any name pass through
``clean_documents``; a text longer than a shard is searched in several that overlap by the longest item.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb

WINDOW = 13
BLOCK_BYTES = 8 << 20
SHARD_WORDS = 1 << 19
#: Places of windows looked at together, and shards searched with one reading of a block where there are several.
PLACES = 1 << 20
GROUP = 4
MATCH = pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())])
SCHEMA = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "matches array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def suffix_array(tokens: np.ndarray, vocabulary: int, depth: int) -> np.ndarray:
    """Suffixes of ``tokens`` (ranks below ``vocabulary``) in order of their first ``depth`` tokens, by prefix doubling."""
    n = len(tokens)
    bits = max(1, int(vocabulary).bit_length())
    width = max(1, min(62 // bits, depth))
    padded = np.concatenate([tokens.astype(np.int64) + 1, np.zeros(width, np.int64)])
    key = padded[:n].copy()
    for j in range(1, width):
        key = (key << bits) | padded[j:j + n]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.empty(n + 1, np.int64)
    group[n] = -1
    group[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    reach = width
    while reach < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        mine = order[at]
        key = group[mine] * (n + 2) + group[np.minimum(mine + reach, n)] + 1
        by = np.argsort(key, kind="stable")
        order[at], key = mine[by], key[by]
        new[at] = np.concatenate([[True], key[1:] != key[:-1]])
        group[order[at]] = np.maximum.accumulate(np.where(new[at], at, 0))
        reach *= 2
    return order


def flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


class Benchmark:
    """A block of benchmark items: their words in a row, each item followed by a 0, and their distinct windows.

    ``begins`` are the words where a window starts, ``window`` the window's number; ``rep`` and ``need`` are the place and
    length of each distinct window, ``set`` the number of the set of items that have it.
    """

    def __init__(self, items: pa.Table, window: int):
        hashes, starts = tb.words(flat(items.column("text")), tb.ALNUM)
        ids = np.array(["null" if x is None else str(x) for x in items.column("item_id").to_pylist()], object)
        self.names, name = np.unique(ids, return_inverse=True)
        n = np.diff(starts)
        item = np.repeat(np.arange(len(n)), n)
        self.words = np.insert(hashes, starts[1:], 0)
        self.at = np.arange(len(hashes)) + item
        start = starts[:-1] + np.arange(len(n))
        self.word, self.left, self.name = self.at - start[item], (start + n)[item] - self.at, name[item]
        need = np.minimum(window, n)[item]
        self.begins = np.flatnonzero(self.left >= need)
        at, need = self.at[self.begins], need[self.begins]
        with np.errstate(over="ignore"):
            key = need.astype(np.uint64) * _GOLD
            for j in range(int(need.max()) if len(need) else 0):
                on = need > j
                key[on] = tb.mixed(key[on] * np.uint64(5) + self.words[at[on] + j])
            _, first, self.window = np.unique(key, return_index=True, return_inverse=True)
            self.rep, self.need = at[first], need[first]
            pair = np.unique(self.window * len(self.names) + self.name[self.begins])
            of, member = (pair // len(self.names), pair % len(self.names)) if len(pair) else (pair, pair)
            edge = np.searchsorted(of, np.arange(len(first) + 1))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mixed(member.astype(np.uint64) + _GOLD), dtype=np.uint64)])
            _, one, self.set = np.unique(sums[edge[1:]] - sums[edge[:-1]], return_index=True, return_inverse=True)
        self.set_size = (edge[1:] - edge[:-1])[one]
        self.members = member[tb.spread(edge[one], self.set_size)]
        self.set_start = np.cumsum(self.set_size) - self.set_size


def compare(query: np.ndarray, q: np.ndarray, text: np.ndarray, p: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common length of query[q:] and text[p:], up to ``most``; and where the query is larger beyond it."""
    lcp, larger = np.zeros(len(q), np.int64), np.zeros(len(q), bool)
    active = np.arange(len(q))
    d = 0
    while len(active):
        active = active[most[active] > d]
        x, y = query[q[active] + d], text[p[active] + d]
        same = x == y
        larger[active] = ~same & (x > y)
        active = active[same]
        d += 1
        lcp[active] = d
    return lcp, larger


def bound(query: np.ndarray, q: np.ndarray, text: np.ndarray, order: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of each query suffix's first ``most`` words: the first suffix not below it, or the first above it."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) // 2
        lcp, larger = compare(query, q[open_], text, order[mid], most[open_])
        go = larger | (upper & (lcp == most[open_]))
        low[open_] = np.where(go, mid + 1, low[open_])
        high[open_] = np.where(go, high[open_], mid)
        open_ = open_[low[open_] < high[open_]]
    return low


class Shard:
    """The suffix array of some words; 0 ends each document and the shard, and is in no query."""

    def __init__(self, tokens: np.ndarray, depth: int):
        self.vocabulary, ranks = np.unique(np.append(tokens, np.uint64(0)), return_inverse=True)
        self.order = suffix_array(ranks, len(self.vocabulary), max(depth, 1))
        self.text = np.append(ranks.astype(np.int64), 0)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ranks, minlength=len(self.vocabulary)))])

    def windows(self, b: Benchmark) -> tuple[np.ndarray, ...]:
        """The block's words as ranks of this shard, the distinct windows that occur, and each one's range in the suffix array."""
        at = np.minimum(np.searchsorted(self.vocabulary, b.words), len(self.vocabulary) - 1)
        query = np.where((self.vocabulary[at] == b.words) & (b.words > 0), at, -1)
        unknown = np.concatenate([[0], np.cumsum(query < 0)])
        k = np.flatnonzero(unknown[b.rep + b.need] == unknown[b.rep])
        q, need = b.rep[k], b.need[k]
        low = bound(query, q, self.text, self.order, need, self.first[query[q]], self.first[query[q] + 1], False)
        high = bound(query, q, self.text, self.order, need, low, self.first[query[q] + 1], True)
        some = np.flatnonzero(high > low)
        return query, k[some], low[some], high[some]

    def nearest(self, b: Benchmark, query: np.ndarray, k: np.ndarray, low: np.ndarray, high: np.ndarray) -> "Nearest":
        return Nearest(self, b, query, k, low, high)


class Nearest:
    """The benchmark suffixes that begin with some windows, in the order of a shard's suffixes.

    ``k`` has windows of one length in the order of their ranges, which don't overlap. A suffix is inserted at a place of its
    window's range; of those inserted at one place, the one with the longest match stands next to it on either side.
    """

    def __init__(self, shard: Shard, b: Benchmark, query: np.ndarray, k: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.shard, self.b, self.query, self.low, self.high = shard, b, query, low, high
        nth = np.full(len(b.rep), -1)
        nth[k] = np.arange(len(k))
        mine = np.flatnonzero(nth[b.window] >= 0)
        c, s = nth[b.window[mine]], b.begins[mine]
        q, left = b.at[s], b.left[s]
        x = bound(query, q, shard.text, shard.order, left, low[c], high[c], False)
        self.sides = []
        for near, fine in ((x, x < high[c]), (x - 1, x > low[c])):
            i = np.flatnonzero(fine)
            lcp, _ = compare(query, q[i], shard.text, shard.order[near[i]], left[i])
            by = np.lexsort((b.word[s[i]], b.name[s[i]], -lcp, x[i] + c[i]))
            key = (x[i] + c[i])[by]
            one = np.ones(len(key), bool)
            one[1:] = key[1:] != key[:-1]
            self.sides.append((key[one], s[i][by][one]))

    def longest(self, i: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest match at each place ``i`` of the suffix array, in the range of window ``c``, and its suffix."""
        length, which = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for side, (key, s) in enumerate(self.sides):
            at = np.searchsorted(key, i + c, side="right") - (1 - side)
            fine = (at >= 0) & (at < len(key))
            f = np.flatnonzero(fine)
            f = f[key[at[f]] >= self.low[c[f]] + c[f]] if side == 0 else f[key[at[f]] <= self.high[c[f]] + c[f]]
            own = s[at[f]]
            lcp, _ = compare(self.query, self.b.at[own], self.shard.text, self.shard.order[i[f]], self.b.left[own])
            better = lcp > length[f]
            length[f[better]], which[f[better]] = lcp[better], own[better]
        return length, which


class Piece:
    """Some documents and what the benchmark's blocks hit in them."""

    def __init__(self, batch: pa.RecordBatch, depth: int, window: int, detail: bool):
        self.batch, self.depth, self.window, self.detail = batch, max(depth, 1), window, detail
        hashes, starts = tb.words(batch.column("text"), tb.ALNUM)
        self.n_words, self.rows = np.diff(starts), batch.num_rows
        self.tokens = np.insert(hashes, starts[1:], 0)
        self.base = starts + np.arange(self.rows + 1)
        self.edge = np.zeros(len(self.tokens) + 1, np.int32)
        self.whole = np.zeros(self.rows, bool)  # has a window of full length
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # names, row, index of the name
        self.length: np.ndarray | None = None  # of the longest match at each word, and where it is from
        self.names: list[np.ndarray] = []
        self.held: Shard | None = None

    def shards(self) -> Iterator[tuple[int, int, Shard]]:
        n = len(self.tokens)
        for a in range(0, n, SHARD_WORDS):
            z = min(n, a + SHARD_WORDS)
            if z - a < n:
                yield a, z, Shard(self.tokens[a:z + self.depth - 1], self.depth)
            else:
                self.held = self.held or Shard(self.tokens, self.depth)
                yield a, z, self.held

    def search(self, b: Benchmark) -> None:
        pairs = [np.zeros(0, np.int64)]
        for a, z, shard in self.shards():
            query, k, low, high = shard.windows(b)
            for need in np.unique(b.need[k]).tolist():
                own = np.flatnonzero(b.need[k] == need)
                own = own[np.argsort(low[own])]
                at, first, n = k[own], low[own], high[own] - low[own]
                near = shard.nearest(b, query, at, first, first + n) if self.detail else None
                for part in tb.runs(n, PLACES):
                    c = np.repeat(np.arange(part.start, part.stop), n[part])
                    i = tb.spread(first[part], n[part])
                    mine = shard.order[i] < z - a
                    c, i = c[mine], i[mine]
                    p = shard.order[i] + a
                    np.add.at(self.edge, p, 1)
                    np.add.at(self.edge, p + need, -1)
                    row = np.searchsorted(self.base, p, side="right") - 1
                    self.whole[row] |= need >= self.window
                    if near:
                        pairs.append(np.unique(row * len(b.set_size) + b.set[at[c]]))
                        self.note(b, p, *near.longest(i, c))
        pair = np.unique(np.concatenate(pairs))
        if len(pair):
            row, s = pair // len(b.set_size), pair % len(b.set_size)
            pair = np.unique(np.repeat(row, b.set_size[s]) * len(b.names) + b.members[tb.spread(b.set_start[s], b.set_size[s])])
            self.found.append((b.names, pair // len(b.names), pair % len(b.names)))
            self.names.append(b.names)

    def note(self, b: Benchmark, p: np.ndarray, length: np.ndarray, suffix: np.ndarray) -> None:
        if self.length is None:
            self.length = np.zeros(len(self.tokens), np.int32)
            self.block, self.item, self.word = (np.zeros(len(self.tokens), np.int32) for _ in range(3))
        better = length > self.length[p]
        p, suffix = p[better], suffix[better]
        self.length[p], self.block[p], self.item[p], self.word[p] = length[better], len(self.names), b.name[suffix], b.word[suffix]

    def n_hit(self) -> np.ndarray:
        covered = np.concatenate([[0], np.cumsum(np.cumsum(self.edge)[:-1] > 0)])
        return covered[self.base[1:] - 1] - covered[self.base[:-1]]

    def contaminated(self) -> np.ndarray:
        n = self.n_hit()
        return (n > 0) & (20 * n >= self.n_words)

    def items(self) -> tuple[np.ndarray, list[str]]:
        """Number of items with a window in each row, and the digest of their ids."""
        n, digest = np.zeros(self.rows, np.int64), [hashlib.sha256().hexdigest()] * self.rows
        if self.found:
            names = np.unique(np.concatenate([x[np.unique(i)] for x, _, i in self.found]))
            pair = np.unique(np.concatenate([row * len(names) + np.searchsorted(names, x[i]) for x, row, i in self.found]))
            row, name = pair // len(names), names[pair % len(names)]
            n = np.bincount(row, minlength=self.rows)
            upto = np.cumsum(n)
            for r in np.flatnonzero(n).tolist():
                digest[r] = hashlib.sha256(",".join(name[upto[r] - n[r]:upto[r]]).encode()).hexdigest()
        return n, digest

    def matches(self) -> pa.Array:
        """The longest matches that none of the word before them goes on to cover."""
        if self.length is None:
            return pa.array([[]] * self.rows, pa.list_(MATCH))
        start = self.length > 0
        start[1:] &= self.length[:-1] <= self.length[1:]
        p = np.flatnonzero(start)
        row = np.searchsorted(self.base, p, side="right") - 1
        every = np.concatenate(self.names)
        skip = np.cumsum([0, *map(len, self.names)])[self.block[p]]
        made = pa.StructArray.from_arrays([pa.array(every[skip + self.item[p]], pa.string()), pa.array(self.word[p]), pa.array((p - self.base[row]).astype(np.int32)), pa.array(self.length[p])], fields=list(MATCH))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(self.rows + 1)), pa.int32()), made)


def searched(batches: Iterator[pa.RecordBatch], sent: list[Broadcast], depth: int, window: int, detail: bool) -> Iterator[Piece]:
    """The pieces of ``batches`` after a search for every block; of several blocks a worker holds one at a time."""
    only = Benchmark(sent[0].value, window) if len(sent) == 1 else None
    parts = tb.pieces(batches)
    while group := [Piece(x, depth, window, detail) for x in islice(parts, 1 if only else GROUP)]:
        for x in sent:
            b = only or Benchmark(x.value, window)
            for piece in group:
                piece.search(b)
            if not only:
                vars(x).pop("_value", None)  # read again from the executor's disk for the next group
        yield from group


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[list[Broadcast], int]:
    """Broadcasts of the benchmark in blocks, and the words of its longest item. A block's bytes are checked before it is
    fetched; only one is held by the driver at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    sent, depth = [], 1
    for i in range(n):
        block = (items.where(part == i) if n > 1 else items).toArrow()
        depth = max(depth, int(np.diff(tb.words(flat(block.column("text")), tb.ALNUM)[1]).max(initial=1)))
        sent.append(spark.sparkContext.broadcast(block))
    return sent, depth


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per document: counts, digest, verdict and the longest verbatim matches with their locations.

    ``matches`` has, for each word where a hit begins, the longest match from there on with an item that has it, but for
    those that lie within the match of the word before.
    """
    sent, depth = benchmark_blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in searched(batches, sent, depth, window, True):
            n_items, digest = x.items()
            made = [x.batch.column("doc_id").cast(pa.int64()), pa.array(x.n_words, pa.int64()), pa.array(x.n_hit(), pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest), pa.array(x.contaminated()), x.matches()]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches"])

    return docs.select("doc_id", "text").mapInArrow(tb.tidied(run), SCHEMA)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a window of full length, and with less than 5 % hits of shorter items, with all their columns, in one pass."""
    sent, depth = benchmark_blocks(benchmark)
    plain = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in searched(batches, sent, depth, window, False):
            yield x.batch.filter(pa.array(~(x.whole | x.contaminated())))

    return docs.mapInArrow(tb.tidied(run), plain)
