"""Texts as byte arrays: slicing Arrow batches to bounded pieces, words and their hashes, all vectorised.

Nothing here loops over rows or characters in Python. A piece holds whole rows of at most ``PIECE`` bytes of text,
or one longer row.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

PIECE = 2 << 20
#: Bytes hashed at once; a table of powers of that length stays in each worker.
HASHED = 1 << 18
_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _lowered(values: np.ndarray) -> np.ndarray:
    out = values.copy()
    out[65:91] = values[97:123]
    return out


LOWER_BYTE = _lowered(_BYTE)
#: True at the bytes of words: all but ASCII space; and ASCII letters, digits and all beyond ASCII.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.diff(text_bytes(batch.column(column))[1])
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(size[at:at + 65536]), limit, side="right")))
            yield batch.slice(at, n)
            at += n


@lru_cache(1)
def _malloc_trim() -> Callable[[int], int] | None:
    """The C library's, if it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def give_back() -> None:
    """Returns freed memory to the system. A Python worker outlives its tasks, and while it waits would keep the most that one of them took."""
    pa.default_memory_pool().release_unused()
    if trim := _malloc_trim():
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for mapInArrow, with freed memory given back once its task is done."""
    @wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row starts (one more entry at the end); null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if offsets and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[starts[0]:starts[-1]] if data else np.zeros(0, np.uint8)
    return raw, starts - starts[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_spans(raw: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of each word; words never cross rows."""
    n = len(raw)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    word = inside[raw]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(starts, begin, side="right") - 1
    return begin, end, row


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span's bytes, never 0. Spans are in order and don't overlap; memory is bounded by runs of them."""
    out = np.zeros(len(begin), np.uint64)
    at, table, most = 0, LOWER_BYTE if lower else _BYTE, min(HASHED, PIECE)
    with np.errstate(over="ignore"):
        while at < len(begin):
            upto = max(at + 1, int(np.searchsorted(end, begin[at] + most, side="right")))
            base, stop = begin[at], end[upto - 1]
            n = int(stop - base)
            up, down = _powers(most)
            if n > most:  # one long span
                total = n
                for a in range(0, n, most):
                    part = table[raw[base + a:min(base + a + most, stop)]]
                    total += int((part * up[:len(part)]).sum(dtype=np.uint64)) * pow(int(_BASE), a, 2**64)
                out[at] = total % 2**64
                at = upto
                continue
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(table[raw[base:stop]] * up[:n], out=sums[1:])
            b, e = begin[at:upto] - base, end[at:upto] - base
            out[at:upto] = (sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64)
            at = upto
    out = mixed(out)
    out[out == 0] = 1
    return out


def stretches(raw: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Borders of stretches of about ``PIECE`` bytes that cut no word; a longer word is in one."""
    a, n = 0, len(raw)
    while a < n:
        z, step = min(a + PIECE, n), 256
        while z < n:
            gap = np.flatnonzero(~inside[raw[z:z + step]])
            if len(gap):
                z += int(gap[0])
                break
            z, step = min(z + step, n), 2 * step
        yield a, z
        a = z


def words(column: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of a column, and where each row's words start (one more entry at the end).

    A long text is read stretch by stretch, so what is held beside the result doesn't grow with it.
    """
    raw, starts = text_bytes(column)
    n, out = np.zeros(len(column), np.int64), [np.zeros(0, np.uint64)]
    for a, z in stretches(raw, inside):
        part = raw[a:z]
        begin, end, _ = word_spans(part, np.concatenate([[0], starts[(starts > a) & (starts < z)] - a, [z - a]]), inside)
        out.append(span_hashes(part, begin, end))
        n += np.bincount(np.searchsorted(starts, begin + a, side="right") - 1, minlength=len(n))
    return np.concatenate(out), np.concatenate([[0], np.cumsum(n)])


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (``n`` numbers) for each entry, one after another."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def runs(n: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive entries whose ``n`` add up to at most ``most``, or one larger entry."""
    upto, a = np.concatenate([[0], np.cumsum(n)]), 0
    while a < len(n):
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + most, side="right")) - 1)
        yield slice(a, z)
        a = z
