"""Simple-8b word-aligned coding of whole numbers, coded and decoded in whole arrays.

A 64-bit word has a selector in its top 4 bits; the others hold a number of values of equal width. Selector 0 is an
escape: the next word is one raw value (of 61 to 64 bits). Values come in blocks of ``BLOCK``; each block's first word
has an offset, so blocks decode independently, and all words of one selector are unpacked together.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 512
#: Values and bits of each for selectors 0 to 15; 0 is the escape, 1 a run of zeros.
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
_COUNT = np.array(COUNTS)
MAGIC = b"CW8B"
HEADER = struct.Struct("<4sIQIII")


def bit_lengths(v: np.ndarray) -> np.ndarray:
    out = np.zeros(v.shape, np.uint8)
    high = v >> np.uint64(32)
    big = high > 0
    out[...] = np.frexp(np.where(big, high, v).astype(np.float64))[1]
    return np.where(big, out + 32, out).astype(np.uint8)


def _widest(bits: np.ndarray) -> dict[int, np.ndarray]:
    """For each count c, the largest of the c entries from each place on; sums of powers of two are combined."""
    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[:, :x.shape[1] - by] = x[:, by:]
        return out

    power, width = {1: bits}, 1
    while width < max(COUNTS):
        power[2 * width] = np.maximum(power[width], ahead(power[width], width))
        width *= 2
    out = {}
    for c in set(COUNTS):
        base = 1 << (c.bit_length() - 1)
        out[c] = power[base] if base == c else np.maximum(power[base], ahead(power[base], c - base))
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and for each block its first word (one more entry at the end)."""
    values = values.astype(np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    pad = max(COUNTS)
    grid = np.zeros((blocks, BLOCK + pad), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = values
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    length = np.full(blocks, BLOCK)
    length[-1] = n - (blocks - 1) * BLOCK
    widest = _widest(bit_lengths(grid))
    chosen = np.zeros(grid.shape, np.uint8)
    for s in range(15, 0, -1):
        chosen[widest[COUNTS[s]] <= BITS[s]] = s
    rows, places = [], []
    live, at = np.arange(blocks), np.zeros(blocks, np.int64)
    while len(live):
        rows.append(live)
        places.append(at)
        at = at + _COUNT[chosen[live, at]]
        more = at < length[live]
        live, at = live[more], at[more]
    row, place = np.concatenate(rows), np.concatenate(places)
    by = np.argsort(row * np.int64(BLOCK) + place)
    row, place = row[by], place[by]
    sel = chosen[row, place]
    takes = 1 + (sel == 0)
    first = np.cumsum(takes) - takes
    words = np.zeros(int(takes.sum()), np.uint64)
    for s in range(16):
        i = np.flatnonzero(sel == s)
        if not len(i):
            continue
        if s == 0:
            words[first[i] + 1] = grid[row[i], place[i]]
            continue
        packed = np.full(len(i), np.uint64(s) << np.uint64(60))
        if BITS[s]:
            for j in range(COUNTS[s]):
                packed |= grid[row[i], place[i] + j] << np.uint64(j * BITS[s])
        words[first[i]] = packed
    offsets = np.concatenate([first[np.searchsorted(row, np.arange(blocks))], [len(words)]])
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[sel]
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(sel == 0).tolist():  # a raw word may look like any other, so escapes are followed in order
        if not raw[i]:
            raw[i + 1] = True
    counts = np.where(raw, 0, counts)
    before = np.cumsum(counts) - counts
    block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    start = block * BLOCK + before - before[offsets[block]]
    stop = np.minimum((block + 1) * BLOCK, n)
    for s in range(16):
        i = np.flatnonzero((sel == s) & ~raw)
        if not len(i) or s == 1:
            continue
        if s == 0:
            out[start[i]] = words[i + 1]
            continue
        mask = np.uint64((1 << BITS[s]) - 1)
        for j in range(COUNTS[s]):
            at = start[i] + j
            fine = at < stop[i]
            out[at[fine]] = (words[i[fine]] >> np.uint64(j * BITS[s])) & mask
    return out


def to_image(doc_ids: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> bytes:
    """A file image: header, document ids, document lengths, block offsets, words; little-endian."""
    words, offsets = encode(values)
    head = HEADER.pack(MAGIC, 1, len(values), len(doc_ids), len(offsets) - 1, BLOCK)
    return b"".join([head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def from_image(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, document lengths and values of a file image."""
    magic, version, n, docs, blocks, block = HEADER.unpack_from(image)
    if magic != MAGIC or version != 1 or block != BLOCK:
        raise ValueError("not a token file of this format")
    at = HEADER.size
    ids = np.frombuffer(image, "<i8", docs, at)
    lengths = np.frombuffer(image, "<u8", docs, at + 8 * docs)
    offsets = np.frombuffer(image, "<u8", blocks + 1, at + 16 * docs).astype(np.int64)
    words = np.frombuffer(image, "<u8", -1, at + 16 * docs + 8 * (blocks + 1))
    return ids, lengths.astype(np.int64), decode(words, offsets, n)
