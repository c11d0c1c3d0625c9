"""Bucket-pointer refinement against brute force: buckets, long texts in parts, a passage in every document."""

import hashlib
from collections import Counter

import numpy as np

from corpusweave.llm import suffix_dedup as sd

RNG = np.random.default_rng(21)


def brute(data):
    first = {}
    for i, t in sorted(data, key=lambda x: x[0]):
        for p in range(len(t) - 49):
            first.setdefault(t[p:p + 50], i)
    out = Counter()
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p:p + 50]] < i:
                gone[p:p + 50] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out[(i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())] += 1
    return out


def test_window_buckets_are_those_of_the_bytes():
    text = RNG.integers(0, 2, (300, 76)).astype(np.uint8)
    text[100:200, 20:] = text[:100, 20:]
    text[200:, :60] = text[:100, :60]
    text[250:] = 7
    got = sd.window_buckets(text)
    assert got.shape == (300, 27)
    name, whose = {}, {}
    for r in range(300):
        for p in range(27):
            w = text[r, p:p + 50].tobytes()
            assert name.setdefault(w, got[r, p]) == got[r, p] and whose.setdefault(got[r, p], w) == w


def test_refining_parts_buckets_by_their_pointers():
    bucket, pointer = RNG.integers(0, 6, 200), RNG.integers(0, 4, 200)
    got = sd.refine(bucket, pointer)
    seen = {}
    for b, p, g in zip(bucket, pointer, got, strict=True):
        assert seen.setdefault(g, (b, p)) == (b, p)
    assert len(seen) == len({*zip(bucket.tolist(), pointer.tolist(), strict=True)})
    assert sorted(sd.refine(np.arange(5), np.zeros(5, int)).tolist()) == [0, 1, 2, 3, 4]


def test_minima_are_the_same_in_parts(monkeypatch):
    gram = np.sort(RNG.integers(0, 40, 500)).astype(np.uint64)
    context = RNG.integers(0, 2, (500, 2 * sd.SIDE)).astype(np.uint8)
    context[:, 2:50] = 0
    low = RNG.integers(0, 10, 500)
    n = RNG.integers(1, 15, 500)
    doc = RNG.integers(0, 99, 500)
    whole = sd.all_minima(gram, low, n, context, doc)
    monkeypatch.setattr(sd, "TOGETHER", 20)
    assert (sd.all_minima(gram, low, n, context, doc) == whole).all() and whole.max() < sd.NO_ID


def test_long_texts_are_cut_into_parts_and_joined(spark, monkeypatch):
    monkeypatch.setattr(sd, "PART", 1000)
    raw = "".join(RNG.choice(list("abcde "), 5200))
    data = [(1, raw[:3000]), (2, raw[970:2100] + "Z" * 400 + raw[100:300]), (3, "x" + raw), (4, raw[960:1040]), (5, raw[5000:5060] * 40), (6, ""), (7, "y" * 2500)]
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    got = Counter(map(tuple, sd.removed_passages(table.unionByName(spark.createDataFrame([(8, None)], "doc_id long, text string"))).collect()))
    assert got == brute([(i, t.encode()) for i, t in [*data, (8, "")]])


def test_a_passage_in_every_document(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    data = [(i, f"start {i} {'abc'[i % 3]}{passage} and then number {i * 37} ends " + "tail " * (i % 4)) for i in range(400)]
    got = Counter(map(tuple, sd.removed_passages(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()))
    assert got == brute([(i, t.encode()) for i, t in data])


def test_a_very_long_text(spark):
    """24 MB in one text: its parts are found again in two small documents, across the border of two parts."""
    words = np.array([f"w{i:05d}" for i in range(60_000)])
    raw = " ".join(RNG.choice(words, 3_600_000))
    at = sd.PART - 300
    data = [(1, raw), (2, "q " + raw[at:at + 600] + " q"), (3, raw[-5000:])]
    got = {r.doc_id: r for r in sd.removed_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[1].n_bytes == len(raw) and got[1].n_removed == 0 and got[1].kept_sha256 == hashlib.sha256(raw.encode()).hexdigest()
    assert (got[2].n_removed, got[2].n_spans, got[3].n_removed, got[3].n_spans) == (600, 1, 5000, 1) or got[2].n_removed in (601, 602)
