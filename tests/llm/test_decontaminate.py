"""Decontamination against brute force: matches, many items that share a passage, blocks, long texts, small shards."""

import re
import time
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from corpusweave.llm import decontaminate as dc

RNG = np.random.default_rng(8)
VOCABULARY = ["alpha", "beta", "gamma", "delta", "epsilon"]


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def text(n):
    return " ".join(RNG.choice(VOCABULARY, n))


def brute(doc, items, window=13):
    """Hit words, items, whether a whole window is hit, and the left-maximal longest matches as (word, length)."""
    w, hit, names, whole, long = split(doc), set(), set(), False, {}
    for name, t in items:
        b = split(t)
        need = min(window, len(b))
        for i in range(len(b) - need + 1) if b else ():
            for p in range(len(w) - need + 1):
                n = 0
                while i + n < len(b) and p + n < len(w) and b[i + n] == w[p + n]:
                    n += 1
                if n >= need:
                    hit |= set(range(p, p + need))
                    names.add(str(name))
                    whole |= need == window
                    long[p] = max(long.get(p, 0), n)
    return len(hit), names, whole, sorted((p, n) for p, n in long.items() if long.get(p - 1, 0) <= n)


def blocks(items, n):
    tables = [pa.table({"item_id": pa.array([i for i, _ in items[k::n]], pa.int64()), "text": pa.array([t for _, t in items[k::n]], pa.string())}) for k in range(n)]
    depth = max(len(split(t)) for _, t in items)
    return [SimpleNamespace(value=t) for t in tables], depth


@pytest.mark.parametrize("n_blocks,shard_words", [(1, 1 << 19), (3, 1 << 19), (1, 50), (2, 50)])
def test_pieces_match_brute_force(monkeypatch, n_blocks, shard_words):
    monkeypatch.setattr(dc, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(dc, "PLACES", 7)
    passage = text(40)
    items = [(1, passage), (2, "x " + passage + " y"), (3, text(30)), (4, None), (5, "zeta"), (6, text(16)), (6, "alpha beta gamma delta"), (7, passage[:60])]
    docs = [None, "", text(200), "x " + passage, passage + " z " + passage[20:], text(20) + " " + passage, " ".join(split(passage)[3:25]), "Zeta zeta", text(90)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(docs))), "text": pa.array(docs, pa.string())})
    sent, depth = blocks(items, n_blocks)
    pieces = list(dc.searched(iter([batch]), sent, depth, 13, True))
    plain = list(dc.searched(iter([batch]), sent, depth, 13, False))
    at = 0
    for piece, lean in zip(pieces, plain, strict=True):
        n_items, _ = piece.items()
        matches = piece.matches().to_pylist()
        assert (piece.n_hit() == lean.n_hit()).all() and (piece.whole == lean.whole).all()
        for r in range(piece.rows):
            n_hit, names, whole, long = brute(docs[at], items)
            assert (piece.n_hit()[r], n_items[r], bool(piece.whole[r])) == (n_hit, len(names), whole)
            assert [(m["doc_word"], m["n_words"]) for m in matches[r]] == long
            w, own = split(docs[at]), dict()
            for i, t in items:
                own.setdefault(str(i), []).append(split(t))
            for m in matches[r]:
                part = w[m["doc_word"]:m["doc_word"] + m["n_words"]]
                assert any(b[m["item_word"]:m["item_word"] + m["n_words"]] == part for b in own[m["item_id"]])
            at += 1
    assert at == len(docs)


def test_a_passage_of_many_items_in_every_document_takes_bounded_memory():
    passage = text(40)
    items = [(i, f"a{i} {passage} b{i}") for i in range(300)] + [(1000 + i, "alpha") for i in range(20)]
    docs = [f"{text(20)} {passage} end" for _ in range(3000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(docs))), "text": docs})
    sent, depth = blocks(items, 1)
    tracemalloc.start()
    began = time.time()
    (piece,) = dc.searched(iter([batch]), sent, depth, 13, True)
    n, digest = piece.items()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert piece.whole.all() and n.min() >= 300 and len(set(digest)) <= 2
    assert peak < 250 << 20 and time.time() - began < 60


def test_a_very_long_text_is_searched_in_shards():
    passage = text(40)
    word = np.array([f"w{i}" for i in range(5000)])
    long = " ".join(RNG.choice(word, 3_000_000)) + " " + passage + " tail"
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [long]})
    sent, depth = blocks([(1, passage)], 1)
    tracemalloc.start()
    (piece,) = dc.searched(iter([batch]), sent, depth, 13, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert piece.n_hit()[0] == 40 and piece.matches().to_pylist()[0][0]["n_words"] == 40 and peak < 250 << 20
