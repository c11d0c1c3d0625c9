"""Very long texts through the operators that read whole texts in Python: equal results in stretches, bounded memory."""

import tracemalloc
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pytest

from corpusweave.llm import language_id, quality_crf, token_files

RNG = np.random.default_rng(31)
MB = 1 << 20


@contextmanager
def at_most(size):
    tracemalloc.start()
    yield
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < size, peak / MB


def prose(n, line=12):
    words = RNG.choice(np.array([f"word{i}" for i in range(3000)]), n)
    return "\n".join(" ".join(words[i:i + line]) for i in range(0, n, line))


@pytest.fixture(scope="module")
def long():
    return prose(2_400_000)  # 21 MB, 200,000 lines


def test_language(long):
    model = language_id.Model(["a", "b"], RNG.normal(size=(language_id.BUCKETS + 1, 3)), np.zeros(2))
    model.logits[:-1, -1], model.logits[-1] = 1, 0
    with at_most(80 * MB):
        best, score = model.predict(pa.array([long]))
    assert len(best) == 1 and 0.5 <= score[0] <= 1


def test_quality(long):
    model = quality_crf.Model(RNG.normal(size=quality_crf.WIDTH) * 0.1, 0.0, RNG.normal(size=(2, 2)), (1.0, 0.0))
    column = pa.array([long, "x" * (9 * MB), "", "a short one\nof two lines"])
    with at_most(450 * MB):
        score = model.score(column)
    alone = [model.score(column.slice(i, 1))[0] for i in range(4)]
    assert np.allclose(score, alone) and (score > 0).all() and (score < 1).all()


def test_long_chains_are_as_short_ones(monkeypatch):
    score, tie, at = RNG.normal(size=900) * 3, RNG.normal(size=(2, 2)) * 2, np.array([0, 1, 400, 403, 880, 900])
    weight = RNG.random(5)
    whole = quality_crf.forward_backward(score, at, tie, weight)
    for limit in (1, 5, 100):
        monkeypatch.setattr(quality_crf, "LONG", limit)
        part = quality_crf.forward_backward(score, at, tie, weight)
        assert all(np.allclose(x, y) for x, y in zip(whole, part, strict=True))


def test_tokens(long):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    coder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode([long[:MB]])
    with at_most(260 * MB):
        ids, n = coder.encode([long])
    assert n.tolist() == [len(ids)] and coder.tokenizer.decode(ids[:2000].tolist()) == long[:len(coder.tokenizer.decode(ids[:2000].tolist()))]
