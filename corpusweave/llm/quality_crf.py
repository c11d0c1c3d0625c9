"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are binned ratios (symbols, shouting, capitals, digits, repeated
words, word and line length, repetition of an earlier line), its own and those of both neighbours; two more weights
tie neighbouring labels. The CRF is fitted to the labels of a sample of documents, which their lines inherit, by the
gradient of the likelihood from forward-backward. A document's quality is the mean of its lines' marginals, weighted
by line length, and a logistic scale of it makes the score.

The fit uses at most ``SAMPLE_ROWS`` labelled rows of at most ``SAMPLE_BYTES`` each; scores use whole texts. Edge
cases: null and empty texts are one empty line; without labels every score is 0.5; repeated rows score alike; rows
with several labels count with each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .sampling import held_out, labelled_sample

SAMPLE_ROWS = 4000
SAMPLE_BYTES = 64 << 10
STEPS = 150
#: Bytes of text, and lines, looked at together.
STRETCH = 1 << 20
LINES = 1 << 15
#: Lines of a chain that is scanned by itself.
LONG = 4096


def _class(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_UPPER, _DIGIT, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _DIGIT[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
COUNTS = (_class("#*$%&<>|"), _class("!"), _UPPER, _DIGIT, _LETTER, _class(".,;:?"), _class("|"))
RATIO = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
LENGTH = np.array([1, 2, 4, 8, 16, 40, 100])
EACH = 8
METRICS = 12
#: Own, previous and next line's bins; before the first and after the last line a bin of their own.
WIDTH = 3 * METRICS * (EACH + 1)


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of each line (3 x METRICS), line lengths in bytes, and where each row's lines start."""
    raw, starts = tb.text_bytes(column)
    rows = len(starts) - 1
    breaks = np.flatnonzero(raw == 10)
    row = np.searchsorted(starts, breaks, side="right") - 1
    at = np.concatenate([[0], np.cumsum(1 + np.bincount(row, minlength=rows))])
    begin = np.empty(at[-1], np.int64)
    begin[at[:-1]] = starts[:-1]
    begin[at[row] + 1 + np.arange(len(breaks)) - np.searchsorted(breaks, starts[row])] = breaks + 1
    end = np.empty(at[-1], np.int64)
    end[:-1] = begin[1:] - 1
    end[at[1:] - 1] = starts[1:]
    size = end - begin
    counts = np.zeros((len(COUNTS), len(size)), np.int64)
    n, again, line_hash = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), np.zeros(len(size), np.uint64)
    for part in tb.runs(size + 1, STRETCH):
        piece = raw[begin[part.start]:end[part.stop - 1]]
        b, e = begin[part] - begin[part.start], end[part] - begin[part.start]
        hashes, first = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for low, high in tb.stretches(piece, tb.SPACED):  # several where one line is long
            cut, b_in, e_in = piece[low:high], np.clip(b, low, high) - low, np.clip(e, low, high) - low
            for i, table in enumerate(COUNTS):
                sums = np.concatenate([[0], np.cumsum(table[cut], dtype=np.int64)])
                counts[i, part] += sums[e_in] - sums[b_in]
            w_begin, w_end, _ = tb.word_spans(cut, np.unique(np.concatenate([[0], b_in, [high - low]])), tb.SPACED)
            hashes.append(tb.span_hashes(cut, w_begin, w_end))
            first.append(w_begin + low)
        h, w_begin = np.concatenate(hashes), np.concatenate(first)
        low, high = np.searchsorted(w_begin, b), np.searchsorted(w_begin, e)
        n[part] = high - low
        line = np.searchsorted(b, w_begin, side="right") - 1
        repeat = np.zeros(len(h) + 1, np.int64)
        for back in (1, 2):
            repeat[back + 1:] |= (h[back:] == h[:-back]) & (line[back:] == line[:-back])
        repeat = np.cumsum(repeat)
        again[part] = repeat[high] - repeat[low]
        some = np.flatnonzero(size[part] > 0)
        line_hash[part.start + some] = tb.span_hashes(piece, b[some], e[some])
    of = np.repeat(np.arange(rows), np.diff(at))
    by = np.lexsort((line_hash, of))
    seen = np.zeros(len(size), bool)
    seen[by[1:]] = (line_hash[by[1:]] == line_hash[by[:-1]]) & (of[by[1:]] == of[by[:-1]]) & (line_hash[by[1:]] > 0)
    per_word, per_byte = np.maximum(n, 1), np.maximum(size, 1)
    ratio = lambda x, y: np.digitize(x / y, RATIO).astype(np.int16)
    symbols, bangs, upper, digits, letters, stops, pipes = counts
    bins = np.stack([ratio(symbols, per_word), ratio(bangs, per_word), ratio(upper, np.maximum(letters, 1)), ratio(digits, per_byte), ratio(letters, per_byte), ratio(stops, per_word),
                     ratio(pipes, per_word), ratio(again, per_word), np.digitize(n, LENGTH).astype(np.int16), np.digitize(letters / per_word, LENGTH * 0.5 + 1.5).astype(np.int16),
                     seen.astype(np.int16), np.digitize(np.diff(at)[of], LENGTH).astype(np.int16)], axis=1)
    out = np.empty((len(size), 3, METRICS), np.int16)
    edge_first, edge_last = np.zeros(len(size), bool), np.zeros(len(size), bool)
    edge_first[at[:-1]] = edge_last[at[1:] - 1] = True
    out[:, 0] = bins
    out[1:, 1], out[:-1, 2] = bins[:-1], bins[1:]
    out[edge_first, 1] = out[edge_last, 2] = EACH
    return out.reshape(len(size), -1) + np.arange(3 * METRICS, dtype=np.int16) * np.int16(EACH + 1), size, at


def scan(local: np.ndarray, pot: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States along one chain, each the one before times ``pot`` times the line's ``local``, normalised, and the logarithms of the norms.

    The chain is cut into as many blocks as a block has lines. All blocks advance together, first from both labels at once,
    which tells the state each begins with, then from that: steps grow with the square root of the lines.
    """
    n = len(local)
    width = max(1, int(np.ceil(np.sqrt(n))))
    blocks = np.ones((-(-n // width) * width, 2))
    blocks[:n] = local
    blocks = blocks.reshape(-1, width, 2)
    through = np.broadcast_to(np.eye(2), (len(blocks), 2, 2))
    for j in range(width):
        through = (through @ pot) * blocks[:, j, None, :]
        through = through / through.sum(axis=(1, 2), keepdims=True)
    entry = np.empty((len(blocks), 2))
    for k, t in enumerate(through):
        entry[k] = state
        state = state @ t
        state = state / state.sum()
    states, logs = np.empty(blocks.shape), np.empty(blocks.shape[:2])
    for j in range(width):
        entry = (entry @ pot) * blocks[:, j]
        norm = entry.sum(axis=1)
        entry = entry / norm[:, None]
        states[:, j], logs[:, j] = entry, np.log(norm)
    return states.reshape(-1, 2)[:n], logs.ravel()[:n]


def long_chain(local: np.ndarray, pot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised forward and backward states of one chain, logarithms of its norms, and its expected label pairs."""
    first, last = local[0].sum(), local[-1].sum()
    ahead, logs = scan(local[1:], pot, local[0] / first)
    ahead, logs = np.concatenate([local[:1] / first, ahead]), np.concatenate([[np.log(first)], logs])
    after, _ = scan(local[-2::-1], pot.T, local[-1] / last)
    after = np.concatenate([after[::-1], local[-1:] / last])
    back = np.ones_like(ahead)
    back[:-1] = after[1:] @ pot.T
    both = ahead[:-1, :, None] * pot[None] * after[1:, None, :]
    return ahead, back / back.sum(axis=1, keepdims=True), logs, (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def forward_backward(score: np.ndarray, at: np.ndarray, tie: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of "good", expected label pairs (2 x 2, each chain's times its ``weight``) and log of the partition sum of each chain.

    ``score``: by line, of good against bad. Chains advance together, longest first, so a step is a slice; those of more
    than ``LONG`` lines are scanned block by block.
    """
    n = np.diff(at)
    weight = np.ones(len(n)) if weight is None else weight
    order = np.argsort(-n, kind="stable")
    first, n, weight = at[:-1][order], n[order], weight[order]
    apart = int((n > LONG).sum())  # they come first
    most = int(n[apart]) if len(n) > apart else 0
    live = np.searchsorted(-n[apart:], -np.arange(most), side="left")
    emit = np.stack([np.zeros(len(score)), score], axis=1)
    ahead, back, logs = np.zeros_like(emit), np.zeros_like(emit), np.zeros(len(score))
    pot = np.exp(tie)
    shift = emit.max(axis=1)
    local = np.exp(emit - shift[:, None])
    pairs = np.zeros((2, 2))
    for f, m, w in zip(first[:apart].tolist(), n[:apart].tolist(), weight[:apart], strict=True):
        own = slice(f, f + m)
        ahead[own], back[own], norms, two = long_chain(local[own], pot)
        logs[own], pairs = norms + shift[own], pairs + w * two
    first, n, weight = first[apart:], n[apart:], weight[apart:]
    state = None
    for t in range(most):
        i = first[:live[t]] + t
        state = local[i] if t == 0 else (state[:live[t]] @ pot) * local[i]
        norm = state.sum(axis=1)
        state = state / norm[:, None]
        ahead[i], logs[i] = state, np.log(norm) + shift[i]
    back[first + n - 1] = 1
    for t in range(most - 2, -1, -1):
        i = first[:live[t + 1]] + t
        after = back[i + 1] * local[i + 1]
        b = after @ pot.T
        both = ahead[i][:, :, None] * pot[None] * after[:, None, :]
        pairs += (both * (weight[:len(i)] / both.sum(axis=(1, 2)))[:, None, None]).sum(axis=0)
        back[i] = b / b.sum(axis=1, keepdims=True)
    both = ahead * back
    return both[:, 1] / both.sum(axis=1), pairs, np.add.reduceat(logs, at[:-1]) if len(at) > 1 else np.zeros(0)


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    tie: np.ndarray
    scale: tuple[float, float]

    def lines(self, features: np.ndarray) -> np.ndarray:
        """Score of each line of being good against bad, by itself and its neighbours' features."""
        parts = [self.weight[features[a:a + LINES]].sum(axis=1) for a in range(0, len(features), LINES)]
        return np.concatenate([*parts, np.zeros(0)]) + self.bias

    def quality(self, features: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log odds of the length-weighted mean marginal of each document."""
        good, _, _ = forward_backward(self.lines(features), at, self.tie)
        w = size + 1.0
        q = np.add.reduceat(good * w, at[:-1]) / np.add.reduceat(w, at[:-1])
        q = np.clip(q, 1e-6, 1 - 1e-6)
        return np.log(q / (1 - q))

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        return 1 / (1 + np.exp(-(self.scale[0] * self.quality(*line_features(column)) + self.scale[1])))


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    model = Model(np.zeros(WIDTH), 0.0, np.zeros((2, 2)), (1.0, 0.0))
    if len(set(labels.tolist())) < 2:
        return model
    features, size, at = line_features(texts)
    n = np.diff(at)
    y = np.repeat(labels, n).astype(float)
    # A document counts once, however many lines it has, and both labels count alike.
    doc = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    part = np.repeat(doc / n, n)
    linked = np.ones(len(y), bool)
    linked[at[1:] - 1] = False
    real = np.zeros((2, 2))
    inner = np.flatnonzero(linked)
    np.add.at(real, (y[inner].astype(int), y[inner + 1].astype(int)), part[inner])
    theta = np.zeros(WIDTH + 1 + 4)
    m, v, flat = np.zeros_like(theta), np.zeros_like(theta), features.ravel().astype(np.int64)
    for step in range(1, STEPS + 1):
        model.weight, model.bias, model.tie = theta[:WIDTH], theta[WIDTH], theta[WIDTH + 1:].reshape(2, 2)
        good, pairs, _ = forward_backward(model.lines(features), at, model.tie, doc / n)
        miss = (y - good) * part
        grad = np.zeros_like(theta)
        grad[:WIDTH] = np.bincount(flat, np.repeat(miss, features.shape[1]), WIDTH)
        grad[WIDTH] = miss.sum()
        grad[WIDTH + 1:] = (real - pairs).ravel()
        grad -= 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        theta = theta + 0.08 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    model.weight, model.bias, model.tie = theta[:WIDTH], float(theta[WIDTH]), theta[WIDTH + 1:].reshape(2, 2)
    z, a, b = model.quality(features, size, at), 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(a * z + b)))
        s, g = p * (1 - p) + 1e-6, labels - p
        h = np.array([[(s * z * z).sum() + 1, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        a, b = np.array([a, b]) + 0.5 * np.linalg.solve(h, [(g * z).sum() - (a - 1), g.sum()])
    model.scale = (float(max(a, 1e-3)), float(b))
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    marked = labels.where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    t = labelled_sample(docs, marked, SAMPLE_ROWS, SAMPLE_BYTES)
    column = t.column("text").combine_chunks()
    return fit(column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column, np.array(t.column("label").to_pylist(), np.int64))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.pieces(batches):
            score = sent.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return (docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
            .mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int"))
