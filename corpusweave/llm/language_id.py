"""Language identification: averaged hashed subword embeddings with a linear softmax, fitted by SGD in numpy.

Subwords are the byte 2- to 4-grams of lower-cased words with their borders; each hashes to a row of an embedding
table. A text is the mean of its rows, then a linear layer and a softmax. Scores are calibrated by a temperature, and
texts whose calibrated score is under a threshold, set where nearly all held-out sample texts pass, can be rejected.
As mean and layer are linear, prediction adds one precomputed row of logits per subword.

The fit uses a sample of at most ``SAMPLE_ROWS`` labelled rows of at most ``SAMPLE_BYTES`` each, and of their lines
``LINES`` drawn at random; predictions use whole texts. Scores have six digits. Edge cases: a null text or one without a letter is ``und`` with score 0 and is rejected; without labelled rows
everything is; ties go to the first label in order; repeated rows get equal answers; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .sampling import held_out, labelled_sample
from .store import unused

SAMPLE_ROWS = 2000
SAMPLE_BYTES = 64 << 10
BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
DIMENSION = 16
#: Lines of the sample that the fit goes over.
LINES = 9000
EPOCHS = 4
STRETCH = 1 << 18

_FOLD = np.zeros(256, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def subwords(raw: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the subword at every byte; ``BUCKETS`` where there is none. Texts don't run together."""
    x = _FOLD[raw]
    upper = np.zeros(len(x), bool)
    upper[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    x = np.where(upper, x | 0x20, x)
    edge = np.zeros(len(x) + 1, bool)
    edge[starts] = True
    wide = np.concatenate([x, np.zeros(max(ORDERS), np.uint8)]).astype(np.uint32)
    n = len(x)
    cut, inner = np.zeros(n, bool), np.zeros(n, bool)
    code = wide[:n].copy()
    stop = np.concatenate([edge[1:n + 1], np.ones(max(ORDERS), bool)])
    for k in range(2, max(ORDERS) + 1):
        cut |= stop[k - 2:n + k - 2]
        if k > 2:
            inner |= wide[k - 2:n + k - 2] == 0
        code = code * np.uint32(0x01000193) + wide[k - 1:n + k - 1] + np.uint32(k)
        h = code ^ (code >> np.uint32(15))
        h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
        blank = cut | inner | ((wide[:n] == 0) & (wide[k - 1:n + k - 1] == 0))
        if k in ORDERS:
            yield np.where(blank, np.uint32(BUCKETS), h).astype(np.int64)


@dataclass
class Model:
    labels: list[str]
    logits: np.ndarray  # BUCKETS + 1 rows; the last, for no subword, is 0 and its count too
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def raw_scores(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Logits of each text, read in stretches, so what is held doesn't grow with a long text."""
        sums = np.zeros((len(starts) - 1, len(self.labels) + 1), np.float64)
        for a in range(0, len(raw), STRETCH):
            z = min(a + STRETCH, len(raw))
            low, high = max(a - 1, 0), min(z + max(ORDERS), len(raw))
            edges = np.concatenate([[0], starts[(starts > low) & (starts < high)] - low, [high - low]])
            rows = np.arange(np.searchsorted(starts, a, side="right") - 1, np.searchsorted(starts, z))
            rows = rows[starts[rows + 1] > np.maximum(starts[rows], a)]
            begin = np.maximum(starts[rows], a) - low
            for h in subwords(raw[low:high], edges):
                sums[rows] += np.add.reduceat(self.logits[h[:z - low]], begin, axis=0)
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest label and its calibrated probability."""
        return top(self.raw_scores(*tb.text_bytes(column)) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def top(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = softmax(z)
    best = p.argmax(axis=1)
    return best, p[np.arange(len(p)), best]


def fit(texts: pa.Array, labels: list[str], seed: int = 11) -> Model:
    names = sorted(set(labels))
    y = np.searchsorted(names, labels) if names else np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    test = rng.random(len(y)) < 0.2
    lines, target = [], []
    for i in np.flatnonzero(~test).tolist():
        for line in [x for x in texts[i].as_py().split("\n") if x.strip()]:
            lines.append(line)
            target.append(y[i])
    pick = rng.permutation(len(lines))[:LINES]
    y_fit = np.array(target, np.int64)[pick]
    grams = []
    for i in pick.tolist():
        raw = np.frombuffer(lines[i].encode(), np.uint8)
        g = np.concatenate(list(subwords(raw, np.array([0, len(raw)]))))
        grams.append(g[g < BUCKETS])
    keep = [i for i, g in enumerate(grams) if len(g)]
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    seen = np.zeros(BUCKETS, bool)
    weight, bias = np.zeros((DIMENSION, len(names)), np.float32), np.zeros(len(names), np.float32)
    weight[:] = rng.normal(0, 0.3, weight.shape)
    batch, steps = 32, 0
    total = EPOCHS * -(-len(keep) // batch)
    for _ in range(EPOCHS):
        order = rng.permutation(keep)
        for at in range(0, len(order), batch):
            own = order[at:at + batch]
            size = np.array([len(grams[i]) for i in own])
            flat = np.concatenate([grams[i] for i in own])
            seen[flat] = True
            first = np.cumsum(size) - size
            mean = np.add.reduceat(embed[flat], first, axis=0) / size[:, None]
            p = softmax(mean @ weight + bias)
            p[np.arange(len(own)), y_fit[own]] -= 1
            rate = 2.0 * (1 - steps / total)
            back = (p @ weight.T / size[:, None]).astype(np.float32)
            weight -= rate * 0.05 * (mean.T @ p).astype(np.float32)
            bias -= rate * 0.01 * p.sum(axis=0).astype(np.float32)
            np.add.at(embed, flat, -rate * 5 * np.repeat(back, size, axis=0))
            steps += 1
    logits = np.zeros((BUCKETS + 1, len(names) + 1))
    logits[:-1, :-1] = np.where(seen[:, None], embed @ weight, 0)
    logits[:-1, -1] = 1
    model = Model(names, logits, bias.astype(np.float64))
    if test.any():
        raw, starts = tb.text_bytes(texts.filter(pa.array(test)))
        z, truth = model.raw_scores(raw, starts), y[test]
        grid = np.geomspace(0.05, 5, 40)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        best, score = top(z / model.temperature)
        right = score[best == truth]
        model.least = float(min(0.5, np.quantile(right, 0.002))) if len(right) else 0.0
    return model


def learn(docs: DataFrame) -> Model:
    t = labelled_sample(docs, docs.select("doc_id", F.col("lang").alias("label")).distinct(), SAMPLE_ROWS, SAMPLE_BYTES)
    column = t.column("text").combine_chunks()
    return fit(column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column, t.column("label").to_pylist())


def _judge(batch: pa.RecordBatch, model: Model, letter: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    lettered = batch.column(letter).to_numpy(zero_copy_only=False).astype(bool)
    if not model.labels:
        return ["und"] * len(lettered), np.zeros(len(lettered)), np.ones(len(lettered), bool)
    best, score = model.predict(batch.column("text"))
    score = np.where(lettered, score.round(6), 0.0)
    return [model.labels[i] if a else "und" for i, a in zip(best.tolist(), lettered.tolist(), strict=True)], score, ~lettered | (score < model.least)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row of ``docs``; lang is read by the fit alone."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.pieces(batches):
            lang, score, gone = _judge(batch, sent.value, "letter")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(lang), pa.array(score), pa.array(gone)],
                                             names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return (docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), letter.alias("letter"))
            .mapInArrow(tb.tidied(run), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns, in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs))
    plain = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    letter = unused(docs, "has_letter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.pieces(batches):
            _, _, gone = _judge(batch, sent.value, letter)
            yield batch.drop_columns([letter]).filter(pa.array(~gone))

    return docs.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(tb.tidied(run), plain)
