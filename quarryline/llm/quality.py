"""Quality: random-indexing word vectors, pooled, and a small calibrated network.

A word is known by its own hash (A-Z lowered), in one of ``WORDS`` buckets, and by its
shape (case, digits, marks, with runs shortened) or that it repeats the word before it,
in one of ``SHAPES`` buckets, so that words never seen before say something too.  Each
bucket has a sparse random index vector; its vector is the sum of the index vectors of
its neighbours of the same kind over all documents, one fixed-size table that partitions
sum up.  A document is the mean and the spread of its shapes' and of its words' vectors.
A two-layer network in numpy is trained on labelled rows, and a temperature, fitted on
rows that it wasn't trained on, turns its output into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .labelled import TRAIN_ROWS, held_out, training_rows
from .shared import Stored, small_batches

THRESHOLD = 0.7
#: buckets of shapes, which come first, and of words
SHAPES, WORDS = 4096, 1 << 14
DIMENSIONS = 32
#: of a document: mean and spread for each kind of bucket, and its length
INPUTS = 4 * DIMENSIONS + 1
NEIGHBOURS = 2
HIDDEN = 24

_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = np.arange(33, 127)
_KIND[48:58] = ord("0")
_KIND[65:91] = ord("A")
_KIND[97:123] = ord("a")
_KIND[128:] = ord("a")
U = np.uint64


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Two places of each bucket's index vector, the first +1, the second -1."""
    h = tb.mix(np.arange(1, SHAPES + WORDS + 1, dtype=U))
    plus = (h % U(DIMENSIONS)).astype(np.int64)
    minus = (plus + 1 + ((h >> U(32)) % U(DIMENSIONS - 1)).astype(np.int64)) % DIMENSIONS
    return plus, minus


def _buckets(column: pa.Array) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray], np.ndarray]]:
    """(first row, end row, each word's bucket as a shape and as a word, each row's first
    word)."""
    for lo, hi, data, offsets in tb.pieces(column):
        starts, ends, first = tb.runs(~tb.SEPARATOR[data], offsets)
        if not len(starts):
            yield lo, hi, (np.zeros(0, np.int64), np.zeros(0, np.int64)), first
            continue
        kind = _KIND[data]
        keep = kind > 0
        keep[1:] &= kind[1:] != kind[:-1]
        keep[starts] = True
        keep &= ~tb.SEPARATOR[data]
        at = np.concatenate([[0], np.cumsum(keep)])
        shape = tb.span_hash(tb.prefix_sums(kind[keep]), at[starts], at[ends])
        word = tb.span_hash(tb.prefix_sums(tb.LOWER[data]), starts, ends)
        again = np.zeros(len(word), bool)
        again[1:] = word[1:] == word[:-1]
        again[first[:-1][first[:-1] < len(word)]] = False
        # the last two buckets of shapes are for words that repeat the one before
        out = (shape % U(SHAPES - 2)).astype(np.int64)
        out[again] = SHAPES - 2
        yield lo, hi, (out, SHAPES + (word % U(WORDS)).astype(np.int64)), first


_SUMS = [f"d{k}" for k in range(DIMENSIONS)]


def _neighbour_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plus, minus = _index()
    total = np.zeros((SHAPES + WORDS) * DIMENSIONS, np.int64)
    for batch in batches:
        for lo, hi, kinds, first in _buckets(batch.column(0)):
            row = np.repeat(np.arange(hi - lo), np.diff(first))
            for k in range(1, NEIGHBOURS + 1):
                same = np.flatnonzero(row[k:] == row[:-k])
                for word in kinds:
                    a, b = word[same], word[same + k]
                    for x, y in ((a, b), (b, a)):
                        total += np.bincount(x * DIMENSIONS + plus[y], minlength=len(total))
                        total -= np.bincount(x * DIMENSIONS + minus[y], minlength=len(total))
    table = total.reshape(-1, DIMENSIONS)
    at = np.flatnonzero(table.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(at), *map(pa.array, table[at].T.copy())], names=["at", *_SUMS])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of the buckets, their own index vector mixed in."""
    parts = docs.select("text").mapInArrow(_neighbour_sums, ", ".join(f"{c} long" for c in ["at", *_SUMS]))
    rows = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in _SUMS]).toArrow()
    table = np.zeros((SHAPES + WORDS, DIMENSIONS))
    table[rows["at"].to_numpy().astype(np.int64)] = np.column_stack([rows[c].to_numpy() for c in _SUMS])
    table /= np.linalg.norm(table, axis=1, keepdims=True) + 1e-9
    plus, minus = _index()
    table[np.arange(len(table)), plus] += 0.7
    table[np.arange(len(table)), minus] -= 0.7
    return (table / np.linalg.norm(table, axis=1, keepdims=True)).astype(np.float32)


def _pooled(column: pa.Array, vectors: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    for lo, hi, kinds, first in _buckets(column):
        n = hi - lo
        size = np.maximum(1, np.diff(first))[:, None]
        found = []
        for word in kinds:
            # sums over a row from counts of its buckets
            key = np.repeat(np.arange(n), np.diff(first)) * len(vectors) + word
            pair, count = np.unique(key, return_counts=True)
            row, v = pair // len(vectors), vectors[pair % len(vectors)]
            sums, squares = np.zeros((n, DIMENSIONS)), np.zeros((n, DIMENSIONS))
            at = np.searchsorted(row, np.arange(n))
            full = np.flatnonzero(np.diff(np.append(at, len(row))))
            if len(full):
                sums[full] = np.add.reduceat(v * count[:, None], at[full], axis=0)
                squares[full] = np.add.reduceat(v * v * count[:, None], at[full], axis=0)
            mean = sums / size
            found += [mean, np.sqrt(np.maximum(0, squares / size - mean**2))]
        yield lo, hi, np.column_stack([*found, np.minimum(1, np.log1p(np.diff(first)) / 5)])


class Network:
    """Two layers, tanh and logistic; Adam on mini-batches with a fixed seed."""

    def __init__(self, inputs: int = INPUTS):
        rng = np.random.default_rng(7)
        self.mean, self.scale, self.temperature = np.zeros(inputs), np.ones(inputs), 1.0
        self.parts = [rng.normal(0, 1 / np.sqrt(inputs), (inputs, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.parts
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d[0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 128) -> Network:
        if not len(y):
            return self
        rng = np.random.default_rng(11)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-2
        m, v, t = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts], 0
        steps = max(epochs * len(y) // batch, 600)
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(y), batch)
            z = (x[pick] - self.mean) / self.scale
            a, b, c, d = self.parts
            h = np.tanh(z @ a + b)
            e = (1 / (1 + np.exp(-np.clip(h @ c + d[0], -30, 30))) - y[pick]) / batch
            back = np.outer(e, c) * (1 - h * h)
            grads = [z.T @ back + 1e-4 * a, back.sum(axis=0), h.T @ e + 1e-4 * c, np.array([e.sum()])]
            rate = 0.01 * (1 - t / (steps + 1))
            for p, g, m1, v1 in zip(self.parts, grads, m, v, strict=True):
                m1 += 0.1 * (g - m1)
                v1 += 0.001 * (g * g - v1)
                p -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(v1 / (1 - 0.999**t)) + 1e-8)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Network:
        """The temperature with the least log loss on rows not trained on."""
        if len(y):
            z = self.logit(x)
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            losses = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in grid]
            self.temperature = float(grid[int(np.argmin(losses))])
        return self


def _labelled(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [p for _, _, p in _pooled(batch.column(0), vectors.value)]
            if x:
                yield pa.RecordBatch.from_pydict({"label": batch.column(1), "fold": batch.column(2), "x": pa.array(np.concatenate(x).tolist(), pa.list_(pa.float64()))})

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors of ``docs`` and a network from those of ``labels`` (doc_id, quality)
    that aren't held out."""
    small_batches(docs.sparkSession)
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    sample = Stored(training_rows(docs, labels, "quality", rows).mapInArrow(_labelled(shared), "label int, fold int, x array<double>"))
    got = sample.read().toArrow()
    sample.discard()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, INPUTS)
    y, fold = got["label"].to_numpy().astype(float), got["fold"].to_numpy()
    order = np.lexsort((*x.T[:4], *x.T[2 * DIMENSIONS : 2 * DIMENSIONS + 4], y, fold))
    x, y, fold = x[order], y[order], fold[order]
    return vectors, Network().fit(x[fold != 0], y[fold != 0]).calibrate(x[fold == 0], y[fold == 0])


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    A null or wordless text is scored as a document of no words; repeated rows give
    repeated rows; a null doc_id isn't held out.  Only labels 0 and 1 of rows that
    aren't held out are learned from; of a doc_id that repeats in ``labels``, the
    highest.  Without labels all scores come from an untrained network.  Other columns
    aren't read; an empty table gives no rows."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = model.value
        for batch in batches:
            s = np.zeros(batch.num_rows)
            for lo, hi, x in _pooled(batch.column(2), vectors):
                s[lo:hi] = network(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
