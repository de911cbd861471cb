"""Toxicity: noisy-channel deobfuscation, then scoring of the restored text.

*Language model.*  Counts of character trigrams inside words, over all documents.

*Channel.*  A disguised word is a lattice: a digit or sign may stand for a letter it
looks like, a separator or a repeated letter may have been added, single letters with
spaces between them may be one word or several.  Viterbi finds the likeliest letters
under the language model.  A word without such characters has one path, itself, and
isn't decoded.

*Score.*  Written and restored words are matched with markers (words and word beginnings
that labelled toxic documents have and clean ones don't); a logistic regression turns a
document's evidence into a probability.  Markers are chosen on four fifths of the
training rows and the regression is fitted on the rest, so it sees evidence as it will be
for new documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .labelled import TRAIN_ROWS, held_out, training_rows
from .shared import Stored, small_batches

THRESHOLD = 0.3
#: longer words and spelled-out runs are decoded in windows, each half over the next
WINDOW = 96
#: letters that a sign may stand for, and what that costs (in nats)
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "#": "h"}
SUBSTITUTED, SEPARATED, REPEATED, DOUBLED, KEPT_SIGN = 1.0, 0.4, 0.7, 2.5, 7.0
SEPARATORS = "-._*~'^=/\\,:;"
CLASSES = 64
#: beginnings of words that may be markers, in bytes
HEADS = (4, 5, 6)
#: bits of the filter that tells which features may be markers
FILTER_BITS = 24

U = np.uint64
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 32
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in {*LOOKS_LIKE, *SEPARATORS}]] = True
_FIRST = np.zeros(256, bool)
_FIRST[[ord(c) for c in "0123456789@$!|(+"]] = True
#: marks that may stand around a word
_AROUND = np.zeros(256, bool)
_AROUND[[ord(c) for c in ".,;:!?\"'()[]{}<>*#%&=~-_/\\"]] = True
_REPEATS = re.compile(r"(\S)\1{3,}", re.S)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        for _, _, data, offsets in tb.pieces(batch.column(0)):
            c = np.zeros(len(data) + 3, np.int64)
            c[2:-1] = _CLASS[tb.LOWER[data]]
            total += np.bincount(c[:-2] * CLASSES * CLASSES + c[1:-1] * CLASSES + c[2:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"at": pa.array(at), "n": pa.array(total[at])})


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) over character classes, interpolated; its size is fixed."""
    rows = docs.select("text").mapInArrow(_trigrams, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    three = np.zeros(CLASSES**3)
    three[rows["at"].to_numpy().astype(np.int64)] = rows["n"].to_numpy()
    three = three.reshape(CLASSES, CLASSES, CLASSES)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + CLASSES)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20)
    return np.log(p3)


class Decoder:
    """Viterbi decoding of one word's lattice; words met before are remembered."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.known: dict[str, str] = {}

    def __call__(self, word: str) -> str:
        if word not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[word] = self._decode(word)
        return self.known[word]

    def _decode(self, word: str) -> str:
        model = self.model
        # state: classes of the last two characters; value: (cost, text)
        states: dict[tuple[int, int, str], tuple[float, str]] = {(0, 0, ""): (0.0, "")}
        for i, x in enumerate(word):
            # a letter that stands twice may well be meant; three times hardly
            again = REPEATED if word[max(0, i - 2) : i + 3].count(x) > 2 else DOUBLED
            new: dict[tuple[int, int, str], tuple[float, str]] = {}

            def offer(a: int, b: int, last: str, cost: float, text: str, new=new) -> None:
                key = (a, b, last)
                if key not in new or cost < new[key][0]:
                    new[key] = (cost, text)

            letter = x.isalpha()
            options = [(x, 0.0)] if letter else [(y, SUBSTITUTED) for y in LOOKS_LIKE.get(x, "")]
            for (a, b, last), (cost, text) in states.items():
                for y, extra in options:
                    c = ord(y) - 96 if "a" <= y <= "z" else 27 + ord(y) % 32
                    offer(b, c, y, cost + extra - model[a][b][c], text + y)
                if x == last or not letter and last in LOOKS_LIKE.get(x, ""):
                    offer(a, b, last, cost + again, text)
                if x == " ":  # between spaced letters: the word goes on or ends
                    offer(a, b, last, cost + SEPARATED, text)
                    if b:
                        offer(0, 0, "", cost + SEPARATED - model[a][b][0], text + " ")
                elif not letter:
                    if x in SEPARATORS:
                        offer(a, b, last, cost + SEPARATED, text)
                    if b:
                        offer(0, 0, "", cost + KEPT_SIGN - model[a][b][0], text + " ")
                    else:
                        offer(0, 0, "", cost + KEPT_SIGN, text)
            states = new
        best = min(((cost - (self.model[a][b][0] if b else 0), text) for (a, b, _), (cost, text) in states.items()), default=(0.0, ""))
        return best[1]


def _windows(text: str) -> Iterator[str]:
    """The text with long repeats shortened, in windows if it is still long."""
    text = _REPEATS.sub(r"\1\1\1", text)
    for i in range(0, max(1, len(text) - WINDOW // 2), WINDOW // 2):
        yield text[i : i + WINDOW].strip(" ")


def _disguised(low: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str]]:
    """(row, spelling) of words that have more than one reading."""
    starts, ends, first = tb.runs(~tb.SEPARATOR[low], offsets)
    if not len(starts):
        return
    letter = tb.LETTER[low]
    odd = _SIGN[low]
    odd[1:] |= letter[1:] & (low[1:] == low[:-1]) & (low[1:] < 128)
    # words without the marks around them
    inside = np.flatnonzero(~_AROUND[low] & ~tb.SEPARATOR[low])
    lo = np.append(inside, len(low))[np.searchsorted(inside, starts)]
    hi = np.append(-1, inside)[np.searchsorted(inside, ends)] + 1
    # a sign for a letter may begin a word; a bracket that is closed isn't one
    before, after = low[np.maximum(lo - 1, 0)], np.append(low, 0)[hi]
    lo = np.where((lo > starts) & (lo < ends) & _FIRST[before] & ~((before == ord("(")) & (after == ord(")"))), lo - 1, lo)
    letters, odds = np.append(0, np.cumsum(letter)), np.append(0, np.cumsum(odd))
    whole = np.flatnonzero(lo < hi)
    whole = whole[(letters[hi[whole]] > letters[lo[whole]]) & (odds[hi[whole]] > odds[lo[whole]]) & (hi[whole] - lo[whole] > 1)]
    row_of = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    data = low.tobytes()
    for row, i, j in zip(row_of[whole].tolist(), lo[whole].tolist(), hi[whole].tolist(), strict=True):
        for text in _windows(data[i:j].decode("utf-8", "replace")):
            yield row, text
    # single letters (or signs for them) of any script, with spaces between
    characters = np.append(0, np.cumsum((low & 0xC0) != 0x80))
    single = (characters[ends] - characters[starts] == 1) & (letter[starts] | _FIRST[low[starts]])
    a, b, _ = tb.runs(single, first)
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        if j - i >= 3:
            for text in _windows(" ".join(data[x:y].decode("utf-8", "replace") for x, y in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True))):
                yield int(row_of[i]), text


def _features(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word, and of its beginnings."""
    starts, ends, first = tb.runs(tb.LETTER[low], offsets)
    row = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    sums = tb.prefix_sums(low)
    rows, hashes = [row], [tb.span_hash(sums, starts, ends)]
    for k in HEADS:
        long = ends - starts > k
        rows.append(row[long])
        hashes.append(tb.span_hash(sums, starts[long], starts[long] + k) ^ U(0x5BD1E995))
    return np.concatenate(rows), np.concatenate(hashes)


def _read(column: pa.Array, decode: Decoder) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, rows, features, words per row) of written and restored words."""
    for lo, hi, data, offsets in tb.pieces(column):
        low = tb.LOWER[data]
        rows, hashes = _features(low, offsets)
        length = np.bincount(rows, minlength=hi - lo)
        restored: dict[int, list[str]] = {}
        for row, text in _disguised(low, offsets):
            got = decode(text)
            if got and got != text:
                restored.setdefault(row, []).append(got)
        if restored:
            keys = sorted(restored)
            joined = [" ".join(restored[k]).encode() for k in keys]
            data2 = np.frombuffer(b"".join(joined), np.uint8)
            r2, h2 = _features(tb.LOWER[data2], np.concatenate([[0], np.cumsum([len(x) for x in joined])]))
            rows, hashes = np.concatenate([rows, np.array(keys)[r2]]), np.concatenate([hashes, h2])
        yield lo, hi, rows, hashes, length


def _filter(features: DataFrame) -> np.ndarray:
    """Bits for the hashes h of ``features``: a filter of fixed size, whatever their number."""
    at = features.select(F.col("h").bitwiseAND((1 << FILTER_BITS) - 1).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[words["word"].to_numpy().astype(np.int64)] = words["mask"].to_numpy().astype(np.int64)
    return bits.view(U)


def _document_frequency(model, label: int, among=None):
    """How many texts with the label have each feature (that a filter lets through)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(model.value)
        found: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "n": pa.array(n)})
                found.clear()

        for batch in batches:
            wanted = batch.filter(pa.compute.and_(pa.compute.equal(batch.column(1), label), pa.compute.not_equal(batch.column(2), 0)))
            for _, hi, rows, hashes, _ in _read(wanted.column(0), decode):
                if among is not None:
                    at = hashes & U((1 << FILTER_BITS) - 1)
                    keep = (among.value[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)).astype(bool)
                    rows, hashes = rows[keep], hashes[keep]
                order = np.lexsort((hashes, rows))
                rows, hashes = rows[order], hashes[order]
                once = np.ones(len(rows), bool)
                once[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
                found.append(hashes[once])
                if sum(map(len, found)) > 2_000_000:
                    yield from flush()
        yield from flush()

    return run


def _isin(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(hashes), bool)
    at = np.searchsorted(table, hashes)
    at[at == len(table)] = 0
    return table[at] == hashes


class Markers:
    """Features with their weights; a table of 2**20 bits rules most words out."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(hashes >> U(44)).astype(np.int64)] = True

    def evidence(self, lo: int, hi: int, rows: np.ndarray, hashes: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Inputs of the regression for each row."""
        n = hi - lo
        hit = np.flatnonzero(self.maybe[(hashes >> U(44)).astype(np.int64)])
        hit = hit[_isin(self.hashes, hashes[hit])]
        rows, at = rows[hit], np.searchsorted(self.hashes, hashes[hit])
        weight = self.weights[at]
        total = np.bincount(rows, weights=weight, minlength=n)
        once = np.unique(rows * (len(self.hashes) + 1) + at)
        row1 = once // (len(self.hashes) + 1)
        first = self.weights[once % (len(self.hashes) + 1)] if len(once) else np.zeros(0)
        distinct = np.bincount(row1, weights=first, minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, rows, weight)
        # without markers all are 0, however short the text
        dense = np.log1p(100 * total / (length[:n] + 20))
        return np.column_stack([np.log1p(total), np.log1p(distinct), top, dense, (top > 0).astype(float)])


class Regression:
    """Logistic regression by Newton's steps, with a small ridge.  Inputs beyond those that
    it was fitted on count as the last of those."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Regression:
        self.least, self.most = (x.min(axis=0), x.max(axis=0)) if len(x) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        self.mean, self.scale = x.mean(axis=0) if len(x) else np.zeros(x.shape[1]), (x.std(axis=0) if len(x) else np.zeros(x.shape[1])) + 1e-6
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        self.w = np.zeros(z.shape[1])
        ridge = np.eye(z.shape[1]) * np.r_[0.01, np.full(x.shape[1], 0.3)]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ self.w)
            self.w += np.clip(step, -3, 3)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = self.w[0] + ((np.clip(x, self.least, self.most) - self.mean) / self.scale) @ self.w[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Everything that scoring needs; its size is bounded."""

    def __init__(self, characters: np.ndarray, markers: Markers, regression: Regression):
        self.characters, self.markers, self.regression = characters, markers, regression

    def scores(self, column: pa.Array, decode: Decoder) -> np.ndarray:
        out = np.zeros(len(column))
        for lo, hi, *rest in _read(column, decode):
            out[lo:hi] = self.regression(self.markers.evidence(lo, hi, *rest))
        return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from ``docs`` and those of ``labels`` (doc_id, toxic) that aren't held
    out; without labels of both kinds it scores everything 0.0 or so."""
    spark = docs.sparkSession
    small_batches(spark)
    characters = language_model(docs)
    shared = spark.sparkContext.broadcast(characters)
    sample = Stored(training_rows(docs, labels, "toxic", rows))
    sizes = {r["label"]: r["count"] for r in sample.read().where("fold != 0").groupBy("label").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    least = max(3, bad // 400)
    frequency = lambda label, among=None: sample.read().mapInArrow(_document_frequency(shared, label, among), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    toxic = Stored(frequency(1).where(F.col("n") >= least))
    both = toxic.read().withColumnRenamed("n", "n1").join(frequency(0, spark.sparkContext.broadcast(_filter(toxic.read()))).withColumnRenamed("n", "n0"), "h", "left")
    n1, n0 = F.col("n1"), F.coalesce("n0", F.lit(0))
    share1, share0 = n1 / max(1, bad), n0 / max(1, good)
    weight = F.log((n1 + 0.5) / (bad + 1)) - F.log((n0 + 0.5) / (good + 1))
    sure = (share1 - share0) / F.sqrt(share1 * (1 - share1) / max(1, bad) + (n0 + 1) / float(max(1, good)) ** 2 + 1e-9)
    # every one that toxic rows have surely more often: fewer than the bounded rows have features
    told = both.select("h", weight.alias("weight")).where((F.col("weight") > 1.5) & (sure > 2.5)).toArrow()
    toxic.discard()
    hashes, weight = told["h"].to_numpy().astype(np.int64).view(U), told["weight"].to_numpy().astype(float)
    markers = Markers(hashes, weight)
    model = Model(characters, markers, Regression())
    evidence = sample.read().mapInArrow(_evidence(spark.sparkContext.broadcast(model)), "label int, fold int, x array<double>").toArrow()
    x = np.array(evidence["x"].to_pylist(), float).reshape(-1, 5)
    y, fold = evidence["label"].to_numpy().astype(float), evidence["fold"].to_numpy()
    rest = fold == 0
    if y[rest].sum() < 20:  # too few unseen toxic rows to fit on alone
        rest = np.ones(len(y), bool)
    model.regression.fit(x[rest], y[rest])
    sample.discard()
    return model


def _evidence(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        decode = Decoder(model.characters)
        for batch in batches:
            x = [model.markers.evidence(lo, hi, *rest) for lo, hi, *rest in _read(batch.column(0), decode)]
            if x:
                yield pa.RecordBatch.from_pydict({"label": batch.column(1), "fold": batch.column(2), "x": pa.array(np.concatenate(x).tolist(), pa.list_(pa.float64()))})

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    A null text counts as empty and is scored like a text without markers; repeated
    rows give repeated rows; a null doc_id isn't held out.  Only labels 0 and 1 of rows
    that aren't held out are learned from; of a doc_id that repeats in ``labels``, the
    highest.  Other columns aren't read; an empty table gives no rows."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(model.value.characters)
        for batch in batches:
            s = model.value.scores(batch.column(2), decode)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that ``score`` predicts toxic, decided where they are read."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(model.value.characters)
        for batch in batches:
            yield batch.filter(pa.array(model.value.scores(batch.column(at), decode) < threshold))

    return docs.mapInArrow(run, docs.schema)
