"""Language-model scoring with a hidden Markov model over word classes.

Words are grouped in a fixed number of classes: the most frequent words are classes of
their own, the others are classed by how they end (so words never seen have a class),
and the end of a text is a class.  A word's probability is the probability of its class
given all words before it, times its share of the class: (count + 1) over the class's
sum of those, with one share for words never seen.

The model is trained by Baum-Welch.  Training texts are written once as classes, in
slices by hash.  A step runs scaled forward and backward recursions over one slice in
its partitions, sums the expected counts, replaces the slice's former ones and takes the
next model from the counts of all slices (incremental expectation maximisation, which
never lowers the bound that it climbs).  A pass takes every slice, so all training
texts; passes end when the likelihood of the training texts hardly grows.  The first
guess is drawn at random around the classes' masses.  Scores are exact sequence
likelihoods by the scaled forward recursion.

Long texts are cut into pieces.  Products of the pieces' transition matrices give the
exact state probabilities before and after each piece, so pieces are recursed side by
side, in bounded memory.

Word counts cover all training texts.  The most frequent words' counts are sent to the
tasks (a bounded list); all other words are joined with the whole table of counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .labelled import held_out
from .shared import Stored, small_batches

PARTS, HELD_OUT = 7, 2
STATES = 8
#: words that are classes of their own, classes of endings; class 0 is the end
OWN, ENDINGS = 1024, 1024
CLASSES = 1 + OWN + ENDINGS
#: words whose counts are sent to every task: 12 bytes each
SENT = 1 << 20
#: passes over all training texts at most, and the relative gain in likelihood that ends them
PASSES, GAIN = 6, 1e-3
SLICES = 8
#: words of a window in which pieces are sorted by length, of a piece, and of one recursion
WINDOW, PIECE, CELLS = 2_000_000, 2048, 600_000
#: expected counts: of firsts, of moves, of emissions
SUMS = STATES + STATES * STATES + CLASSES * STATES
U = np.uint64


class Counts:
    """Counts and classes of the most frequent words, found by hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        frequent = np.argsort(-counts, kind="stable")[:OWN]
        own = np.zeros(len(counts), np.int32)
        own[frequent] = 1 + np.arange(len(frequent))
        order = np.argsort(hashes)
        self.hashes, self.counts, self.own = hashes[order], counts[order], own[order]
        bits = max(1, min(22, int(len(hashes)).bit_length()))
        self.shift = U(64 - bits)
        self.start = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=U) << self.shift).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it isn't there."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = self.start[(hashes >> self.shift).astype(np.int64)]
        last = len(self.hashes) - 1
        at = np.minimum(at, last)
        behind = np.flatnonzero(self.hashes[at] < hashes)
        while len(behind):
            at[behind] += 1
            inside = behind[at[behind] <= last]
            at = np.minimum(at, last)
            behind = inside[self.hashes[at[inside]] < hashes[inside]]
        return np.where(self.hashes[at] == hashes, at, -1)


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, ending classes, each row's first word)."""
    for lo, hi, data, offsets in tb.pieces(column):
        low = tb.LOWER[data]
        starts, ends, first = tb.runs(~tb.SEPARATOR[data], offsets)
        sums = tb.prefix_sums(low)
        hashes = tb.span_hash(sums, starts, ends)
        ending = tb.span_hash(sums, np.maximum(starts, ends - 3), ends) % U(ENDINGS)
        yield lo, hi, hashes, ending.astype(np.int32) + 1 + OWN, first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of training texts, by windows; the row with a null word has
    the number of texts."""
    texts, held, size = 0, [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size
        if held:
            h = np.concatenate([x for x, _ in held])
            g = np.concatenate([x for _, x in held])
            order = np.argsort(h)
            h, g = h[order], g[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            yield pa.RecordBatch.from_pydict({"h": pa.array(h[at].view(np.int64)), "g": pa.array(g[at].astype(np.int32)), "c": pa.array(np.diff(np.append(at, len(h))))})
        held.clear()
        size = 0

    for batch in batches:
        texts += batch.num_rows
        for _, _, hashes, ending, _ in _tokens(batch.column(0)):
            held.append((hashes, ending))
            size += len(hashes)
            if size >= WINDOW:
                yield from flush()
    yield from flush()
    yield pa.RecordBatch.from_pydict({"h": pa.nulls(1, pa.int64()), "g": pa.nulls(1, pa.int32()), "c": pa.array([texts], pa.int64())})


class Chain:
    """A hidden Markov model: first (K), move (K, K), emit (classes, K)."""

    def __init__(self, first: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.first, self.move, self.emit = first, move, emit

    @classmethod
    def guess(cls, class_counts: np.ndarray) -> Chain:
        rng = np.random.default_rng(5)
        emit = ((class_counts + 1) / (class_counts + 1).sum())[:, None] * np.exp(rng.normal(0, 0.7, (CLASSES, STATES)))
        move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    @classmethod
    def from_counts(cls, counts: np.ndarray, class_counts: np.ndarray) -> Chain:
        """From expected counts (of firsts, moves, emissions, in one array), a little
        smoothed by how frequent classes are."""
        k = STATES
        first, move, emit = counts[:k] + 0.1, counts[k : k + k * k].reshape(k, k) + 0.1, counts[k + k * k :].reshape(CLASSES, k)
        prior = (class_counts + 1) / (class_counts + 1).sum()
        emit = emit + 5 * prior[:, None]
        return cls(first / first.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def narrow(self) -> Chain:
        """The same in single precision."""
        return Chain(*(x.astype(np.float32) for x in (self.first, self.move, self.emit)))

    def forward(self, seen: np.ndarray, live: np.ndarray, start: np.ndarray, keep: bool = False):
        """(log10 likelihoods, last state probabilities, all of them if ``keep``) of pieces
        sorted by length, longest first; ``seen`` is (places, pieces), ``live`` the number of
        pieces that have each place, ``start`` what states their first words have."""
        t, n = seen.shape
        total, a = np.zeros(n), start
        last = np.empty_like(start)
        alphas = np.zeros((t, n, STATES), start.dtype) if keep else None
        for i in range(t):
            m = live[i]
            a = self.emit[seen[i, :m]] * (a if i == 0 else a[:m] @ self.move)
            s = a.sum(axis=1)
            a /= s[:, None]
            total[:m] += np.log10(s)
            last[:m] = a
            if keep:
                alphas[i, :m] = a
        return total, last, alphas

    def transfer(self, seen: np.ndarray, live: np.ndarray) -> np.ndarray:
        """(pieces, states before, states of the last word): the pieces' matrices, scaled."""
        n = seen.shape[1]
        out = np.repeat(np.eye(STATES)[None], n, axis=0)
        for i in range(len(seen)):
            m = live[i]
            step = (out[:m].reshape(-1, STATES) @ self.move).reshape(m, STATES, STATES) * self.emit[seen[i, :m]][:, None, :]
            step /= step.sum(axis=(1, 2), keepdims=True)
            out[:m] = step
        return out

    def expect(self, seen: np.ndarray, live: np.ndarray, start: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, float]:
        """(expected counts of firsts, moves and emissions, log10 likelihood).  ``before``:
        states of the word before a piece, zeros if it begins its text; ``after``: what
        follows the piece makes of its last word's states."""
        t, n = seen.shape
        total, _, alphas = self.forward(seen, live, start, True)
        moves = np.zeros((STATES, STATES))
        beta = after.copy()
        inner = before.any(axis=1)
        for i in range(t - 1, -1, -1):
            m = live[i]
            g = alphas[i, :m] * beta[:m]
            g /= g.sum(axis=1, keepdims=True)
            if i or inner.any():
                prior = alphas[i - 1, :m] if i else before
                eb = self.emit[seen[i, :m]] * beta[:m]
                # scale each step so that its expected moves sum to one
                norm = ((prior @ self.move) * eb).sum(axis=1, keepdims=True)
                eb /= np.where(norm > 0, norm, 1)
                moves += prior.T @ eb
                beta[:m] = eb @ self.move.T
            alphas[i, :m] = g
        moves *= self.move
        there = np.arange(n)[None, :] < live[:, None]
        flat, g = seen[there], alphas[there]
        order = np.argsort(flat.astype(np.int16), kind="stable")
        flat = flat[order]
        at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        emit = np.zeros((CLASSES, STATES))
        emit[flat[at]] = np.add.reduceat(g[order], at, axis=0, dtype=np.float64)
        return np.concatenate([alphas[0][~inner].sum(axis=0), moves.ravel(), emit.ravel()]), float(total.sum())


def _dealt(pieces: list[np.ndarray], cells: int | None = None) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(places in the list, (places, pieces) classes, live): batches of like lengths."""
    cells = cells or CELLS
    order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
    at = 0
    while at < len(order):
        longest = len(pieces[order[at]])
        n = max(1, min(cells // longest, 2048))
        own = order[at : at + n]
        lengths = np.array([len(pieces[i]) for i in own])
        seen = np.zeros((longest, len(own)), np.int32)
        for j, i in enumerate(own):
            seen[: lengths[j], j] = pieces[i]
        live = np.searchsorted(-lengths, -np.arange(longest), "left")
        yield own, seen, live
        at += n


class Pieces:
    """Texts in pieces of at most ``PIECE`` words, and the states around each piece."""

    def __init__(self, chain: Chain, texts: list[np.ndarray]):
        size = PIECE
        self.pieces = [t[i : i + size] for t in texts for i in range(0, len(t), size)]
        self.text = np.repeat(np.arange(len(texts)), [-(-len(t) // size) for t in texts])
        n = len(self.pieces)
        self.start = np.tile(chain.first, (n, 1))
        self.before, self.after = np.zeros((n, STATES)), np.ones((n, STATES))
        long = np.flatnonzero(np.bincount(self.text, minlength=len(texts)) > 1)
        if not len(long):
            return
        lo, hi = np.searchsorted(self.text, long), np.searchsorted(self.text, long, "right")
        some = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
        firsts = lo.tolist()
        matrix = np.zeros((n, STATES, STATES))
        for own, seen, live in _dealt([self.pieces[i] for i in some], CELLS // STATES):
            matrix[some[own]] = chain.transfer(seen, live)
        for own, seen, live in _dealt([self.pieces[i] for i in firsts]):
            at = lo[own]
            self.before[at + 1] = chain.forward(seen, live, self.start[at])[1]
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            for i in range(a + 1, b - 1):
                state = self.before[i] @ matrix[i]
                self.before[i + 1] = state / state.sum()
            for i in range(b - 2, a - 1, -1):
                state = matrix[i + 1] @ self.after[i + 1]
                self.after[i] = state / state.sum()
            self.start[a + 1 : b] = self.before[a + 1 : b] @ chain.move

    def log10(self, chain: Chain) -> np.ndarray:
        """Log10 likelihoods of the texts."""
        out = np.zeros(len(self.pieces))
        for own, seen, live in _dealt(self.pieces):
            out[own] = chain.forward(seen, live, self.start[own])[0]
        return np.bincount(self.text, out, int(self.text[-1]) + 1 if len(self.text) else 0)

    def expect(self, chain: Chain) -> tuple[np.ndarray, float]:
        """Expected counts over all texts and their log10 likelihood, in single precision."""
        slim = chain.narrow()
        total, told = np.zeros(SUMS), 0.0
        for own, seen, live in _dealt(self.pieces):
            counts, likelihood = slim.expect(seen, live, *(x[own].astype(np.float32) for x in (self.start, self.before, self.after)))
            total += counts
            told += likelihood
        return total, told


def _classed(counts: Counts, hashes: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the sent words or -1, class) of each word."""
    at = counts.find(hashes)
    own = counts.own[at] if len(counts.own) else np.zeros(len(at), np.int32)
    return at, np.where((at >= 0) & (own > 0), own, ending)


def _encode(shared):
    """Texts, ends included, as 16-bit classes: of each piece of a batch, a row a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            slices = batch.column(1).to_numpy()
            for lo, hi, hashes, ending, first in _tokens(batch.column(0)):
                words = np.ones(len(hashes) + hi - lo, bool)
                words[first[1:] + np.arange(hi - lo)] = False
                classes = np.zeros(len(words), np.int16)
                classes[words] = _classed(counts, hashes, ending)[1]
                own = np.repeat(slices[lo:hi], np.diff(first) + 1)
                some = np.unique(own)
                yield pa.RecordBatch.from_pydict({"classes": pa.array([classes[own == s].tobytes() for s in some], pa.binary()), "slice": pa.array(some, pa.int32())})

    return run


def _expectations(shared):
    """Expected counts of a slice, and at -1 its log10 likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        total, told, held, size = np.zeros(SUMS), 0.0, [], 0

        def done() -> None:
            nonlocal total, told, held, size
            counts, likelihood = Pieces(chain, held).expect(chain)
            total, told, held, size = total + counts, told + likelihood, [], 0

        for batch in batches:
            for blob in batch.column(0):
                classes = np.frombuffer(blob.as_py(), np.int16)
                held += np.split(classes, np.flatnonzero(classes == 0) + 1)[:-1]
                size += len(classes)
                if size >= WINDOW:
                    done()
        if held:
            done()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.append(at, -1)), "w": pa.array(np.append(total[at], told))})

    return run


class LanguageModel:
    """Counts of words, sums of classes and the trained chain."""

    def __init__(self, docs: DataFrame, parts: int = PARTS, part: int = HELD_OUT, passes: int = PASSES):
        spark = docs.sparkSession
        small_batches(spark)
        train = docs.where(~held_out(parts, part)).select("text")
        told = Stored(train.mapInArrow(_count, "h long, g int, c long").groupBy("h").agg(F.max("g").alias("g"), F.sum("c").alias("c")))
        self.vocabulary = told.read().where("h is not null")
        texts = told.read().where("h is null").agg(F.sum("c")).first()[0] or 0
        words, distinct = self.vocabulary.agg(F.sum("c"), F.count("*")).first()
        self.tokens, self.texts = (words or 0) + texts, texts
        self.distinct = distinct + (texts > 0)
        top = self.vocabulary.orderBy(F.desc("c"), "h").limit(SENT).toArrow()
        hashes, c = top["h"].to_numpy().astype(np.int64).view(U), top["c"].to_numpy().astype(np.int64)
        self.counts = Counts(hashes, c)
        # sums of count + 1 by class: endings' without the words that are their own
        sums = self.vocabulary.groupBy("g").agg(F.sum(F.col("c") + 1).alias("s"), F.sum("c").alias("c")).toArrow()
        self.sums, self.mass = np.zeros(CLASSES), np.zeros(CLASSES)
        at = sums["g"].to_numpy().astype(np.int64)
        self.sums[at], self.mass[at] = sums["s"].to_numpy(), sums["c"].to_numpy()
        own = np.flatnonzero(self.counts.own)
        if len(own):
            taken = {r["h"]: r["g"] for r in top.select(["h", "g"]).slice(0, OWN).to_pylist()}
            for i in own.tolist():
                g, n = taken[int(self.counts.hashes[i : i + 1].view(np.int64)[0])], int(self.counts.counts[i])
                self.sums[g] -= n + 1
                self.mass[g] -= n
                self.mass[self.counts.own[i]] = n
        self.mass[0] = texts
        self.chain = Chain.guess(self.mass)
        if texts:
            self._train(spark, train, passes)

    def _train(self, spark, train: DataFrame, passes: int) -> None:
        counts = spark.sparkContext.broadcast(self.counts)
        slices = train.select("text", F.expr(f"cast(pmod(xxhash64(text), {SLICES}) as int)"))
        encoded = Stored(slices.mapInArrow(_encode(counts), "classes binary, slice int"), by="slice")
        counts.destroy()
        # a slice's expected counts; the counts of all, if some slices are yet to come
        parts: dict[int, np.ndarray] = {}
        self.likelihoods: list[float] = []
        for _ in range(passes):
            told = 0.0
            for k in range(SLICES):
                shared = spark.sparkContext.broadcast(self.chain)
                rows = encoded.read().where(F.col("slice") == k).select("classes")
                found = rows.mapInArrow(_expectations(shared), "at long, w double").groupBy("at").agg(F.sum("w").alias("w")).toArrow()
                shared.destroy()
                at, w = found["at"].to_numpy().astype(np.int64), found["w"].to_numpy()
                told += float(w[at < 0].sum())
                parts[k] = np.zeros(SUMS)
                parts[k][at[at >= 0]] = w[at >= 0]
                total = sum(parts.values())
                if total.any():
                    self.chain = Chain.from_counts(total, self.mass)
            self.likelihoods.append(told)
            if len(self.likelihoods) > 1 and told - self.likelihoods[-2] < GAIN * abs(told):
                break
        encoded.discard()


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, h long, g int, times long"


def _score(shared):
    """A row for each text with what the sent words give; rows of its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, chain, sums, tokens, distinct, texts = shared.value
        row = TaskContext.get().partitionId() << 40
        base = np.log10(counts.counts + 1.0)
        inside = np.where(counts.own > 0, 0.0, base)
        log_sum, log_all = np.log10(sums + 1), np.log10(tokens + distinct + 1)

        def done(held: list) -> Iterator[pa.RecordBatch]:
            scores = Pieces(chain, [x[0] for x in held]).log10(chain)
            n = len(held)
            rest = [[x[k] for x in held] for k in range(1, 7)]
            empty = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(rest[0], pa.int64()), pa.array(rest[1], pa.int64()), pa.array(rest[2], pa.bool_()), pa.array([len(x[0]) for x in held], pa.int64()), pa.array(rest[3], pa.int64()), pa.array(rest[4], pa.float64()), pa.array(scores + np.array(rest[5])), *empty], names=names)

        names = [x.split()[0] for x in _SCORED.split(", ")]
        held, size = [], 0
        for batch in batches:
            ids, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi, hashes, ending, first in _tokens(batch.column(2)):
                at, c = _classed(counts, hashes, ending)
                there = at >= 0
                b = np.where(there, base[at] if len(base) else 0.0, 0.0)
                w = np.where(there, inside[at] if len(base) else 0.0, 0.0) - np.where(c > OWN, log_sum[c], 0.0)
                for i in range(hi - lo):
                    x = slice(first[i], first[i + 1])
                    known = int(there[x].sum())
                    n = first[i + 1] - first[i] + 1
                    total = float(b[x].sum()) + np.log10(texts + 1.0) - n * log_all
                    held.append((np.append(c[x], 0), row + lo + i, ids[lo + i], flags[lo + i], known + (texts > 0), total, float(w[x].sum())))
                # words that weren't sent, each once for a text
                other = np.flatnonzero(~there)
                if len(other):
                    of = np.searchsorted(first, other, "right") - 1
                    order = np.lexsort((hashes[other], of))
                    other, of = other[order], of[order]
                    h = hashes[other]
                    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]))
                    n = len(new)
                    blank = [pa.nulls(n, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(of[new] + (row + lo)), *blank, pa.array(h[new].view(np.int64)), pa.array(ending[other[new]].astype(np.int32)), pa.array(np.diff(np.append(new, len(h))))], names=names)
                size += hi - lo + len(hashes)
                if size >= WINDOW:
                    yield from done(held)
                    held, size = [], 0
            row += batch.num_rows
        if held:
            yield from done(held)

    return run


def score(docs: DataFrame, parts: int = PARTS, part: int = HELD_OUT, passes: int = PASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each
    row of ``docs`` (doc_id, text).

    A null or empty text is the end token alone.  Repeated rows are scored, and counted
    in training, as often as they occur; a null doc_id isn't held out.  Without training
    texts all words are unknown.  Other columns aren't read; an empty table gives none."""
    model = LanguageModel(docs, parts, part, passes)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.counts, model.chain, model.sums, model.tokens, model.distinct, model.texts))
    rows = docs.select(F.col("doc_id").cast("long"), held_out(parts, part).alias("held_out"), "text")
    told = Stored(rows.mapInArrow(_score(shared), _SCORED))
    others = told.read().where("h is not null").join(model.vocabulary.select("h", "c"), "h", "left")
    share = F.log10(F.coalesce("c", F.lit(0)) + 1)
    more = others.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"), F.sum(share * F.col("times")).alias("more"))
    whole = told.read().where("h is null").join(more, "row", "left")
    # unsent words' denominators are in what the text's own row holds
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
