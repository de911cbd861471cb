"""Phrase collocation mining: tries of Apriori-safe candidates, walked by all positions at once.

1. *Words.*  All words of every language are counted; those that are frequent enough get
   codes.  Texts are written once more as arrays of codes, with 0 between pieces and for all
   other words: no candidate holds a rare word.
2. *Candidates* of k + 1 words are sequences in the texts whose first k and last k words are
   frequent phrases (Apriori) and whose hash occurs often enough: hashes are counted by a
   shuffle of sums from each task, and those that are frequent set bits in a filter of fixed
   size.  Collisions and a full filter only let more candidates in.
3. *Counts.*  Candidates are dealt into blocks of bounded size.  A block is a double-array
   trie (next state: base[state] + sign, valid if its check is the state; a sign is a byte
   of a word's code) that is sent to all tasks; numpy advances the states of all positions together, a level at a time, and
   counts accepting states with ``bincount``.  Tasks' counts are summed in slices.

Then every candidate is cut in two in each place, scored against its parts' counts in whole
numbers, and ranked within its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from . import wordspans
from .ngram_join import FILTER_BITS, _row_filter
from .shared import Stored, small_batches

#: occurrences and words of a phrase
LEAST, WORDS = 100, 5
#: a phrase goes if a longer one that holds it has this share of its occurrences
ABSORB_PERCENT = 100
#: phrases reported for each language
TOP = 2000
#: candidates of one trie, and frequent words of one table of codes, at most
BLOCK = 1 << 17
CODES = 1 << 20
#: positions of one row of codes, and cells after them: no phrase may have more words
CELLS = 1 << 18
AHEAD = 16
#: counts of one row between tasks
SLICE = 4096
#: bits of a hash below those that tell its slice: 2048 slices
HASH_SLICE_SHIFT = 53
#: rows of words that a task holds before it sums them, hashes likewise, and rows of one batch
HELD = 1 << 17
HASHES = 1 << 19
BATCH_ROWS = 1 << 16
#: slots of a trie for each of its nodes: placing is quick in a table that is mostly free
ROOM = 6

U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_SPLIT = _BREAK.copy()
_SPLIT[[0x20, 0x09]] = True


# --- words -----------------------------------------------------------------------------


def _languages(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Each row's language, their names and a hash for each."""
    coded = column.dictionary_encode()
    names = coded.dictionary.to_pylist()
    return coded.indices.to_numpy(zero_copy_only=False), names, np.array([tb.hash_bytes(b"lang " + n.encode()) for n in names], U)


def _pieces(batches: Iterator[pa.RecordBatch]):
    """For each bounded piece of batches (lang, text): lowered bytes, words' spans, their keys
    (a positive hash of language and word), languages, names, and whether a word begins a piece."""
    for batch in batches:
        lang, names, salt = _languages(batch.column(0))
        for lo, hi, data, offsets in tb.pieces(batch.column(1)):
            low = tb.LOWER[data]
            starts, ends, first = tb.runs(~_SPLIT[data], offsets)
            of = np.repeat(lang[lo:hi], np.diff(first))
            key = tb.mix(wordspans.hashes(low, starts, ends) ^ salt[of]) >> U(1) | U(1) if len(starts) else np.zeros(0, U)
            marks = np.concatenate([[0], np.cumsum(_BREAK[data])])
            begins = np.ones(len(starts), bool)
            begins[1:] = marks[starts[1:]] > marks[ends[:-1]]
            begins[first[:-1][first[:-1] < len(starts)]] = True
            yield low, starts, ends, key.view(np.int64), of, names, begins


_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("key", pa.int64()), ("seen", pa.int64())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words by language, and of all words together (word null), summed in windows."""
    held: list[pa.RecordBatch] = []
    size = 0

    def summed() -> pa.Table:
        return pa.Table.from_batches(held, _COUNTS).group_by(["lang", "word", "key"]).aggregate([("seen", "sum")]).rename_columns(["lang", "word", "key", "seen"])

    for low, starts, ends, key, of, names, _ in _pieces(batches):
        if not len(key):
            continue
        keys, at, seen = np.unique(key, return_index=True, return_counts=True)
        data, to = wordspans.copied(low, starts[at], ends[at])
        inside = np.ones(len(data), bool)
        inside[to[1:] - 1] = False
        word = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(to - np.arange(len(to))), pa.py_buffer(data[inside])).cast(pa.string())
        lang = pa.array(names, pa.string())
        held.append(pa.RecordBatch.from_arrays([lang.take(pa.array(of[at])), word, pa.array(keys), pa.array(seen)], schema=_COUNTS))
        all_of = np.bincount(of, minlength=len(names))
        held.append(pa.RecordBatch.from_arrays([lang, pa.nulls(len(names), pa.string()), pa.array(np.zeros(len(names), np.int64)), pa.array(all_of)], schema=_COUNTS))
        size += len(at)
        if size > HELD:
            table = summed()
            held, size = table.to_batches(), len(table)
            if size > HELD // 2:
                yield from table.to_batches(BATCH_ROWS)
                held, size = [], 0
    if held:
        yield from summed().to_batches(BATCH_ROWS)


# --- codes -----------------------------------------------------------------------------


class Codes:
    """Sorted keys of frequent words, found by their first bits; code = first + place."""

    def __init__(self, keys: np.ndarray, first: int):
        self.keys, self.first = np.append(keys, np.int64(-1)), first
        self.shift = 63 - max(1, int(2 * len(keys)).bit_length())
        begins = np.bincount(keys >> self.shift, minlength=1 << (63 - self.shift))
        self.start = np.concatenate([[0], np.cumsum(begins)]).astype(np.int32)
        self.most = int(begins.max(initial=0))

    def of(self, cells: np.ndarray) -> np.ndarray:
        """Cells with the keys that are here replaced by minus their codes."""
        out = cells.copy()
        at = np.flatnonzero(cells > 0)
        head = cells[at] >> self.shift
        place, end = self.start[head], self.start[head + 1]
        for _ in range(self.most):
            left = place < end
            at, place, end = at[left], place[left], end[left]
            hit = self.keys[place] == cells[at]
            out[at[hit]] = -(place[hit] + self.first)
            at, place, end = at[~hit], place[~hit] + 1, end[~hit]
        return out


def _rows_of_codes(cells: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    """Bounded rows; each has the next cells too, where no phrase of the row begins."""
    for k in range(0, len(cells), CELLS):
        part = np.ascontiguousarray(cells[k : k + CELLS + AHEAD]).astype(kind)
        yield pa.RecordBatch.from_pydict({"cells": pa.array([part.tobytes()], pa.binary()), "starts": pa.array([min(CELLS, len(cells) - k)], pa.int32())})


def _written(codes, last: bool, kind: str):
    """Texts as keys, with the words of one table as codes; ``last``: 0 for all other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                cells = codes.value.of(np.concatenate(held))
                yield from _rows_of_codes(np.maximum(-cells, 0) if last else cells, kind)

        for _, _, _, key, _, _, begins in _pieces(batches):
            cells = np.zeros(len(key) + int(begins.sum()), np.int64)
            cells[np.arange(len(key)) + np.cumsum(begins)] = key
            held.append(cells)
            size += len(cells)
            if size >= CELLS:
                yield from out()
                held, size = [], 0
        yield from out()

    return run


def _rewritten(codes, last: bool, kind: str):
    """Rows of keys with one more table's words as codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cells = codes.value.of(np.frombuffer(batch.column(0)[i].as_buffer(), np.int64))
                part = (np.maximum(-cells, 0) if last else cells).astype(kind)
                yield pa.RecordBatch.from_pydict({"cells": pa.array([part.tobytes()], pa.binary()), "starts": batch.column(1).slice(i, 1)})

    return run


_CELLS = "cells binary, starts int"


def _coded(texts: DataFrame, words: Stored, kind: str, blocks: int) -> tuple[Stored, Stored]:
    """Texts as rows of codes, and the words with theirs: a pass for each table of codes."""
    spark = texts.sparkSession
    first, done, parts = 1, None, []
    for b in range(blocks):
        block = words.read().where(f"word is not null and pmod(key, {blocks}) = {b}")
        keys = np.sort(block.select("key").distinct().toArrow()["key"].to_numpy().astype(np.int64))
        codes = spark.sparkContext.broadcast(Codes(keys, first))
        last = b == blocks - 1
        width = kind if last else "<i8"
        step = Stored(done.read().mapInArrow(_rewritten(codes, last, width), _CELLS) if done else texts.mapInArrow(_written(codes, last, width), _CELLS))
        if done:
            done.discard()
        done = step
        parts.append(Stored(block.mapInArrow(_with_codes(codes), "lang string, word string, seen bigint, code int")))
        codes.destroy()
        first += len(keys)
    return done, Stored(reduce(DataFrame.unionByName, [p.read() for p in parts]))


def _with_codes(codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = -codes.value.of(batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("word"), batch.column("seen"), pa.array(code.astype(np.int32))], names=["lang", "word", "seen", "code"])

    return run


# --- tries -----------------------------------------------------------------------------


class Trie:
    """A double array over the paths (n, k) of codes, which are distinct; state 0 is the root.
    A code is followed a byte at a time, the highest first, so no state has more than 256
    next ones; a path's last state holds minus its place in ``paths`` less one as its base."""

    def __init__(self, paths: np.ndarray):
        self.depth = paths.shape[1]
        self.paths = paths = paths[np.lexsort(paths.T[::-1])]
        self.bytes = max(1, -(-int(paths.max()).bit_length() // 8))
        self.begins = np.zeros(int(paths[:, 0].max()) + 2, bool)  # whether a path begins with a code
        self.begins[paths[:, 0]] = True
        signs = np.stack([paths[:, k] >> (8 * j) & 255 for k in range(self.depth) for j in reversed(range(self.bytes))], axis=1)
        new = np.ones(signs.shape, bool)  # whether a row is the first with its first l + 1 bytes
        new[1:] = np.logical_or.accumulate(signs[1:] != signs[:-1], axis=1)
        numbered = np.cumsum(new, axis=0) - 1
        first = np.concatenate([[1], 1 + np.cumsum(numbered[-1] + 1)])  # node 0 is the root
        sign = np.concatenate([signs[new[:, k], k] for k in range(signs.shape[1])]).astype(np.int64)
        parent = np.concatenate([np.zeros(numbered[-1][0] + 1, np.int64)] + [first[k - 1] + numbered[new[:, k], k - 1] for k in range(1, signs.shape[1])])
        slot = self._place(sign, parent, int(first[-1]))
        self.base[slot[first[-2] : first[-1]]] = -1 - np.arange(len(paths), dtype=np.int32)

    def _place(self, sign: np.ndarray, parent: np.ndarray, nodes: int) -> np.ndarray:
        """Slots of the nodes.  Every node with children gets a base so that all of them have
        slots of their own: those with most children first, all of a kind at random together and
        those that collide again; a table in which too many do is doubled."""
        rng = np.random.default_rng(nodes)
        owner, begin, count = np.unique(parent, return_index=True, return_counts=True)  # nodes are numbered by level and path
        spread = ROOM * nodes + 512
        free, claim = np.ones(spread + 256, bool), np.zeros(spread + 256, np.int64)
        free[0] = False
        base_of = np.zeros(nodes, np.int64)
        high = 256
        while high:
            left = np.flatnonzero((count <= high) & (count > high // 2))
            tries = 0
            while len(left):
                tries += 1
                if not tries % 500:
                    free, claim, spread = np.concatenate([free, np.ones(spread, bool)]), np.zeros(len(free) + spread, np.int64), 2 * spread
                size = count[left]
                starts = np.concatenate([[0], np.cumsum(size)[:-1]])
                at = np.repeat(begin[left] - starts, size) + np.arange(int(size.sum()))
                base = rng.integers(1, spread, len(left))
                slot, by = np.repeat(base, size) + sign[at], np.repeat(np.arange(len(left)), size)
                claim[slot] = by
                fits = np.logical_and.reduceat((claim[slot] == by) & free[slot], starts)
                base_of[owner[left[fits]]] = base[fits]
                free[slot[fits[by]]] = False
                left = left[~fits]
            high //= 2
        slot = np.concatenate([[0], base_of[parent] + sign])
        self.base, self.check = np.zeros(len(free), np.int32), np.full(len(free), -1, np.int32)
        self.base[slot] = base_of
        self.check[slot[1:]] = slot[parent]
        return slot

    def walk(self, cells: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions below ``starts`` where a path begins, and which.  ``cells`` ends in
        ``depth`` zeros."""
        at = np.flatnonzero(self.begins[np.minimum(cells[:starts], len(self.begins) - 1)])
        state = np.zeros(len(at), np.int32)
        for k in range(self.depth):
            code = cells[at + k]
            some = (code > 0) & (code < 1 << 8 * self.bytes)
            at, state, code = at[some], state[some], code[some]
            for j in reversed(range(self.bytes)):
                to = self.base[state] + (code >> 8 * j & 255)
                ok = self.check[to] == state
                at, state, code = at[ok], to[ok], code[ok]
        return at, -1 - self.base[state]


def _cells(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[np.ndarray, int]]:
    for batch in batches:
        for i in range(batch.num_rows):
            cells = np.frombuffer(batch.column(0)[i].as_buffer(), kind).astype(np.int32)
            yield np.concatenate([cells, np.zeros(AHEAD, np.int32)]), batch.column(1)[i].as_py()


def _sequence_hash(cells: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(at), U)
    for k in range(size):
        out = tb.mix(out * U(0x9E3779B97F4A7C15) + cells[at + k].astype(U))
    return out.view(np.int64)


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & ((1 << FILTER_BITS) - 1)
    return (bits[at >> 6] >> (at & 63).astype(U) & U(1)).astype(bool)


def _longer(cells: np.ndarray, starts: int, trie, phrases, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ``size`` + 1 words begin whose first and last ``size`` are frequent phrases (as
    far as the filter tells), and their hashes."""
    at = np.flatnonzero(cells[:starts]) if trie is None else trie.value.walk(cells, starts)[0]
    at = at[cells[at + size] > 0]
    if phrases is not None:
        at = at[_passes(phrases.value, _sequence_hash(cells, at + 1, size))]
    return at, _sequence_hash(cells, at, size + 1)


def _hash_counts(trie, phrases, size: int, kind: str):
    """Counts of the hashes of longer sequences, summed in windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                key, seen = np.unique(np.concatenate(held), return_counts=True)
                for k in range(0, len(key), BATCH_ROWS):
                    yield pa.RecordBatch.from_pydict({"rh": pa.array(key[k : k + BATCH_ROWS]), "seen": pa.array(seen[k : k + BATCH_ROWS])})

        for cells, starts in _cells(batches, kind):
            held.append(_longer(cells, starts, trie, phrases, size)[1])
            size_held += len(held[-1])
            if size_held > HASHES:
                yield from out()
                held, size_held = [], 0
        yield from out()

    return run


def _sequences(trie, phrases, often, size: int, kind: str):
    """The longer sequences whose hashes are frequent, packed in slices of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros((0, size + 1), np.int32))
        for cells, starts in _cells(batches, kind):
            at, key = _longer(cells, starts, trie, phrases, size)
            at, key = (x[_passes(often.value, key)] for x in (at, key))
            held = _merged(held, (key, np.stack([cells[at + k] for k in range(size + 1)], axis=1)))
            if len(held[0]) > HASHES:
                yield from _packed(held)
                held = (held[0][:0], held[1][:0])
        yield from _packed(held)

    return run


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of both, in order, with their sequences."""
    key, at = np.unique(np.concatenate([a[0], b[0]]), return_index=True)
    return key, np.concatenate([a[1], b[1]])[at]


def _packed(found: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    key, paths = found
    part = key >> HASH_SLICE_SHIFT
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(key)]])
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if lo < hi:
            yield pa.RecordBatch.from_pydict({"slice": pa.array([part[lo]], pa.int64()), "keys": pa.array([key[lo:hi].tobytes()], pa.binary()), "paths": pa.array([np.ascontiguousarray(paths[lo:hi]).tobytes()], pa.binary())})


def _unpacked(size: int):
    """Each sequence of the slices once.  Rows of a slice stand together."""

    def paths(found: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(found[0]), BATCH_ROWS):
            part = found[1][k : k + BATCH_ROWS]
            yield pa.RecordBatch.from_pydict({"path": pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, size + 1), pa.int32()), pa.array(part.ravel()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                new = (np.frombuffer(batch.column(1)[i].as_buffer(), np.int64), np.frombuffer(batch.column(2)[i].as_buffer(), np.int32).reshape(-1, size + 1))
                if part != now and held is not None:
                    yield from paths(held)
                    held = None
                now, held = part, new if held is None else _merged(held, new)
        if held is not None:
            yield from paths(held)

    return run


def _leaf_counts(trie, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(trie.value.paths)
        total = np.zeros(-(-n // SLICE) * SLICE, np.int64)
        for cells, starts in _cells(batches, kind):
            total += np.bincount(trie.value.walk(cells, starts)[1], minlength=len(total))
        for k in np.flatnonzero(total.reshape(-1, SLICE).any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "seen": pa.array([total[k * SLICE : (k + 1) * SLICE].tobytes()], pa.binary())})

    return run


def _summed(trie):
    """Slices of counts, added up; a row for each path that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, k in enumerate(batch.column(0).to_pylist()):
                part = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
                total[k] = total[k] + part if k in total else part
        for k, counts in total.items():
            at = np.flatnonzero(counts)
            path = trie.value.paths[k * SLICE + at]
            yield pa.RecordBatch.from_pydict({"path": pa.ListArray.from_arrays(pa.array(np.arange(0, path.size + 1, path.shape[1]), pa.int32()), pa.array(path.ravel())), "seen": pa.array(counts[at])})

    return run


def _tries(paths: DataFrame, size: int) -> Iterator[Trie]:
    """Tries of all ``paths``, each of at most ``BLOCK``.  They are dealt by their first word, so
    a position is walked in one trie and passed over in all others; only if a word has too many
    for that, by more of their words."""
    blocks = max(1, -(-paths.count() * 5 // (4 * BLOCK)))

    def dealt_by(words: int) -> DataFrame:
        return paths.withColumn("block", F.expr(f"pmod(xxhash64(slice(path, 1, {words})), {blocks})"))

    def fits(dealt: DataFrame) -> bool:
        return (dealt.groupBy("block").count().agg(F.max("count")).first()[0] or 0) <= BLOCK

    words = 1
    while not fits(dealt := dealt_by(words)):
        words, blocks = (words, 2 * blocks) if words == size else (words + 1, blocks)
    for b in range(blocks):
        block = dealt.where(F.col("block") == b).select("path").toArrow()["path"].combine_chunks()
        if len(block):
            yield Trie(block.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int32))


def _hashes(paths: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"rh": pa.array(_sequence_hash(path, np.arange(0, len(path), size), size))})

    return paths.mapInArrow(run, "rh bigint")


def _frequent_phrases(coded: DataFrame, known: DataFrame | None, size: int, least: int, kind: str) -> list[Stored]:
    """(path, seen) of the phrases of ``size`` + 1 words, given those of ``size`` (None: words)."""
    spark = coded.sparkSession
    send = spark.sparkContext.broadcast
    tries = [send(t) for t in _tries(known, size)] if known is not None else [None]
    if not tries:
        return []
    phrases = send(_row_filter(_hashes(known.select("path"), size))) if known is not None else None
    sums = reduce(DataFrame.unionByName, [coded.mapInArrow(_hash_counts(t, phrases, size, kind), "rh bigint, seen bigint") for t in tries])
    often = send(_row_filter(sums.groupBy("rh").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= least)))
    found = reduce(DataFrame.unionByName, [coded.mapInArrow(_sequences(t, phrases, often, size, kind), "slice long, keys binary, paths binary") for t in tries])
    candidates = Stored(found.repartition("slice").sortWithinPartitions("slice").mapInArrow(_unpacked(size), "path array<int>"))
    for b in (*tries, phrases, often):
        if b is not None:
            b.destroy()
    parts = []
    for trie in _tries(candidates.read(), size + 1):
        sent = send(trie)
        counts = coded.mapInArrow(_leaf_counts(sent, kind), "slice int, seen binary").repartition("slice").mapInArrow(_summed(sent), "path array<int>, seen bigint")
        parts.append(Stored(counts.where(F.col("seen") >= least)))
        sent.destroy()
    candidates.discard()
    return parts


def count_phrases(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The phrases of 1 to ``words`` words of ``docs`` (lang, text) that occur ``least`` times
    or more in their language: (path, seen), the codes' words (lang, word, seen, code), and the
    number of all words of each language (lang, n)."""
    if not 1 <= words <= AHEAD:
        raise ValueError(f"phrases have 1 to {AHEAD} words")
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    counts = texts.mapInArrow(_count_words, "lang string, word string, key bigint, seen bigint").groupBy("lang", "word", "key").agg(F.sum("seen").alias("seen"))
    table = Stored(counts.where(F.col("word").isNull() | (F.col("seen") >= least)))
    n_words = table.read().where("word is not null").count()
    kind = "<u2" if n_words < 1 << 16 else "<i4"
    coded, named = _coded(texts, table, kind, max(1, -(-n_words * 5 // (4 * CODES))))
    levels = [named.read().select(F.array("code").alias("path"), "seen")]
    known = None
    for size in range(1, words):
        parts = _frequent_phrases(coded.read(), known, size, least, kind)
        if not parts:
            break
        known = reduce(DataFrame.unionByName, [p.read() for p in parts])
        levels.append(known)
    coded.discard()
    total = table.read().where("word is null").select("lang", F.col("seen").alias("n"))
    return reduce(DataFrame.unionByName, levels), named.read(), total


def collocations(docs: DataFrame, least: int = LEAST, words: int = WORDS, absorb_percent: int = ABSORB_PERCENT, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of 2 to ``words`` words of each language of ``docs`` (lang, text) by
    score: lang, rank, phrase, a (its count), l and r (counts of the parts of its lowest-scoring
    cut), n (words of the language), score = floor(1000 a n / (l r)).

    A-Z are lowered; texts end in pieces at ``.,;:!?`` and line ends, pieces in words at spaces
    and tabs.  A null language is ``und``; null and empty texts have no words; long texts are
    counted whole.  Equal rows count as often as they stand there.  Ties in score go to the
    greater count, then to the smaller phrase by its bytes; ties of cuts to the first.  Other
    columns aren't read.  An empty table, and a language without frequent phrases, give no rows.
    Words, and candidates until they are counted, are told apart by 64-bit hashes.
    """
    counted, named, total = count_phrases(docs, least, words)
    counted = Stored(counted).read()
    longer = counted.where(F.size("path") > 1)
    parts = longer.select("path", F.col("seen").alias("a"), F.explode(F.expr("sequence(1, size(path) - 1)")).alias("k"))
    parts = parts.withColumn("left", F.expr("slice(path, 1, k)")).withColumn("right", F.expr("slice(path, k + 1, size(path) - k)"))
    parts = parts.join(counted.select(F.col("path").alias("left"), F.col("seen").alias("l")), "left").join(counted.select(F.col("path").alias("right"), F.col("seen").alias("r")), "right")
    of = named.select(F.col("code"), "lang").join(total, "lang")
    parts = parts.withColumn("code", F.col("path")[0]).join(of, "code")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    # 1000 a n stays below 10^38 up to 10^17 words
    parts = parts.withColumn("up", (wide("a") * 1000).cast("decimal(23,0)")).withColumn("up", (F.col("up").cast("decimal(38,0)") * F.col("n").cast("decimal(20,0)")).cast("decimal(38,0)")).withColumn("low", (wide("l") * wide("r")).cast("decimal(38,0)"))
    parts = parts.withColumn("score", F.expr("up div low"))
    cut = parts.groupBy("path", "lang").agg(F.expr("min_by(struct(a, l, r, n, score), struct(score, k))").alias("c")).select("path", "lang", "c.*")
    inner = longer.where(F.size("path") > 2).select(F.col("seen").alias("more"), "path", F.explode(F.expr("sequence(2, size(path) - 1)")).alias("m"))
    inner = inner.select("more", F.expr("explode(transform(sequence(1, size(path) - m + 1), i -> slice(path, i, m)))").alias("path")).groupBy("path").agg(F.max("more").alias("more"))
    kept = cut.join(inner, "path", "left").where(f"more is null or 100 * more < {absorb_percent} * a").drop("more")
    spelled = kept.select("path", F.posexplode("path").alias("i", "code")).join(named.select("code", "word"), "code").groupBy("path").agg(F.expr("array_join(transform(sort_array(collect_list(struct(i, word))), x -> x.word), ' ')").alias("phrase"))
    ranked = kept.join(spelled, "path").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: the same phrases from slices of lists of words
SQL = f"""
with texts as (
    select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), pieces as (
    select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from texts
), listed as (
    select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') as ws from pieces
), sized as (
    select lang, ws, unnest(range(1, {WORDS} + 1)) as k from listed
), spans as (
    select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from sized where len(ws) >= k
), counted as (
    select lang, ws[i : i + k - 1] as p, k, count(*) as f from spans group by all
), totals as (
    select lang, sum(f)::bigint as n from counted where k = 1 group by lang
), often as (
    select * from counted where f >= {LEAST}
), cuts as (
    select lang, p, f, k, unnest(range(1, k)) as c from often where k > 1
), scored as (
    select x.lang, x.p, x.f as a, x.c, y.f as l, z.f as r, t.n, (1000::hugeint * x.f * t.n) // (y.f::hugeint * z.f) as score
    from cuts x join often y on y.lang = x.lang and y.p = x.p[1 : c] join often z on z.lang = x.lang and z.p = x.p[c + 1 :] join totals t on t.lang = x.lang
), lowest as (
    select * from scored qualify row_number() over (partition by lang, p order by score, c) = 1
), inner_sizes as (
    select lang, p, k, f, unnest(range(2, k)) as m from often where k > 2
), inner_spans as (
    select lang, p, m, f, unnest(range(1, k - m + 2)) as i from inner_sizes
), absorbed as (
    select lang, p[i : i + m - 1] as p, max(f) as more from inner_spans group by all
), ranked as (
    select s.lang, array_to_string(s.p, ' ') as phrase, a, l, r, n, score::bigint as score
    from lowest s left join absorbed b on b.lang = s.lang and b.p = s.p where b.more is null or 100 * b.more < {ABSORB_PERCENT} * a
)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score
from ranked qualify rank <= {TOP}
"""
