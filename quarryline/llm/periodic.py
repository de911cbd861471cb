"""Periodic run detection: string synchronising sets over the words of each text.

A run is a stretch of words that repeats with smallest period q at least three times and
that no neighbouring word extends.  Periods up to ``SMALL`` are found by comparing each
word with the one that far ahead.  Longer ones are found scale by scale, at
tau = 6, 12, 24, ...:

* *Highly periodic regions*: the windows of tau words that lie in a run of period at most
  tau / 3.  Those runs belong to smaller scales and are known by then.
* *Synchronising set*: every other window has the hash of its words as identity.  Position
  i is chosen when the smallest identity among windows i .. i + tau is that of window i or
  of window i + tau.  The choice depends on words i .. i + 2 tau - 1 alone, so equal
  contexts are chosen alike, and outside of the periodic regions tau positions in a row
  always hold a chosen one.
* *Proposals*: a run of period p with 1.5 tau <= p < 3 tau holds a chosen i for which i + p
  is chosen too, both with equal contexts inside of the run (three periods are long enough
  for that, and two less one word can't all be periodic by tau / 3).  So all pairs of
  chosen positions that far apart with equal contexts propose their distance.
* *Runs*: each proposal is extended both ways by comparing hashes of spans, then held
  against the words' own hashes; where a span's hash has deceived, the row is compared word
  by word at that distance.  Of proposals for one stretch the smallest period is its own.

Everything is a numpy pass over the words of a bounded piece of a batch (a long text is a
piece of its own); a scale takes time in proportion to the words of the texts that are
long enough for it.  Texts are independent of each other: no shuffle and no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from . import wordspans
from .shared import small_batches

#: times that a run's words repeat at least; the proposals are complete from three on
EXPONENT = 3
#: words of a run at least
SHORTEST = 24
#: periods that are found by comparing words directly
SMALL = 8
FIRST_SCALE = 6

U = np.uint64
_LAST = np.iinfo(U).max
_A, _B = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of true of ``least`` or more."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).view(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    keep = hi - lo >= least
    return lo[keep], hi[keep]


def _at_distance(ids: np.ndarray, p: int) -> list[tuple[int, int]]:
    """(start, end) of all stretches of period ``p`` that repeat three times."""
    lo, hi = _stretches(ids[p:] == ids[:-p], (EXPONENT - 1) * p)
    return list(zip(lo.tolist(), (hi + p).tolist(), strict=True))


def _pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return tb.mix(left * _A + tb.mix(right) * _B)


def _chosen(window: np.ndarray, periodic: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """The synchronising set of scale ``tau`` and its contexts' hashes.  ``window`` has a
    hash for tau words from each position on."""
    identity = np.where(periodic, _LAST, window)
    least, width = identity, 1
    while width < tau + 1:
        step = min(width, tau + 1 - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    n = len(least)
    at = np.flatnonzero(((identity[:n] == least) | (identity[tau : tau + n] == least)) & (least != _LAST))
    return at, _pair_hash(window[at], window[at + tau])


def _proposals(at: np.ndarray, context: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of pairs with equal contexts and low <= distance < high."""
    places, distances = [], []
    i = np.arange(len(at))
    k = 1
    while len(i := i[i + k < len(at)]):
        apart = at[i + k] - at[i]
        i, apart = i[apart < high], apart[apart < high]
        ok = (apart >= low) & (context[i] == context[i + k])
        places.append(at[i[ok]])
        distances.append(apart[ok])
        k += 1
    return (np.concatenate(places), np.concatenate(distances)) if places else (at[:0], at[:0])


def _extended(sums: np.ndarray, i: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the words before i, and those from i on, equal those d later."""
    n = len(sums) - 1
    left, right = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    step = 1 << max(0, int(most).bit_length())
    while step:
        lo = i - left - step
        ok = np.flatnonzero(lo >= 0)
        a = lo[ok]
        left[ok] += step * (tb.span_hash(sums, a, a + step) == tb.span_hash(sums, a + d[ok], a + d[ok] + step))
        hi = i + d + right + step
        ok = np.flatnonzero(hi <= n)
        b = hi[ok]
        right[ok] += step * (tb.span_hash(sums, b - d[ok] - step, b - d[ok]) == tb.span_hash(sums, b - step, b))
        step >>= 1
    return left, right


def _is_run(ids: np.ndarray, s: int, e: int, d: int) -> bool:
    if s > 0 and ids[s - 1] == ids[s - 1 + d] or e < len(ids) and ids[e] == ids[e - d]:
        return False
    return bool((ids[s : e - d] == ids[s + d : e]).all())


def word_runs(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and then period, of rows of words with
    hashes ``ids``; row r has words first[r] .. first[r + 1] - 1, and no run leaves its row."""
    rows = len(first) - 1
    length = np.diff(first)
    row = np.repeat(np.arange(rows), length)
    # after each row a mark that occurs nowhere else keeps rows apart
    line = np.empty(len(ids) + rows, U)
    line[np.arange(len(ids)) + row] = ids
    line[first[1:] + np.arange(rows)] = tb.mix(np.arange(rows, dtype=U) + _B)
    found: dict[tuple[int, int], int] = {}
    most = int(length.max(initial=0))
    for p in range(1, min(SMALL, most // EXPONENT) + 1):
        for s, e in _at_distance(line, p):
            found.setdefault((s, e), p)

    tau, window, at, size = FIRST_SCALE, None, np.arange(len(line)), np.repeat(length, length + 1)
    sums = None
    while 2 * most >= EXPONENT * 3 * tau:
        long_enough = 2 * size >= EXPONENT * 3 * tau  # three of the scale's smallest period
        if not long_enough.all():
            at, size = at[long_enough], size[long_enough]
            window = window[long_enough] if window is not None else None
        if window is None:
            window = np.zeros(len(at), U)
            words = line[at]
            for k in range(tau):
                window[: len(at) - k] += words[k:] * tb._PLACE[k % 5] * U(2 * (k // 5) + 1)
            window = tb.mix(window)
        periodic = np.zeros(len(line) + 1, np.int32)
        for (s, e), q in found.items():
            if EXPONENT * q <= tau <= e - s:
                periodic[s] += 1
                periodic[e - tau + 1] -= 1
        chosen, context = _chosen(window, np.cumsum(periodic)[at] > 0, tau)
        i, d = _proposals(chosen, context, -(-3 * tau // 2), 3 * tau)
        if len(i):
            if sums is None:
                sums = np.concatenate([np.zeros(1, U), np.cumsum((line + U(1)) * tb._power("up", tb._BASE, len(line)))])
            i = at[i]
            left, right = _extended(sums, i, d, most)
            s, e = i - left, i + d + right
            wide = e - s >= EXPONENT * d
            for p, x, y in sorted(set(zip(d[wide].tolist(), s[wide].tolist(), e[wide].tolist(), strict=True))):
                if _is_run(line, x, y, p):
                    found.setdefault((x, y), p)
                else:  # equal hashes of unequal spans
                    r = int(np.searchsorted(first + np.arange(rows + 1), x, "right")) - 1
                    base = int(first[r]) + r
                    for lo, hi in _at_distance(line[base : base + int(length[r])], p):
                        found.setdefault((base + lo, base + hi), p)
        # a window of twice as many words is two of this scale
        ahead = np.concatenate([window[tau:], np.zeros(min(tau, len(window)), U)])
        window = _pair_hash(window, ahead)
        tau *= 2
    out = np.array([(s, e, q) for (s, e), q in found.items()], np.int64).reshape(-1, 3)
    out = out[np.lexsort((out[:, 2], out[:, 0]))]
    marks = np.searchsorted(first[1:] + np.arange(rows), out[:, 0])  # marks before a run
    return out[:, 0] - marks, out[:, 1] - marks, out[:, 2]


def _scan(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in tb.pieces(batch.column(1)):
                starts, ends, first = tb.runs(~tb.SEPARATOR[data], offsets)
                s, e, q = word_runs(wordspans.hashes(data, starts, ends), first)
                enough = e - s >= shortest
                s, e, q = s[enough], e[enough], q[enough]
                gone = np.zeros(len(starts) + 1, np.int32)
                np.add.at(gone, s + q, 1)
                np.add.at(gone, e, -1)
                kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                cut, bound = np.searchsorted(kept, first), np.searchsorted(s, first)
                texts = [wordspans.joined(data, starts[k], ends[k]) for k in (kept[cut[r] : cut[r + 1]] for r in range(hi - lo))]
                runs = pa.StructArray.from_arrays([pa.array(s - np.repeat(first[:-1], np.diff(bound))), pa.array(e - s), pa.array(q)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(lo, hi - lo), "n_words": pa.array(np.diff(first)), "runs": pa.ListArray.from_arrays(pa.array(bound, pa.int32()), runs), "collapsed": pa.array(texts, pa.binary()).cast(pa.string())})

    return run


def find_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_words, runs (start, length and
    period in words, by start and then period) and collapsed: the words that no run holds
    after its first period, with one space between.

    Words are what stands between ASCII white space, upper and lower case apart.  Null,
    empty and wordless texts have no words, no runs and an empty collapsed text.  Texts of
    any length are whole; a text is the work of one task.  Repeated rows, null and equal
    doc_ids and ties change nothing: each row stands for itself.  Other columns aren't
    read.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan(shortest), f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def with_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, told by the checksum of their id, end in
    their words from some place on over and over.  All others are as they were."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.expr("filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != '')")
    hit = docs.select("doc_id", "text", F.when(h % 10 == 0, F.expr("1")).alias("hit"), F.floor(h / 10).alias("g")).withColumn("w", F.when(F.col("hit") == 1, words))
    sized = hit.withColumn("n", F.when(F.col("w").isNotNull(), F.size("w").cast("long"))).withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    whole = sized.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0, int(n) - 1), i -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return whole.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def runs_digest(docs: DataFrame) -> DataFrame:
    """The runs of ``docs`` with tails: their number, the one with the greatest exponent (ties:
    the smallest start, then period) and checksums of all runs and of the collapsed text."""
    found = find_runs(with_tails(docs))
    best = F.expr("aggregate(runs, runs[0], (b, r) -> if(r.length * b.period > b.length * r.period, r, b))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    table = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return table.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
