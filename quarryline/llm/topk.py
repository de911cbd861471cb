"""Exact top-k inner products by no-random-access aggregation.

Every component is a list of the candidates, sorted; for a query, a component's list
is read from the end that its sign favours.  Lists are read side by side, each entry
once and in order, an eighth, a half, two thirds, then all of them; an entry that has been
read adds its product to its candidate.  A candidate's score lies between two bounds: a
value not yet read is no better than the last one read from its list and no worse than
the list's end.  A candidate whose upper bound is under the k-th lower bound, read or not, can't qualify.
Reading stops when few are left, and their scores are resolved.

Candidates and queries are packed into blocks, and every block of queries meets every
block of candidates; only the k best of each meeting are shuffled.  The k-th best score
that a query has from the blocks a task read before is a lower bound for the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256
CANDIDATES = 4096
QUERIES = 1024
#: blocks of candidates that a block of queries meets in one task, and blocks of queries that it remembers
TOGETHER, REMEMBERED = 4, 8
#: depths that lists are read to before candidates are looked at, as parts of their length
DEPTHS = (1 / 8, 1 / 2, 2 / 3, 1)
_PACKED = "block long, ids binary, width int, kind string, cells binary"


def _pack(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors = None, [], []

        def block() -> pa.RecordBatch:
            width = max([1, *map(len, vectors)])
            cells = np.zeros((len(ids), width))
            for row, v in zip(cells, vectors, strict=True):
                row[: len(v)] = v
            small = np.abs(cells).max(initial=0) < 2**15
            kind = "<i2" if small else "<f8"
            return pa.RecordBatch.from_pydict({"block": [at], "ids": [np.array(ids, np.int64).tobytes()], "width": pa.array([width], pa.int32()), "kind": [kind], "cells": [cells.astype(kind).tobytes()]})

        for batch in batches:
            for b, i, v in zip(*(batch.column(n).to_pylist() for n in ("block", "vec_id", "v")), strict=True):
                if ids and (b != at or len(ids) == rows):
                    yield block()
                    ids, vectors = [], []
                at = b
                ids.append(i)
                vectors.append(v)
        if ids:
            yield block()

    return run


def _unpack(ids: bytes, width: int, kind: str, cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(cells, kind).reshape(-1, width).astype(float)


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of x with q, as long."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * len(q) < 2**52:
        return (x @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in exact], np.int64)


class Lists:
    """The sorted lists of a block of candidates, each readable from both ends."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(-x.T, axis=1, kind="stable").astype(np.int32)
        values = np.take_along_axis(x.T, order, axis=1)
        self.ids, self.x = ids, x
        self.order, self.values = np.concatenate([order, order[:, ::-1]]), np.concatenate([values, values[:, ::-1]])
        self.largest = np.abs(x).max(initial=0)
        #: entries read so far
        self.read = 0

    def nearest(self, own: int, q: np.ndarray, k: int, least: float) -> np.ndarray:
        """Rows of the candidates (without vec_id ``own``) that may be among the k best of
        q and reach ``least``: few, unless the lists had to be read to their ends."""
        n, width = self.x.shape
        extent = float(self.largest) * float(np.abs(q).max(initial=0)) * max(1, len(q))
        other = self.ids != own
        if not np.isfinite(extent):  # no bounds without overflow
            return np.flatnonzero(other)
        slack = 0.0 if extent < 2**52 else 1e-9 * extent
        used = np.flatnonzero(q)
        weight, rows = q[used], used + width * (q[used] < 0)
        worst = weight * self.values[rows, -1]
        # the k-th best score of earlier blocks is a lower bound already; without one, candidates' own are needed
        own_floor = np.full(n, worst.sum()) if np.isinf(least) else None
        score, maybe, depth = np.zeros(n), other, 0
        for part in DEPTHS:
            start, depth = depth, max(min(n, k), int(n * part))
            ids, products = self.order[rows, start:depth].ravel(), self.values[rows, start:depth] * weight[:, None]
            self.read += len(ids)
            score += np.bincount(ids, products.ravel(), n)
            roof, floor = score, score
            if depth < n:
                # what is unread of a list is no better than what was read last, and no worse than its end
                last = weight * self.values[rows, depth - 1]
                roof = score + last.sum() - np.bincount(self.order[rows, :depth].ravel(), np.repeat(last, depth), n)
                if own_floor is not None:
                    own_floor -= np.bincount(ids, np.repeat(worst, depth - start), n)
                    floor = score + own_floor
            lows = floor[other] if own_floor is not None or depth == n else score[:0]
            reach = max(least, np.partition(lows, len(lows) - k)[len(lows) - k] if len(lows) >= k else -np.inf)
            # scores outside of long are held at its ends, so they tie there
            reach = -np.inf if reach <= -(2.0**63) else min(reach, 2.0**63 - 1)
            maybe = other & (roof >= reach - slack)
            if maybe.sum() <= max(4 * k, n // 64):
                break
        return np.flatnonzero(maybe)


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, dict] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = _unpack(row["ids"], row["width"], row["kind"], row["cells"])
                qids, q = _unpack(row["qids"], row["qwidth"], row["qkind"], row["qcells"])
                if row["qids"] not in met and len(met) >= REMEMBERED:
                    met.pop(next(iter(met)))
                reached = met.setdefault(row["qids"], {})
                width = max(x.shape[1], q.shape[1])
                x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
                lists, out = Lists(ids, x), []
                for own, v in zip(qids.tolist(), q, strict=True):
                    before = reached.get(own, [])
                    rows = lists.nearest(own, v, k, before[-1] if len(before) == k else -np.inf)
                    scores = _scores(x[rows], v)
                    best = np.lexsort((ids[rows], -scores.astype(object) if scores.size and scores.min() == -(2**63) else -scores))[:k]
                    out += [(own, int(ids[rows[i]]), int(scores[i])) for i in best]
                    reached[own] = sorted([*before, *scores[best].tolist()], reverse=True)[:k]
                if out:
                    yield pa.RecordBatch.from_pydict({n: pa.array([o[i] for o in out], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    return run


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding)
    with ``is_query`` the k highest integer inner products among all rows with another
    vec_id, ties to the smaller vec_id; fewer if there are fewer rows.

    Components are floor(scale * x).  Rows whose vec_id or vector is null, or whose
    vector holds a null, NaN or infinity, take no part; shorter vectors are padded
    with 0.  A vec_id that repeats is one query (its smallest vector) and as many
    candidates.  Scores outside of long are held at its ends.  Other columns aren't read."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cells = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    clean = vectors.where("vec_id is not null and embedding is not null").where(ok)
    rows = clean.select(F.col("vec_id").cast("long").alias("vec_id"), cells.alias("v"), is_query.alias("asks"))
    asks = rows.where("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asks.count() // QUERIES))
    asked = asks.select(F.expr(f"pmod(xxhash64(vec_id), {blocks})").alias("block"), "vec_id", "v")
    queries = asked.repartition("block").sortWithinPartitions("block", "vec_id").mapInArrow(_pack(2 * QUERIES), _PACKED)
    queries = queries.select("block", *[F.col(c).alias("q" + c) for c in ("ids", "width", "kind", "cells")])
    packed = rows.select(F.lit(0).cast("long").alias("block"), "vec_id", "v").mapInArrow(_pack(CANDIDATES), _PACKED)
    # a block of candidates is copied once for some thousand queries, a block of queries
    # once for some thousand candidates
    groups = max(1, rows.count() // (TOGETHER * CANDIDATES))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = packed.withColumn("block", every(blocks)).withColumn("part", F.expr(f"pmod(xxhash64(ids), {groups})"))
    met = dealt.join(queries.withColumn("part", every(groups)), ["block", "part"])
    best = met.select("ids", "width", "kind", "cells", "qids", "qwidth", "qkind", "qcells").mapInArrow(_best(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def topk_digest(vectors: DataFrame) -> DataFrame:
    """The rows of the query: vec_ids divisible by 50 against all rows."""
    return top_k(vectors, F.col("vec_id") % 50 == 0)


#: the same in DuckDB's SQL
SQL = """
WITH ok AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asks AS (SELECT vec_id, min(v) AS v FROM ok WHERE vec_id % 50 = 0 GROUP BY vec_id),
scored AS (SELECT q.vec_id AS query_id, c.vec_id,
  CAST(list_inner_product(q.v[1:least(len(q.v), len(c.v))], c.v[1:least(len(q.v), len(c.v))]) AS BIGINT) AS score FROM asks q JOIN ok c ON q.vec_id != c.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
