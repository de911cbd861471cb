"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks of about ``block_bytes``.  With weight w,
block i of a source may run from slot floor(i / w) on and must have run by slot
ceil((i + 1) / w); taking the released block with the earliest deadline in each slot
keeps every source within less than one block of w * slots.

Weights are whole parts of a period (``resolution`` slots), so the schedule repeats:
one period, whose length doesn't depend on the data, is scheduled once, and the slot
of every block follows from it by arithmetic.  Rows are never dropped or repeated.
After a source has ended its slots stay empty and the others keep theirs.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import quoted, unused

BLOCK_BYTES = 1 << 16
RESOLUTION = 4096
#: sources that a recipe may name
MOST_SOURCES = 100_000
#: rows that are put in order in one task
BUCKET_ROWS = 2_000


def shares(weights: dict, resolution: int = RESOLUTION) -> dict:
    """Whole parts of the period in proportion to the weights, each at least one."""
    total = math.fsum(weights.values())
    if not weights or total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must be positive")
    period = max(resolution, 4 * len(weights))
    exact = {k: w / total * period for k, w in weights.items()}
    out = {k: max(1, math.floor(x)) for k, x in exact.items()}
    order = sorted(exact, key=lambda k: (math.floor(exact[k]) - exact[k], str(k)))
    spare = period - sum(out.values())
    for k in order[: max(0, spare)]:
        out[k] += 1
    while spare < 0:
        k = max(out, key=lambda x: (out[x], str(x)))
        out[k] -= 1
        spare += 1
    return out


def one_period(parts: dict) -> list[tuple]:
    """(source, k, slot): earliest deadline first over the blocks of one period."""
    period = sum(parts.values())
    waiting = sorted(((k * period // a, -(-(k + 1) * period // a), str(s), s, k) for s, a in parts.items() for k in range(a)), key=lambda x: x[:3])
    ready: list[tuple] = []
    out, at = [], 0
    for slot in range(period):
        while at < len(waiting) and waiting[at][0] <= slot:
            _, deadline, name, source, k = waiting[at]
            heapq.heappush(ready, (deadline, name, k, source))
            at += 1
        deadline, _, k, source = heapq.heappop(ready)
        out.append((source, k, slot))
    return out


def tempered(docs: DataFrame, power: float = 0.5) -> dict:
    """Target weights: each source's bytes to a power (1: as found, 0: equal)."""
    rows = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("bytes")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: map them to the sources of a recipe")
    return {r["source"]: float(r["bytes"]) ** power for r in rows}


def scheduled(docs: DataFrame, weights: dict | None = None, block_bytes: int = BLOCK_BYTES, resolution: int = RESOLUTION) -> DataFrame:
    """``docs`` (doc_id, text, source and others) with mix_block (of its source, from 0),
    mix_slot and mix_place (in its block, from 0): sorted by the last two it is mixed.

    Without weights, they are ``tempered``.  A null source is a source; a source that
    the weights don't name is an error.  A null text counts as empty.  A text longer
    than a block is a block that is longer.  Rows of a source are taken in an order
    that their doc_id's hash gives.  Names mix_* in ``docs`` are replaced."""
    docs = docs.drop("mix_block", "mix_slot", "mix_place")
    p = unused(docs.columns)
    size, hashed, bucket, upto, start, block = (p + n for n in ("size", "hash", "bucket", "upto", "start", "block"))
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    sized = docs.withColumn(size, length).withColumn(hashed, F.xxhash64("doc_id"))
    found = docs.groupBy("source").agg(F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()
    if not found:
        return docs.withColumns({"mix_block": F.lit(0).cast("long"), "mix_slot": F.lit(0).cast("long"), "mix_place": F.lit(0).cast("long")})
    weights = tempered(docs) if weights is None else weights
    missing = {r["source"] for r in found} - set(weights)
    if missing:
        raise ValueError(f"no weight for {sorted(map(str, missing))[:5]}")
    parts = shares(weights, resolution)
    period = sum(parts.values())
    spark = docs.sparkSession
    kind = docs.schema["source"].dataType.simpleString()
    counts = {r["source"]: r["rows"] for r in found}
    recipe = spark.createDataFrame([(s, a, max(1, -(-counts.get(s, 0) // BUCKET_ROWS))) for s, a in parts.items()], f"{p}s {kind}, {p}parts long, {p}buckets long")
    plan = spark.createDataFrame(one_period(parts), f"{p}s {kind}, {p}k long, {p}slot long")
    same = F.col("source").eqNullSafe(F.col(p + "s"))
    rows = sized.join(F.broadcast(recipe), same).drop(p + "s").withColumn(bucket, F.expr(f"pmod({hashed}, {p}buckets)"))
    sums = rows.groupBy("source", bucket).agg(F.sum(size).alias(p + "all"))
    before = F.sum(p + "all").over(Window.partitionBy("source").orderBy(bucket)) - F.col(p + "all")
    ahead = sums.select(F.col("source").alias(p + "s"), F.col(bucket).alias(p + "b"), before.alias(p + "ahead"))
    inside = Window.partitionBy("source", bucket).orderBy(hashed, "doc_id", size)
    placed = rows.withColumn(upto, F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(ahead, same & (F.col(bucket) == F.col(p + "b"))).drop(p + "s")
    placed = placed.withColumn(start, F.col(p + "ahead") + F.col(upto) - F.col(size))
    placed = placed.withColumn(block, F.floor(F.col(start) / block_bytes).cast("long"))
    turn = placed.join(F.broadcast(plan), same & (F.expr(f"{block} % {p}parts") == F.col(p + "k")))
    slot = F.expr(f"{block} div {p}parts * {period} + {p}slot")
    # within a block, by the byte at which a row starts
    place = F.col(start) - F.col(block) * block_bytes
    return turn.select(*quoted(docs.columns), F.col(block).alias("mix_block"), slot.cast("long").alias("mix_slot"), place.alias("mix_place"))


def mixed(docs: DataFrame, weights: dict | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` in mixed order: files and rows follow the schedule."""
    order = scheduled(docs, weights, block_bytes)
    out = order.repartitionByRange("mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place", "doc_id")
    return out.select(*quoted(docs.columns))


def mix_digest(docs: DataFrame) -> DataFrame:
    """The rows of the query: where each document stands."""
    rows = scheduled(docs.select("doc_id", "text", "source"))
    return rows.select("doc_id", "source", "mix_block", "mix_slot", "mix_place")
