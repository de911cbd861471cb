"""K-d tree sharding with DataFrame operations only.

Rows are points over metadata: source, language and size.  A node of the tree with
k shards is split along its widest dimension at the weighted quantile that gives
the halves floor(k/2) and ceil(k/2) shares of its bytes, until every leaf is one
shard.

*Cells.*  Rows are summed once to cells: equal coordinates (2**10 of sources, 2**6 of
languages, half octaves of sizes), and of coordinates that hold much, equal parts by the
text's hash, so that no cell holds more than a ``CELLS``-th of all bytes (or a 16th of a
shard).  There are at most 2**22 coordinates and twice that many parts however many rows
there are, mostly some ten thousand cells; the quantiles of all nodes of a level are
running sums over them.

*Copies.*  Equal texts are one point, whatever their metadata, so they stay in one
shard.  Only a group with more bytes than an even shard, which therefore fits none, is
cut, by the hash of its rows, into pieces of about a quarter of a shard.

*Large points* (above a sixteenth of a shard, so at most some twenty for each shard) are
dealt to the two sides first, in the order of the dimension; the cut through the cells
then makes up for what they leave uneven.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stored

SHARDS = 40
#: what a row takes besides its text
ROW_BYTES = 16
#: a point above this part of a shard is large; a group that is cut has so many pieces a shard
LARGE, PIECES = 16, 4
#: bits of the coordinates, and of the hash that cuts equal ones
SOURCE, LANG, SIZE, TIE = 10, 6, 6, 40
#: cells that all bytes would fill, at least, and for each shard
CELLS, SHARD_CELLS = 1 << 14, 16
#: groups of more rows than this, or than a 100 000th of all rows, are sent to the tasks
HOT_ROWS, MOST_HOT = 1000, 100_000
#: rows that are numbered in one task
NUMBERED = 50_000
DIMENSIONS = {"by_source": SOURCE, "by_lang": LANG, "by_size": SIZE}
CELL = ("large", *DIMENSIONS, "part")


def _slim(docs: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The rows without their texts."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    source = F.col("source") if "source" in docs.columns else F.lit(None)
    size = (F.octet_length(body) + ROW_BYTES).cast("long")
    octaves = F.least(F.lit((1 << SIZE) - 1), (F.log2(size.cast("double")) * 2).cast("int"))
    return docs.select(
        "doc_id",
        *order,
        size.alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"),
        F.xxhash64("doc_id", lang.cast("string"), source.cast("string")).alias("row_hash"),
        F.shiftrightunsigned(F.xxhash64(source.cast("string")), 64 - SOURCE).cast("int").alias("by_source"),
        F.shiftrightunsigned(F.xxhash64(lang.cast("string")), 64 - LANG).cast("int").alias("by_lang"),
        octaves.alias("by_size"),
    )


def _located(slim: DataFrame, groups: DataFrame, count: int, share: float) -> DataFrame:
    """The rows at their group's coordinates.  ``groups`` has the texts that repeat; those
    of very many rows, and those to be cut, are few (``MOST_HOT`` and one a shard) and are
    sent to the tasks, so that no text brings many rows to one."""
    known = (F.col("bytes") > share) | (F.col("copies") > max(HOT_ROWS, count // MOST_HOT))
    met = slim.join(F.broadcast(groups.where(known)), "h", "left")
    rest = slim.join(F.broadcast(groups.where(known).select("h")), "h", "left_anti").join(groups.where(~known), "h", "left")
    rows = met.where("copies is not null").unionByName(rest)
    whole = F.coalesce("bytes", "size")
    pieces = F.when(whole > share, F.when(F.col("copies") > 1, F.ceil(whole * PIECES / share)).otherwise(1)).otherwise(1)
    rows = rows.withColumns({"by_source": F.coalesce("one_source", "by_source"), "by_lang": F.coalesce("one_lang", "by_lang"), "large": whole > share / LARGE, "pieces": pieces.cast("long")})
    tie = F.shiftrightunsigned(F.xxhash64("h", F.expr("pmod(row_hash, pieces)")), 64 - TIE)
    return rows.withColumn("tie", tie).drop("one_source", "one_lang", "bytes", "copies", "pieces")


def _parted(located: DataFrame, bound: float) -> DataFrame:
    """The rows with the part of their coordinates that names their cell: a large point is
    its own, other coordinates are parted by hash if they hold more than ``bound``."""
    full = located.where("not large").groupBy(*DIMENSIONS).agg((F.sum("size") / bound).alias("full"))
    full = full.where("full > 1").withColumn("parts", F.ceil("full").cast("long")).drop("full")
    met = located.join(F.broadcast(full), [*DIMENSIONS], "left")
    part = F.shiftright(F.col("tie") * F.coalesce("parts", F.lit(1)), TIE)
    return met.withColumn("part", F.when(F.col("large"), F.col("tie")).otherwise(part)).drop("tie", "parts")


def _tree(cells: DataFrame, shards: int) -> DataFrame:
    """The cells (with their bytes) with the shard of the leaf that each falls into."""
    node, beside = Window.partitionBy("node"), Window.partitionBy("node", "large").orderBy("pos")
    tie = F.shiftrightunsigned(F.xxhash64(*CELL), 64 - TIE)
    now = cells.select("*", tie.alias("tie"), F.lit(1).cast("long").alias("node"), F.lit(shards).alias("k"), F.lit(0).alias("shard"))
    span = lambda d, bits: (F.max(d).over(node) - F.min(d).over(node)) * (1 << 20 - bits)
    half = F.floor(F.col("k") / 2).cast("int")
    most = shards
    while most > 1:
        spans = now.select("*", *[span(d, bits).alias(f"span_{d}") for d, bits in DIMENSIONS.items()], F.sum("bytes").over(node).alias("total"), F.sum(F.expr("if(large, bytes, 0)")).over(node).alias("heavy"))
        widest = F.greatest(*[f"span_{d}" for d in DIMENSIONS])
        value = F.when(F.col("span_by_source") == widest, F.col("by_source")).when(F.col("span_by_lang") == widest, F.col("by_lang")).otherwise(F.col("by_size"))
        goal = F.col("total") * half / F.col("k")
        placed = spans.select(*now.columns, "total", "heavy", goal.alias("goal"), (F.shiftleft(value.cast("long"), TIE) + F.col("tie")).alias("pos"))
        run = placed.withColumn("upto", F.sum("bytes").over(beside))
        # a beginning of the large points that leaves the goal in the cells' reach, near to their own share
        beyond = F.expr("greatest(0D, upto - goal, goal - (total - heavy) - upto)")
        off = F.abs(F.col("upto") - F.col("heavy") * half / F.col("k"))
        mine = F.when(F.col("large"), F.struct(beyond.alias("beyond"), off.alias("off"), F.col("pos").alias("pos"), F.col("upto").cast("double").alias("taken")))
        none = F.struct(F.expr("greatest(0D, goal - (total - heavy))").alias("beyond"), (F.col("heavy") * half / F.col("k")).cast("double").alias("off"), F.lit(-1).cast("long").alias("pos"), F.lit(0.0).alias("taken"))
        best = run.withColumn("held", F.least(F.coalesce(F.min(mine).over(node), none), none))
        up = F.when(F.col("large"), F.col("pos") > F.col("held.pos")).otherwise(F.col("upto") - F.col("bytes") / 2 > F.col("goal") - F.col("held.taken"))
        sided = best.withColumn("up", (F.col("k") > 1) & up)
        step = {"node": F.expr("if(k > 1, node * 2 + cast(up as int), node)"), "shard": F.col("shard") + F.when(F.col("up"), half).otherwise(0), "k": F.when(F.col("up"), F.col("k") - half).otherwise(F.greatest(half, F.lit(1)))}
        now = sided.select(*[step[c].alias(c) if c in step else c for c in now.columns])
        most -= most // 2
    return now.select(*CELL, "shard")


def kd_shards(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, and source and lang if there):
    doc_id, size (UTF-8 bytes and 16), text_crc32, shard, slot (0, 1, ... in a shard),
    and row_hash (of doc_id, lang and source) and h (of the text), which name the row.

    ``order``: columns of ``docs`` whose order the slots of a shard follow; the first
    holds whole numbers from 0 on, none of them of very many rows.
    ``target_bytes``: take as many shards as leave each at most about that much.
    A null text counts as empty; null metadata is a value of its own.  Equal texts share
    a shard unless together they exceed an even one.  Rows equal in doc_id, lang, source
    and text can't be told apart and are never cut, and neither is one long text; an
    empty table gives no rows.  Other columns of ``docs`` aren't read, and may have any
    name."""
    slim = Stored(_slim(docs, order))
    last = F.max(order[0]) if order else F.lit(0)
    total, count, last = slim.read().agg(F.sum("size"), F.count("*"), last).first()
    if target_bytes:
        shards = max(1, -(-(total or 0) // target_bytes))
    copies = slim.read().groupBy("h").agg(F.count("*").alias("copies"), F.sum("size").alias("bytes"), F.min("by_source").alias("one_source"), F.min("by_lang").alias("one_lang"))
    groups = Stored(copies.where("copies > 1"))
    located = Stored(_located(slim.read(), groups.read(), count, (total or 0) / shards))
    bound = (total or 0) / max(CELLS, SHARD_CELLS * shards)
    parted = _parted(located.read(), max(1.0, bound))
    leaves = Stored(_tree(parted.groupBy(*CELL).agg(F.sum("size").alias("bytes")), shards))
    # no cell holds much, so none is a hot key
    placed = parted.join(leaves.read(), [*CELL])
    buckets = max(1, int((count or 0) // (shards * NUMBERED)))
    # buckets are ranges of the first column that gives the order
    bucket = F.expr(f"cast(`{order[0]}` as decimal(20)) * {buckets} div {(last or 0) + 1}") if order else F.expr(f"pmod(row_hash, {buckets})")
    table = Stored(placed.select("doc_id", *order, "size", "text_crc32", "h", "row_hash", "shard", bucket.alias("bucket")))
    for done in (slim, groups, located, leaves):
        done.discard()
    return _numbered(table.read(), order)


def _numbered(table: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Gapless slots: shards are numbered in buckets, each from where the last ended."""
    sizes = table.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = sizes.withColumn("before", F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("rows"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(*order, "h", "doc_id", "row_hash"))
    numbered = table.withColumn("inside", inside).join(before.select("shard", "bucket", "before"), ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside") - 1).alias("slot"), "row_hash", "h")


def shard_digest(docs: DataFrame) -> DataFrame:
    """The rows of the query: law ``bytes``, shards 0 to 39."""
    return kd_shards(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
