"""Chat formatting with DataFrame operations only.

Logs hold a conversation again and again as it grows.  A rolling hash names every
prefix of every conversation: the hash after i turns is the sum of the hashes of
(place, role, text) of the first i turns.  A conversation whose whole hash is a
proper prefix of another one is a snapshot and is dropped by an anti-join; of equal
ones the smallest conv_id stays.  What is left is rendered.

All turns are sorted once, in ranges, so a long conversation lies in several of them.
Places, hashes and lengths are running sums: inside each range, plus the sums of the
conversation's ranges before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stored

#: rendered bytes of a part
PART_BYTES = 8 << 20
#: bytes of a text that the bounds of ranges are taken from
HEAD = 64
#: ``monotonically_increasing_id`` has the partition above this bit
_RANGE = 33


def _sorted(turns: DataFrame) -> DataFrame:
    """Every distinct turn; ``at`` grows in the order of conversations and turns."""
    once = turns.where("conv_id is not null").groupBy("conv_id", "turn", "role", "text").agg(F.lit(1).alias("one")).drop("one")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    ranges = once.repartitionByRange(*order, F.substring("text", 1, HEAD).asc_nulls_first())
    return ranges.sortWithinPartitions(*order, F.col("text").asc_nulls_first()).withColumn("at", F.monotonically_increasing_id())


def _running(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` (conv_id, at) with running sums of columns over their conversation."""
    rows = rows.withColumn("range", F.shiftright("at", _RANGE))
    inside = Window.partitionBy("conv_id", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("conv_id").orderBy("range")  # a row for each range of a conversation
    sums = rows.groupBy("conv_id", "range").agg(*[F.sum(n).alias(n) for n in names])
    ahead = sums.select("conv_id", "range", *[(F.sum(n).over(across) - F.col(n)).alias("ahead_" + n) for n in names])
    run = rows.withColumns({n: F.sum(n).over(inside) for n in names}).join(ahead, ["conv_id", "range"])
    kinds = dict(rows.dtypes)
    return run.withColumns({n: (F.col(n) + F.col("ahead_" + n)).cast(kinds[n]) for n in names}).drop("range", *["ahead_" + n for n in names])


def _rolled(lines: DataFrame) -> DataFrame:
    """conv_id, at, place (from 1), the bytes up to the turn and the two rolling hashes
    after it, from (conv_id, at, bytes, body)."""
    placed = _running(lines.withColumn("place", F.lit(1).cast("long")), "place", "bytes")
    salted = [F.xxhash64(F.lit(salt), "place", "body.x", "body.y").cast("decimal(38,0)").alias(n) for salt, n in ((1, "a"), (2, "b"))]
    return _running(Stored(placed.select("conv_id", "at", "place", "bytes", *salted)).read(), "a", "b")


def _maximal(texts: DataFrame, line) -> DataFrame:
    """conv_id, at, place, before (bytes before the turn), n_turns and n_copies of the
    turns of maximal conversations."""
    words = [F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    body = F.struct(F.xxhash64(F.lit(1), *words).alias("x"), F.xxhash64(F.lit(2), *words).alias("y"))
    lines = Stored(texts.select("conv_id", "at", F.octet_length(line).cast("long").alias("bytes"), F.octet_length(line).cast("long").alias("own"), body.alias("body")))
    rolled = Stored(_rolled(lines.read().drop("own"))).read()
    lengths = rolled.groupBy("conv_id").agg(F.max("place").alias("n"))
    marked = rolled.join(lengths, "conv_id")
    whole = marked.where("place = n").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    shorter = marked.where("place < n").select(F.col("place").alias("n"), "a", "b").distinct()
    kept = whole.join(shorter, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")
    slim = rolled.join(kept, "conv_id").join(lines.read().select("at", "own"), "at")
    return slim.select("conv_id", "at", "place", (F.col("bytes") - F.col("own")).alias("before"), "n_turns", "n_copies")


def _line(opening: str, closing: str, end: str):
    return F.concat(F.lit(opening), F.coalesce("role", F.lit("")), F.lit(closing + "\n"), F.coalesce("text", F.lit("")), F.lit(end))


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """The turns of the maximal conversations: conv_id, place (from 1), role, text,
    n_turns, n_copies (logged conversations equal to it, itself included).

    Turns are ordered by turn, role and text, nulls first; a null role or text equals an
    empty one when conversations are compared.  Rows repeated in conv_id, turn, role and
    text count once; rows without conv_id are left out.  Other columns aren't read; an
    empty table gives no rows."""
    texts = Stored(_sorted(turns)).read()
    kept = _maximal(texts, _line("", "", "")).drop("conv_id", "before")
    return texts.join(kept, "at").select("conv_id", "place", "role", "text", "n_turns", "n_copies")


def render(turns: DataFrame, opening: str = "<|", closing: str = "|>", end: str = "<|end|>\n", part_bytes: int = PART_BYTES) -> DataFrame:
    """Rendered maximal conversations: conv_id, part, n_turns, n_copies, rendered.

    Each turn is its role between the marks, a line feed, its text and the end mark; see
    ``collapse_snapshots`` for their order and for nulls and repeated rows.  One string
    can't hold a conversation without bound, so a turn goes to the part that its first
    byte falls in, counted in ``part_bytes`` from the conversation's beginning: equal
    conversations have equal parts whatever their turns' numbers, and nearly all have the
    single part 0.  (A turn longer than a part leaves a gap in the numbers.)"""
    line = _line(opening, closing, end)
    texts = Stored(_sorted(turns)).read()
    kept = _maximal(texts, line).select("at", "place", "n_turns", "n_copies", F.floor(F.col("before") / part_bytes).cast("int").alias("part"))
    lines = texts.select("conv_id", "at", line.alias("line")).join(kept, "at")
    groups = lines.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    text = F.concat_ws("", F.transform("lines", lambda x: x["line"]))
    return groups.select("conv_id", "part", "n_turns", "n_copies", text.alias("rendered"))


#: the same in DuckDB's SQL: prefixes are compared as texts
SQL = f"""
WITH once AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
  count(*) OVER (PARTITION BY conv_id) AS n,
  '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line FROM once),
heads AS (SELECT conv_id, place, n, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY place) AS head FROM placed),
whole AS (SELECT head, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM heads WHERE place = n GROUP BY head, n),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.place = w.n AND h.place < h.n AND h.head = w.head)),
lines AS (SELECT k.conv_id, k.n AS n_turns, k.n_copies, p.place, p.line,
  sum(strlen(p.line)) OVER (PARTITION BY k.conv_id ORDER BY p.place) - strlen(p.line) AS before FROM kept k JOIN placed p ON p.conv_id = k.conv_id)
SELECT conv_id, CAST(before // {PART_BYTES} AS INTEGER) AS part, n_turns, n_copies, string_agg(line, '' ORDER BY place) AS rendered
FROM lines GROUP BY ALL
"""
