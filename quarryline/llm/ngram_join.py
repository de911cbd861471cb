"""N-gram Jaccard join: size-aware heavy-light set similarity self-join.

Each text is the set of its distinct 5-word shingles; two texts link when
``intersection >= 0.75 * union``.  Equal sets are one class from the start, so a
group of copies is one node however large it is.

*Order.*  Shingles are ordered from rare to frequent: by hash, with those found
frequent (counted over all texts, in windows of a few million shingles) last, in
order of their counts.  The list of frequent ones is bounded (``MOST_FREQUENT``);
any order gives whole results, a good one short lists.

*Light sets* (fewer shingles than the boundary) enumerate the 2-subsets of their
``n - ceil(0.75 n) + 2`` first shingles: two sets that link share two of those.
*Heavy sets* post their ``n - ceil(0.75 n) + 1`` first shingles to inverted lists,
as do the light sets that are large enough to link with a heavy one.  The boundary
is the size at which enumerating costs more rows than posting and scanning, taken
from the sizes and list lengths that the counting pass found.

*Scanning.*  Lists are sorted by size, so a member is compared with members of
about its size.  No list is expanded into all pairs: first each member gets one
partner; then, with components known, lists are dealt in bounded blocks and only
members of different components are compared, by parity bitmaps whose Hamming
distance never exceeds the symmetric difference (so nothing that links is lost).
Each text tries its closest candidate for two rounds, then all candidates that still
cross components.  Exact intersection of the shingle sets decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .shared import Stored, quoted, unused

WORDS = 5
#: 100 * intersection >= 75 * union
PERCENT = 75
#: shingles counted together in one window, and the count that makes one frequent
WINDOW = 2_000_000
FREQUENT = 2
#: the frequent shingles that are sent to every task: at most 16 bytes each
MOST_FREQUENT = 1 << 20
#: bits of the filter that tells which rows' texts are needed (8 MB)
FILTER_BITS = 26
#: members of a list that are compared in one task
BLOCK = 2048
TOKEN_BYTES = 6
#: rounds in which each text tries its closest candidate before all are tried
CLOSEST_ROUNDS = 2

U = np.uint64


def _enough(both, a, b):
    """The link condition, in whole numbers."""
    return 100 * both >= PERCENT * (a + b - both)


def _least_overlap(n: int) -> int:
    return -(-PERCENT * n // 100)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[np.ndarray]]]:
    """Columns other than text with the shingle sets of their rows, piece by piece."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        rest = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"}
        for lo, hi, data, offsets in tb.pieces(text):
            hashes, first = tb.words(data, offsets)
            all_shingles = tb.shingles(hashes, WORDS)
            yield {k: c.slice(lo, hi - lo) for k, c in rest.items()}, [tb.shingle_set(hashes, all_shingles, first[i], first[i + 1], WORDS) for i in range(hi - lo)]


def _chosen(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The texts of batches (rh, text) whose rows the filter lets through."""
    for batch in batches:
        at = batch.column(0).to_numpy() & ((1 << FILTER_BITS) - 1)
        keep = (bits[at >> 6] >> (at & 63).astype(U) & U(1)).astype(bool)
        if keep.any():
            yield batch.select(["text"]).filter(pa.array(keep))


def _row_filter(rows: DataFrame) -> np.ndarray:
    """Bits for the hashes rh of ``rows``: a filter of fixed size, whatever their number.
    A full one lets all rows through, which costs time and changes no result."""
    at = rows.select(F.col("rh").bitwiseAND((1 << FILTER_BITS) - 1).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[words["word"].to_numpy().astype(np.int64)] = words["mask"].to_numpy().astype(np.int64)
    return bits.view(U)


def _hashed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("rh"), "text")


def _node(s: np.ndarray) -> int:
    """The class of a set: two 64-bit digests of its shingles, mixed into one."""
    both = np.array([s.sum(dtype=U), np.bitwise_xor.reduce(s), U(len(s))], U)
    return int(tb.mix(np.array([(both * tb._PLACE[:3]).sum(dtype=U)], U)).view(np.int64)[0])


def _bitmap(s: np.ndarray) -> bytes:
    bits = 1 << max(8, int(len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


_DOCS = "doc_id long, rh long, node long, n int, bits binary, token long, seen long"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text (class, size, parity bitmap), and rows of shingles that
    several different sets of a window have."""
    window: list[np.ndarray] = []
    held, known = 0, set()

    def frequent() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if window:
            tokens = np.concatenate(window)
            tokens.sort()
            at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            seen = np.diff(np.append(at, len(tokens)))
            keep = seen >= FREQUENT
            yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(int(keep.sum()), pa.int64()), "rh": pa.nulls(int(keep.sum()), pa.int64()), "node": pa.nulls(int(keep.sum()), pa.int64()), "n": pa.nulls(int(keep.sum()), pa.int32()), "bits": pa.nulls(int(keep.sum()), pa.binary()), "token": pa.array(tokens[at[keep]].view(np.int64)), "seen": pa.array(seen[keep].astype(np.int64))})
        window.clear()
        known.clear()
        held = 0

    for rest, sets in _sets(batches):
        nodes = [_node(s) for s in sets]
        none = pa.nulls(len(sets), pa.int64())
        yield pa.RecordBatch.from_pydict({"doc_id": rest["doc_id"], "rh": rest["rh"], "node": pa.array(nodes, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int32()), "bits": pa.array([_bitmap(s) for s in sets], pa.binary()), "token": none, "seen": none})
        for node, s in zip(nodes, sets, strict=True):
            if node not in known and len(s):
                known.add(node)
                window.append(s)
                held += len(s)
        if held >= WINDOW:
            yield from frequent()
    yield from frequent()


def _ordered(s: np.ndarray, tokens: np.ndarray, seen: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """The set from rare to frequent."""
    if not len(tokens):
        return s
    near = np.flatnonzero(maybe[(s >> U(42)).astype(np.int64)])
    at = np.searchsorted(tokens, s[near])
    at[at == len(tokens)] = 0
    found = tokens[at] == s[near]
    if not found.any():
        return s
    hot = np.zeros(len(s), bool)
    hot[near[found]] = True
    return np.concatenate([s[~hot], s[hot][np.argsort(seen[at[found]], kind="stable")]])


def _post(frequent, first, boundary: int):
    """Postings of heavy sets and 2-subsets of light ones, from one row of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = frequent.value
        maybe = np.zeros(1 << 22, bool)  # rules most shingles out
        maybe[(tokens >> U(42)).astype(np.int64)] = True
        known: set[int] = set()
        for _, sets in _sets(_chosen(batches, first.value)):
            out, nodes, sizes = [], [], []
            for s in sets:
                n = len(s)
                if n < 3:  # such a set links with none but its equals
                    continue
                node = _node(s)
                if node in known:
                    continue
                known.add(node)
                order, spare = _ordered(s, tokens, seen, maybe), n - _least_overlap(n)
                if n < boundary:
                    head = order[: spare + 2]
                    i, j = np.triu_indices(len(head), 1)
                    low, high = np.minimum(head[i], head[j]), np.maximum(head[i], head[j])
                    out.append(tb.mix(low * tb._PLACE[1] + high * tb._PLACE[2]))
                    nodes.append(node), sizes.append((n, len(i)))
                if 100 * n >= PERCENT * boundary:
                    out.append(order[: spare + 1])
                    nodes.append(node), sizes.append((n, spare + 1))
            if len(known) > 1_000_000:
                known.clear()
            if out:
                count = np.array([c for _, c in sizes])
                yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate(out).view(np.int64)), "node": pa.array(np.repeat(np.array(nodes, np.int64), count)), "n": pa.array(np.repeat(np.array([n for n, _ in sizes], np.int32), count))})

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by (token, n, node): members of lists of two or more,
    each with one partner: the first of about its size, or the one before it."""
    held = None  # the last row so far: token, node, n, first of its sub-list, its partner, whether its list has more
    for batch in batches:
        token, node, n = (batch.column(i).to_numpy() for i in range(3))
        if held is not None:
            token, node, n = np.append(held[0], token), np.append(held[1], node), np.append(held[2], n)
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, n = token[keep], node[keep], n[keep]
        if not len(token):
            continue
        same = np.zeros(len(token), bool)
        same[1:] = token[1:] == token[:-1]
        size = np.floor(np.log(np.maximum(n, 1)) / np.log(4 / 3)).astype(np.int64)
        starts = ~same
        starts[1:] |= size[1:] != size[:-1]
        at = np.maximum.accumulate(np.where(starts, np.arange(len(token)), 0))
        mate = node[at]
        first = np.flatnonzero(starts & same)
        mate[first] = node[first - 1]
        more = same.copy()
        more[:-1] |= same[1:]
        lead = node[at]
        if held is not None:
            more[0] |= held[5]
            mate[0] = held[4]
            inside = at == 0
            lead[inside] = held[3]
            mate[inside & (np.arange(len(token)) > 0)] = held[3]
        last = len(token) - 1
        held = (token[last], node[last], n[last], lead[last], mate[last], more[last])
        show = more[:last]
        yield pa.RecordBatch.from_pydict({"token": pa.array(token[:last][show]), "node": pa.array(node[:last][show]), "n": pa.array(n[:last][show]), "mate": pa.array(mate[:last][show])})
    if held is not None and held[5]:
        yield pa.RecordBatch.from_pydict({"token": pa.array([held[0]], pa.int64()), "node": pa.array([held[1]], pa.int64()), "n": pa.array([held[2]], pa.int32()), "mate": pa.array([held[4]], pa.int64())})


def _keep_sets(wanted):
    """Shingle sets of the rows that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for _, sets in _sets(_chosen(batches, wanted.value)):
            nodes, packed = [], []
            for s in sets:
                node = _node(s)
                if node not in known:
                    known.add(node)
                    nodes.append(node)
                    packed.append(np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]).tobytes())
            if nodes:
                yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "s": pa.array(packed, pa.binary())})

    return run


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets meet the threshold."""

    def tokens(packed: pa.Buffer) -> np.ndarray:
        out = np.zeros((packed.size // TOKEN_BYTES, 8), np.uint8)
        out[:, :TOKEN_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, TOKEN_BYTES)
        return out.view(U).ravel()

    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            x, y = tokens(batch.column(2)[i].as_buffer()), tokens(batch.column(3)[i].as_buffer())
            keep.append(bool(_enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> Stored:
    """The pairs that link.  Of each class that a pair needs, one row's text is made into
    its set again; what the filter lets through besides is joined with no pair."""
    needed = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    bits = _row_filter(needed.join(classes.select("node", "rh"), "node"))
    if not bits.any():
        return Stored(pairs)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    sets = _hashed_texts(docs).mapInArrow(_keep_sets(shared), "node long, s binary").groupBy("node").agg(F.max("s").alias("s"))
    a, b = sets.select(F.col("node").alias("u"), F.col("s").alias("a")), sets.select(F.col("node").alias("v"), F.col("s").alias("b"))
    linked = Stored(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(_linked, "u long, v long"))
    shared.destroy()
    return linked


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def _could_link(x: np.ndarray, y: np.ndarray, a: int, b: int) -> bool:
    size = min(len(x), len(y))
    apart = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())
    return 100 * (a + b - apart) >= PERCENT * (a + b + apart)  # (a + b - apart) / 2 is the most that they can share


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and bitmaps allow a link."""
    for batch in batches:
        c = [batch.column(i).to_pylist() for i in range(6)]
        keep = [min(a, b) * 100 >= PERCENT * max(a, b) and _could_link(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), a, b) for a, b, x, y in zip(c[2], c[3], c[4], c[5], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _cross(all_pairs: bool):
    """In a block (or two) of one list: pairs in different components whose sizes and
    bitmaps allow a link: each member's closest, or all."""

    def pairs(group: list[tuple]) -> list[tuple[int, int, float]]:
        by: dict[int, list[int]] = {}
        maps: dict[tuple[int, int], np.ndarray] = {}
        for i, g in enumerate(group):
            by.setdefault(len(g[3]), []).append(i)

        def stack(level: int, size: int) -> np.ndarray:
            if (level, size) not in maps:
                rows = np.frombuffer(b"".join(group[i][3] for i in by[level]), np.uint8).reshape(-1, level)
                while rows.shape[1] > size:
                    half = rows.shape[1] // 2
                    rows = rows[:, :half] ^ rows[:, half:]
                maps[level, size] = np.ascontiguousarray(rows).view(U)
            return maps[level, size]

        n = np.array([g[1] for g in group], np.int64)
        comp = np.array([g[2] for g in group], np.int64)
        side = np.array([g[4] for g in group], np.int64)
        two = side.any() and not side.all()
        found: list[tuple[int, int, float]] = []
        closest: dict[int, tuple[float, int]] = {}
        levels = sorted(by)
        for level in levels:
            for other in (x for x in levels if level <= x <= 2 * level):
                mine, theirs = np.array(by[level]), np.array(by[other])
                a, b = stack(level, level), stack(other, level)
                for k, i in enumerate(mine):
                    ok = (comp[theirs] != comp[i]) & (np.minimum(n[theirs], n[i]) * 100 >= PERCENT * np.maximum(n[theirs], n[i]))
                    if two:
                        ok &= side[theirs] != side[i]
                    if level == other:
                        ok &= theirs > i
                    ok = np.flatnonzero(ok)
                    if not len(ok):
                        continue
                    apart = np.bitwise_count(b[ok] ^ a[k]).sum(axis=1, dtype=np.int64)
                    total = n[theirs[ok]] + n[i]
                    # (total - apart) / 2 is the most that they can share
                    close = 100 * (total - apart) >= PERCENT * (total + apart)
                    for j, d in zip(theirs[ok[close]].tolist(), (apart[close] / total[close]).tolist(), strict=True):
                        if all_pairs:
                            found.append((group[i][0], group[j][0], d))
                            continue
                        for x, y in ((int(i), j), (j, int(i))):
                            if x not in closest or (d, y) < closest[x]:
                                closest[x] = (d, y)
        return found if all_pairs else [(group[x][0], group[y][0], d) for x, (d, y) in closest.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, out = None, [], []
        told: set[tuple[int, int]] = set()

        def close() -> None:
            for u, v, d in pairs(group) if len(group) > 1 else ():
                if all_pairs:  # a pair meets in many lists
                    u, v = min(u, v), max(u, v)
                    if (u, v) in told:
                        continue
                    if len(told) > 500_000:
                        told.clear()
                    told.add((u, v))
                out.append((at[0], u, v, d))

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_pydict({n: pa.array([p[k] for p in out], pa.float64() if n == "apart" else pa.int64()) for k, n in enumerate(("token", "u", "v", "apart"))})
                out.clear()

        for batch in batches:
            c = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for token, x, y, node, n, comp, bits, side in zip(*c, strict=True):
                if (token, x, y) != at:
                    close()
                    at, group = (token, x, y), []
                group.append((node, n, comp, bits, side))
            yield from flush()
        close()
        yield from flush()

    return run


def _crossing(lists: DataFrame, comps: DataFrame, classes: DataFrame, all_pairs: bool) -> DataFrame:
    """(token, u, v, apart): candidate pairs between components, from lists that hold several."""
    labelled = lists.select("token", "node", "n").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo != hi")
    table = labelled.join(mixed.select("token", F.expr(f"cast(ceil(members / {BLOCK}) as int)").alias("blocks")), "token")
    table = table.withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    table = table.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    table = table.select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "n", "component", F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    table = table.join(classes.select("node", "bits"), "node").select("token", "x", "y", "node", "n", "component", "bits", "side")
    dealt = table.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", "n", "node")
    return dealt.mapInArrow(_cross(all_pairs), "token long, u long, v long, apart double")


def _boundary(classes: DataFrame, repeats: float) -> int:
    """The smallest size at which a set costs fewer rows as heavy than as light.
    Heavy: its postings and the members it meets on their lists; light: its subsets."""
    sizes = classes.where("n >= 3").agg(F.expr("percentile_approx(n, 0.99)")).first()[0] or 0
    for n in range(3, max(4, min(int(sizes), 2000))):
        spare = n - _least_overlap(n)
        if (spare + 2) * (spare + 1) / 2 > (spare + 1) * (1 + repeats):
            return n
    return max(4, int(sizes))


def describe(docs: DataFrame) -> Stored:
    """A row for each row of ``docs``: doc_id, rh (hash of doc_id and text), node (the class
    of equal shingle sets), n (its size), with bitmaps; and counts of shingles."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rh"), "text")
    return Stored(rows.mapInArrow(_describe, _DOCS))


def join_components(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, rh, n_shingles and
    component_id, the smallest doc_id of the group that links connect.

    Null and wordless texts have no shingles and stay alone; texts of fewer than
    five words are one shingle.  Repeated rows and equal texts share a component;
    rows with a null doc_id take part, and never give the component's id.  Other
    columns of ``docs`` aren't read.  An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    told = describe(docs)
    rows = told.read().where("seen is null").select("doc_id", "rh", "node", "n")
    classes = Stored(told.read().where("seen is null and n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("rh").alias("rh"), F.max("n").alias("n"), F.max("bits").alias("bits")))
    counts = told.read().where("seen is not null").groupBy("token").agg(F.sum("seen").alias("seen"))
    top = counts.orderBy(F.desc("seen"), "token").limit(MOST_FREQUENT).toArrow()
    tokens, seen = top["token"].to_numpy().astype(np.int64).view(U), top["seen"].to_numpy().astype(np.int64)
    order = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast((tokens[order], seen[order]))
    total = classes.read().agg(F.sum("n")).first()[0] or 0
    boundary = _boundary(classes.read(), float(seen.sum()) / max(1, total))

    first = spark.sparkContext.broadcast(_row_filter(classes.read().where("n >= 3")))
    posted = _hashed_texts(docs).mapInArrow(_post(frequent, first, boundary), "token long, node long, n int")
    sorted_lists = posted.repartition("token").sortWithinPartitions("token", "n", "node")
    lists = Stored(sorted_lists.mapInArrow(_lists, "token long, node long, n int, mate long"))
    frequent.destroy()
    first.destroy()

    mates = lists.read().where("mate != node").groupBy("node", "mate").agg(F.count("*").alias("k")).groupBy("node").agg(F.expr("max_by(mate, struct(k, mate))").alias("mate"))
    u = classes.read().select(F.col("node").alias("u"), F.col("n").alias("a"), F.col("bits").alias("x"))
    v = classes.read().select(F.col("node").alias("v"), F.col("n").alias("b"), F.col("bits").alias("y"))
    near = mates.select(F.col("node").alias("u"), F.col("mate").alias("v")).join(u, "u").join(v, "v").select("u", "v", "a", "b", "x", "y").mapInArrow(_plausible, "u long, v long")
    links = _verified(Stored(near).read(), classes.read(), docs)
    labels = components(links.read())
    # each text's closest candidate, twice; then all candidates of lists that had any
    open_lists = lists.read()
    for _ in range(CLOSEST_ROUNDS):
        some = Stored(_crossing(open_lists, labels, classes.read(), False))
        closest = some.read().groupBy("u").agg(F.expr("min_by(v, struct(apart, v))").alias("v"))
        more = _verified(Stored(closest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()).read(), classes.read(), docs)
        links = Stored(links.read().unionByName(more.read()))
        labels = components(links.read())
        open_lists = lists.read().join(some.read().select("token").distinct(), "token", "left_semi")
    rest = _verified(Stored(_crossing(open_lists, labels, classes.read(), True).select("u", "v").distinct()).read(), classes.read(), docs)
    labels = components(links.read().unionByName(rest.read()))
    lists.discard()
    named = classes.read().join(labels, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    group = named.join(least, "component").select("node", "component_id")
    whole = rows.join(group, "node", "left")
    return whole.select("doc_id", "rh", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` without the texts that repeat another one: of each component the row
    with the smallest doc_id stays (of rows that repeat in doc_id and text, the one whose
    other columns have the smallest hash).  Other columns may have any name."""
    p = unused(docs.columns)
    found = join_components(docs).where("n_shingles = 0 or doc_id <=> component_id").select(F.col("rh").alias(p + "row")).distinct()
    others = [c.cast("string") for c, n in zip(quoted(docs.columns), docs.columns, strict=True) if n not in ("doc_id", "text")]
    marked = docs.withColumn(p + "row", F.xxhash64("doc_id", "text")).withColumn(p + "rest", F.xxhash64(F.lit(0), *others))
    kept = marked.join(found, p + "row", "left_semi").withColumn(p + "nth", F.row_number().over(Window.partitionBy(p + "row").orderBy(p + "rest")))
    return kept.where(f"{p}nth = 1").select(*quoted(docs.columns))
