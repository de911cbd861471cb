"""MinHash near-dedup with SetSketch registers: bands propose, a likelihood estimates, whole sets decide.

Each text is the set of its distinct 3-word shingles; texts link when
``intersection >= 0.85 * union``.  Equal sets are one class from the start.

*Sketch.*  Every register takes the least of the shingles' exponential values x (rate
``RATE``) on an exponential scale, truncated to a byte: ``1 - log_BASE(x)``, 0 to 255.
Sketches of parts are merged by the greater register (``merged``).  Unlike whole minima,
two registers are also equal with a known small probability when their minima differ.

*Bands* of ``BAND`` registers are tokens of inverted lists: at the threshold two sets miss
each other in all ``REGISTERS / BAND`` lists once in more than 10^10 times.

*Estimate.*  With both sizes known, the numbers of registers that are greater, less and
equal have a joint likelihood for each Jaccard similarity.  A pair is a candidate unless
every similarity from the threshold on is less likely than the best one by ``exp(-UNLIKELY)``
(six standard deviations).  Parity bitmaps, whose Hamming distance never exceeds the
symmetric difference, then rule out most pairs just below the threshold.

*Verify.*  The sets of candidates are made again from their texts and intersected.

No list is expanded into all pairs: first each member tries the member of its lists that it
meets most often and the one that leads most of its lists.  Then only members of different groups are compared, in bounded blocks of
a list whose sizes allow a link at all: once with each one's likeliest candidate alone, and,
with components known, with all candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .ngram_join import _bitmap, _chosen, _fold, _hashed_texts, _lists, _node, _row_filter
from .shared import Stored, quoted, unused

WORDS = 3
#: 100 * intersection >= 85 * union
PERCENT = 85
REGISTERS, BAND = 200, 5
#: base of the scale and rate of the values: bytes hold sets of 1 to 10^8
BASE, RATE, TOP = 1.1, 20.0, 255
UNLIKELY = 18.0
#: equal registers that two sets which link have at least (fewer once in more than 10^12 times)
LEAST_SAME = 130
#: similarities that are tried, from below any that could be taken for the threshold
GRID = np.linspace(0.4, 1.0, 121)
#: members of a list that are compared in one task
BLOCK = 2048
#: steps from a member to the first of its group that are followed: 2 to this power
JUMPS = 3

U = np.uint64
_FACTOR = tb.mix(np.arange(1, REGISTERS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, registers) of bytes; an empty set's registers are 0."""
    out = np.zeros((len(sets), REGISTERS), np.uint8)
    full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(full):
        return out
    shingles = np.concatenate([sets[i] for i in full])
    begins = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    least, buffer = np.empty((REGISTERS, len(full)), U), np.empty_like(shingles)
    for k in range(REGISTERS):
        np.multiply(shingles, _FACTOR[k], out=buffer)
        np.minimum.reduceat(buffer, begins, out=least[k])
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    out[full] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).T.astype(np.uint8)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sketched sets."""
    return np.maximum(a, b)


def _apart(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likelihoods(more: np.ndarray, less: np.ndarray, same: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(pairs, ``GRID``): log likelihoods of similarities of sets of sizes ``m`` and ``n`` with so
    many registers of the first greater, less and equal; -inf where sizes rule one out."""
    u = (m / (m + n))[:, None]
    v = 1 - u
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = u - v * GRID, v - u * GRID
        possible = (a >= -1e-12) & (b >= -1e-12)
        up, down = _apart(np.maximum(a, 0)), _apart(np.maximum(b, 0))
        tiny = 1e-12
        out = more[:, None] * np.log(up + tiny) + less[:, None] * np.log(down + tiny) + same[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return np.where(possible, out, -np.inf)


def candidates(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of sketches may link, and their likeliest similarities."""
    same = (x == y).sum(axis=1)
    ok = np.minimum(m, n) * 100 >= PERCENT * np.maximum(m, n)
    at = np.flatnonzero(ok & (same >= LEAST_SAME))
    keep, best = np.zeros(len(x), bool), np.zeros(len(x))
    for k in range(0, len(at), 1 << 14):
        part = at[k : k + (1 << 14)]
        more = (x[part] > y[part]).sum(axis=1)
        found = likelihoods(more, REGISTERS - more - same[part], same[part], m[part].astype(float), n[part].astype(float))
        # a similarity just above the last that sizes allow may be the pair's own
        over = np.where(GRID >= PERCENT / 100 - 1e-9, found, -np.inf).max(axis=1)
        keep[part] = (over >= found.max(axis=1) - UNLIKELY) | ~np.isfinite(over)
        best[part] = GRID[found.argmax(axis=1)]
    return keep, best


def _could_link(x: bytes, y: bytes, m: int, n: int) -> bool:
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    apart = int(np.bitwise_count(_fold(a, size) ^ _fold(b, size)).sum())
    return 100 * (m + n - apart) >= PERCENT * (m + n + apart)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for lo, hi, data, offsets in tb.pieces(batch.column("text")):
            hashes, first = tb.words(data, offsets)
            every = tb.shingles(hashes, WORDS)
            yield batch.slice(lo, hi - lo), [tb.shingle_set(hashes, every, first[i], first[i + 1], WORDS) for i in range(hi - lo)]


PAIRS = "u long, v long, s long, t long"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, sets in _sets(batches):
        regs = sketches(sets)
        yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "rh": rows.column("rh"), "node": pa.array([_node(s) for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int32()), "regs": pa.array([r.tobytes() for r in regs], pa.binary()), "bits": pa.array([_bitmap(s) for s in sets], pa.binary())})


def _registers(column: pa.Array) -> np.ndarray:
    """Sketches of a column of bytes without nulls."""
    data = np.frombuffer(column.buffers()[2], np.uint8)
    begin = np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0] if len(column) else 0
    return data[begin : begin + len(column) * REGISTERS].reshape(-1, REGISTERS)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A token for each band of each class."""
    bands = REGISTERS // BAND
    weight = U(256) ** np.arange(BAND, dtype=U)
    for batch in batches:
        regs = _registers(batch.column("regs")).reshape(-1, bands, BAND)
        token = tb.mix((regs.astype(U) * weight).sum(axis=2, dtype=U) * U(2 * bands + 1) + np.arange(bands, dtype=U)).view(np.int64)
        yield pa.RecordBatch.from_pydict({"token": pa.array(token.ravel()), "node": pa.array(np.repeat(batch.column("node").to_numpy(), bands)), "n": pa.array(np.repeat(batch.column("n").to_numpy(), bands))})


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (u, v, s, t, m, n, x, y, a, b) with sketches and bitmaps, those that may link."""
    for batch in batches:
        m, n = batch.column("m").to_numpy(), batch.column("n").to_numpy()
        keep, _ = candidates(_registers(batch.column("x")), _registers(batch.column("y")), m, n)
        a, b = batch.column("a"), batch.column("b")
        for i in np.flatnonzero(keep).tolist():
            keep[i] = _could_link(a[i].as_py(), b[i].as_py(), int(m[i]), int(n[i]))
        yield batch.select(["u", "v", "s", "t"]).filter(pa.array(keep))


def _keep_sets(wanted):
    """Sets of the rows that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for _, sets in _sets(_chosen(batches, wanted.value)):
            new = [(node, s) for node, s in ((_node(s), s) for s in sets) if node not in known and not known.add(node)]
            if len(known) > 1_000_000:
                known.clear()
            if new:
                yield pa.RecordBatch.from_pydict({"node": pa.array([node for node, _ in new], pa.int64()), "s": pa.array([s.tobytes() for _, s in new], pa.binary())})

    return run


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v, a, b) whose sets meet the threshold."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), U) for k in (2, 3))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = 100 * both >= PERCENT * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))


def _verified(pairs: DataFrame, docs: DataFrame) -> Stored:
    """Of pairs (u, v, s, t), with hashes of a row of each class, those that link: their sets are
    made again of the rows' texts."""
    pairs = Stored(pairs).read()
    bits = _row_filter(pairs.select(F.explode(F.array("s", "t")).alias("rh")))
    if not bits.any():
        return Stored(pairs.select("u", "v"))
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    sets = _hashed_texts(docs).mapInArrow(_keep_sets(sent), "node long, s binary").groupBy("node").agg(F.max("s").alias("s"))
    a, b = sets.select(F.col("node").alias("u"), F.col("s").alias("a")), sets.select(F.col("node").alias("v"), F.col("s").alias("b"))
    # v is the one that many may have in common: it is met while rows are short
    links = Stored(pairs.select("u", "v").join(b, "v").join(a, "u").select("u", "v", "a", "b").mapInArrow(_linked, "u long, v long"))
    sent.destroy()
    return links


_KEYS = ("token", "band", "within", "x", "y")


def _compared(table: pa.Table, closest: bool) -> pa.RecordBatch | None:
    """Candidates among the members of whole blocks, which stand together: all blocks are gone
    through at once, each member against the one next to it, then the second next and so on."""
    c = {k: table.column(k).to_numpy() for k in (*_KEYS, "node", "rh", "n", "component", "side", "home")}
    regs, maps = _registers(table.column("regs").combine_chunks()), None if closest else table.column("bits").combine_chunks()
    edge = np.zeros(len(regs), bool)
    edge[0] = True
    for k in _KEYS:
        edge[1:] |= c[k][1:] != c[k][:-1]
    end = np.append(np.flatnonzero(edge)[1:], len(regs))[np.cumsum(edge) - 1]
    two = ~c["within"] | (c["x"] != c["y"])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    i, step = np.arange(len(regs)), 1
    while len(i := i[i + step < end[i]]):
        j = i + step
        meet = (c["component"][i] != c["component"][j]) & (c["home"][i] | c["home"][j]) & (~two[i] | (c["side"][i] != c["side"][j]))
        at = i[meet]
        if len(at):
            keep, best = candidates(regs[at], regs[at + step], c["n"][at], c["n"][at + step])
            for k in [] if closest else np.flatnonzero(keep).tolist():
                p = int(at[k])
                keep[k] = _could_link(maps[p].as_py(), maps[p + step].as_py(), int(c["n"][p]), int(c["n"][p + step]))
            found.append((at[keep], at[keep] + step, 1 - best[keep]))
        step += 1
    if not found:
        return None
    i, j, apart = (np.concatenate(x) for x in zip(*found, strict=True))
    if closest:  # of each member, in both directions
        i, j, apart = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(apart, 2)
        order = np.lexsort((c["node"][j], apart, c["node"][i]))
        first = c["node"][i[order]]
    else:  # of each pair, one way round
        turned = c["node"][i] > c["node"][j]
        i, j = np.where(turned, j, i), np.where(turned, i, j)
        order = np.lexsort((c["node"][j], c["node"][i]))
        first = np.stack([c["node"][i[order]], c["node"][j[order]]], axis=1)
    new = np.ones(len(order), bool)
    new[1:] = first[1:] != first[:-1] if closest else (first[1:] != first[:-1]).any(axis=1)
    i, j, apart = i[order[new]], j[order[new]], apart[order[new]]
    return pa.RecordBatch.from_pydict({"u": pa.array(c["node"][i]), "v": pa.array(c["node"][j]), "s": pa.array(c["rh"][i]), "t": pa.array(c["rh"][j]), "apart": pa.array(apart)})


def _across(closest: bool):
    """Candidates in blocks sorted by ``_KEYS``; a block is whole before it is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def last_edge(batch: pa.RecordBatch) -> int:
            """Where the batch's last block begins."""
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in _KEYS])
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
            return int(change[-1]) + 1 if len(change) else 0

        def same_block(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
            return all(a.column(k)[len(a) - 1].as_py() == b.column(k)[0].as_py() for k in _KEYS)

        for batch in batches:
            if not batch.num_rows:
                continue
            cut = last_edge(batch)
            if held and (cut or not same_block(held[-1], batch)):
                whole = [*held, batch.slice(0, cut)] if cut else held
                out = _compared(pa.Table.from_batches(whole), closest)
                held = []
                if out is not None:
                    yield out
            elif cut:
                out = _compared(pa.Table.from_batches([batch.slice(0, cut)]), closest)
                if out is not None:
                    yield out
            held.append(batch.slice(cut))
        if held:
            out = _compared(pa.Table.from_batches(held), closest)
            if out is not None:
                yield out

    return run


def _mates(lists: DataFrame) -> DataFrame:
    """Pairs (u, v) to try first, two for each member at most: v is the leader of most of u's
    lists, or the first of about u's size in most of them.  The leader of a list is the member
    whose lists are the longest together: the text that others are edited from has most bands
    in common with them, though they may have few with each other."""
    sizes = lists.groupBy("token").agg(F.count("*").alias("members"))
    weight = lists.join(sizes, "token").groupBy("node").agg(F.sum("members").alias("weight"))
    leaders = lists.join(weight, "node").groupBy("token").agg(F.expr("max_by(node, struct(weight, node))").alias("lead"))
    both = lists.join(leaders, "token").select("node", F.explode(F.array("lead", "mate")).alias("v")).where("v != node")
    counted = both.groupBy("node", "v").agg(F.count("*").alias("k"))
    best = counted.join(weight.select(F.col("node").alias("v"), "weight"), "v").groupBy("node").agg(F.expr("max_by(v, struct(k, v))").alias("most"), F.expr("max_by(v, struct(weight, k, v))").alias("heaviest"))
    return best.select(F.col("node").alias("u"), F.explode(F.array_distinct(F.array("most", "heaviest"))).alias("v"))


def _crossing(lists: DataFrame, labels: DataFrame, classes: Stored, closest: bool) -> DataFrame:
    """(u, v, s, t, apart): candidates between components, from lists that hold several, with
    hashes of a row of each.

    The component with most members in a list is its main one; all others' members are
    compared with those of the main one and with each other.  Sizes that may link lie in one
    band or in two neighbouring ones: members of the main component stay in their band, the
    others visit both next ones.  Members are dealt into blocks by hash, and blocks of others
    meet all: in a long list of one component and a few others, a member of the component is
    in one block alone."""
    named = lists.select("token", "node", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    main = named.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(F.expr("max_by(component, struct(c, component))").alias("main"), F.count("*").alias("parts")).where("parts > 1")
    own = F.floor(F.log("n") / float(np.log(100 / PERCENT)) + 1e-9).cast("int")
    put = named.join(main.select("token", "main"), "token").withColumn("other", F.col("component") != F.col("main"))
    put = put.withColumn("step", F.explode(F.when(F.col("other"), F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("band", own + F.col("step")).withColumn("home", F.col("step") == 0)
    some = put.groupBy("token", "band").agg(F.count_if("other").alias("k"), F.count_if("home").alias("h"), F.count("*").alias("c")).where("k > 0 and h > 0 and c > 1")
    some = some.select("token", "band", F.expr(f"cast(ceil(k / {BLOCK}) as int)").alias("others"), F.expr(f"cast(ceil((c - k) / {BLOCK}) as int)").alias("mains"))
    dealt = put.join(some, ["token", "band"]).withColumn("own", F.expr("cast(pmod(xxhash64(node), if(other, others, mains)) as int)"))
    block = "named_struct('within', {0}, 'x', {1}, 'y', {2}, 'side', {3})"
    met = f"""if(other, concat(if(mains > 0, transform(sequence(0, mains - 1), j -> {block.format("false", "own", "j", "false")}), array()), transform(sequence(0, others - 1), j -> {block.format("true", "least(own, j)", "greatest(own, j)", "own > j")})),
        transform(sequence(0, others - 1), i -> {block.format("false", "i", "own", "true")}))"""
    dealt = dealt.withColumn("b", F.explode(F.expr(met))).select("token", "band", "b.*", "node", "n", "component", "home")
    dealt = dealt.join(classes.read().select("node", "rh", "regs", *([] if closest else ["bits"])), "node")
    ordered = dealt.repartition("token", "band", "within", "x", "y").sortWithinPartitions("token", "band", "within", "x", "y")
    return ordered.mapInArrow(_across(closest), PAIRS + ", apart double")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, rh (hash of both), n_shingles and
    component_id, the smallest doc_id of the group that links connect.

    Null, empty and wordless texts have no shingles and stay alone; texts of fewer than three
    words are one shingle.  Texts of any length are whole.  Repeated rows and equal sets share
    a component; rows with a null doc_id take part and never give a component's id, which is
    null if all are.  Other columns aren't read.  An empty table gives no rows.  Sets are told
    apart by a 64-bit digest, shingles by 64-bit hashes.
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rh"), "text")
    told = Stored(rows.mapInArrow(_describe, "doc_id long, rh long, node long, n int, regs binary, bits binary"))
    classes = Stored(told.read().where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("rh").alias("rh"), F.max("n").alias("n"), F.max("regs").alias("regs"), F.max("bits").alias("bits")))
    # smaller sets link with their equals alone
    large = classes.read().where(F.col("n") >= -(-PERCENT // (100 - PERCENT))).select("node", "n", "regs")
    posted = large.mapInArrow(_banded, "token long, node long, n int").repartition("token").sortWithinPartitions("token", "n", "node")
    lists = Stored(posted.mapInArrow(_lists, "token long, node long, n int, mate long"))

    mates = _mates(lists.read())
    u = classes.read().select(F.col("node").alias("u"), F.col("rh").alias("s"), F.col("n").alias("m"), F.col("regs").alias("x"), F.col("bits").alias("a"))
    v = classes.read().select(F.col("node").alias("v"), F.col("rh").alias("t"), "n", F.col("regs").alias("y"), F.col("bits").alias("b"))
    first = mates.join(v, "v").join(u, "u")
    links = _verified(first.mapInArrow(_plausible, PAIRS), docs)
    # labels of one group may differ, which only costs comparisons; equal ones are of one group
    lead = Stored(links.read().groupBy(F.col("u").alias("node")).agg(F.max("v").alias("component"))).read()
    for _ in range(JUMPS):
        lead = lead.join(lead.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left").select("node", F.coalesce("further", "component").alias("component"))
        lead = Stored(lead).read()
    some = _crossing(lists.read(), lead, classes, True).groupBy("u").agg(F.expr("min_by(struct(v, s, t), struct(apart, v))").alias("c")).select("u", "c.*")
    more = _verified(some, docs)
    labels = components(links.read().unionByName(more.read()))
    rest = _verified(_crossing(lists.read(), labels, classes, False).select("u", "v", "s", "t").distinct(), docs)
    labels = components(links.read().unionByName(more.read()).unionByName(rest.read()))
    lists.discard()
    named = classes.read().join(labels, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    group = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    whole = told.read().select("doc_id", "rh", "node", "n").join(group, "node", "left")
    return whole.select("doc_id", "rh", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept: whether the row is its component's smallest
    doc_id (where all ids of a component are null, all its rows are kept)."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns (of any name); of rows that
    repeat in doc_id and text all stay."""
    p = unused(docs.columns)
    keep = near_duplicates(docs).where("doc_id <=> component_id").select(F.col("rh").alias(p + "row")).distinct()
    return docs.withColumn(p + "row", F.xxhash64("doc_id", "text")).join(keep, p + "row", "left_semi").select(*quoted(docs.columns))
