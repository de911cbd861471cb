"""Entities and edges: validation, keyed merges, traversal, impact, flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import CONFIDENCE, named, rank
from ..sources.stages import stored


def live_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull())


def validate_entities(entities: DataFrame, required: DataFrame) -> DataFrame:
    """``entities`` (label, source_id, properties MAP) with reject_reason: null, or an
    unknown label, or the required property (label, property) that is missing."""
    needs = required.groupBy("label").agg(F.sort_array(F.collect_set("property")).alias("_needs"))
    rows = entities.join(needs, "label", "left")
    missing = F.filter("_needs", lambda p: F.coalesce(F.element_at("properties", p), F.lit("")) == "")
    reason = F.when(F.col("_needs").isNull(), "unknown label").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    return rows.withColumn("reject_reason", reason).drop("_needs")


def validate_edges(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """``edges`` with reject_reason where (source_label, rel_type, target_label) isn't allowed."""
    key = ["source_label", "rel_type", "target_label"]
    rows = edges.join(allowed.select(*key).distinct().withColumn("_ok", F.lit(True)), key, "left")
    return rows.withColumn("reject_reason", F.when(F.col("_ok").isNull(), "triple not allowed")).drop("_ok")


def is_stale(updated_at: Column, as_of: Column, hours: int = 24) -> Column:
    """Older than so many hours; null or unreadable is stale."""
    at = F.try_to_timestamp(updated_at.cast("string"))
    return F.coalesce((F.unix_timestamp(as_of) - F.unix_timestamp(at)) > hours * 3600, F.lit(True))


def freshness_summary(entities: DataFrame, as_of: Column) -> DataFrame:
    """Counts updated within an hour, a day, and before; percentages half-even."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp("updated_at")
    n = F.count("*")
    share = lambda c: F.when(n > 0, F.bround(100.0 * F.count_if(c) / n, 2)).otherwise(F.lit(0.0))
    return entities.agg(n.alias("total"), F.count_if(age <= 3600).alias("within_hour"), F.count_if(age <= 86400).alias("within_day"), F.count_if(F.coalesce(age > 86400, F.lit(True))).alias("older"), share(age <= 3600).alias("hour_percent"), share(age <= 86400).alias("day_percent"))


def upsert_decisions(target: DataFrame, batch: DataFrame) -> DataFrame:
    """(source_id, decision) for each id of the batch; the last row of an id counts."""
    new = batch.groupBy("source_id").agg(F.max_by("text_hash", F.struct("updated_at", "text_hash")).alias("_new"))
    rows = new.join(target.select("source_id", F.col("text_hash").alias("_old")), "source_id", "left")
    return rows.select("source_id", F.when(F.col("_old").isNull(), "CREATED").when(F.col("_old") == F.col("_new"), "SKIPPED").otherwise("UPDATED").alias("decision"))


def apply_upsert(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The table after the merge: new values over old ones, created_at kept; an id whose
    hash is unchanged keeps its row."""
    order = Window.partitionBy("source_id").orderBy(F.desc("updated_at"), F.desc("text_hash"))
    new = batch.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    fields = [c for c in target.columns if c != "source_id"]
    rows = target.alias("o").join(new.alias("n"), "source_id", "full_outer")
    same = F.col("o.text_hash").eqNullSafe(F.col("n.text_hash"))
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c == "created_at" else F.when(same, F.col(f"o.{c}")).otherwise(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")))
    return rows.select("source_id", *[pick(c).alias(c) for c in fields])


def upsert_edges_checked(edges: DataFrame, entities: DataFrame, existing: DataFrame) -> DataFrame:
    """``edges`` (source_id, rel_type, target_id) with decision CREATED, SKIPPED or REJECTED."""
    ids = entities.select("source_id").distinct()
    rows = edges.join(ids.withColumn("_s", F.lit(1)), "source_id", "left").join(ids.select(F.col("source_id").alias("target_id"), F.lit(1).alias("_t")), "target_id", "left")
    rows = rows.join(existing.select("source_id", "rel_type", "target_id", F.lit(1).alias("_e")).distinct(), ["source_id", "rel_type", "target_id"], "left")
    decision = F.when(F.col("_s").isNull() | F.col("_t").isNull(), "REJECTED").when(F.col("_e").isNotNull(), "SKIPPED").otherwise("CREATED")
    return rows.select("source_id", "rel_type", "target_id", decision.alias("decision"))


def soft_delete(entities: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """deleted_at set once for the ids."""
    rows = entities.join(ids.select("source_id").distinct().withColumn("_gone", F.lit(1)), "source_id", "left")
    return rows.withColumn("deleted_at", F.when(F.col("_gone") == 1, F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at"))).drop("_gone")


#: roots that have the same neighbours are walked as one, in so many parts
PARTS = 64


def _alike(pairs: DataFrame, key: list[str], member: str) -> DataFrame:
    """``key`` of distinct ``pairs`` with (_size, _set): the number and two digests of its members.
    Keys with equal ones have the same members."""
    return pairs.groupBy(*key).agg(F.count("*").alias("_size"), F.struct(*[F.bit_xor(F.xxhash64(F.lit(seed), member)) for seed in (1, 2)]).alias("_set"))


def reach(edges: DataFrame, roots: DataFrame | None = None, hops: int | None = 2, undirected: bool = False) -> DataFrame:
    """(root, node, hop): what each root reaches over (src, dst) within so many hops (None: any
    number), with the fewest; a root reaches itself only through a cycle.  Each hop joins the
    nodes first reached in the last one with the edges; it is written before the next, so a
    hop's plan doesn't grow with the ones before it, and an empty one is the last.

    What a root reaches depends on its neighbours alone.  Where that halves the roots at least,
    of those with the same neighbours one is walked for all (one in each of ``PARTS``, so that
    no task gets all roots of a large class)."""
    both = edges.select("src", "dst")
    if undirected:
        both = both.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = stored(both.where("src is not null").distinct())
    front = (roots.select(F.col("node").alias("root")) if roots is not None else both.select(F.col("src").alias("root"))).distinct()
    if hops == 1:
        return _walked(both, front, hops)
    alike = _alike(both.join(front.select(F.col("root").alias("src")), "src", "left_semi"), ["src"], "dst").withColumn("_part", F.expr(f"pmod(xxhash64(src), {PARTS})"))
    first = F.min("src").over(Window.partitionBy("_size", "_set", "_part"))
    members = stored(alike.select(F.col("src").alias("root"), first.alias("first")))
    n = members.agg(F.count("*").alias("all"), F.count_if(F.col("root") == F.col("first")).alias("walked")).first()
    if 2 * n.walked > n["all"]:
        return _walked(both, front, hops)
    found = stored(_walked(both, members.select(F.col("first").alias("root")).distinct(), hops))
    return members.join(found.withColumnRenamed("root", "first"), "first").select("root", "node", "hop")


def _walked(both: DataFrame, roots: DataFrame, hops: int | None) -> DataFrame:
    front = roots.withColumn("node", F.col("root"))
    found, hop = None, 0
    while hops is None or hop < hops:
        hop += 1
        step = front.join(both.select(F.col("src").alias("node"), "dst"), "node").select("root", F.col("dst").alias("node")).distinct()
        step = stored((step.join(found, ["root", "node"], "left_anti") if found is not None else step).withColumn("hop", F.lit(hop)))
        found = step if found is None else found.unionByName(step)
        if hop != hops and step.isEmpty():
            break
        front = step.select("root", "node")
    return found


def impact(depends_on: DataFrame, links: DataFrame, hops: int | None = 2) -> DataFrame:
    """(service, affected, epics, tickets): who depends on a service within so many hops,
    and how many distinct epics and tickets concern any of them.  Tickets that concern the
    same services are counted together, and so are services that the same ones depend on."""
    hit = stored(reach(depends_on.select(F.col("dst").alias("src"), F.col("src").alias("dst")), hops=hops).select("root", "node"))
    affected = hit.groupBy("root").agg(F.count("node").alias("affected"))
    told = links.where("kind in ('epic', 'ticket') and ticket is not null and service is not null").select("kind", "ticket", F.col("service").alias("node")).join(hit.select("node").distinct(), "node", "left_semi")
    sets = stored(_alike(told.distinct(), ["kind", "ticket"], "node").groupBy("kind", "_size", "_set").agg(F.min("ticket").alias("ticket"), F.count("*").alias("_n")).select("kind", "ticket", "_n"))
    told = stored(told.join(sets, ["kind", "ticket"]).distinct())
    met = hit.join(told.select("node").distinct(), "node", "left_semi")
    alike = stored(_alike(met, ["root"], "node"))
    classes = alike.join(alike.groupBy("_size", "_set").agg(F.min("root").alias("first")), ["_size", "_set"]).select("root", "first")
    work = met.join(classes.select(F.col("first").alias("root")).distinct(), "root", "left_semi").join(told, "node").select("root", "kind", "ticket", "_n").distinct()
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("_n"))).alias(f"{kind}s")
    counts = classes.join(work.groupBy(F.col("root").alias("first")).agg(of("epic"), of("ticket")), "first").drop("first")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return affected.join(counts, "root", "left").select(F.col("root").alias("service"), "affected", zero("epics"), zero("tickets"))


def context(depends_on: DataFrame, publishes: DataFrame, subscribes: DataFrame) -> DataFrame:
    """(service, dependencies, dependents, published, subscribed): sorted arrays."""
    sets = lambda df, key, value, name: df.groupBy(F.col(key).alias("service")).agg(F.sort_array(F.collect_set(value)).alias(name))
    out = None
    for part in (sets(depends_on, "src", "dst", "dependencies"), sets(depends_on, "dst", "src", "dependents"), sets(publishes, "service", "topic", "published"), sets(subscribes, "service", "topic", "subscribed")):
        out = part if out is None else out.join(part, "service", "full_outer")
    return out


def dependency_rollup(edges: DataFrame, most_vias: int = 20, most_evidence: int = 5) -> DataFrame:
    """(src, dst, kinds, vias, edge_ids, confidence): one row for each dependent and
    dependency; event edges point from subscriber to publisher; no self-loops."""
    turn = F.col("kind") == "event"
    rows = edges.select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"), "kind", "via", "id", "confidence").where("src != dst")
    return rows.groupBy("src", "dst").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.slice(F.sort_array(F.collect_set("via")), 1, most_vias).alias("vias"), F.slice(F.sort_array(F.collect_set("id")), 1, most_evidence).alias("edge_ids"), named(F.max(rank("confidence", CONFIDENCE)), CONFIDENCE).alias("confidence"))


def graph_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by label, edges by type."""
    a = entities.groupBy(F.col("label").alias("name")).count().select(F.lit("node").alias("kind"), "name", F.col("count").alias("n"))
    b = edges.groupBy(F.col("rel_type").alias("name")).count().select(F.lit("edge").alias("kind"), "name", F.col("count").alias("n"))
    return a.unionByName(b)


def merge_nodes(nodes: DataFrame, properties: list[str]) -> DataFrame:
    """One row for each (label, id): the first non-null value of a property by ordinal."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c) for c in properties]
    return nodes.groupBy("label", "id").agg(*first)


def maximal_paths(edges: DataFrame, entries: DataFrame, max_depth: int = 5) -> DataFrame:
    """(path, length, truncated): all simple paths from entries (node) that can't be
    extended, or that have max_depth nodes.  Paths of each length are written before they
    are extended; none are the end."""
    hops = stored(edges.select("src", "dst").where("src != dst").distinct())
    now = stored(entries.select(F.array("node").alias("path"), F.col("node").alias("at")).distinct())
    done = now.where("false").select("path", F.lit(False).alias("truncated"))
    for depth in range(1, max_depth + 1):
        longer = now.join(hops, now["at"] == hops["src"], "left").withColumn("goes", F.col("dst").isNotNull() & ~F.array_contains("path", F.col("dst")))
        if depth == max_depth:
            last = longer.groupBy("path").agg(F.bool_or("goes").alias("truncated"))
            return done.unionByName(last).where(F.size("path") > 1).select("path", F.size("path").alias("length"), "truncated")
        # a path that goes nowhere stays as it is, with a null next node
        ends = longer.withColumn("any", F.bool_or("goes").over(Window.partitionBy("path"))).where("goes or not any")
        step = stored(ends.select("path", F.when(F.col("goes"), F.col("dst")).alias("next")).distinct())
        done = done.unionByName(step.where("next is null").select("path", F.lit(False).alias("truncated")))
        now = step.where("next is not null").select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("at"))
        if now.isEmpty():
            return done.where(F.size("path") > 1).select("path", F.size("path").alias("length"), "truncated")


def flows_for_service(flows: DataFrame, k: int = 25) -> DataFrame:
    """The k first flows of each service: confidence, length, id."""
    rows = flows.withColumn("service", F.explode("path"))
    order = Window.partitionBy("service").orderBy(F.desc(rank("confidence", CONFIDENCE)), F.desc(F.size("path")), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("service", "rank", "id")
