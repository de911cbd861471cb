"""What is asked of services, files, corpora and listings: one job answers for all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import CONFIDENCE, named, rank


def filter_listing(rows: DataFrame, day: str, name: str | None = None, month: str | None = None, start: str | None = None, end: str | None = None, **equal: str | None) -> DataFrame:
    """Rows that meet every filter given: a case-insensitive part of the name, a part of the
    date as text, dates from and to (both included), equal fields."""
    conditions = [F.col(k) == v for k, v in equal.items() if v]
    if name:
        conditions.append(F.lower("name").contains(name.lower()))
    if month:
        conditions.append(F.col(day).cast("string").contains(month))
    if start:
        conditions.append(F.col(day) >= F.lit(start).cast("date"))
    if end:
        conditions.append(F.col(day) <= F.lit(end).cast("date"))
    return rows.where(reduce(lambda a, b: a & b, conditions)) if conditions else rows


def edges_by_provenance(edges: DataFrame, entities: DataFrame, provenance: str, rel_type: str | None = None, limit: int = 100) -> DataFrame:
    """The first edges (src, rel_type, dst, via) of one origin whose ends are both live."""
    live = entities.where(F.col("deleted_at").isNull()).select("source_id").distinct()
    rows = edges.where(F.col("provenance") == provenance)
    if rel_type:
        rows = rows.where(F.col("rel_type") == rel_type)
    for end in ("src", "dst"):
        rows = rows.join(live.withColumnRenamed("source_id", end), end, "left_semi")
    keys = ["src", "rel_type", "dst", "via"]
    return rows.select(*keys).distinct().orderBy(*keys).limit(limit)


def purge_ids(corpus: DataFrame, keep_types: list[str]) -> DataFrame:
    """(store, id) of what goes: every row of a type that isn't kept, or of none."""
    return corpus.where(~F.coalesce(F.col("kind").isin(keep_types), F.lit(False))).select("store", "id")


def purge_plan(corpus: DataFrame, keep_types: list[str], expected: DataFrame | None = None) -> DataFrame:
    """(store, deletes, keeps[, as_expected]): counts to look at before anything is deleted;
    ``expected`` (store, keeps) is what should be left."""
    kept = F.coalesce(F.col("kind").isin(keep_types), F.lit(False))
    plan = corpus.groupBy("store").agg(F.count_if(~kept).alias("deletes"), F.count_if(kept).alias("keeps"))
    if expected is None:
        return plan
    return plan.join(expected.select("store", F.col("keeps").alias("_e")), "store", "left").withColumn("as_expected", F.coalesce(F.col("keeps") == F.col("_e"), F.lit(False))).drop("_e")


def service_detail(depends_on: DataFrame, links: DataFrame) -> DataFrame:
    """(service, uses, used_by, tickets): sorted neighbours both ways and how many distinct
    tickets concern each service that has an edge."""
    sets = lambda key, value, name: depends_on.groupBy(F.col(key).alias("service")).agg(F.sort_array(F.collect_set(value)).alias(name))
    both = sets("src", "dst", "uses").join(sets("dst", "src", "used_by"), "service", "full_outer")
    tickets = links.groupBy("service").agg(F.countDistinct("ticket").alias("tickets"))
    none = F.array().cast("array<string>")
    return both.join(tickets, "service", "left").select("service", F.coalesce("uses", none).alias("uses"), F.coalesce("used_by", none).alias("used_by"), F.coalesce("tickets", F.lit(0).cast("long")).alias("tickets"))


#: what a service's row tells: (name, edge, whether it goes out, labels at its other end) (fixed values)
PROFILE = (
    ("owners", "OWNED_BY", True, ("Team",)), ("uses", "DEPENDS_ON", True, ("Service",)), ("used_by", "DEPENDS_ON", False, ("Service",)), ("tickets", "LINKED_TO", False, ("Ticket", "Epic")),
    ("documents", "DOCUMENTED_IN", True, ("ConfluencePage", "Page", "ServiceDoc")), ("published", "PUBLISHES", True, ("Topic",)), ("subscribed", "SUBSCRIBES", True, ("Topic",)),
)


def service_profile(entities: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """One row for each live service of a graph (entities: source_id, label, name, deleted_at;
    edges: source_id, rel_type, target_id): service, name, and for each of ``PROFILE`` the first
    ``most`` ids at the other end, sorted, and how many live ones there are (n_owners, ...).
    Repeated edges count once."""
    live = entities.where("deleted_at is null").select("source_id", "label", "name")
    named = edges.select("source_id", "rel_type", "target_id").where(F.col("rel_type").isin(*sorted({p[1] for p in PROFILE})))
    ends = named.join(live.select("source_id", F.col("label").alias("_from")), "source_id").join(live.select(F.col("source_id").alias("target_id"), F.col("label").alias("_to")), "target_id")
    kinds = [F.when((F.col("rel_type") == rel) & (F.col("_from" if out else "_to") == "Service") & F.col("_to" if out else "_from").isin(*labels), F.struct(F.col("source_id" if out else "target_id").alias("service"), F.lit(name).alias("kind"), F.col("target_id" if out else "source_id").alias("other"))) for name, rel, out, labels in PROFILE]
    seen = ends.select(F.explode(F.array_compact(F.array(*kinds))).alias("k")).select("k.*").distinct()
    # ranked first, so that no more than the shown ones are gathered
    ranked = seen.withColumn("_n", F.row_number().over(Window.partitionBy("service", "kind").orderBy("other")))
    of = lambda name: F.col("kind") == name
    told = ranked.groupBy("service").agg(*[c for name, *_ in PROFILE for c in (F.sort_array(F.collect_list(F.when(of(name) & (F.col("_n") <= most), F.col("other")))).alias(name), F.count_if(of(name)).alias(f"n_{name}"))])
    rows = live.where("label = 'Service'").select(F.col("source_id").alias("service"), "name").join(told, "service", "left")
    none = F.array().cast("array<string>")
    return rows.select("service", "name", *[c for name, *_ in PROFILE for c in (F.coalesce(name, none).alias(name), F.coalesce(f"n_{name}", F.lit(0).cast("long")).alias(f"n_{name}"))])


def owned_tables(ddl: DataFrame, access: DataFrame) -> DataFrame:
    """(store, table, owner, users): who declares a table's schema, and which services
    that don't declare it use it."""
    owners = ddl.select("store", "table", F.col("sid").alias("owner")).distinct()
    used = access.select("store", "table", "sid").distinct().join(owners.withColumnRenamed("owner", "sid"), ["store", "table", "sid"], "left_anti")
    users = used.groupBy("store", "table").agg(F.sort_array(F.collect_set("sid")).alias("users"))
    return owners.join(users, ["store", "table"], "left").select("store", "table", "owner", F.coalesce("users", F.array().cast("array<string>")).alias("users"))


def topic_members(members: DataFrame, names: DataFrame) -> DataFrame:
    """(name, role, sid): services (sid, role, topic, raw_names) that publish or subscribe to
    each name asked for, by the topic's name or any raw one, in any case."""
    known = members.select("sid", "role", F.explode(F.array_union(F.array("topic"), F.col("raw_names"))).alias("_n")).select("sid", "role", F.lower("_n").alias("_n")).distinct()
    return names.select("name", F.lower("name").alias("_n")).distinct().join(known, "_n").select("name", "role", "sid").distinct()


def service_endpoints(routes: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, sid, method, path): routes of the service that a name, id or alias (alias, sid)
    stands for, in any case."""
    own = routes.select(F.lower("sid").alias("_n"), "sid").unionByName(aliases.select(F.lower("alias").alias("_n"), "sid")).distinct()
    asked = names.select("name", F.lower("name").alias("_n")).distinct()
    return asked.join(own, "_n").select("name", "sid").distinct().join(routes.select("sid", "method", "path"), "sid").select("name", "sid", "method", "path").distinct()


def write_counts(decisions: DataFrame) -> DataFrame:
    """(created, updated, skipped)."""
    return decisions.agg(*[F.count_if(F.col("decision") == d.upper()).alias(d) for d in ("created", "updated", "skipped")])


def flow_stats(flows: DataFrame, services: DataFrame) -> DataFrame:
    """(measure, key, n): flows by length, services in a flow, services in none."""
    by_length = flows.groupBy("length").agg(F.count("*").alias("n")).select(F.lit("length").alias("measure"), F.col("length").cast("string").alias("key"), "n")
    inside = flows.select(F.explode("path").alias("node")).distinct()
    told = services.select("node").distinct().join(inside.withColumn("_in", F.lit(1)), "node", "left")
    count = lambda c, key: told.where(c).agg(F.count("*").alias("n")).select(F.lit("services").alias("measure"), F.lit(key).alias("key"), "n")
    return by_length.unionByName(count("_in is not null", "covered")).unionByName(count("_in is null", "uncovered"))


def normalize_discipline(name: Column, canonical: list[str], aliases: dict[str, str]) -> Column:
    """The discipline that a name is, by itself, as an alias, or by a part of it, in the order
    given; null if none."""
    low = F.lower(F.trim(name))
    out = F.when(low.isin(canonical), low)
    for alias, target in aliases.items():
        out = out.when(low == alias, target)
    for c in canonical:
        out = out.when(low.contains(c), c)
    return out


def merge_disciplines(effort: DataFrame, canonical: list[str], aliases: dict[str, str]) -> DataFrame:
    """(request_id, discipline, days): days summed by canonical discipline; what isn't above
    zero or has no discipline goes."""
    rows = effort.where("days > 0").withColumn("discipline", normalize_discipline(F.col("discipline"), canonical, aliases))
    return rows.where("discipline is not null").groupBy("request_id", "discipline").agg(F.sum("days").alias("days"))


def recompute_ledger(ledger: DataFrame, touches: DataFrame) -> DataFrame:
    """(path, status): extracted where an extractor parsed a file in full, scanned where one
    touched it, else pending; skipped and failed stay."""
    seen = touches.groupBy("path").agg(F.bool_or(F.col("parse") == "full").alias("_full"))
    rows = ledger.join(seen, "path", "left")
    return rows.select("path", F.when(F.col("status").isin("skipped", "failed"), F.col("status")).when(F.col("_full"), "extracted").when(F.col("_full").isNotNull(), "scanned").otherwise("pending").alias("status"))


def service_tickets(links: DataFrame, least: str = "low", limit: int = 50) -> DataFrame:
    """(service, rank, ticket, confidence, hits): each service's first tickets by confidence,
    hits and newest id; the limit is from 1 to 200."""
    place = rank("confidence", CONFIDENCE)
    each = links.groupBy("service", "ticket").agg(F.max(place).alias("_c"), F.count("*").alias("hits")).where(F.col("_c") >= CONFIDENCE.index(least))
    order = Window.partitionBy("service").orderBy(F.desc("_c"), F.desc("hits"), F.desc("ticket"))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, min(200, limit))).select("service", "rank", "ticket", named(F.col("_c"), CONFIDENCE).alias("confidence"), "hits")


def recent_limit(tickets: DataFrame, n: int) -> DataFrame:
    """Each project's n latest tickets, ties by id."""
    order = Window.partitionBy("project").orderBy(F.desc("updated_at"), "id")
    return tickets.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def embed_text(label: Column, fields: dict[str, list[str]]) -> Column:
    """The text to embed: a label's fields with single spaces between; null for another label
    or if all are blank."""
    out = F.lit(None).cast("string")
    for name, columns in fields.items():
        text = F.trim(F.concat_ws(" ", *[F.when(F.trim(F.col(c)) != "", F.col(c)) for c in columns]))
        out = F.when(label == name, F.when(text != "", text)).otherwise(out)
    return out


def hops(edges: DataFrame, left_out: tuple[str, ...] = ("test", "library", "script"), most_evidence: int = 10) -> DataFrame:
    """(src, dst, kind, vias, evidence, confidence): one hop of edges between different
    services whose caller is none of the types left out."""
    rows = edges.where(F.col("src") != F.col("dst")).where(~F.coalesce(F.col("caller_type").isin(*left_out), F.lit(False)))
    return rows.groupBy("src", "dst", "kind").agg(F.sort_array(F.collect_set("via")).alias("vias"), F.slice(F.sort_array(F.collect_set("evidence")), 1, most_evidence).alias("evidence"), named(F.max(rank("confidence", CONFIDENCE)), CONFIDENCE).alias("confidence"))


def chunk_edges(chunks: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(source_id, rel_type, target_id): parents have chunks, duplicates point to their
    canonical chunk."""
    text = lambda c: F.col(c).cast("string")
    has = chunks.select(text("parent_id").alias("source_id"), F.lit("HAS_CHUNK").alias("rel_type"), text("chunk_id").alias("target_id"))
    return has.unionByName(duplicates.where("is_duplicate").select(text("chunk_id").alias("source_id"), F.lit("DUPLICATE_OF").alias("rel_type"), text("canonical_id").alias("target_id")))


def merge_batches(*batches: DataFrame) -> DataFrame:
    """All rows of all batches; the writer removes repeats."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)
