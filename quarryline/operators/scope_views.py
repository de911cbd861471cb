"""What a request's systems, documents and scope items amount to; phases, endpoints, flows, owners, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_path


def cross_domain(requests: DataFrame, systems: DataFrame, links: DataFrame, domains: tuple[str, str], crossing: float, hubs: dict[str, float], linked: dict[str, float], most: float = 0.6) -> DataFrame:
    """(request_id, is_cross_domain, overhead) for requests (request_id, system): whether both
    domains take part, and the sum of the overheads that apply, each once, up to ``most``:
    for crossing, for each hub present, for each system that a link (src, dst) of one
    present touches."""
    rows = requests.select("request_id", "system").join(systems.select("system", "domain"), "system", "left")
    ends = links.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("l")).select("l.*")
    touching = ends.where(F.col("b").isin(*linked)).select(F.col("a").alias("system"), F.col("b").alias("to"))
    touching = touching.unionByName(touching.select(F.col("to").alias("system"), "to")).groupBy("system").agg(F.collect_set("to").alias("touches"))
    rows = rows.join(touching, "system", "left")
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = [has(F.col("domain") == d).alias(f"_d{i}") for i, d in enumerate(domains)]
    flags += [has(F.col("system") == h).alias(f"_h{i}") for i, h in enumerate(hubs)]
    flags += [has(F.array_contains("touches", s)).alias(f"_l{i}") for i, s in enumerate(linked)]
    told = rows.groupBy("request_id").agg(*flags).withColumn("is_cross_domain", F.col("_d0") & F.col("_d1"))
    total = F.when(F.col("is_cross_domain"), crossing).otherwise(0.0)
    for prefix, table in (("_h", hubs), ("_l", linked)):
        for i, factor in enumerate(table.values()):
            total = total + F.when(F.col(f"{prefix}{i}"), factor).otherwise(0.0)
    return told.select("request_id", "is_cross_domain", F.least(F.round(total, 4), F.lit(most)).alias("overhead"))


def input_tier(documents: DataFrame) -> DataFrame:
    """(project_id, tier, is_valid): 0 without a prd, 1 with it, 2 with an hld too, 3 with
    dependent documents besides; a set is valid with a brd and a prd."""
    has = lambda kind: F.coalesce(F.bool_or(F.col("doc_kind") == kind), F.lit(False))
    sets = documents.groupBy("project_id").agg(has("brd").alias("_b"), has("prd").alias("_p"), has("hld").alias("_h"), has("dependent_docs").alias("_d"))
    tier = F.when(~F.col("_p"), 0).when(F.col("_h") & F.col("_d"), 3).when(F.col("_h"), 2).otherwise(1)
    return sets.select("project_id", tier.alias("tier"), (F.col("_b") & F.col("_p")).alias("is_valid"))


def item_status(name: Column, effort_text: Column) -> Column:
    """By the share of a name's words that are longer than three letters and in the text:
    fully_estimated from a half, partially_estimated from a fifth, else not_estimable."""
    text = F.lower(F.coalesce(effort_text, F.lit("")))
    words = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"\s+"), lambda w: w != "")
    share = F.size(F.filter(words, lambda w: (F.length(w) > 3) & F.contains(text, w))) / F.greatest(F.size(words), F.lit(1))
    return F.when(share >= 0.5, "fully_estimated").when(share >= 0.2, "partially_estimated").otherwise("not_estimable")


def scope_status(items: DataFrame, efforts: DataFrame) -> DataFrame:
    """Scope items (doc_id, id, name) with the status that their document's effort text gives."""
    return items.join(efforts.select("doc_id", "effort_text"), "doc_id", "left").withColumn("status", item_status(F.col("name"), F.col("effort_text"))).drop("effort_text")


def scope_coverage(items: DataFrame) -> DataFrame:
    """(doc_id, coverage): fully estimated items and half of the partial ones, by all."""
    worth = F.when(F.col("status") == "fully_estimated", 1.0).when(F.col("status") == "partially_estimated", 0.5).otherwise(0.0)
    return items.groupBy("doc_id").agg(F.avg(worth).alias("coverage"))


def phase_status(repos: DataFrame, phases: DataFrame, versions: dict[str, str]) -> DataFrame:
    """(org, repo, phase, status) for recorded phases and those with a current version: pending
    without a record; a done one is stale if made by another version, from another commit
    (not clone) or, for extract, from another ledger."""
    keys = ["org", "repo", "phase"]
    wanted = phases.select(*keys)
    if versions:
        wanted = wanted.unionByName(repos.select("org", "repo", F.explode(F.array(*map(F.lit, versions))).alias("phase"))).distinct()
    rows = wanted.join(phases.withColumnRenamed("ledger_at", "_made_from"), keys, "left").join(repos.select("org", "repo", "head_sha", "ledger_at"), ["org", "repo"])
    current = F.lit(None).cast("string")
    for phase, version in versions.items():
        current = F.when(F.col("phase") == phase, F.lit(version)).otherwise(current)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    stale = (current.isNotNull() & ~F.col("version").eqNullSafe(current)) | ((F.col("phase") != "clone") & ~same("input_sha", "head_sha")) | ((F.col("phase") == "extract") & F.col("ledger_at").isNotNull() & ~same("_made_from", "ledger_at"))
    state = F.coalesce("status", F.lit("pending"))
    return rows.select(*keys, F.when((state == "done") & stale, "stale").otherwise(state).alias("status"))


def phase_summary(states: DataFrame) -> DataFrame:
    """(org, phase, status, n)."""
    return states.groupBy("org", "phase", "status").agg(F.count("*").alias("n"))


def repos_needing(states: DataFrame, phase: str, force: bool = False) -> DataFrame:
    """(org, repo) whose phase isn't done; all but skipped ones if forced."""
    rows = states.where(F.col("phase") == phase).where(F.col("status") != "skipped")
    return (rows if force else rows.where(F.col("status").isin("pending", "failed", "stale", "running"))).select("org", "repo")


def find_endpoints(asked: DataFrame, routes: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """(ask_id, route_id, sid, method, path[, schemas]) for questions (ask_id, method, path, sid;
    a null method or sid is any): routes with the same path or the same normalized one.
    ``schemas`` (route_id, role, status, schema) come as sorted arrays."""
    keys = lambda p: F.explode(F.array_distinct(F.array(F.concat(F.lit("="), p), F.concat(F.lit("~"), norm_path(p)))))
    left = asked.select("ask_id", F.upper("method").alias("_m"), F.col("sid").alias("_s"), keys(F.col("path")).alias("_k"))
    right = routes.select("route_id", "sid", "method", "path", keys(F.col("path")).alias("_k"))
    found = left.join(right, "_k").where((F.col("_m").isNull() | (F.col("_m") == F.col("method"))) & (F.col("_s").isNull() | (F.col("_s") == F.col("sid")))).select("ask_id", "route_id", "sid", "method", "path").distinct()
    if schemas is None:
        return found
    each = schemas.groupBy("route_id").agg(F.sort_array(F.collect_set(F.struct("role", "status", "schema"))).alias("schemas"))
    return found.join(each, "route_id", "left")


def service_flows(members: DataFrame, limit: int = 20) -> DataFrame:
    """(service, rank, flow_id, role, length): flows that a service enters first, then longer ones."""
    order = Window.partitionBy("service").orderBy(F.when(F.col("role") == "entry", 0).otherwise(1), F.desc("length"), "flow_id")
    return members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("service", "rank", "flow_id", "role", "length")


def extract_owners(files: DataFrame) -> DataFrame:
    """(repo_id, rel_type, team_id, name): the owners that ownership files (repo_id, text) name
    after the pattern of a line; comments go, repeats count once."""
    line = F.explode(F.split("text", r"\r\n|[\r\n]"))
    tokens = F.split(F.trim(F.regexp_replace(F.regexp_replace("_line", r"#.*$", ""), r"\s+", " ")), " ")
    owners = files.select("repo_id", line.alias("_line")).select("repo_id", F.explode(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1)))).alias("_o"))
    names = owners.where(F.col("_o").startswith("@") & (F.length("_o") > 1)).select("repo_id", F.regexp_replace("_o", "^@+", "").alias("name")).distinct()
    return names.select("repo_id", F.lit("OWNED_BY").alias("rel_type"), F.concat(F.lit("team:"), "name").alias("team_id"), "name")


def link_coverage(documents: DataFrame, links: DataFrame, top: int = 60) -> DataFrame:
    """(measure, key, n): documents (doc_id, doc_type, in_graph) by type, linked and not in the
    graph; links (doc_id, sid, confidence, matched) by type, service and confidence; the terms
    matched most."""
    both = documents.select("doc_id", "doc_type", "in_graph").join(links.groupBy("doc_id").agg(F.count("*").alias("_n")), "doc_id", "left")
    by_type = both.groupBy(F.col("doc_type").alias("key")).agg(F.count("*").alias("docs"), F.count_if(F.col("_n") > 0).alias("linked_docs"), F.coalesce(F.sum("_n"), F.lit(0)).alias("links"), F.count_if(~F.col("in_graph")).alias("not_in_graph"))
    out = by_type.unpivot("key", ["docs", "linked_docs", "links", "not_in_graph"], "measure", "n").select("measure", "key", "n")
    typed = links.join(documents.select("doc_id", "doc_type"), "doc_id")
    services = typed.groupBy(F.concat_ws(" ", "sid", "doc_type", "confidence").alias("key")).agg(F.count("*").alias("n")).select(F.lit("service").alias("measure"), "key", "n")
    sure = links.groupBy(F.col("confidence").alias("key")).agg(F.count("*").alias("n")).select(F.lit("confidence").alias("measure"), "key", "n")
    terms = links.select(F.explode("matched").alias("key")).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(top).select(F.lit("term").alias("measure"), "key", "n")
    return out.unionByName(services).unionByName(sure).unionByName(terms)


def gap_retrieval(context: DataFrame, top: DataFrame, hits: DataFrame, most: int = 3, above: float = 0.7) -> DataFrame:
    """(query_id, sid, chunk_id, score): of the first services of a question's context (query_id,
    sid, place) that its results (query_id, sid) lack, the best chunk, if it scores above the bound."""
    first = Window.partitionBy("query_id").orderBy("place", "sid")
    lacking = context.groupBy("query_id", "sid").agg(F.min("place").alias("place")).join(top.select("query_id", "sid"), ["query_id", "sid"], "left_anti")
    chosen = lacking.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).select("query_id", "sid")
    best = hits.join(chosen, ["query_id", "sid"], "left_semi").groupBy("query_id", "sid").agg(F.min(F.struct((-F.col("score")).alias("_s"), "chunk_id")).alias("_b"))
    return best.select("query_id", "sid", F.col("_b.chunk_id").alias("chunk_id"), (-F.col("_b._s")).alias("score")).where(F.col("score") > above)


def endpoint_calls(edges: DataFrame, routes: DataFrame) -> DataFrame:
    """(edge_id, src, route_id): the routes of an edge's target that its first item (method,
    path) with a hit names, paths compared by their normalized form."""
    items = edges.select("edge_id", "src", F.col("dst").alias("sid"), F.posexplode("items").alias("_pos", "_item"))
    items = items.select("edge_id", "src", "sid", "_pos", F.col("_item.method").alias("method"), norm_path(F.col("_item.path")).alias("_k"))
    hits = items.join(routes.select("route_id", "sid", "method", norm_path(F.col("path")).alias("_k")), ["sid", "method", "_k"])
    first = hits.groupBy("edge_id", "src", "route_id").agg(F.min("_pos").alias("_pos"))
    order = Window.partitionBy("edge_id", "src")
    return first.withColumn("_least", F.min("_pos").over(order)).where("_pos = _least").select("edge_id", "src", "route_id")
