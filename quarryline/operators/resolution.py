"""Cross-repository resolution: calls to routes, topics, tables, packages, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import CONFIDENCE, named, rank
from ..functions.text import base_domain, norm_path, norm_topic, slug, stable_id


def service_ids(repos: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(repo, sid): the slug; of repos with one slug, all but the one whose name is the
    slug get a hash; overrides (repo, sid) first."""
    rows = repos.select("repo", slug(F.col("repo")).alias("_slug"))
    several = F.count("*").over(Window.partitionBy("_slug")) > 1
    own = F.when(several & (F.col("repo") != F.col("_slug")), F.concat("_slug", F.lit("-"), F.substring(F.sha1("repo"), 1, 6))).otherwise(F.col("_slug"))
    rows = rows.withColumn("_sid", own)
    if overrides is None:
        return rows.select("repo", F.col("_sid").alias("sid"))
    return rows.join(overrides, "repo", "left").select("repo", F.coalesce("sid", "_sid").alias("sid"))


def resolve_host(calls: DataFrame, hosts: DataFrame) -> DataFrame:
    """(call_id, sid): calls (call_id, host, path) meet hosts (host, prefix, sid); the longest
    prefix of the path decides, if it leaves one service."""
    met = calls.join(hosts, "host").where(F.startswith("path", "prefix") & ((F.length("path") == F.length("prefix")) | (F.col("prefix") == "") | F.expr("substring(path, length(prefix) + 1, 1) = '/'")))
    longest = met.groupBy("call_id").agg(F.max(F.length("prefix")).alias("_l"))
    best = met.join(longest, "call_id").where(F.length("prefix") == F.col("_l"))
    return best.groupBy("call_id").agg(F.countDistinct("sid").alias("_n"), F.min("sid").alias("sid")).where("_n = 1").select("call_id", "sid")


def match_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(call_id, route_id, sid, tier, literals): calls (call_id, method, path) and routes
    (route_id, sid, method, path) of one length whose segments agree, a parameter
    agreeing with anything (tier 2), or a route that is a suffix of a call, its literals
    not met by a call's parameter and the last segment shared (tier 1).

    Every match shares a literal at one place from the end: that is the join key, over
    distinct (method, path)."""
    wild = lambda c: F.when(F.upper(c).isin("ANY", "*") | c.isNull(), F.lit("*")).otherwise(F.upper(c))
    parts = lambda df: df.withColumn("m", wild(F.col("method"))).withColumn("s", F.reverse(F.filter(F.split(norm_path(F.col("path")), "/"), lambda x: x != "")))
    c, r = parts(calls), parts(routes)
    keys = lambda df, m, s: df.select(m, s).distinct().select(m, s, F.posexplode(s).alias("pos", "literal")).where("literal != '{}'")
    ck = keys(c.select(F.col("m").alias("cm"), F.col("s").alias("cs")), "cm", "cs")
    rk = keys(r.select(F.col("m").alias("rm"), F.col("s").alias("rs")), "rm", "rs")
    pairs = ck.join(rk, ["pos", "literal"]).where("cm = rm or cm = '*' or rm = '*'").select("cm", "cs", "rm", "rs").distinct()
    same = F.size("cs") == F.size("rs")
    both = F.arrays_zip(F.slice("cs", 1, F.size("rs")).alias("a"), F.col("rs").alias("b"))
    agree = F.forall(both, lambda x: (x["a"] == x["b"]) | (x["a"] == "{}") | (x["b"] == "{}"))
    shared = F.size(F.filter(both, lambda x: (x["a"] == x["b"]) & (x["a"] != "{}")))
    no_guess = F.forall(both, lambda x: ~((x["b"] == "{}") & (x["a"] != "{}"))) | (F.element_at("cs", 1) == F.element_at("rs", 1))
    scored = pairs.where((F.size("cs") >= F.size("rs")) & agree).withColumn("literals", shared)
    scored = scored.withColumn("tier", F.when(same & (F.col("literals") >= 1), 2).when(~same & no_guess & (F.col("literals") >= 1) & (F.element_at("cs", 1) == F.element_at("rs", 1)), 1)).where("tier is not null")
    out = scored.join(c.select("call_id", F.col("m").alias("cm"), F.col("s").alias("cs")), ["cm", "cs"]).join(r.select("route_id", "sid", F.col("m").alias("rm"), F.col("s").alias("rs")), ["rm", "rs"])
    return out.select("call_id", "route_id", "sid", "tier", "literals")


def pick_route(matches: DataFrame) -> DataFrame:
    """(call_id, outcome, sids): of the best (tier, literals) one service is an edge,
    several are candidates."""
    order = Window.partitionBy("call_id").orderBy(F.desc("tier"), F.desc("literals"))
    best = matches.withColumn("_r", F.rank().over(order)).where("_r = 1")
    got = best.groupBy("call_id").agg(F.sort_array(F.collect_set("sid")).alias("sids"))
    return got.select("call_id", F.when(F.size("sids") == 1, "edge").otherwise("candidates").alias("outcome"), "sids")


def unresolved_calls(calls: DataFrame, edges: DataFrame, internal_domains: list[str]) -> DataFrame:
    """(call_id, reason) of calls without an edge."""
    rows = calls.join(edges.select("call_id").distinct(), "call_id", "left_anti")
    reason = F.when(F.col("host").isNull(), "no_base_url").when(F.coalesce(F.col("path"), F.lit("")).contains("${"), "dynamic_url").when(base_domain(F.col("host")).isin(internal_domains), "no_route_match").otherwise("unknown_host")
    return rows.select("call_id", reason.alias("reason"))


def contract_twin_filter(routes: DataFrame) -> DataFrame:
    """Without contract routes that code also has."""
    key = ["sid", "method", "_p"]
    rows = routes.withColumn("_p", norm_path(F.col("path")))
    code = rows.where("origin = 'code'").select(*key).distinct()
    return rows.where("origin = 'code'").unionByName(rows.where("origin != 'code'").join(code, key, "left_anti")).drop("_p")


def external_by_host(calls: DataFrame, systems: DataFrame) -> DataFrame:
    """(call_id, system): the first registry entry (ordinal, system, pattern with *) whose
    pattern the host matches.  The registry is small by nature and the join is a
    nested loop over it."""
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("pattern", r"\.", "\\\\."), r"\*", ".*"), F.lit("$"))
    hosts = calls.select("host").where("host is not null").distinct()
    met = hosts.join(systems.withColumn("_re", regex), F.expr("rlike(host, _re)")).groupBy("host").agg(F.min_by("system", "ordinal").alias("system"))
    return calls.join(met, "host").select("call_id", "system")


def link_topics(publishers: DataFrame, subscribers: DataFrame) -> DataFrame:
    """(publisher, subscriber, topic, confidence): one broker and normalised name; spaces
    must agree where both are known, and then confidence is high, else medium."""
    side = lambda df, who: df.select("broker", norm_topic(F.col("topic")).alias("topic"), F.col("sid").alias(who), F.col("namespace").alias(f"_{who}")).distinct()
    met = side(publishers, "publisher").join(side(subscribers, "subscriber"), ["broker", "topic"])
    ok = F.col("_publisher").isNull() | F.col("_subscriber").isNull() | (F.col("_publisher") == F.col("_subscriber"))
    known = F.col("_publisher").isNotNull() & F.col("_subscriber").isNotNull()
    return met.where(ok & (F.col("publisher") != F.col("subscriber"))).groupBy("publisher", "subscriber", "topic").agg(F.when(F.bool_or(known), "high").otherwise("medium").alias("confidence"))


def shared_tables(access: DataFrame) -> DataFrame:
    """(a, b, tables): pairs of services (a < b) that write the same tables."""
    w = access.where("access = 'write'").select("store", "table", "sid").distinct()
    met = w.withColumnRenamed("sid", "a").join(w.withColumnRenamed("sid", "b"), ["store", "table"]).where("a < b")
    return met.groupBy("a", "b").agg(F.count("*").alias("tables"))


def readers_only(access: DataFrame) -> DataFrame:
    """(store, table, readers): services that read a table and don't write it."""
    sets = access.groupBy("store", "table").agg(F.collect_set(F.when(F.col("access") == "read", F.col("sid"))).alias("_r"), F.collect_set(F.when(F.col("access") == "write", F.col("sid"))).alias("_w"))
    return sets.select("store", "table", F.sort_array(F.array_except("_r", "_w")).alias("readers")).where(F.size("readers") > 0)


def link_libraries(dependencies: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(repo, name, library, how): exact (ecosystem, name), else the last part of the name if
    one library repo has it; not within a repo."""
    lib = artifacts.select("ecosystem", "name", F.col("repo").alias("library")).distinct()
    one = lib.groupBy("ecosystem", "name").agg(F.countDistinct("library").alias("_n"), F.min("library").alias("library")).where("_n = 1").drop("_n")
    exact = dependencies.join(one, ["ecosystem", "name"]).where("repo != library").select("repo", "name", "library", F.lit("exact").alias("how"))
    tail = lambda c: F.regexp_extract(c, r"([^./:@]+)$", 1)
    last = lib.withColumn("_t", tail(F.col("name"))).groupBy("ecosystem", "_t").agg(F.countDistinct("library").alias("_n"), F.min("library").alias("library")).where("_n = 1")
    left = dependencies.join(lib.select("ecosystem", "name").distinct(), ["ecosystem", "name"], "left_anti").withColumn("_t", tail(F.col("name")))
    return exact.unionByName(left.join(last, ["ecosystem", "_t"]).where("repo != library").select("repo", "name", "library", F.lit("name").alias("how")))


def version_drift(dependencies: DataFrame) -> DataFrame:
    """(name, versions): packages used at more than one version."""
    return dependencies.groupBy("name").agg(F.sort_array(F.collect_set("version")).alias("versions")).where(F.size("versions") > 1)


def contract_diff(caller: DataFrame, callee: DataFrame) -> DataFrame:
    """(edge_id, field, problem): fields (edge_id, field, required) of the two sides: extra,
    name_case, missing_required."""
    key = F.lower("field")
    a = caller.select("edge_id", key.alias("k"), F.col("field").alias("_a"))
    b = callee.select("edge_id", key.alias("k"), F.col("field").alias("_b"), "required")
    rows = a.join(b, ["edge_id", "k"], "full_outer")
    problem = F.when(F.col("_b").isNull(), "extra").when(F.col("_a").isNull() & F.col("required"), "missing_required").when(F.col("_a") != F.col("_b"), "name_case")
    return rows.select("edge_id", F.coalesce("_a", "_b").alias("field"), problem.alias("problem")).where("problem is not null")


def merge_edges(edges: DataFrame, most_evidence: int = 25) -> DataFrame:
    """One edge for each (from, to, kind, via): items united, distinct evidence sorted and
    bounded; confidence of the first by (repo, item), raised only to high."""
    rows = edges.withColumn("id", stable_id(*[F.col(c) for c in ("src", "dst", "kind", "via")]))
    high = F.bool_or(F.col("confidence") == "high")
    return rows.groupBy("id", "src", "dst", "kind", "via").agg(F.sort_array(F.collect_set("item")).alias("items"), F.slice(F.sort_array(F.collect_set("evidence")), 1, most_evidence).alias("evidence"), F.when(high, "high").otherwise(F.min_by("confidence", F.struct("repo", "item"))).alias("confidence"))


def overlay_notes(items: DataFrame, notes: DataFrame) -> DataFrame:
    """Items without those that notes corroborate, and the notes."""
    return items.join(notes.select(F.col("corroborates").alias("id")).distinct(), "id", "left_anti").unionByName(notes.select(*items.columns))


def alias_table(candidates: DataFrame, manual: DataFrame) -> DataFrame:
    """(alias, sid, confidence, sources, ambiguous): the best confidence of each; an alias
    given by hand (alias, sid) is taken from other services."""
    rows = candidates.join(manual.select("alias").distinct(), "alias", "left_anti").select("alias", "sid", "confidence", "source")
    rows = rows.unionByName(manual.select("alias", "sid", F.lit("manual").alias("confidence"), F.lit("manual").alias("source")))
    best = rows.groupBy("alias", "sid").agg(named(F.max(rank("confidence", CONFIDENCE)), CONFIDENCE).alias("confidence"), F.slice(F.sort_array(F.collect_set("source")), 1, 8).alias("sources"))
    several = best.groupBy("alias").agg((F.countDistinct("sid") > 1).alias("ambiguous"))
    return best.join(several, "alias")


def alias_ranking(aliases: DataFrame, k: int = 15) -> DataFrame:
    """The k first aliases of each service."""
    order = Window.partitionBy("sid").orderBy(F.desc(rank("confidence", CONFIDENCE)), "ambiguous", F.desc(F.size("sources")), "alias")
    return aliases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def known_only(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Claims (ordinal, src, dst, confidence) between known names (name), any case; no
    self-loops; the first of a pair; an unknown confidence is low."""
    low = lambda c: F.lower(F.trim(c))
    names = known.select(low(F.col("name")).alias("_k"), "name").groupBy("_k").agg(F.min("name").alias("_name"))
    a, b = names.select(F.col("_k").alias("_ka"), F.col("_name").alias("a")), names.select(F.col("_k").alias("_kb"), F.col("_name").alias("b"))
    rows = claims.join(a, low(F.col("src")) == F.col("_ka")).join(b, low(F.col("dst")) == F.col("_kb")).where("a != b")
    sure = F.when(F.col("confidence").isin(*CONFIDENCE), F.col("confidence")).otherwise("low")
    return rows.groupBy("a", "b").agg(F.min_by(sure, "ordinal").alias("confidence")).select(F.col("a").alias("src"), F.col("b").alias("dst"), "confidence")


def required_mentions(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(repo, items, mentioned, percent): items (repo, id, needles) that any document
    (repo, text) of their repo names."""
    texts = docs.select("repo", F.lower("text").alias("_t"))
    hit = items.join(texts, "repo").where(F.exists("needles", lambda n: F.contains(F.col("_t"), F.lower(n)))).select("repo", "id").distinct()
    got = items.select("repo", "id").distinct().join(hit.withColumn("_hit", F.lit(1)), ["repo", "id"], "left")
    return got.groupBy("repo").agg(F.count("*").alias("items"), F.count("_hit").alias("mentioned"), F.round(100.0 * F.count("_hit") / F.count("*"), 2).alias("percent"))


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """(repo, grouping, key, files): counts by class, status and language."""
    one = lambda c: ledger.groupBy("repo", F.col(c).alias("key")).agg(F.count("*").alias("files")).select("repo", F.lit(c).alias("grouping"), "key", "files")
    return one("class").unionByName(one("status")).unionByName(one("language"))


def ledger_gate(ledger: DataFrame) -> DataFrame:
    """(repo, passed, failed, pending): passes with nothing failed or pending."""
    count = lambda s: F.count_if(F.col("status") == s)
    return ledger.groupBy("repo").agg((count("failed") + count("pending") == 0).alias("passed"), count("failed").alias("failed"), count("pending").alias("pending"))


def is_internal(host: Column, domains: list[str]) -> Column:
    return F.coalesce(base_domain(host).isin(domains), F.lit(False))
