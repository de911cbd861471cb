"""Registries over many repositories: hosts, merged items, services, gaps, aliases, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_key, is_secret, name_variants, norm_path, split_identifier

#: settings of a deployment that name a host (fixed values)
APP_NAMES = ("webappname", "appname", "functionappname")
APP_DOMAIN = ".azurewebsites.net"
#: methods whose requests have a body
BODY_METHODS = ("POST", "PUT", "PATCH")
CALL_KINDS = ("outbound_http", "frontend_api_call")
#: rounds in which placeholders inside values are replaced
PLACEHOLDER_ROUNDS = 5


def host_index(items: DataFrame) -> DataFrame:
    """(host, sid, source, prefix): hosts that infrastructure items (sid, infra_kind, name,
    namespace, hosts, paths, targets) answer to: three names of a cluster service, a
    composed service, every host and path of an ingress, an app service.  Names with
    placeholders give none."""
    kind, named = F.col("infra_kind"), F.col("name").isNotNull() & (F.col("name") != "")
    spaced = F.coalesce("namespace", F.lit("")) != ""
    one = lambda h, source: F.struct(h.alias("host"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("prefix"))
    cluster = F.array(one(F.col("name"), "k8s-service"), one(F.when(spaced, F.concat_ws(".", "name", "namespace")), "k8s-service"), one(F.when(spaced, F.concat(F.concat_ws(".", "name", "namespace"), F.lit(".svc.cluster.local"))), "k8s-service"))
    paths = F.when(F.size("paths") > 0, F.col("paths")).otherwise(F.array(F.lit("/")))
    ingress = F.flatten(F.transform("hosts", lambda h: F.transform(paths, lambda p: F.struct(h.alias("host"), F.lit("k8s-ingress").alias("source"), norm_path(F.coalesce(p, F.lit("/"))).alias("prefix")))))
    value = lambda t: F.substring_index(t, "=", -1)
    apps = F.transform(F.filter("targets", lambda t: F.lower(F.substring_index(t, "=", 1)).isin(*APP_NAMES) & F.contains(t, F.lit("=")) & (value(t) != "")), lambda t: one(F.concat(value(t), F.lit(APP_DOMAIN)), "app-service"))
    empty = F.slice(cluster, 1, 0)
    base = F.when((kind == "k8s-service") & named, cluster).when((kind == "compose-service") & named, F.array(one(F.col("name"), "compose-service"))).when((kind == "k8s-ingress") & F.col("hosts").isNotNull(), ingress).otherwise(empty)
    rows = items.select("sid", F.explode(F.concat(base, F.coalesce(apps, empty))).alias("h")).select("sid", "h.*")
    return rows.where("host is not null and host != '' and not contains(host, '$(') and not contains(host, '{')").select(F.lower("host").alias("host"), "sid", "source", "prefix").distinct()


def merged_attributes(items: DataFrame) -> DataFrame:
    """(id, name, values, conflict) of items that share an id (id, source, role, attributes
    MAP): the values of all, if they agree; else those of the items found in code (of
    these, of those that run, if some only test), and if they disagree too, all of them
    sorted, as a conflict.  Empty values say nothing."""
    over = Window.partitionBy("id")
    code = F.bool_or(F.col("source") == "code").over(over)
    first = items.withColumn("_p", ~code | (F.col("source") == "code"))
    runs = F.bool_or(F.col("_p") & (F.col("role") == "runtime")).over(over)
    rows = first.withColumn("_p", F.col("_p") & (~F.coalesce(runs, F.lit(False)) | F.coalesce(F.col("role") == "runtime", F.lit(False))))
    each = rows.select("id", "_p", F.explode("attributes").alias("name", "value")).where("value != ''")
    sets = each.groupBy("id", "name").agg(F.sort_array(F.collect_set("value")).alias("_all"), F.sort_array(F.collect_set(F.when(F.col("_p"), F.col("value")))).alias("_mine"))
    values = F.when((F.size("_all") > 1) & (F.size("_mine") > 0), F.col("_mine")).otherwise(F.col("_all"))
    return sets.select("id", "name", values.alias("values"), (F.size(values) > 1).alias("conflict"))


def merge_items(items: DataFrame) -> DataFrame:
    """(id, attributes, confidence, source, evidence): one row an id; see
    ``merged_attributes``.  Confidence is medium after a conflict or if any item's is;
    evidence is united; the source is code if any item's is, else the first by name."""
    values = merged_attributes(items).groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "values")))).alias("attributes"), F.bool_or("conflict").alias("_c"))
    rows = items.groupBy("id").agg(F.bool_or(F.col("confidence") == "medium").alias("_m"), F.when(F.bool_or(F.col("source") == "code"), "code").otherwise(F.min("source")).alias("source"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
    unsure = F.coalesce("_c", F.lit(False)) | F.coalesce("_m", F.lit(False))
    return rows.join(values, "id", "left").select("id", "attributes", F.when(unsure, "medium").otherwise("high").alias("confidence"), "source", "evidence")


def service_registry(routes: DataFrame, publishers: DataFrame, subscribers: DataFrame, access: DataFrame, calls: DataFrame) -> DataFrame:
    """(sid, routes, publishes, subscribes, stores, callers): what each service offers and
    uses: number of routes, sorted topics and stores, sorted services that call it
    (calls: caller, sid)."""
    sets = lambda df, value, name: df.groupBy("sid").agg(F.sort_array(F.collect_set(value)).alias(name))
    parts = [routes.groupBy("sid").agg(F.count_distinct("method", "path").alias("routes")), sets(publishers, "topic", "publishes"), sets(subscribers, "topic", "subscribes"), sets(access, "store", "stores"), sets(calls.where("caller != sid"), "caller", "callers")]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "sid", "full_outer")
    none = F.array().cast("array<string>")
    return out.select("sid", F.coalesce("routes", F.lit(0)).alias("routes"), *[F.coalesce(c, none).alias(c) for c in ("publishes", "subscribes", "stores", "callers")])


def list_services(services: DataFrame, linked: DataFrame) -> DataFrame:
    """(source_id, name, aliases) of live services (source_id, name, aliases, deleted_at):
    own aliases in order, then linked ones (alias, source_id, deleted_at) by name; of
    aliases that differ only in case the first stays."""
    more = linked.where("deleted_at is null").groupBy("source_id").agg(F.sort_array(F.collect_set("alias")).alias("_more"))
    none = F.array().cast("array<string>")
    rows = services.where("deleted_at is null").join(more, "source_id", "left")
    rows = rows.withColumn("_all", F.filter(F.concat(F.coalesce("aliases", none), F.coalesce("_more", none)), lambda a: F.coalesce(a, F.lit("")) != ""))
    low = F.transform("_all", lambda a: F.lower(a))
    first = F.filter("_all", lambda a, i: F.array_position(low, F.lower(a)) == i + 1)
    return rows.select("source_id", "name", first.alias("aliases"))


def gap_report(items: DataFrame, files: DataFrame) -> DataFrame:
    """(type, file, item, reason), once each: what extraction left open.

    items: id, kind, file, base_url_source, method, path, name_from, entity, payload,
    request, response_schema; files: path, class, status, touched, partial, silent_client
    (uses a client without an item).  Skipped and failed files have no gaps."""
    kind = F.col("kind")
    route = F.concat_ws(" ", F.coalesce("method", F.lit("ANY")), F.coalesce("path", F.lit("/")))
    unknown = lambda c: F.col(c).isNull() | (F.col(c) == "unknown")
    rules = [
        ("unresolved_base_url", kind.isin(*CALL_KINDS) & unknown("base_url_source"), F.concat(route, F.lit(": base URL source unknown"))),
        ("unresolved_entity", (kind == "messaging") & (unknown("name_from") | F.col("entity").isNull()), F.lit("entity name not resolved")),
        ("missing_payload", (kind == "messaging") & F.col("payload").isNull(), F.lit("payload type not resolved")),
        ("missing_schema", (kind == "inbound_http") & F.col("method").isin(*BODY_METHODS) & (F.coalesce("request", F.lit("")) == ""), F.concat(route, F.lit(": no request schema"))),
        ("missing_schema", (kind == "inbound_http") & (F.coalesce("response_schema", F.lit("")) == ""), F.concat(route, F.lit(": no response schema"))),
    ]
    found = F.explode(F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(t).alias("type"), reason.alias("reason"))) for t, rule, reason in rules])))
    of_items = items.select("file", F.col("id").alias("item"), found.alias("g")).select("g.type", "file", "item", "g.reason")
    pending, source = F.col("status") == "pending", F.col("class") == "source"
    partial, touched = F.coalesce("partial", F.lit(False)), F.coalesce("touched", F.lit(False))
    rules = [
        ("partial_parse", pending & partial, F.lit("unresolved or unsupported construct")),
        ("untouched_source", pending & ~partial & source & ~touched, F.lit("no extractor opened this source file")),
        ("untouched_file", pending & ~partial & ~(source & ~touched), F.concat_ws(" ", "class", F.lit("file left pending"))),
        ("silent_client_file", source & touched & F.coalesce("silent_client", F.lit(False)), F.lit("uses a client but yielded no item")),
    ]
    found = F.explode(F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(t).alias("type"), reason.alias("reason"))) for t, rule, reason in rules])))
    open_files = files.where(~F.col("status").rlike("^(skipped|failed)"))
    of_files = open_files.select(F.col("path").alias("file"), found.alias("g")).select("g.type", "file", F.lit(None).cast(dict(items.dtypes)["id"]).alias("item"), "g.reason")
    return of_items.unionByName(of_files).distinct()


def alias_candidates(services: DataFrame, packages: DataFrame, routes: DataFrame, hosts: DataFrame, clients: DataFrame) -> DataFrame:
    """(alias, sid, confidence, source), once each: phrases that may name a service.  From
    services (sid, name, title), packages (sid, name), routes (sid, path: its first literal
    after versions), hosts (sid, host: its first label) and clients (sid, client).  Each
    also gives its variants (see ``name_variants``), and a client's without its last word, at
    low."""
    words = lambda c: F.array_join(split_identifier(c), " ")
    segment = F.element_at(F.filter(F.split(norm_path(F.col("path")), "/"), lambda s: (s != "") & (s != "{}") & ~s.rlike(r"^(v\d+|api)$")), 1)
    one = lambda df, c, confidence, source: df.select(c.alias("alias"), "sid", F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))
    rows = one(services, words(F.col("name")), "high", "name").unionByName(one(services, F.lower(F.trim("title")), "high", "title"))
    rows = rows.unionByName(one(packages, words(F.regexp_extract("name", r"([^./:@]+)$", 1)), "medium", "package")).unionByName(one(routes.where("path is not null"), words(F.try_element_at(F.array(segment), F.lit(1))), "medium", "route"))
    rows = rows.unionByName(one(hosts, words(F.substring_index("host", ".", 1)), "medium", "host")).unionByName(one(clients, words(F.col("client")), "low", "client"))
    # a client is called after what it calls
    called = F.when(F.col("source") == "client", F.regexp_replace("alias", r" (client|gateway|proxy|impl|http|rest|feign)$", "")).otherwise(F.col("alias"))
    variants = rows.select(F.explode(F.array_distinct(F.concat(F.array(called), name_variants(called)))).alias("variant"), "alias", "sid", "source").where("variant != alias and variant != ''").select(F.col("variant").alias("alias"), "sid", F.lit("low").alias("confidence"), "source")
    every = rows.unionByName(variants).where("length(alias) > 2")
    order = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return every.groupBy("alias", "sid", "source").agg(F.min_by("confidence", order).alias("confidence")).select("alias", "sid", "confidence", "source")


def _glob(pattern: Column) -> Column:
    """A pattern with * and ? as a regular expression."""
    plain = F.regexp_replace(pattern, r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(plain, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def external_systems(evidence: DataFrame, registry: DataFrame) -> DataFrame:
    """(system, subproject, matched_by, match, items): systems that evidence (matched_by,
    text, item, subproject) points to, by a registry (ordinal, system, matched_by,
    pattern); the first entry that a text matches counts.  One row a system and
    subproject: its first match by (matched_by, text) and how many items.  The registry is
    small by nature; only distinct texts meet it."""
    texts = evidence.select("matched_by", "text").where("text is not null").distinct()
    patterns = registry.select("ordinal", "system", "matched_by", _glob(F.col("pattern")).alias("_re"))
    hits = texts.join(patterns, "matched_by").where(F.expr("rlike(text, _re)")).groupBy("matched_by", "text").agg(F.min_by("system", "ordinal").alias("system"))
    rows = evidence.join(hits, ["matched_by", "text"])
    best = F.min(F.struct("matched_by", "text"))
    return rows.groupBy("system", "subproject").agg(best.alias("b"), F.count_distinct("item").alias("items")).select("system", "subproject", "b.matched_by", F.col("b.text").alias("match"), "items")


def _definition(asked: DataFrame, definitions: DataFrame, key: str) -> DataFrame:
    """``asked`` (env, subproject and ``key``, a canonical name), once each, with _value: the
    definition of the same subproject if it has any, for the environment, else for
    default; settings files before others, then by file and line."""
    d = definitions.select(F.col("canonical").alias(key), F.col("subproject").alias("_sub"), F.col("env").alias("_env"), F.col("value").alias("_v"), (F.col("source") != "property").alias("_src"), F.col("file").alias("_file"), F.col("line").alias("_line"))
    own = F.coalesce(F.col("_sub") == F.col("subproject"), F.lit(False))
    fits = (F.col("_env") == F.col("env")) | (F.col("_env") == "default")
    order = F.struct((F.col("_env") != F.col("env")).alias("other"), "_src", "_file", "_line")
    best = lambda ok: F.min_by("_v", F.when(ok, order))
    rows = asked.join(d, key, "left").groupBy(*asked.columns).agg(F.bool_or(own).alias("_own"), best(own & fits).alias("_a"), best(fits).alias("_b"))
    return rows.select(*asked.columns, F.when(F.col("_own"), F.col("_a")).otherwise(F.col("_b")).alias("_value"))


def resolve_config(asked: DataFrame, definitions: DataFrame) -> DataFrame:
    """(key, env, subproject, value): the value of each asked key (key, env, subproject) from
    definitions (key, env, subproject, value, source, file, line), in any spelling.
    Placeholders ${name} and ${name:default} in values are resolved through other keys,
    at most five deep; a value with one left that has no default is null."""
    defs = definitions.withColumn("canonical", canonical_key(F.col("key")))
    rows = _definition(asked.select("key", "env", "subproject", canonical_key(F.col("key")).alias("_k")).distinct(), defs, "_k")
    rows = rows.select("key", "env", "subproject", F.col("_value").alias("value"))
    hole = r"\$\{([^{}:]+)(?::([^{}]*))?\}"
    for _ in range(PLACEHOLDER_ROUNDS):
        name = F.regexp_extract("value", hole, 1)
        rows = rows.withColumn("_n", F.when(F.col("value").rlike(hole), canonical_key(F.trim(name))))
        rows = _definition(rows, defs, "_n")
        text = F.regexp_extract("value", hole, 0)
        default = F.when(F.contains(text, F.lit(":")), F.regexp_extract("value", hole, 2))
        filled = F.expr("replace(value, _t, _f)")
        rows = rows.withColumn("_t", text).withColumn("_f", F.coalesce("_value", default))
        rows = rows.select("key", "env", "subproject", F.when(F.col("_n").isNull(), F.col("value")).otherwise(F.when(F.col("_f").isNotNull(), filled)).alias("value"))
    return rows.select("key", "env", "subproject", F.when(~F.col("value").rlike(hole), F.col("value")).alias("value"))


def service_config_keys(settings: DataFrame, names: DataFrame) -> DataFrame:
    """(name, sid, key, environments, secret): the settings of a service that is asked for by
    id, name or alias (names: name, sid), never their values.  settings: sid, key, env,
    value."""
    keys = settings.groupBy("sid", "key").agg(F.sort_array(F.collect_set("env")).alias("environments"), F.bool_or(is_secret(F.col("key"), F.col("value"))).alias("secret"))
    return names.select("name", "sid").distinct().join(keys, "sid").select("name", "sid", "key", "environments", "secret")


def scan_secrets(lines: DataFrame) -> DataFrame:
    """(file, line, key): settings (file, line, key, value) that look like secrets, without
    their values."""
    return lines.where(is_secret(F.col("key"), F.col("value"))).select("file", "line", "key")
