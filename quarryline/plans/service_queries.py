"""More registered queries: services, files, corpora, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph as gr
from ..operators import retrieval as rt
from ..operators import service_views as sv
from ..sources.records import table
from .queries import QUERIES, SQL, job

__all__ = ["QUERIES", "SQL"]


@job("SELECT id, name, planned_end FROM projects WHERE domain = 'domain 2' AND lower(name) LIKE '%2%' AND CAST(planned_end AS VARCHAR) LIKE '%-0%' AND planned_end BETWEEN DATE '1994-03-01' AND DATE '1997-06-30'", ("projects",))
def filter_listing(projects):
    return sv.filter_listing(projects, "planned_end", name="2", month="-0", start="1994-03-01", end="1997-06-30", domain="domain 2", stream=None).select("id", "name", "planned_end")


@job("SELECT DISTINCT src, kind AS rel_type, dst, via FROM raw_edges WHERE confidence = 'high' AND kind = 'http' AND src IN (SELECT sid FROM access WHERE sid NOT LIKE '%7') AND dst IN (SELECT sid FROM access WHERE sid NOT LIKE '%7') ORDER BY 1, 2, 3, 4 LIMIT 50", ("raw_edges", "access"))
def edges_by_provenance(edges, access):
    entities = access.select(F.col("sid").alias("source_id"), F.when(F.col("sid").like("%7"), F.lit("gone")).alias("deleted_at"))
    return sv.edges_by_provenance(edges.withColumn("provenance", F.col("confidence")).withColumn("rel_type", F.col("kind")), entities, "high", "http", 50)


@job("SELECT repo_name AS store, CAST(count_if(doc_type IS NULL OR doc_type NOT IN ('en', 'de')) AS BIGINT) AS deletes, CAST(count_if(doc_type IN ('en', 'de')) AS BIGINT) AS keeps FROM chunks GROUP BY repo_name", ("chunks",))
def purge_plan(chunks):
    return sv.purge_plan(chunks.select(F.col("repo_name").alias("store"), F.col("chunk_id").alias("id"), F.col("doc_type").alias("kind")), ["en", "de"])


@job(""", n AS (SELECT src AS service FROM depends_on UNION SELECT dst FROM depends_on),
 u AS (SELECT src AS service, array_to_string(list_sort(list(DISTINCT dst)), ',') AS uses FROM depends_on GROUP BY src), b AS (SELECT dst AS service, array_to_string(list_sort(list(DISTINCT src)), ',') AS used_by FROM depends_on GROUP BY dst),
 t AS (SELECT src AS service, count(DISTINCT item) AS tickets FROM raw_edges GROUP BY src)
 SELECT service, coalesce(uses, '') AS uses, coalesce(used_by, '') AS used_by, coalesce(tickets, 0) AS tickets FROM n LEFT JOIN u USING (service) LEFT JOIN b USING (service) LEFT JOIN t USING (service)""", ("depends_on", "raw_edges"))
def service_detail(depends_on, raw_edges):
    links = raw_edges.select(F.col("src").alias("service"), F.col("item").alias("ticket"))
    return sv.service_detail(depends_on, links).select("service", F.array_join("uses", ",").alias("uses"), F.array_join("used_by", ",").alias("used_by"), "tickets")


@job(""", o AS (SELECT store, "table", min(sid) AS owner FROM access WHERE access = 'write' GROUP BY ALL)
 SELECT o.store, o."table", o.owner, coalesce(array_to_string(list_sort(list(DISTINCT a.sid) FILTER (a.sid != o.owner)), ','), '') AS users FROM o JOIN access a ON a.store = o.store AND a."table" = o."table" GROUP BY ALL""", ("access",))
def owned_tables(access):
    ddl = access.where("access = 'write'").groupBy("store", "table").agg(F.min("sid").alias("sid"))
    return sv.owned_tables(ddl, access).select("store", "table", "owner", F.array_join("users", ",").alias("users"))


@job("SELECT DISTINCT 'PROD-Click' AS name, 'publisher' AS role, sid FROM publishers WHERE topic = 'prod-click' UNION ALL SELECT DISTINCT 'CLICK.dev', 'subscriber', sid FROM subscribers WHERE topic = 'click.dev'", ("publishers", "subscribers"))
def topic_members(publishers, subscribers):
    side = lambda df, role: df.select("sid", F.lit(role).alias("role"), tx.norm_topic(F.col("topic")).alias("topic"), F.array("topic").alias("raw_names"))
    names = publishers.sparkSession.createDataFrame([("PROD-Click",), ("CLICK.dev",)], "name string")
    return sv.topic_members(side(publishers, "publisher").unionByName(side(subscribers, "subscriber")), names)


@job("SELECT DISTINCT concat('Alias-', upper(sid)) AS name, sid, method, path FROM routes UNION ALL SELECT DISTINCT upper(sid), sid, method, path FROM routes", ("routes",))
def service_endpoints(routes):
    sids = routes.select("sid").distinct()
    names = sids.select(F.upper("sid").alias("name")).unionByName(sids.select(F.concat(F.lit("Alias-"), F.upper("sid")).alias("name")))
    return sv.service_endpoints(routes, names, sids.select(F.concat(F.lit("alias-"), "sid").alias("alias"), "sid"))


@job("SELECT CAST(count_if(t.source_id IS NULL) AS BIGINT) AS created, CAST(count_if(t.text_hash != b.text_hash) AS BIGINT) AS updated, CAST(count_if(t.text_hash = b.text_hash) AS BIGINT) AS skipped FROM entity_batch b LEFT JOIN entity_target t ON t.source_id = b.source_id", ("entity_target", "entity_batch"))
def write_counts(target, batch):
    return sv.write_counts(gr.upsert_decisions(target, batch))


@job(f"""WITH f AS ({SQL['maximal_paths']}), s AS ({SQL['service_detail']}), c AS (SELECT DISTINCT unnest(string_split(path, '>')) AS service FROM f)
 SELECT 'length' AS measure, CAST(length AS VARCHAR) AS key, count(*) AS n FROM f GROUP BY length UNION ALL SELECT 'services', 'covered', count(*) FROM s WHERE service IN (SELECT service FROM c) UNION ALL SELECT 'services', 'uncovered', count(*) FROM s WHERE service NOT IN (SELECT service FROM c)""", ("depends_on",))
def flow_stats(depends_on):
    entries = depends_on.where("src like 's%'").select(F.col("src").alias("node")).distinct()
    services = depends_on.select(F.col("src").alias("node")).unionByName(depends_on.select(F.col("dst").alias("node")))
    return sv.flow_stats(gr.maximal_paths(depends_on, entries, 3), services)


@job("SELECT request_id, CASE category WHEN 'ui' THEN 'frontend' WHEN 'test' THEN 'qa' ELSE 'api' END AS discipline, sum(quantity - 25) AS days FROM items WHERE quantity > 25 AND category != 'other' GROUP BY ALL", ("items",))
def merge_disciplines(items):
    effort = items.select("request_id", F.concat(F.lit(" "), F.upper("category"), F.when(F.col("category") == "api", " work").otherwise("")).alias("discipline"), (F.col("quantity") - 25).alias("days"))
    return sv.merge_disciplines(effort, ["api", "frontend", "qa"], {"ui": "frontend", "test": "qa"})


@job("SELECT o_orderkey AS path, CASE WHEN o_orderkey % 1000 = 5 THEN 'failed' WHEN bool_or(l_linenumber = 1) THEN 'extracted' WHEN count(l_orderkey) > 0 THEN 'scanned' ELSE 'pending' END AS status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 25 GROUP BY o_orderkey")
def recompute_ledger(spark, folder):
    ledger = table(spark, folder, "orders").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 1000 == 5, "failed").otherwise("pending").alias("status"))
    touches = table(spark, folder, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("path"), F.when(F.col("l_linenumber") == 1, "full").otherwise("partial").alias("parse"))
    return sv.recompute_ledger(ledger, touches)


@job(", t AS (SELECT src AS service, item AS ticket, max(CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS c, count(*) AS hits FROM raw_edges GROUP BY ALL) SELECT service, CAST(row_number() OVER (PARTITION BY service ORDER BY c DESC, hits DESC, ticket DESC) AS INTEGER) AS rank, ticket, CASE c WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, hits FROM t WHERE c >= 1 QUALIFY rank <= 20", ("raw_edges",))
def service_tickets(edges):
    return sv.service_tickets(edges.select(F.col("src").alias("service"), F.col("item").alias("ticket"), "confidence"), "medium", 20)


@job("SELECT source_id AS id, status AS project, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY updated_at DESC, source_id) AS n FROM entity_target) WHERE n <= 20", ("entity_target",))
def recent_limit(target):
    return sv.recent_limit(target.select(F.col("source_id").alias("id"), F.col("status").alias("project"), "updated_at"), 20)


@job("SELECT src, dst, kind, array_to_string(list_sort(list(DISTINCT via)), ',') AS vias, array_to_string(list_sort(list(DISTINCT evidence))[1:10], ',') AS evidence, CASE max(CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence FROM raw_edges WHERE src != dst AND via != 'via7' GROUP BY ALL", ("raw_edges",))
def hops(edges):
    typed = edges.withColumn("caller_type", F.when(F.col("via") == "via7", "test"))
    return sv.hops(typed).select("src", "dst", "kind", F.array_join("vias", ",").alias("vias"), F.array_join("evidence", ",").alias("evidence"), "confidence")


@job("SELECT repo_name AS source_id, 'HAS_CHUNK' AS rel_type, CAST(chunk_id AS VARCHAR) AS target_id FROM chunks UNION ALL SELECT CAST(chunk_id AS VARCHAR), 'DUPLICATE_OF', CAST(least AS VARCHAR) FROM (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY display_text) AS least FROM chunks) WHERE chunk_id != least", ("chunks",))
def chunk_edges(chunks):
    duplicates = rt.exact_duplicates(chunks.withColumn("text_hash", tx.text_hash(F.col("display_text"))))
    return sv.chunk_edges(chunks.withColumn("parent_id", F.col("repo_name")), duplicates)
