"""Registered queries of readers and writers: given tables written to files and read again."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from ..functions import text as tx
from ..operators import registry as rg
from ..sources import records as rc
from ..sources.stages import new_folder
from .bindings import VIEWS, view
from .queries import job

_S = lambda e: f"CAST({e} AS VARCHAR(20))"


@job("SELECT event_id AS id, user_id AS who, value, 'good' AS state FROM events WHERE event_id % 11 != 4 UNION ALL SELECT count(*), 0, 0.0, 'bad' FROM events WHERE event_id % 11 = 4")
def read_records(spark, folder):
    """Events as lines of JSON, one in eleven cut short."""
    at, events = new_folder(spark), rc.table(spark, folder, "events")
    line = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("who"), "value"))
    events.select(F.when(F.col("event_id") % 11 == 4, F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line).alias("value")).write.text(at)
    good, bad = rc.read_records(spark, at, StructType().add("id", LongType()).add("who", LongType()).add("value", DoubleType()))
    none = F.lit(0).cast("long")
    return good.select("id", "who", "value", F.lit("good").alias("state")).unionByName(bad.agg(F.count("*").alias("id"), none.alias("who"), F.lit(0.0).alias("value"), F.lit("bad").alias("state")))


@job("SELECT DISTINCT concat('repo', CAST(s_nationkey AS VARCHAR(20))) AS repo, s_name AS name, s_suppkey AS size FROM supplier WHERE s_nationkey % 6 != 2 UNION ALL SELECT 'failed', NULL, count(DISTINCT s_nationkey) FROM supplier WHERE s_nationkey % 6 = 2")
def read_inventories(spark, folder):
    """A document of each repository's items; some have no list, some are no JSON."""
    at, suppliers = new_folder(spark), rc.table(spark, folder, "supplier")
    item = F.struct(F.col("s_name").alias("name"), F.col("s_suppkey").cast("long").alias("size"))
    documents = suppliers.groupBy("s_nationkey").agg(F.collect_list(item).alias("items")).withColumn("repo", F.concat(F.lit("repo"), F.col("s_nationkey").cast("string")))
    whole = F.to_json(F.struct("repo", F.lit("s").alias("sid"), "items"))
    text = F.when(F.col("s_nationkey") % 12 == 2, F.to_json(F.struct("repo"))).when(F.col("s_nationkey") % 6 == 2, F.lit("{oops")).otherwise(whole)
    # a file for each document
    documents.select("s_nationkey", text.alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(at)
    items, failed = rc.read_inventories(spark, at, StructType().add("name", StringType()).add("size", LongType()))
    return items.select("repo", "name", "size").unionByName(failed.agg(F.count("*").alias("size")).select(F.lit("failed").alias("repo"), F.lit(None).cast("string").alias("name"), "size"))


@job("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS effort, CAST(o_orderdate AS DATE) AS due FROM orders WHERE o_orderkey % 9 NOT IN (1, 2) UNION ALL SELECT -1, CAST(count(*) AS DOUBLE), NULL FROM orders WHERE o_orderkey % 9 IN (1, 2)")
def read_tracker(spark, folder):
    """Orders as a table of text with empty, missing and unreadable cells."""
    at, orders = new_folder(spark), rc.table(spark, folder, "orders")
    number = F.when(F.col("o_orderkey") % 9 == 1, F.lit("n/a")).when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_custkey").cast("string"))
    orders.select(F.when(F.col("o_orderkey") % 9 != 2, F.col("o_orderkey")).alias("id"), number.alias("effort"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("due")).write.option("header", True).csv(at)
    rows, skipped = rc.read_tracker(spark, at, {"id": "long", "effort": "double", "due": "date"})
    return rows.unionByName(skipped.agg(F.count("*").cast("double").alias("effort")).select(F.lit(-1).cast("long").alias("id"), "effort", F.lit(None).cast("date").alias("due")))


@job("SELECT event_id AS id, event_type AS project FROM events WHERE ts >= (SELECT date_trunc('month', max(ts)) - INTERVAL 0 MONTH FROM events) AND event_type = 'click'")
def read_audit(spark, folder):
    """Audit rows of the last month, appended twice in halves."""
    at, events = new_folder(spark), rc.table(spark, folder, "events")
    rows = events.select(F.col("event_id").alias("id"), F.col("event_type").alias("project"), F.col("ts").alias("timestamp"))
    for half in (0, 1):
        rc.append_audit(rows.where(F.col("id") % 2 == half), at)
    last = rows.agg(F.date_format(F.max("timestamp"), "yyyy-MM-dd")).first()[0]
    return rc.read_audit(spark, at, last, 0, "click").select("id", "project")


@job("""SELECT coalesce(t.source_id, b.source_id) AS source_id, CASE WHEN b.source_id IS NULL OR t.text_hash = b.text_hash THEN t.status ELSE b.status END AS status, coalesce(t.created_at, b.created_at) AS created_at FROM entity_target t FULL JOIN entity_batch b ON t.source_id = b.source_id""", ("entity_target", "entity_batch"))
def upsert_entities(target, batch):
    """Two versions of a table, the second tried twice."""
    at = new_folder(target.sparkSession)
    for version, rows in ((1, target), (2, batch), (2, batch.withColumn("status", F.lit("late")))):
        rc.upsert_entities(rows, at, version)
    return rc.read_latest(target.sparkSession, at).select("source_id", "status", "created_at")


@job("SELECT s_name AS dealer, branch, state, region FROM supplier JOIN (SELECT s_suppkey AS k, concat('b', CAST(s_suppkey AS VARCHAR(20))) AS branch, n_name AS state, r_name AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey != 3) ON k = s_suppkey WHERE s_suppkey % 4 > 0 UNION ALL SELECT s_name, concat('c', CAST(s_suppkey AS VARCHAR(20))), 'NOWHERE', NULL FROM supplier WHERE s_suppkey % 4 > 0 UNION ALL SELECT s_name, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 4 = 0")
def flatten_dealers(spark, folder):
    """Suppliers as dealers with nested branches, some without any."""
    supplier, nation, region = (rc.table(spark, folder, t) for t in ("supplier", "nation", "region"))
    branch = lambda sign, state: F.struct(F.concat(F.lit(sign), F.col("s_suppkey").cast("string")).alias("code"), state.alias("state"))
    dealers = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(F.col("s_name").alias("dealer"), F.when(F.col("s_suppkey") % 4 > 0, F.array(branch("b", F.col("n_name")), branch("c", F.lit("NOWHERE")))).alias("branches"))
    states = nation.join(region.where("r_regionkey != 3"), nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("state"), F.col("r_name").alias("region"))
    return rc.flatten_dealers(dealers, states)


VIEWS["bulk"] = f"SELECT p_partkey AS row, concat('c', {_S('p_partkey')}) AS code, CASE WHEN p_partkey % 10 = 1 THEN '  ' WHEN p_partkey % 10 = 2 THEN NULL ELSE p_name END AS name, concat('n', {_S('p_partkey % 40')}) AS parent_code FROM part"
VIEWS["bulk_parents"] = f"SELECT concat('n', {_S('n_nationkey')}) AS code FROM nation"
VIEWS["bulk_known"] = f"SELECT concat('c', {_S('s_suppkey * 3')}) AS code FROM supplier"


@job("SELECT code, CASE WHEN trim(coalesce(name, '')) = '' THEN 'missing name' WHEN parent_code NOT IN (SELECT code FROM bulk_parents) THEN 'unknown parent' ELSE 'load' END AS outcome FROM bulk WHERE code NOT IN (SELECT code FROM bulk_known)", ("bulk", "bulk_parents", "bulk_known"))
def load_bulk(rows, parents, known):
    load, errors = rc.load_bulk(rows, parents, known)
    return load.select("code", F.lit("load").alias("outcome")).unionByName(errors.select("code", F.col("reason").alias("outcome")))


@job("SELECT doc_type, count(*) AS n, count(DISTINCT chunk_id) AS ids FROM (SELECT coalesce(lang, 'none') AS doc_type, doc_id AS chunk_id FROM documents) GROUP BY doc_type")
def write_chunks(spark, folder):
    """Chunks written by type in two appends, counted from the files."""
    at, chunks = new_folder(spark), view(spark, folder, "chunks").withColumn("doc_type", F.coalesce("doc_type", F.lit("none")))
    for half in (0, 1):
        rc.write_chunks(chunks.where(F.col("chunk_id") % 2 == half), at)
    return spark.read.option("inferSchema", False).parquet(at).groupBy(F.col("doc_type").cast("string").alias("doc_type")).agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids"))


@job("SELECT n_nationkey AS id, n_name AS name FROM nation")
def write_registry(spark, folder):
    """A registry of two outputs, written sorted and read again."""
    at, nation = new_folder(spark), rc.table(spark, folder, "nation")
    rows = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    rc.write_registry({"nations": (rows, ["id"]), "names": (rows.select("name"), ["name"])}, at)
    return spark.read.schema("id long, name string").json(f"{at}/nations")


@job("SELECT id, name, rag_status FROM projects WHERE vendor IS NOT NULL", ("projects",))
def export_report(projects):
    """A report as text with a header, read again."""
    at = new_folder(projects.sparkSession)
    rc.export_report(projects.where("vendor is not null").select("id", "name", "rag_status"), at)
    return projects.sparkSession.read.option("header", True).schema("id long, name string, rag_status string").csv(at)


_W = "concat('k', repeat(chr(97 + CAST(s_suppkey % 26 AS INT)), 3))"
_CAP = f"concat('K', repeat(chr(97 + CAST(s_suppkey % 26 AS INT)), 3))"
VIEWS["alias_services"] = f"SELECT concat('s', {_S('s_suppkey')}) AS sid, {_W} AS w, CASE WHEN s_suppkey % 2 = 0 THEN concat({_W}, '-crud-services') ELSE concat({_CAP}, 'Service') END AS name, concat(' ', upper({_W}), ' Portal') AS title, concat('@org/', {_W}, '-api') AS package, concat('/api/v2/', {_W}, '/{{id}}') AS path, concat({_W}, '-svc.example.org') AS host, concat({_CAP}, 'ServiceClient') AS client FROM supplier".replace("{{", "{").replace("}}", "}")


@job(
    """, names AS (SELECT sid, w, unnest(CASE WHEN contains(name, 'crud') THEN [w || ' crud services', w || ' crud service', w, w || ' services', w || ' service'] ELSE [w || ' service', w] END) AS alias, name FROM alias_services)
    SELECT alias, sid, CASE WHEN alias = w || ' crud services' OR (alias = w || ' service' AND NOT contains(name, 'crud')) THEN 'high' ELSE 'low' END AS confidence, 'name' AS source FROM names UNION ALL SELECT w || ' portal', sid, 'high', 'title' FROM alias_services
    UNION ALL SELECT w || ' api', sid, 'medium', 'package' FROM alias_services UNION ALL SELECT w, sid, 'low', 'package' FROM alias_services UNION ALL SELECT w, sid, 'medium', 'route' FROM alias_services UNION ALL SELECT w || ' svc', sid, 'medium', 'host' FROM alias_services
    UNION ALL SELECT w, sid, 'low', 'host' FROM alias_services UNION ALL SELECT unnest([w || ' service client', w || ' service', w]), sid, 'low', 'client' FROM alias_services""",
    ("alias_services",),
)
def alias_candidates(services):
    one = lambda column, name: services.select("sid", F.col(column).alias(name))
    return rg.alias_candidates(services, one("package", "name"), one("path", "path"), one("host", "host"), one("client", "client"))


VIEWS["pairs"] = "SELECT event_id AS id, concat('n', CAST(user_id AS VARCHAR(20))) AS a, CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('n', CAST(event_id % 90 AS VARCHAR(20))) END AS b FROM events"


@job("SELECT id, sha1(concat(a, '|', coalesce(b, ''), '|', CAST(id % 3 AS VARCHAR))) AS edge_id FROM pairs", ("pairs",))
def stable_ids(pairs):
    return pairs.select("id", tx.stable_id(F.col("a"), F.col("b"), F.col("id") % 3).alias("edge_id"))
