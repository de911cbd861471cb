"""Event feeds to a stored graph: parse, extract, merge once for each batch, and full re-reads.

A graph lies in a folder: ``entities/<n>`` and ``edges/<n>`` are whole tables, ``rejects/<n>``
the edges that a merge turned away, and ``log/<n>`` has one row for each merge: its token, the
tables that hold from then on, and what it changed.  A merge counts when its log row is there;
until then readers see the tables before it, and a merge that failed half way is done again.
A token that is in the log isn't merged again, so a batch that is tried twice counts once.
Every merge that changes something writes the tables anew: fit for batches of minutes or
hours, not for single events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import upsert_edges_checked
from ..operators.ingest import extract_issue, extract_page, extract_pr
from ..sources.stages import discard, exists, new_folder

#: what is done with the events of each system (fixed values)
EVENTS = {
    "github": {"pull_request": "pull", "pull_request_review": "pull", "push": "seen", "ping": "seen"},
    "jira": {"jira:issue_created": "issue", "jira:issue_updated": "issue"},
    "confluence": {"page_created": "page", "page_updated": "page"},
}
PAYLOAD = """event STRING, webhookEvent STRING,
 pull_request STRUCT<number: BIGINT, title: STRING, state: STRING, merged_at: STRING, updated_at: STRING, user: STRUCT<login: STRING, name: STRING>>, repository STRUCT<id: STRING>,
 issue STRUCT<key: STRING, fields: STRUCT<summary: STRING, updated: STRING, status: STRUCT<name: STRING>, issuetype: STRUCT<name: STRING>, parent: STRUCT<key: STRING>, assignee: STRUCT<accountId: STRING, displayName: STRING>>>,
 page STRUCT<id: STRING, title: STRING, version: STRUCT<when: STRING>>"""
ENTITY = "label STRING, source_id STRING, name STRING, status STRING, description STRING, text_hash STRING, created_at STRING, updated_at STRING, deleted_at STRING, change STRING"
LOG = "n INT, token STRING, tables INT, created LONG, updated LONG, skipped LONG, deleted LONG, edges_created LONG, edges_skipped LONG, edges_rejected LONG"
EDGE = "source_id STRING, rel_type STRING, target_id STRING"


def parse_feed(feed: DataFrame) -> DataFrame:
    """``feed`` (system, event, payload) with the parsed ``object``, ``kind`` and ``outcome``:
    dead_letter (the payload is no JSON object), ignored (an event that isn't known), seen
    (known, with nothing to store), warning (the resource or its id is missing) or merged.
    A tracker or wiki names its event in the payload if the feed doesn't."""
    rows = feed.withColumn("object", F.from_json("payload", PAYLOAD))
    event = F.coalesce("event", F.when(F.col("system") == "confluence", F.coalesce("object.event", "object.webhookEvent")).otherwise(F.col("object.webhookEvent")), F.lit(""))
    kind = F.lit(None).cast("string")
    for system, known in EVENTS.items():
        for name, what in known.items():
            kind = F.when((F.col("system") == system) & (F.trim(event) == name), what).otherwise(kind)
    resource = F.when(F.col("kind") == "pull", F.when(F.col("object.repository.id").isNotNull(), F.col("object.pull_request.number").cast("string"))).when(F.col("kind") == "issue", F.col("object.issue.key")).when(F.col("kind") == "page", F.col("object.page.id"))
    valid = F.from_json("payload", "map<string,string>").isNotNull()
    outcome = F.when(~valid, "dead_letter").when(F.col("kind").isNull(), "ignored").when(F.col("kind") == "seen", "seen").when(resource.isNull(), "warning").otherwise("merged")
    return rows.withColumn("kind", kind).withColumn("outcome", outcome)


def hashed(entities: DataFrame) -> DataFrame:
    """Entities in the stored shape but for what a merge sets.  A person's hash is of the id
    alone: a person that is there already isn't changed by being mentioned."""
    for name in ("status", "description", "updated_at"):
        if name not in entities.columns:
            entities = entities.withColumn(name, F.lit(None).cast("string"))
    every = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in ("name", "status", "description", "updated_at")]))
    text_hash = F.sha2(F.when(F.col("label") == "Person", F.col("source_id")).otherwise(every), 256)
    return entities.select("label", "source_id", "name", "status", "description", text_hash.alias("text_hash"), F.col("updated_at").cast("string").alias("updated_at"))


def extract_feed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of the rows of ``parse_feed`` that are to be merged."""
    merged = parsed.where("outcome = 'merged'")
    pulls = merged.where("kind = 'pull'").select(F.col("object.repository.id").alias("repo"), "object.pull_request.*")
    issues = merged.where("kind = 'issue'").select("object.issue.*").select("key", F.col("fields.issuetype.name").alias("kind"), F.col("fields.summary").alias("summary"), F.col("fields.status.name").alias("status"), F.col("fields.parent.key").alias("parent"), F.col("fields.assignee").alias("assignee"), F.col("fields.updated").alias("updated"))
    pages = merged.where("kind = 'page'").select("object.page.*").select("id", "title", F.lit(None).cast("string").alias("html"), F.col("version.when").alias("updated_at"))
    (pull_nodes, pull_edges), (issue_nodes, issue_edges) = extract_pr(pulls, once=False), extract_issue(issues, once=False)
    nodes = hashed(pull_nodes).unionByName(hashed(issue_nodes)).unionByName(hashed(extract_page(pages)))
    return nodes, pull_edges.unionByName(issue_edges).distinct()


def merge_entities(target: DataFrame, batch: DataFrame, now: Column, gone: Column | None = None) -> DataFrame:
    """The stored entities after a batch, and in ``change`` what it did to each: CREATED,
    UPDATED (another hash, or live again), SKIPPED (the same), DELETED, or null.

    Of several rows of a source_id the last by updated_at, then hash, counts.  created_at
    is the first row's updated_at.  ``gone``: a condition on stored entities; those that
    meet it, are live and not in the batch are marked deleted at ``now``."""
    # summed up before the shuffle: a batch may tell of an entity any number of times
    order = ["updated_at", "text_hash", "name"]
    last = F.max(F.struct(*order, *[c for c in batch.columns if c not in (*order, "source_id")])).alias("_last")
    new = batch.where("source_id is not null").groupBy("source_id").agg(last).select("source_id", "_last.*")
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    rows = target.drop("change").withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), "source_id", "full_outer")
    same = n("_new").isNull() | (o("_old") & o("text_hash").eqNullSafe(n("text_hash")) & o("deleted_at").isNull())
    leaves = F.lit(False) if gone is None else o("_old") & n("_new").isNull() & o("deleted_at").isNull() & gone
    change = F.when(o("_old").isNull(), "CREATED").when(leaves, "DELETED").when(n("_new").isNull(), None).when(same, "SKIPPED").otherwise("UPDATED")
    keep = lambda c: F.when(same, o(c)).otherwise(n(c)).alias(c)
    created = F.when(o("_old"), o("created_at")).otherwise(n("updated_at"))
    deleted = F.when(leaves, now.cast("string")).when(n("_new").isNull(), o("deleted_at"))
    return rows.select(keep("label"), "source_id", *[keep(c) for c in ("name", "status", "description", "text_hash")], created.alias("created_at"), keep("updated_at"), deleted.alias("deleted_at"), change.alias("change"))


class Graph:
    """A stored graph in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        """A row for each merge, oldest first."""
        if not exists(self.spark, f"{self.path}/log"):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json(f"{self.path}/log/*").orderBy("n")

    def _last(self, token: str | None = None):
        """The last merge's number, the tables that hold, and how often the token is there."""
        return self.log().agg(F.max("n").alias("n"), F.max_by("tables", "n").alias("tables"), F.count_if(F.col("token") == token).alias("seen")).first()

    def _table(self, name: str, schema: str, tables: int | None) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{tables}") if tables is not None else self.spark.createDataFrame([], schema)

    def merged(self, token: str) -> bool:
        return self._last(token).seen > 0

    def entities(self) -> DataFrame:
        """All entities, deleted ones too; ``change``: what the last merge that changed any did."""
        return self._table("entities", ENTITY, self._last().tables)

    def edges(self) -> DataFrame:
        return self._table("edges", EDGE, self._last().tables)

    def rejects(self) -> DataFrame:
        """Edges that some merge turned away because an end isn't there."""
        if not exists(self.spark, f"{self.path}/rejects"):
            return self.spark.createDataFrame([], EDGE)
        return self.spark.read.schema(EDGE).parquet(f"{self.path}/rejects/*").distinct()

    def merge(self, entities: DataFrame, edges: DataFrame | None, token: str, now: Column | None = None, gone: Column | None = None) -> bool:
        """Merge a batch under a token; False if that token was merged before.  An edge needs
        both ends among the entities after the batch, deleted ones included."""
        last = self._last(token)
        if last.seen:
            return False
        n = (last.n or 0) + 1
        nodes_at, edges_at = f"{self.path}/entities/{n}", f"{self.path}/edges/{n}"
        merge_entities(self._table("entities", ENTITY, last.tables), entities, F.current_timestamp() if now is None else now, gone).write.mode("overwrite").parquet(nodes_at)
        nodes = self.spark.read.schema(ENTITY).parquet(nodes_at)
        counts = {r.change: r["count"] for r in nodes.groupBy("change").count().collect()}
        told = {"CREATED": 0, "SKIPPED": 0, "REJECTED": 0}
        old = self._table("edges", EDGE, last.tables)
        if edges is not None:
            decided_at = f"{self.path}/decided/{n}"
            upsert_edges_checked(edges.select("source_id", "rel_type", "target_id").distinct(), nodes, old).write.mode("overwrite").parquet(decided_at)
            decided = self.spark.read.schema(EDGE + ", decision STRING").parquet(decided_at)
            told |= {r.decision: r["count"] for r in decided.groupBy("decision").count().collect()}
            if told["REJECTED"]:
                decided.where("decision = 'REJECTED'").drop("decision").write.mode("overwrite").parquet(f"{self.path}/rejects/{n}")
        changed = told["CREATED"] + sum(counts.get(c, 0) for c in ("CREATED", "UPDATED", "DELETED"))
        if changed or last.tables is None:
            (old if edges is None else old.unionByName(decided.where("decision = 'CREATED'").drop("decision"))).write.mode("overwrite").parquet(edges_at)
        else:
            discard(self.spark, nodes_at)
        if edges is not None:
            discard(self.spark, decided_at)
        row = (n, token, n if changed or last.tables is None else last.tables, *[counts.get(c, 0) for c in ("CREATED", "UPDATED", "SKIPPED", "DELETED")], told["CREATED"], told["SKIPPED"], told["REJECTED"])
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("overwrite").json(f"{self.path}/log/{n}")
        return True


def ingest_batch(graph: Graph, feed: DataFrame, token: str) -> bool:
    """Parse, extract and merge the rows of a feed under a token.  What is parsed is written
    before its entities and edges are taken from it, so no payload is parsed for each of them."""
    if graph.merged(token):
        return False
    spark, path = feed.sparkSession, new_folder(feed.sparkSession)
    parsed = parse_feed(feed).select("kind", "outcome", F.when(F.col("outcome") == "merged", F.col("object")).alias("object"))
    parsed.write.parquet(path)
    done = graph.merge(*extract_feed(spark.read.schema(parsed.schema).parquet(path)), token)
    discard(spark, path)
    return done


def ingest_events(feed: DataFrame, graph: Graph, checkpoint: str, name: str = "feed", available_now: bool = True):
    """Start a query that merges every micro-batch of a streaming feed (system, event,
    payload) into the graph; the token is the stream's name and the batch's number."""
    writer = feed.writeStream.foreachBatch(lambda batch, number: ingest_batch(graph, batch, f"{name}-{number}") and None)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def full_sync(graph: Graph, entities: DataFrame, edges: DataFrame | None, labels: list[str], token: str, now: Column) -> bool:
    """Merge a complete re-read of some labels: what is stored under them and not in the
    re-read is marked deleted.  A second one with the same content changes nothing."""
    return graph.merge(hashed(entities), edges, token, now, F.col("o.label").isin(labels))
