"""Registered queries of feeds: a stored graph merged in two batches, full re-reads, kept answers, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import service_views as sv
from ..sources.stages import new_folder
from ..streaming import events as ev
from ..streaming import sync
from .bindings import VIEWS
from .queries import job

_AT = "concat('u', lpad(CAST(event_id AS VARCHAR(20)), 12, '0'))"
_N = lambda e: f"CAST({e} AS VARCHAR(20))"
VIEWS["feed"] = f"""SELECT event_id AS seq, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'github' WHEN 1 THEN 'jira' ELSE 'confluence' END AS system,
 CASE WHEN event_id % 3 = 0 THEN CASE event_type WHEN 'view' THEN 'pull_request_review' WHEN 'error' THEN 'push' WHEN 'purchase' THEN 'fork' ELSE 'pull_request' END ELSE NULL END AS event,
 CASE WHEN event_id % 17 = 5 THEN '{{"pull_request": {{"number"' WHEN event_id % 23 = 7 THEN '[1, 2]'
 WHEN event_id % 19 = 3 THEN '{{"event": "page_created", "webhookEvent": "jira:issue_created", "repository": {{"id": 1}}}}'
 WHEN event_id % 3 = 0 THEN concat('{{"repository": {{"id": ', {_N("user_id % 7")}, '}}, "pull_request": {{"number": ', {_N("user_id % 40")}, ', "title": "change ', {_N("event_id % 5")}, '", "state": "', CASE WHEN event_id % 2 = 0 THEN 'open' ELSE 'closed' END, '", "merged_at": ', CASE WHEN event_id % 4 = 1 THEN '"then"' ELSE 'null' END, ', "updated_at": "', {_AT}, '", "user": {{"login": "Dev', {_N("user_id % 11")}, '"}}}}}}')
 WHEN event_id % 3 = 1 THEN concat('{{"webhookEvent": "', CASE event_type WHEN 'error' THEN 'jira:worklog_updated' WHEN 'view' THEN 'jira:issue_created' ELSE 'jira:issue_updated' END, '", "issue": {{"key": "T-', {_N("user_id % 60")}, '", "fields": {{"summary": "ticket ', {_N("event_id % 6")}, '", "updated": "', {_AT}, '", "status": {{"name": "', event_type, '"}}, "issuetype": {{"name": "', CASE WHEN user_id % 10 = 0 THEN 'Epic' ELSE 'Story' END, '"}}, "parent": ', CASE WHEN user_id % 10 = 0 THEN 'null' ELSE concat('{{"key": "T-', {_N("event_id % 70 - event_id % 10")}, '"}}') END, ', "assignee": {{"accountId": "a', {_N("user_id % 9")}, '", "displayName": "Person ', {_N("user_id % 9")}, '"}}}}}}}}')
 ELSE concat('{{"', CASE WHEN event_id % 2 = 0 THEN 'event' ELSE 'webhookEvent' END, '": "', CASE event_type WHEN 'error' THEN 'page_removed' WHEN 'view' THEN 'page_created' ELSE 'page_updated' END, '", "page": {{"id": "', {_N("user_id % 30")}, '", "title": "page ', {_N("event_id % 4")}, '", "version": {{"when": "', {_AT}, '"}}}}}}') END AS payload FROM events"""
VIEWS["known_repos"] = "SELECT concat('repo:', CAST(r_regionkey AS VARCHAR(20))) AS source_id, r_name AS name FROM region"
VIEWS["wiki"] = "SELECT DISTINCT concat('page:', CAST(user_id % 37 AS VARCHAR(20))) AS source_id, concat('read ', CAST(user_id % 37 AS VARCHAR(20))) AS name FROM events WHERE user_id % 37 % 3 > 0"

_PARSED = """parsed AS (SELECT *, coalesce(event, CASE WHEN system = 'confluence' THEN coalesce(j->>'$.event', j->>'$.webhookEvent') ELSE j->>'$.webhookEvent' END) AS ev,
  CASE WHEN seq * 2 < (SELECT max(seq) FROM feed) THEN 1 ELSE 2 END AS batch FROM (SELECT *, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'OBJECT' THEN payload END END AS j FROM feed)),
 pulls AS (SELECT batch, j->>'$.repository.id' AS repo, j->>'$.pull_request.number' AS number, j->>'$.pull_request.title' AS name, CASE WHEN j->>'$.pull_request.merged_at' IS NOT NULL THEN 'merged' ELSE j->>'$.pull_request.state' END AS status, j->>'$.pull_request.updated_at' AS upd, lower(j->>'$.pull_request.user.login') AS login, j->>'$.pull_request.user.login' AS shown FROM parsed WHERE system = 'github' AND ev IN ('pull_request', 'pull_request_review') AND j->>'$.repository.id' IS NOT NULL AND j->>'$.pull_request.number' IS NOT NULL),
 issues AS (SELECT batch, j->>'$.issue.key' AS key, j->>'$.issue.fields.summary' AS name, j->>'$.issue.fields.status.name' AS status, j->>'$.issue.fields.updated' AS upd, j->>'$.issue.fields.issuetype.name' AS kind, j->>'$.issue.fields.parent.key' AS parent, j->>'$.issue.fields.assignee.accountId' AS who, j->>'$.issue.fields.assignee.displayName' AS shown FROM parsed WHERE system = 'jira' AND ev IN ('jira:issue_created', 'jira:issue_updated') AND j->>'$.issue.key' IS NOT NULL),
 wikis AS (SELECT batch, j->>'$.page.id' AS id, j->>'$.page.title' AS name, j->>'$.page.version.when' AS upd FROM parsed WHERE system = 'confluence' AND ev IN ('page_created', 'page_updated') AND j->>'$.page.id' IS NOT NULL),
 nodes AS (SELECT 0 AS batch, 'Repository' AS label, source_id, name, NULL AS status, NULL AS upd FROM known_repos
  UNION ALL SELECT batch, 'PullRequest', concat('pr:', repo, '#', number), name, status, upd FROM pulls UNION ALL SELECT batch, 'Person', concat('person:', login), shown, NULL, NULL FROM pulls
  UNION ALL SELECT batch, CASE WHEN lower(kind) = 'epic' THEN 'Epic' ELSE 'Ticket' END, concat('ticket:', key), name, status, upd FROM issues UNION ALL SELECT batch, 'Person', concat('person:', who), shown, NULL, NULL FROM issues
  UNION ALL SELECT batch, 'Page', concat('page:', id), name, NULL, upd FROM wikis)"""
_VIEWS = ("feed", "known_repos")


def _feed_sql(rest: str, *more: str) -> str:
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in (*_VIEWS, *more)) + ", " + _PARSED + rest


def _ingested(feed: DataFrame, repos: DataFrame) -> sync.Graph:
    """Known repositories, then the feed in two batches, the first one a second time too."""
    graph = sync.Graph(feed.sparkSession, new_folder(feed.sparkSession))
    graph.merge(sync.hashed(repos.select(F.lit("Repository").alias("label"), "source_id", "name")), None, "repositories")
    half = feed.crossJoin(F.broadcast(feed.agg(F.max("seq").alias("_last"))))
    first, second = half.where("seq * 2 < _last"), half.where("not seq * 2 < _last")
    for token, batch in (("feed-0", first), ("feed-0", first), ("feed-1", second)):
        sync.ingest_batch(graph, batch.drop("_last"), token)
    return graph


@job(
    _feed_sql(""" SELECT system, outcome, count(*) AS n FROM (SELECT system, CASE WHEN j IS NULL THEN 'dead_letter' WHEN system = 'github' AND ev IN ('push', 'ping') THEN 'seen'
  WHEN NOT coalesce(ev IN ('pull_request', 'pull_request_review', 'jira:issue_created', 'jira:issue_updated', 'page_created', 'page_updated'), false) THEN 'ignored'
  WHEN (system = 'github' AND j->>'$.repository.id' IS NOT NULL AND j->>'$.pull_request.number' IS NOT NULL) OR (system = 'jira' AND j->>'$.issue.key' IS NOT NULL) OR (system = 'confluence' AND j->>'$.page.id' IS NOT NULL) THEN 'merged' ELSE 'warning' END AS outcome FROM parsed) GROUP BY ALL"""),
    ("feed",),
)
def feed_outcomes(feed):
    return sync.parse_feed(feed).groupBy("system", "outcome").agg(F.count("*").alias("n"))


@job(
    _feed_sql(""", rows AS (SELECT *, row_number() OVER (PARTITION BY source_id, batch ORDER BY upd DESC NULLS LAST) AS r FROM nodes), last AS (SELECT * FROM rows WHERE r = 1),
 stored AS (SELECT *, first_value(upd) OVER (PARTITION BY source_id ORDER BY batch) AS created_at, row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN label = 'Person' THEN batch ELSE -batch END) AS keep FROM last)
 SELECT label, source_id, name, status, created_at, upd AS updated_at FROM stored WHERE keep = 1"""),
    _VIEWS,
)
def ingest_events(feed, repos):
    return _ingested(feed, repos).entities().select("label", "source_id", "name", "status", "created_at", "updated_at")


@job(
    _feed_sql(""", edges AS (SELECT DISTINCT * FROM (SELECT batch, concat('pr:', repo, '#', number) AS source_id, 'MODIFIES' AS rel_type, concat('repo:', repo) AS target_id FROM pulls UNION ALL SELECT batch, concat('pr:', repo, '#', number), 'AUTHORED_BY', concat('person:', login) FROM pulls
  UNION ALL SELECT batch, concat('ticket:', key), 'ASSIGNED_TO', concat('person:', who) FROM issues UNION ALL SELECT batch, concat('ticket:', key), 'PART_OF', concat('ticket:', parent) FROM issues WHERE parent IS NOT NULL)),
 known AS (SELECT source_id AS target_id, min(batch) AS since FROM nodes GROUP BY source_id)
 SELECT DISTINCT source_id, rel_type, target_id, CASE WHEN since <= batch THEN 'stored' ELSE 'rejected' END AS state FROM (SELECT e.*, coalesce(k.since, 99) AS since FROM edges e LEFT JOIN known k USING (target_id))"""),
    _VIEWS,
)
def ingest_edges(feed, repos):
    graph = _ingested(feed, repos)
    return graph.edges().withColumn("state", F.lit("stored")).unionByName(graph.rejects().withColumn("state", F.lit("rejected")))


@job(
    _feed_sql(""", had AS (SELECT DISTINCT source_id FROM nodes WHERE label = 'Page')
 SELECT 'wiki-1' AS token, (SELECT count(*) FROM wiki WHERE source_id NOT IN (SELECT source_id FROM had)) AS created, (SELECT count(*) FROM wiki WHERE source_id IN (SELECT source_id FROM had)) AS updated, 0::BIGINT AS skipped, (SELECT count(*) FROM had WHERE source_id NOT IN (SELECT source_id FROM wiki)) AS deleted, true AS new_tables
 UNION ALL SELECT 'wiki-2', 0, 0, (SELECT count(*) FROM wiki), 0, false""", "wiki"),
    (*_VIEWS, "wiki"),
)
def full_sync(feed, repos, wiki):
    """Two full re-reads of the wiki after the feed: the second changes nothing."""
    graph = _ingested(feed, repos)
    pages = wiki.select(F.lit("Page").alias("label"), "source_id", "name")
    for token in ("wiki-1", "wiki-2", "wiki-2"):
        sync.full_sync(graph, pages, None, ["Page"], token, F.lit("2024-02-01"))
    return graph.log().where("token like 'wiki%'").select("token", "created", "updated", "skipped", "deleted", (F.col("tables") == F.col("n")).alias("new_tables"))


VIEWS["asked"] = """SELECT event_id AS query_id, ts, concat(event_type, ' ', CAST(CAST(floor(value / 20) AS INT) AS VARCHAR(20))) AS query,
 CASE CAST(event_id % 5 AS INT) WHEN 0 THEN '{"lang": "en", "top": {"k": 3, "by": "x"}}' WHEN 1 THEN '{ "top":{"by":"x","k":3}, "lang":"en" }' WHEN 2 THEN '{}' WHEN 3 THEN NULL ELSE concat('{"lang": "', event_type, '"}') END AS filters FROM events"""


@job(
    f"""WITH RECURSIVE asked AS ({VIEWS["asked"]}), keyed AS (SELECT query_id, ts, concat(query, '|', coalesce(filters->>'$.lang', ''), '|', coalesce(filters->>'$.top.k', '')) AS k FROM asked),
 misses AS (SELECT k, min(ts) AS at_time FROM keyed GROUP BY k UNION ALL SELECT k, at_time FROM (SELECT m.k, min(q.ts) AS at_time FROM misses m JOIN keyed q ON q.k = m.k AND q.ts >= m.at_time + INTERVAL 12 HOUR GROUP BY m.k))
 SELECT query_id, NOT (m.k IS NOT NULL AND row_number() OVER (PARTITION BY q.k, ts ORDER BY query_id) = 1) AS hit FROM keyed q LEFT JOIN misses m ON m.k = q.k AND m.at_time = q.ts""",
    ("asked",),
)
def cache_hits(asked):
    return ev.cache_hits(asked.withColumn("query_key", ev.query_key(F.col("query"), F.col("filters"))), 12 * 3600).select("query_id", "hit")


_GONE = lambda n: f"CASE WHEN {n} % 7 = 3 THEN 'then' ELSE NULL END AS deleted_at"
_ID = lambda kind, n: f"concat('{kind}:', {_N(n)})"
VIEWS["graph_entities"] = f"""SELECT {_ID("service", "s_suppkey")} AS source_id, 'Service' AS label, s_name AS name, {_GONE("s_suppkey")} FROM supplier UNION ALL SELECT {_ID("team", "n_nationkey")}, 'Team', n_name, {_GONE("n_nationkey")} FROM nation
 UNION ALL SELECT {_ID("ticket", "o_orderkey")}, CASE WHEN o_orderkey % 5 = 0 THEN 'Epic' ELSE 'Ticket' END, o_orderpriority, {_GONE("o_orderkey")} FROM orders UNION ALL SELECT {_ID("page", "doc_id")}, CASE WHEN doc_id % 2 = 0 THEN 'Page' ELSE 'Other' END, source, {_GONE("doc_id")} FROM documents
 UNION ALL SELECT DISTINCT concat('topic:', event_type), 'Topic', event_type, NULL FROM events"""
VIEWS["graph_edges"] = f"""SELECT {_ID("service", "s_suppkey")} AS source_id, 'OWNED_BY' AS rel_type, {_ID("team", "s_nationkey")} AS target_id FROM supplier UNION ALL SELECT {_ID("service", "s_suppkey")}, 'OWNED_BY', {_ID("service", "s_suppkey + 1")} FROM supplier UNION ALL SELECT {_ID("ticket", "l_orderkey")}, 'LINKED_TO', {_ID("service", "l_suppkey")} FROM lineitem
 UNION ALL SELECT {_ID("service", "l_suppkey")}, 'DEPENDS_ON', {_ID("service", "l_partkey % 50")} FROM lineitem UNION ALL SELECT {_ID("service", "doc_id % 60")}, 'DOCUMENTED_IN', {_ID("page", "doc_id")} FROM documents
 UNION ALL SELECT {_ID("service", "user_id % 40")}, CASE WHEN event_id % 3 = 0 THEN 'PUBLISHES' WHEN event_id % 3 = 1 THEN 'SUBSCRIBES' ELSE 'MENTIONS' END, concat('topic:', event_type) FROM events"""
_PART = lambda name, rel, out, labels: f"(SELECT {'source_id' if out else 'target_id'} AS service, array_to_string(list_sort(list(DISTINCT {'target_id' if out else 'source_id'}))[1:20], ',') AS {name}, count(DISTINCT {'target_id' if out else 'source_id'}) AS n_{name} FROM graph_edges JOIN live o ON o.id = {'target_id' if out else 'source_id'} WHERE rel_type = '{rel}' AND o.label IN ({', '.join(repr(x) for x in labels)}) GROUP BY 1)"


@job(
    f", live AS (SELECT source_id AS id, label, name FROM graph_entities WHERE deleted_at IS NULL) SELECT id AS service, name, "
    + ", ".join(f"coalesce({name}, '') AS {name}, coalesce(n_{name}, 0) AS n_{name}" for name, *_ in sv.PROFILE)
    + " FROM live s " + " ".join(f"LEFT JOIN {_PART(*p)} {p[0]}_part ON {p[0]}_part.service = s.id" for p in sv.PROFILE) + " WHERE s.label = 'Service'",
    ("graph_entities", "graph_edges"),
)
def service_profile(entities, edges):
    rows = sv.service_profile(entities, edges, 20)
    return rows.withColumns({name: F.array_join(name, ",") for name, *_ in sv.PROFILE})
