"""Feeds merged into a stored graph: once for each batch, the same as a stream, and full re-reads."""

import json

import pytest
from pyspark.sql import functions as F

from quarryline.streaming import sync

FEED = "system string, event string, payload string"


def pull(number, title, at, login="Ann", repo=1):
    return ("github", "pull_request", json.dumps({"repository": {"id": repo}, "pull_request": {"number": number, "title": title, "state": "open", "updated_at": at, "user": {"login": login}}}))


def issue(key, summary, at, parent=None):
    return ("jira", None, json.dumps({"webhookEvent": "jira:issue_updated", "issue": {"key": key, "fields": {"summary": summary, "updated": at, "status": {"name": "Open"}, "parent": {"key": parent} if parent else None, "assignee": {"accountId": "a1", "displayName": "Bo"}}}}))


ONE = [pull(1, "first", "2024-01-01"), pull(1, "second", "2024-01-02"), issue("T-1", "one", "2024-01-01", "T-2"), ("github", "push", "{}"), ("github", "star", "{}"), ("jira", None, "{"), ("confluence", "page_created", '{"space": 1}')]
TWO = [pull(1, "second", "2024-01-02"), pull(2, "other", "2024-01-03", "Cy", repo=9), issue("T-2", "two", "2024-01-03"), issue("T-1", "one", "2024-01-01", "T-2"), ("confluence", "page_updated", '{"page": {"id": 5, "title": "P", "version": {"when": "2024-01-04"}}}')]


def entities(graph):
    return sorted(map(tuple, graph.entities().drop("change").collect()))


def filled(spark, path):
    graph = sync.Graph(spark, path)
    repos = spark.createDataFrame([("Repository", "repo:1", "r")], "label string, source_id string, name string")
    assert graph.merge(sync.hashed(repos), None, "repos")
    for token, rows in (("feed-0", ONE), ("feed-1", TWO)):
        assert sync.ingest_batch(graph, spark.createDataFrame(rows, FEED), token)
    return graph


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    return filled(spark, str(tmp_path_factory.mktemp("graph")))


def test_outcomes(spark):
    got = [r.outcome for r in sync.parse_feed(spark.createDataFrame(ONE, FEED)).collect()]
    assert got == ["merged", "merged", "merged", "seen", "ignored", "dead_letter", "warning"]
    odd = [("github", "pull_request", None), ("github", "pull_request", "[1]"), ("github", None, "{}"), (None, "push", "{}"), ("jira", "jira:issue_created", '{"issue": "T"}')]
    assert [r.outcome for r in sync.parse_feed(spark.createDataFrame(odd, FEED)).collect()] == ["dead_letter", "dead_letter", "ignored", "ignored", "warning"]


def test_the_last_row_of_a_batch_counts_and_creation_stays(graph):
    rows = {r.source_id: r for r in graph.entities().collect()}
    assert set(rows) == {"repo:1", "pr:1#1", "pr:9#2", "person:ann", "person:cy", "person:a1", "ticket:T-1", "ticket:T-2", "page:5"}
    assert (rows["pr:1#1"].name, rows["pr:1#1"].created_at, rows["pr:1#1"].change) == ("second", "2024-01-02", "SKIPPED")
    assert all(r.deleted_at is None for r in rows.values())


def test_edges_need_both_ends(graph):
    edges, rejects = (set(map(tuple, x.collect())) for x in (graph.edges(), graph.rejects()))
    # the parent came in the second batch, with the edge once more
    assert ("ticket:T-1", "PART_OF", "ticket:T-2") in edges and ("ticket:T-1", "PART_OF", "ticket:T-2") in rejects
    assert ("pr:9#2", "MODIFIES", "repo:9") in rejects and ("pr:9#2", "MODIFIES", "repo:9") not in edges
    assert ("pr:1#1", "MODIFIES", "repo:1") in edges and len(edges) == 6


def test_a_token_is_merged_once(spark, tmp_path):
    graph = filled(spark, str(tmp_path))
    before, log = entities(graph), graph.log().collect()
    assert not sync.ingest_batch(graph, spark.createDataFrame([pull(1, "late", "2025-01-01")], FEED), "feed-1")
    assert entities(graph) == before and graph.log().collect() == log
    assert [(r.n, r.created, r.updated, r.skipped) for r in log] == [(1, 1, 0, 0), (2, 4, 0, 0), (3, 4, 0, 4)]


def test_a_merge_that_failed_half_way_is_done_again(spark, tmp_path):
    graph = filled(spark, str(tmp_path))
    before = entities(graph)
    # tables of a fourth merge without its row in the log
    graph.entities().limit(1).write.parquet(f"{graph.path}/entities/4")
    assert entities(graph) == before
    assert sync.ingest_batch(graph, spark.createDataFrame([pull(1, "third", "2024-02-01")], FEED), "feed-2")
    assert {r.name for r in graph.entities().where("source_id = 'pr:1#1'").collect()} == {"third"} and graph.entities().count() == len(before)


def test_a_stream_in_two_batches_equals_the_batches(spark, tmp_path, graph):
    source, path = str(tmp_path / "in"), str(tmp_path / "graph")
    other = sync.Graph(spark, path)
    other.merge(sync.hashed(spark.createDataFrame([("Repository", "repo:1", "r")], "label string, source_id string, name string")), None, "repos")
    for rows in (ONE, TWO):
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").json(source)
        sync.ingest_events(spark.readStream.schema(FEED).json(source), other, str(tmp_path / "at")).awaitTermination()
    assert entities(other) == entities(graph)
    assert sorted(map(tuple, other.edges().collect())) == sorted(map(tuple, graph.edges().collect()))
    # started again without new files, and with the last batch tried again, nothing changes
    log = other.log().collect()
    sync.ingest_events(spark.readStream.schema(FEED).json(source), other, str(tmp_path / "at")).awaitTermination()
    assert not sync.ingest_batch(other, spark.createDataFrame(TWO, FEED), "feed-1")
    assert other.log().collect() == log


def test_full_reads_mark_what_is_gone_and_a_second_changes_nothing(spark, tmp_path):
    graph = filled(spark, str(tmp_path))
    tickets = spark.createDataFrame([("Ticket", "ticket:T-1", "one", "Open", "2024-01-01"), ("Ticket", "ticket:T-3", "new", "Open", "2024-03-01")], "label string, source_id string, name string, status string, updated_at string")
    read = lambda rows, token: sync.full_sync(graph, rows, None, ["Ticket"], token, F.lit("2024-04-01"))
    assert read(tickets, "full-1")
    state = entities(graph)
    changes = {r.source_id: (r.change, r.deleted_at) for r in graph.entities().where("change is not null").collect()}
    assert changes == {"ticket:T-1": ("SKIPPED", None), "ticket:T-2": ("DELETED", "2024-04-01"), "ticket:T-3": ("CREATED", None)}
    assert read(tickets, "full-2") and entities(graph) == state
    last = graph.log().collect()[-1]
    assert (last.created, last.updated, last.skipped, last.deleted, last.tables) == (0, 0, 2, 0, last.n - 1)
    back = tickets.unionByName(tickets.where("source_id = 'ticket:T-3'").withColumn("source_id", F.lit("ticket:T-2")))
    assert read(back, "full-3") and graph.entities().where("source_id = 'ticket:T-2' and deleted_at is null and change = 'UPDATED'").count() == 1
    # an empty re-read of other labels leaves tickets alone
    assert sync.full_sync(graph, tickets.where("false"), None, ["Page"], "full-4", F.lit("2024-05-01"))
    assert {r.source_id for r in graph.entities().where("deleted_at is not null").collect()} == {"page:5"}
