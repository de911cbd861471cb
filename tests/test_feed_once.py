"""How often the rows of a feed are read, and what is shuffled, until they are merged."""

import json

import pytest
from pyspark.sql import functions as F

from quarryline.plans import sync_queries as sq
from quarryline.streaming import sync

SCHEMA = "seq long, system string, event string, payload string"


def issue(seq):
    fields = {"summary": f"s{seq % 6}", "updated": f"u{seq:04}", "status": {"name": "Open"}, "parent": {"key": f"T-{seq % 9}"}, "assignee": {"accountId": f"a{seq % 4}", "displayName": f"P {seq % 4}"}}
    return (seq, "jira", None, json.dumps({"webhookEvent": "jira:issue_updated", "issue": {"key": f"T-{seq % 7}", "fields": fields}}))


def page(seq):
    return (seq, "confluence", None, json.dumps({"event": "page_updated", "page": {"id": seq % 5, "title": f"t{seq}", "version": {"when": f"u{seq:04}"}}}))


@pytest.fixture
def counted(spark):
    """A feed of 200 rows, and how many of its rows were read."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return spark.createDataFrame([issue(i) if i % 2 else page(i) for i in range(200)], SCHEMA).mapInArrow(run, SCHEMA), seen


def test_a_batch_is_parsed_once(spark, tmp_path, counted):
    feed, seen = counted
    graph = sync.Graph(spark, str(tmp_path))
    assert sync.ingest_batch(graph, feed, "one") and seen.value == 200
    got = {r.source_id: (r.name, r.updated_at) for r in graph.entities().collect()}
    assert len(got) == 7 + 2 + 5 and got["ticket:T-3"] == ("s1", "u0199") and got["page:2"] == ("t192", "u0192") and got["person:a1"] == ("P 1", None)
    assert not sync.ingest_batch(graph, feed, "one") and seen.value == 200


def test_the_last_row_is_found_before_the_shuffle(spark):
    batch = sync.hashed(spark.createDataFrame([("Page", "p", f"n{i}", "2024" if i == 7 else None) for i in range(50)] + [("Person", "q", None, None), ("Person", "q", "Q", None)], "label string, source_id string, name string, updated_at string"))
    merged = sync.merge_entities(spark.createDataFrame([], sync.ENTITY), batch, F.lit("now"))
    assert sorted((r.source_id, r.name, r.created_at, r.change) for r in merged.collect()) == [("p", "n7", "2024", "CREATED"), ("q", "Q", None, "CREATED")]
    assert "Window" not in merged._jdf.queryExecution().executedPlan().toString()


def test_edges_of_two_batches_take_four_reads_of_the_feed(spark, counted):
    # the last seq and the rows, for each batch; a third one has a token that was merged
    feed, seen = counted
    got = sq.ingest_edges(feed, spark.createDataFrame([("repo:1", "r")], "source_id string, name string")).collect()
    assert seen.value <= 4 * 200
    assert {r.rel_type for r in got} == {"ASSIGNED_TO", "PART_OF"} and {r.target_id for r in got if r.state == "rejected"} == {"ticket:T-7", "ticket:T-8"}


def test_full_reads_after_the_feed_read_nothing_of_it_again(spark, counted):
    feed, seen = counted
    wiki = spark.createDataFrame([("page:1", "read 1"), ("page:9", "read 9")], "source_id string, name string")
    got = sq.full_sync(feed, spark.createDataFrame([("repo:1", "r")], "source_id string, name string"), wiki).collect()
    assert seen.value <= 4 * 200
    assert sorted(tuple(r) for r in got) == [("wiki-1", 1, 1, 0, 4, True), ("wiki-2", 0, 0, 2, 0, False)]
