"""Versioned merges, status changes of streams, rankings over a part of the chunks."""

from quarryline.operators import retrieval as rt
from quarryline.sources import records as rc
from quarryline.streaming import events as ev


def test_versions_of_a_merged_table(spark, tmp_path):
    path = str(tmp_path / "t")
    d = lambda *rows: spark.createDataFrame(rows, "source_id long, status string, text_hash string, updated_at string, created_at string")
    assert rc.read_latest(spark, path) is None
    rc.upsert_entities(d((1, "a", "h", "t1", "t1"), (2, "a", "h", "t1", "t1")), path, 0)
    rc.upsert_entities(d((1, "b", "h", "t2", "t2"), (2, "b", "g", "t2", "t2"), (3, "b", "g", "t2", "t2")), path, 1)
    rc.upsert_entities(d((9, "x", "x", "t3", "t3")), path, 1)  # tried again
    got = {r.source_id: (r.status, r.created_at) for r in rc.read_latest(spark, path).collect()}
    assert got == {1: ("a", "t1"), 2: ("b", "t1"), 3: ("b", "t2")} and rc.versions(spark, path) == [0, 1]


def test_status_changes_of_a_stream(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00', 1L, 'Green'), ('a', timestamp'2024-01-01 00:00:01', 2L, 'Green'), ('a', timestamp'2024-01-01 00:00:02', 3L, 'Red'), ('b', timestamp'2024-01-01 00:00:00', 4L, 'Red'), ('a', timestamp'2024-01-01 00:00:03', 5L, 'Green') t(entity, ts, seq, status)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ev.status_changes(stream).writeStream.format("memory").queryName("changed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.entity, r.previous, r.new) for r in spark.table("changed").collect()) == [("a", "Green", "Red"), ("a", "Red", "Green")]


def test_rankings_over_a_part(spark):
    d = spark.createDataFrame
    chunks = d([(1, "one two"), (2, "one two three"), (3, "four")], "chunk_id long, display_text string")
    vectors = d([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, vector array<double>")
    asked = d([(7, "one", [1.0, 0.0])], "query_id long, text string, vector array<double>")
    keep = d([(2,), (3,)], "id long")
    assert [r.id for r in rt.dense_topk(asked, vectors, 5, keep).orderBy("rank").collect()] == [2, 3]
    assert [r.id for r in rt.hybrid_search(asked, chunks, vectors, 5, keep=keep).orderBy("rank").collect()] == [2, 3]
