"""Readers, writers and streams, against their batch twins."""

import datetime as dt
import json

from pyspark.sql.types import StructType

from quarryline.sources import records as rc
from quarryline.streaming import events as ev


def test_records_and_rejects(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "name": "x"}\n{broken\n')
    good, bad = rc.read_records(spark, str(tmp_path), StructType().add("id", "long").add("name", "string"))
    assert [r.id for r in good.collect()] == [1] and bad.count() == 1


def test_inventories(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"repo": "r", "sid": "s", "items": [{"kind": "k", "id": "1"}, {"kind": "k", "id": "2"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"sid": "s"}))
    items, failed = rc.read_inventories(spark, str(tmp_path), StructType().add("kind", "string").add("id", "string"))
    assert items.count() == 2 and failed.count() == 1


def test_tracker_skips_bad_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,amount\n1,2.5\n,3\n2,odd\n3,\n")
    good, bad = rc.read_tracker(spark, str(tmp_path / "t.csv"), {"amount": "double"})
    assert sorted(r.id for r in good.collect()) == ["1", "3"] and bad.count() == 2


def test_audit_months(spark, tmp_path):
    rows = spark.createDataFrame([("p", dt.datetime(2024, m, 1), m) for m in (1, 3, 4)], "project string, timestamp timestamp, n int")
    rc.append_audit(rows, str(tmp_path / "a"))
    got = rc.read_audit(spark, str(tmp_path / "a"), "2024-04-15", 1, "p")
    assert [r.n for r in got.collect()] == [3, 4]


def test_bulk_load(spark):
    d = spark.createDataFrame
    rows = d([(1, "c1", "n", "p"), (2, "c2", " ", "p"), (3, "c3", "n", "q"), (4, "c4", "n", "p")], "row int, code string, name string, parent_code string")
    good, bad = rc.load_bulk(rows, d([("p",)], "code string"), d([("c4",)], "code string"))
    assert [r.code for r in good.collect()] == ["c1"] and sorted(r.reason for r in bad.collect()) == ["missing name", "unknown parent"]


def test_events_are_routed(spark):
    rows = spark.createDataFrame([("push", '{"id": "1"}'), ("odd", "{}"), ("push", "{no"), ("push", "{}")], "event string, payload string")
    assert [r.outcome for r in ev.route_events(rows, "id string", ["push"]).collect()] == ["upsert", "ignored", "dead_letter", "warning"]


def _requests(spark):
    base = dt.datetime(2024, 1, 1)
    seconds = [0, 1, 2, 3, 30, 60, 61, 200]
    return spark.createDataFrame([(1, i, base + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)], "user_id long, event_id long, ts timestamp")


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = _requests(spark)
    batch = ev.rate_limit_batch(rows, 3, 60).first()
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ev.rate_limit(stream, 3, 60).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: r.accepted for r in spark.table("limited").collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: True}
    assert (batch.accepted, batch.refused) == (6, 2)


def test_sessions_and_repeats_as_streams(spark, tmp_path):
    rows = _requests(spark)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ev.activity_sessions(stream, "50 seconds", "1 second").writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.events for r in spark.table("sessions").collect()) == [1, 7]
