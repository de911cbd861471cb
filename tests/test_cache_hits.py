"""Kept answers: keys, batches against a plain loop, and a stream that equals the batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quarryline.streaming import events as ev

START = dt.datetime(2024, 1, 1)
SCHEMA = "query_id long, query_key string, ts timestamp"


def asked(n=400, seed=1):
    rng = random.Random(seed)
    return [(i, f"k{rng.randrange(6)}", START + dt.timedelta(seconds=rng.randrange(40_000))) for i in range(n)]


def plain(rows, ttl):
    kept, out = {}, {}
    for i, k, ts in sorted(rows, key=lambda r: (r[1] or "", r[2], r[0])):
        hit = k in kept and (ts - kept[k]).total_seconds() < ttl
        if not hit:
            kept[k] = ts
        out[i] = hit
    return out


def test_equal_filters_have_one_key(spark):
    rows = [('{"a": 1, "b": {"x": 1, "y": [1, 2]}}', "1"), ('{ "b":{"y":[1,2],"x":1},"a":1}', "1"), ('{"a": "1", "b": {"x": 1, "y": [1, 2]}}', "2"), ('{"a": 1, "b": {"x": 1, "y": [2, 1]}}', "3"), (None, "4"), ("{}", "4"), ("{oops", "4")]
    got = spark.createDataFrame(rows, "filters string, same string").withColumn("k", ev.query_key(F.lit("q"), F.col("filters")))
    assert got.groupBy("same").agg(F.countDistinct("k").alias("n")).where("n != 1").count() == 0 and got.select("k").distinct().count() == 4
    one = spark.range(1).select(ev.query_key(F.lit("a{}"), F.lit(None).cast("string")).alias("x"), ev.query_key(F.lit("a"), F.lit(None).cast("string")).alias("y"), ev.query_key(F.lit(None).cast("string"), F.lit("{}")).alias("z")).first()
    assert len(set(one)) == 3


def test_batches_equal_a_plain_loop(spark):
    rows = asked()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # keys that go over batches
    try:
        got = {r.query_id: r.hit for r in ev.cache_hits(spark.createDataFrame(rows, SCHEMA), 3600).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(rows, 3600)


def test_a_hit_does_not_renew_and_the_bound_is_a_miss(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [(1, "k", at(0)), (2, "k", at(50)), (3, "k", at(99)), (4, "k", at(100)), (5, "k", at(100)), (6, None, at(0)), (7, None, at(1)), (8, "k", None)]
    got = {r.query_id: r.hit for r in ev.cache_hits(spark.createDataFrame(rows, SCHEMA), 100).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: True, 6: False, 7: True, 8: False}
    assert ev.cache_hits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_stream_equals_the_batch(spark, tmp_path):
    rows = sorted(asked(200), key=lambda r: r[2])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(0, 200, 50):
        spark.createDataFrame(rows[k : k + 50], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ev.cache_hits_stream(stream, 3600, "10 hours").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(out).awaitTermination()
    got = {r.query_id: r.hit for r in spark.read.parquet(out).collect()}
    assert got == plain(rows, 3600)
