"""Jobs read the bindings that their SQL was made with, also where another module uses a name again."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarryline.plans.bindings import VIEWS
from quarryline.plans.queries import QUERIES, SQL, job

KINDS = ("click", "view", "purchase", None)
#: (event_id, ts, user_id, event_type); one id is null, one negative, two events have no time
EVENTS = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * 7 % 11), i % 5 * 10**15, KINDS[i // 4 % 4]) for i in range(32)]
EVENTS += [(None, dt.datetime(2023, 1, 1), 1, "view"), (-6, None, 1, "signup"), (2**62, None, 2, "click")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("events"))
    rows = spark.createDataFrame(EVENTS, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    rows.coalesce(1).write.parquet(f"{out}/events.parquet")
    return out


def rows(spark, folder, name):
    """(columns and rows of the query, those of its SQL)"""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet{'/*.parquet' if os.path.isdir(f'{folder}/events.parquet') else ''}'")
    want = con.execute(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, folder)
    got = got.select([F.col(c).cast("timestamp_ntz" if t == "timestamp" else t).alias(c) for c, t in got.dtypes])
    key = lambda row: [(v is not None, v) for v in row]
    return (got.columns, sorted(map(tuple, got.collect()), key=key)), ([c[0] for c in want.description], sorted(want.fetchall(), key=key))


def test_route_events(spark, folder):
    got, want = rows(spark, folder, "route_events")
    assert got == want
    assert {outcome for _, outcome in got[1]} == {"upsert", "ignored", "dead_letter", "warning"}


def test_feed_of_the_stored_graph(spark):
    got, want = rows(spark, "/root/testdata/sf0.001", "feed_outcomes")
    assert got == want


def test_last_of_batch(spark, folder):
    got, want = rows(spark, folder, "last_of_batch")
    assert got == want
    assert [(event, at is None) for event, at in got[1]] == [(None, False), ("click", False), ("purchase", False), ("signup", True), ("view", False)]


def test_a_name_used_again(spark, monkeypatch):
    for names in (QUERIES, SQL, VIEWS):
        monkeypatch.setitem(names, "again", "SELECT 1 AS a")

    @job("SELECT a FROM again", ("again",))
    def again(rows):
        return rows

    VIEWS["again"] = "SELECT 2 AS a"
    assert [r.a for r in QUERIES["again"](spark, "").collect()] == [1] == [a for (a,) in duckdb.execute(SQL["again"]).fetchall()]
