"""Sorted lists read in order; turns that tie, long conversations and clashing names."""

import random

import duckdb
import numpy as np
import pytest

pytest.importorskip("quarryline.llm")

from pyspark.sql import functions as F  # noqa: E402

from quarryline.llm import chat, topk  # noqa: E402


def test_reading_stops_early_and_misses_nothing():
    rng = np.random.default_rng(7)
    x = np.floor(rng.exponential(20, (3000, 12)))
    x[::50] *= 8  # few large ones
    ids = np.arange(3000) * 2
    lists = topk.Lists(ids, x)
    read = 0
    for own in (0, 100, 7):
        q = np.floor(rng.normal(0, 100, 12))
        lists.read = 0
        rows = lists.nearest(own, q, 5, -np.inf)
        scores = np.where(ids == own, -np.inf, x @ q)
        best = np.lexsort((ids, -scores))[:5]
        assert set(best) <= set(rows.tolist()) and own not in ids[rows]
        read += lists.read
    assert read < 0.9 * 3 * x.size


def test_a_reached_score_ends_reading_sooner():
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(0, 100, (2000, 16)))
    q = np.floor(rng.normal(0, 100, 16))
    lists = topk.Lists(np.arange(2000), x)
    top = np.sort(x @ q)
    free, bound = [], []
    for least, out in ((-np.inf, free), (top[-1], bound)):
        lists.read = 0
        out += [lists.nearest(-1, q, 5, least), lists.read]
    assert bound[1] <= free[1] and int(np.argmax(x @ q)) in bound[0].tolist()


def test_huge_and_uneven_vectors(spark):
    rows = [(i, [float(10 ** (300 if i % 7 == 0 else 12)), float(i)] + [1.0] * (i % 3), 1, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block long, ids string")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=3).collect()
    assert len(got) == 9 and all(r.vec_id != r.query_id for r in got)
    top = {r.query_id: r.vec_id for r in got if r["rank"] == 1}
    assert top == {0: 1, 20: 0, 40: 0}  # held at the end of long, ties to the smaller id


def as_duckdb(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return sorted(con.execute(f"SELECT conv_id, part, n_turns, n_copies, rendered FROM ({chat.SQL})").fetchall())


def test_turns_that_tie_follow_role_and_text(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(("user", "assistant", None, "")), rng.choice(("a", "b", "c", "d", None, ""))) for c in range(30) for t in (None, 0, 0, 0, 1, 1, 2)]
    rows += [(100, 3, "user", x) for x in "bcda"] + [(101, 9, "user", x) for x in "dcba"]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = sorted(tuple(r) for r in chat.render(df).collect())
    assert got == as_duckdb(rows)
    assert (100, 0, 4, 2, "".join(f"<|user|>\n{x}<|end|>\n" for x in "abcd")) in got


def test_long_conversations_and_names_that_clash(spark):
    turns = [(k, "user" if k % 2 else "assistant", f"text {k} " + "x" * (k % 90)) for k in range(3000)]
    rows = [(1, *t) for t in turns] + [(2, k + 77, r, t) for k, r, t in turns] + [(3, *t) for t in turns[:1500]]
    names = ["at", "range", "place", "bytes", "body", "part", "line", "own"]
    df = spark.createDataFrame([(*r, *([1] * len(names))) for r in rows], ["conv_id", "turn", "role", "text", *names])
    got = chat.render(df, part_bytes=50_000).orderBy("part").collect()
    assert {(r.conv_id, r.n_turns, r.n_copies) for r in got} == {(1, 3000, 2)}
    assert [r.part for r in got] == list(range(len(got))) and len(got) > 2 and max(len(r.rendered) for r in got) < 50_200
    assert "".join(r.rendered for r in got) == "".join(f"<|{r}|>\n{t}<|end|>\n" for _, r, t in turns)
