"""Walks with stored frontiers against plain ones, and both ways to find terms."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarryline.operators import graph as gr
from quarryline.operators import linking as ln


def edges(n, m, seed):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]


def walked(pairs, hops):
    out = {}
    nexts = {}
    for a, b in pairs:
        nexts.setdefault(a, set()).add(b)
    for root in nexts:
        front, seen, hop = {root}, {}, 0
        while front and (hops is None or hop < hops):
            hop += 1
            front = {b for a in front for b in nexts.get(a, ())} - set(seen)
            seen.update(dict.fromkeys(front, hop))
        out.update({(root, k): v for k, v in seen.items()})
    return out


@pytest.mark.parametrize("hops", [1, 3, None])
def test_reach_equals_a_plain_walk(spark, hops):
    pairs = edges(40, 60, 2) + [(f"n{i}", f"n{i + 1}") for i in range(100, 112)]
    got = {(r.root, r.node): r.hop for r in gr.reach(spark.createDataFrame(pairs, "src string, dst string"), hops=hops).collect()}
    assert got == walked(pairs, hops)


def test_a_deep_walk_has_a_small_plan(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(8)], "src string, dst string")
    plan = gr.reach(chain, hops=7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert gr.reach(chain.where("false")).count() == 0 and gr.reach(chain.where("false"), hops=None).count() == 0


def test_impact_counts_what_concerns_dependents(spark):
    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("c", "a")], "src string, dst string")
    links = spark.createDataFrame([("a", "T1", "ticket"), ("b", "T1", "ticket"), ("b", "E1", "epic"), ("d", None, "ticket"), ("d", "X", "other"), ("z", "T9", "ticket")], "service string, ticket string, kind string")
    got = {r.service: (r.affected, r.epics, r.tickets) for r in gr.impact(deps, links).collect()}
    assert got == {"c": (3, 1, 1), "b": (2, 0, 1), "a": (3, 1, 1)}


def plain_paths(pairs, entries, most):
    nexts = {}
    for a, b in pairs:
        if a != b:
            nexts.setdefault(a, set()).add(b)
    out = set()

    def go(path):
        more = [b for b in nexts.get(path[-1], ()) if b not in path]
        if not more or len(path) == most:
            if len(path) > 1:
                out.add((tuple(path), bool(more)))
            return
        for b in more:
            go([*path, b])

    for e in entries:
        go([e])
    return out


@pytest.mark.parametrize("most", [2, 4, 6])
def test_paths_equal_a_plain_search(spark, most):
    pairs, entries = edges(12, 20, 5), ["n0", "n1", "n0", "nowhere"]
    got = gr.maximal_paths(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([(e,) for e in entries], "node string"), most).collect()
    assert {(tuple(r.path), r.truncated) for r in got} == plain_paths(pairs, entries, most) and len(got) == len(plain_paths(pairs, entries, most))
    assert all(r.length == len(r.path) for r in got)


def plain_terms(text, terms):
    words, at, out = text.split(), 0, Counter()
    while at < len(words):
        for n in range(4, 0, -1):
            gram = " ".join(words[at : at + n])
            if at + n <= len(words) and gram in terms:
                out[gram] += 1
                at += n - 1
                break
        at += 1
    return out


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_terms_by_both_ways(spark, sent):
    rng = random.Random(8)
    words = ["a", "b", "c", "d", "e"]
    terms = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(25)} - {"a", "b"}
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(3, "c d e c d e"), (None, "a b c d"), (99, None), (98, "")]
    want = Counter()
    for i, text in texts:
        for term, n in plain_terms(text or "", terms).items():
            want[i, term] += n
    table = spark.createDataFrame([(t.upper(),) for t in terms] + [("",), (None,), ("x y z a b",)], "term string")
    got = ln.find_terms(spark.createDataFrame(texts, "id long, text string"), table, sent_bytes=sent)
    assert {(r.id, r.term.lower()): r["count"] for r in got.collect()} == dict(want)
    none = spark.createDataFrame([], "id long, text string")
    assert ln.find_terms(none, table, sent_bytes=sent).count() == 0 and ln.find_terms(spark.createDataFrame(texts, "id long, text string"), table.where(F.lit(False)), sent_bytes=sent).count() == 0
