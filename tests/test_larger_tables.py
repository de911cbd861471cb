"""What only larger tables showed: half tenths, and work that grew with the product of two sides."""

import random

import pytest

from quarryline.operators import estimation as es
from quarryline.operators import graph as gr
from quarryline.operators import planning as pl


def test_half_tenths_round_up_whatever_the_digits_of_the_sum(spark):
    # 0.40 * 9 + 0.35 * 12 + 0.25 * 23 is 13.549999999999999 by its digits, and ten times it 135.5
    scored = spark.createDataFrame([(1, 1, 9.0, 12.0, 23.0), (2, 1, 13.6, 13.6, 13.6), (3, 1, None, 1.0, 1.0), (4, 1, -9.0, 0.0, 0.0)], "proposal_id long, request_id long, quality double, cost double, delivery double")
    raw = 0.40 * 9.0 + 0.35 * 12.0 + 0.25 * 23.0
    assert raw < 13.55 and raw * 10 == 135.5
    got = {r.proposal_id: (r.composite, r.rank) for r in es.rank_vendors(scored).collect()}
    assert got == {1: (13.6, 1), 2: (13.6, 2), 3: (0.0, 3), 4: (0.0, 4)}


def plain_missing(requests, items, links, external, most):
    out = set()
    for request in {r for r, _ in requests if r is not None}:
        have = {s for r, s in requests if r == request}
        met = [x for x in links if x[1] in have and x[2] in have and external not in x[1:3] and not any((request, end, x[3]) in items for end in x[1:3])]
        one = {}
        for ordinal, src, dst, unit, criticality in sorted(met):
            if not any(e[1] == dst and e[3] == unit and e[0] < ordinal for e in met):
                one.setdefault((src, unit), (ordinal, pl.COMPLEXITY.get(criticality, "medium")))
        rows = sorted((("complex", "medium", "simple").index(c), o, *key) for key, (o, c) in one.items())[:most]
        out |= {(request, src, unit, ("complex", "medium", "simple")[place]) for place, _, src, unit in rows}
    return out


def test_missing_integrations_equal_plain_ones_and_many_links_make_no_more_rows(spark):
    rng = random.Random(3)
    some = lambda n: f"S{rng.randrange(n)}"
    requests = [(rng.randrange(40), some(9)) for _ in range(160)] + [(None, "S1"), (None, "S2"), (7, None), (1, "ERP")]
    items = [(rng.randrange(40), some(9), f"U{rng.randrange(3)}") for _ in range(80)] + [(2, None, "U1"), (2, "S1", None), (None, "S1", "U1")]
    links = [(i, some(9), "ERP" if i % 11 == 0 else some(9), f"U{rng.randrange(3)}", rng.choice(["critical", "high", "low", "odd", None])) for i in range(900)]
    asked = spark.createDataFrame(requests, "request_id long, system string")
    got = pl.missing_integrations(asked, spark.createDataFrame(items, "request_id long, system string, unit_id string"), spark.createDataFrame(links, "ordinal int, src string, dst string, unit_id string, criticality string"), "ERP")
    have = {tuple(r) for r in got.collect()}
    assert have == plain_missing(requests, set(items), links, "ERP", pl.MOST_ADDED) and len(have) > 100
    # links are told apart by their ends and unit before any request meets them, and no link travels with a request
    plan = got._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "dst" not in " ".join(x for x in plan.splitlines() if "hashpartitioning" in x)


def plain_reach(pairs, hops):
    nexts, out = {}, set()
    for a, b in pairs:
        if a is not None:
            nexts.setdefault(a, set()).add(b)
    for root in nexts:
        front, seen, hop = {root}, set(), 0
        while front and (hops is None or hop < hops):
            hop += 1
            front = {b for a in front for b in nexts.get(a, ())} - seen
            seen |= front
            out |= {(root, b, hop) for b in front}
    return out


def hub_edges():
    # 300 services with the same three hubs, 40 with some of them, a cycle, a tail and null ends
    rng = random.Random(4)
    pairs = [(f"s{i}", f"n{k}") for i in range(300) for k in range(3)] + [(f"s{i}", f"n{rng.randrange(9)}") for i in range(300, 340)]
    return pairs + [(f"n{k}", f"c{k % 2}") for k in range(9)] + [("c0", "s0"), ("c1", "tail"), ("x", None), (None, "y")]


@pytest.mark.parametrize(("hops", "undirected"), [(2, True), (2, False), (3, False), (None, False)])
def test_roots_with_the_same_neighbours_are_walked_once(spark, monkeypatch, hops, undirected):
    walked, walk = [], gr._walked
    monkeypatch.setattr(gr, "_walked", lambda both, roots, n: walked.append(roots.count()) or walk(both, roots, n))
    pairs = hub_edges() if not undirected else [(a, b) for a, b in hub_edges() if a and b]
    got = gr.reach(spark.createDataFrame(pairs, "src string, dst string"), hops=hops, undirected=undirected).collect()
    every = pairs + [(b, a) for a, b in pairs] if undirected else pairs
    assert len(got) == len(set(got)) and {tuple(r) for r in got if r.node is not None} == {x for x in plain_reach(every, hops) if x[1] is not None}
    assert walked[0] < 175


def test_impact_joins_sets_of_tickets_and_not_tickets(spark, monkeypatch):
    kept, store = [], gr.stored
    monkeypatch.setattr(gr, "stored", lambda df: kept.append(store(df)) or kept[-1])
    pairs = hub_edges()[:-2]
    # 2000 tickets concern one of seven pairs of services; some are told twice, some of nobody
    links = [(s, f"T{t}", "epic" if t % 3 == 0 else "ticket") for t in range(2000) for s in (f"s{t % 7}", f"s{300 + t % 7}", f"s{t % 7}")]
    links += [("s1", None, "epic"), (None, "T1", "epic"), ("s1", "T5", "other"), ("nobody", "T9999", "ticket"), ("s9", "T0", "ticket"), ("s9", "T0", "epic")]
    got = gr.impact(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame(links, "service string, ticket string, kind string"))
    hit = {}
    for root, node, _ in plain_reach([(b, a) for a, b in pairs], 2):
        hit.setdefault(root, set()).add(node)
    count = lambda nodes, kind: len({t for s, t, k in links if s in nodes and k == kind and t})
    assert {tuple(r) for r in got.collect()} == {(root, len(nodes), count(nodes, "epic"), count(nodes, "ticket")) for root, nodes in hit.items()}
    assert got.agg({"tickets": "max"}).first()[0] > 1300
    assert [df.count() < 40 for df in kept if df.columns == ["kind", "ticket", "_n"]] == [True]
