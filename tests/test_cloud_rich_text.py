"""Cloud cost rules one by one, and trees of rich text against a plain walk."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import cloud as cl
from quarryline.operators import ingest as ig

RULES = [("category", "ui", 1, "web", 1, "hosting"), ("category", "ui", 2, "cdn", 1, "files"), ("category", "backendLogic", 3, "sql", 1, "rules"), ("system", "A", 4, "web", 3, "tier"), ("system", "A", 5, "hub", 1, "devices"), ("baseline", "", 6, "vault", 1, "secrets"), ("keyword", "service bus", 7, "bus", 1, "named"), ("keyword", "CDN", 8, "cdn", 1, "cdn named")]


@pytest.fixture(scope="module")
def tables(spark):
    items = [(1, 1, 10, "one Service"), (1, 2, 10, "BUS of all"), (1, 3, 99, None), (2, 1, 12, "service"), (2, 2, 12, ""), (2, 3, 12, "bus and cdn"), (3, 1, 11, "x")]
    return dict(
        items=spark.createDataFrame(items, "request_id long, ordinal int, unit_id long, reason string"),
        units=spark.createDataFrame([(10, "ui"), (11, "qa"), (12, None)], "unit_id long, category string"),
        systems=spark.createDataFrame([(1, 1, "A"), (1, 2, "A"), (1, 3, "B"), (4, 1, "C"), (4, 2, None)], "request_id long, ordinal int, system string"),
        rules=spark.createDataFrame(RULES, "kind string, key string, ordinal int, resource string, quantity int, reason string"),
        models=spark.createDataFrame([("A", "Multi-region"), ("B", "IB Countrywise, multi"), ("C", "single")], "system string, deployment_model string"),
        prices=spark.createDataFrame([("web", 100.0), ("cdn", 40.0), ("sql", 240.0), ("hub", 7.5), ("vault", 5.0)], "resource string, price double"),
    )


def test_every_kind_of_rule(tables):
    called = cl.called_for(*(tables[k] for k in ("items", "units", "systems", "rules")))
    many = cl.request_multiplier(tables["systems"], tables["models"])
    got = {(r.request_id, r.resource): (r.line, r.quantity, r.cost, r.reason) for r in cl.cloud_lines(called, many, tables["prices"]).collect()}
    assert got[1, "web"] == (1, 3, 900.0, "hosting; A: tier")  # the larger quantity, both reasons, three countries
    assert got[1, "sql"][:3] == (2, 1, 720.0)  # unit 99 isn't known
    assert got[1, "bus"] == (6, 1, 0.0, "named")  # two words over two reasons, any case, no price
    assert (2, "bus") not in got  # an empty reason stands between
    assert got[2, "cdn"] == (2, 1, 40.0, "cdn named") and got[2, "sql"][3] == "rules"
    assert {k for k in got if k[0] == 3} == {(3, "vault")} and {k for k in got if k[0] == 4} == {(4, "vault")}
    totals = {r.request_id: r for r in cl.cloud_totals(cl.cloud_lines(called, many, tables["prices"]), many).collect()}
    assert (totals[3].monthly_total, totals[3].non_production, totals[3].with_non_production, totals[3].multiplier) == (5, 3, 8, 1.0)
    one = totals[1]
    assert one.multiplier == 3.0 and one.monthly_total == round(900 + 120 + 720 + 22.5 + 15) and one.resources == 6


def test_models(spark):
    rows = [("IB countrywise", 3.0), ("ib regionwise", 2.0), ("multi", 2.0), ("single", 1.0), ("", 1.0), (None, 1.0)]
    assert all(r.m == r.want for r in spark.createDataFrame(rows, "model string, want double").withColumn("m", cl.deployment_multiplier(F.col("model"))).collect())


def test_empty_tables(tables):
    none = {k: v.where("false") for k, v in tables.items()}
    called = cl.called_for(*(none[k] for k in ("items", "units", "systems", "rules")))
    assert called.count() == 0
    assert cl.called_for(tables["items"], none["units"], none["systems"], none["rules"]).count() == 0


def plain(node):
    if isinstance(node, list):
        return " ".join(map(plain, node)).strip()
    if isinstance(node, dict):
        if isinstance(node.get("text"), str):
            return node["text"]
        return plain(node["content"]) if isinstance(node.get("content"), list) else ""
    return "" if node is None else node if isinstance(node, str) else json.dumps(node)


def tree(rng, depth):
    kind = rng.randrange(8)
    if depth == 0 or kind < 3:
        return {"type": "text", "text": rng.choice(["a", " b ", "", 'q"\\x', "line\nline", "é"])} if kind != 1 else {"type": "mention", "attrs": {"text": "no", "content": [{"text": "no"}]}}
    if kind == 3:
        return [tree(rng, depth - 1) for _ in range(rng.randrange(3))]
    if kind == 4:
        return rng.choice([None, "plain", 7, {"text": 5, "content": [{"text": "under"}]}, {"content": {"text": "no list"}}, {}, {"text": "own", "content": [{"text": "no"}]}])
    return {"type": "p", "attrs": {"text": "no"}, "content": [tree(rng, depth - 1) for _ in range(rng.randrange(4))]}


def test_trees_equal_a_plain_walk(spark):
    rng = random.Random(4)
    trees = [t for t in (tree(rng, rng.randrange(1, 7)) for _ in range(400)) if isinstance(t, dict | list)]
    rows = [(i, json.dumps(t), plain(t)) for i, t in enumerate(trees)]
    got = spark.createDataFrame(rows, "id long, tree string, want string").withColumn("got", ig.rich_text(F.col("tree")))
    assert [(r.tree, r.got) for r in got.where("got != want or got is null").collect()] == [] and got.where("want != ''").count() > 100


def test_what_is_no_tree_stays(spark):
    rows = [("plain text", "plain text"), (None, ""), ("", ""), ("[oops", "[oops"), ("5", "5"), ('"quoted"', '"quoted"'), ("{}", ""), ("[]", "")]
    got = spark.createDataFrame(rows, "tree string, want string").withColumn("got", ig.rich_text(F.col("tree")))
    assert got.where("not got <=> want").count() == 0
    deep = '{"content": [' * 30 + '{"text": "x"}' + "]}" * 30
    assert spark.createDataFrame([(deep,)], "tree string").select(ig.rich_text(F.col("tree"))).first()[0] == ""
