"""Hand-made cases of the jobs over services, files and listings."""

from pyspark.sql import functions as F

from quarryline.operators import service_views as sv


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_files_and_corpora(spark):
    d = spark.createDataFrame
    ledger = d([("a", "pending"), ("b", "pending"), ("c", "failed"), ("d", "pending")], "path string, status string")
    touches = d([("a", "partial"), ("a", "full"), ("b", "partial"), ("c", "full")], "path string, parse string")
    assert rows(sv.recompute_ledger(ledger, touches)) == [("a", "extracted"), ("b", "scanned"), ("c", "failed"), ("d", "pending")]
    corpus = d([("s", 1, "keep"), ("s", 2, None), ("t", 3, "other")], "store string, id long, kind string")
    assert rows(sv.purge_ids(corpus, ["keep"])) == [("s", 2), ("t", 3)]
    assert rows(sv.purge_plan(corpus, ["keep"], d([("s", 1)], "store string, keeps long"))) == [("s", 1, 1, True), ("t", 1, 0, False)]
    assert rows(sv.purge_plan(corpus.where("false"), ["keep"])) == []


def test_disciplines_and_texts(spark):
    d = spark.createDataFrame
    effort = d([(1, " QA ", 2.0), (1, "ui", 1.0), (1, "qa lead", 3.0), (1, "?", 9.0), (1, None, 9.0), (2, "qa", 0.0)], "request_id long, discipline string, days double")
    assert rows(sv.merge_disciplines(effort, ["frontend", "qa"], {"ui": "frontend"})) == [(1, "frontend", 1.0), (1, "qa", 5.0)]
    nodes = d([("page", "T", " ", "x"), ("page", None, "", None), ("other", "T", "S", "x")], "label string, title string, space string, body string")
    assert [r.t for r in nodes.select(sv.embed_text(F.col("label"), {"page": ["title", "space", "body"]}).alias("t")).collect()] == ["T x", None, None]


def test_services(spark):
    d = spark.createDataFrame
    edges = d([("a", "b"), ("b", "c")], "src string, dst string")
    links = d([("a", "T1"), ("a", "T1"), ("z", "T2")], "service string, ticket string")
    assert rows(sv.service_detail(edges, links)) == [("a", ["b"], [], 1), ("b", ["c"], ["a"], 0), ("c", [], ["b"], 0)]
    access = d([("db", "t", "a"), ("db", "t", "b"), ("db", "u", "a")], "store string, `table` string, sid string")
    ddl = d([("db", "t", "a"), ("db", "u", "a")], "store string, `table` string, sid string")
    assert rows(sv.owned_tables(ddl, access)) == [("db", "t", "a", ["b"]), ("db", "u", "a", [])]
    assert sv.merge_batches(edges, edges).count() == 4
