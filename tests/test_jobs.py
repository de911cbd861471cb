"""Hand-made cases of the jobs."""

import datetime as dt

from pyspark.sql import functions as F

from quarryline.functions import ranks
from quarryline.functions import text as tx
from quarryline.operators import estimation as es
from quarryline.operators import graph as gr
from quarryline.operators import portfolio as pf
from quarryline.operators import resolution as rs
from quarryline.operators import retrieval as rt


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_paths_topics_and_names(spark):
    path = lambda p: one(spark, tx.norm_path(F.lit(p)))
    assert path("/v2/catalogs{}") == "/v2/catalogs"
    assert path("/v1/catalogs/assemblies${q}") == "/v1/catalogs/assemblies"
    assert path("/a//b/{id}/7/?x=1#y") == "/a/b/{}/{}"
    assert path("users/:id/") == "/users/{}"
    topic = lambda p: one(spark, tx.norm_topic(F.lit(p)))
    assert topic("prod-dev.orders.created.uat") == "orders.created"
    assert topic("prod") == "prod"
    assert one(spark, tx.split_identifier(F.lit("HTTPServer-fooBar_baz2"))) == ["http", "server", "foo", "bar", "baz2"]
    assert one(spark, tx.slug(F.lit(" My  Repo_1! "))) == "my-repo-1"
    assert one(spark, tx.is_placeholder(F.lit("xxx"))) is True


def test_small_functions(spark):
    assert one(spark, tx.citations(F.lit("a [ref:2] b [ref:10] [ref:2]"))) == [2, 10]
    assert one(spark, tx.keyword_score(F.lit("Alpha beta"), F.array(F.lit("alpha"), F.lit("x")))) == 0.5
    assert one(spark, tx.query_type(F.lit("What depends on billing?"))) == "structural"
    assert one(spark, tx.redact(F.lit("db_password: hunter2 x"))) == "db_password: *** x"
    assert abs(one(spark, tx.entropy(F.lit("aabb"))) - 1.0) < 1e-9
    df = spark.createDataFrame([("A10",), ("A2",), ("B1",), ("A1",)], "c string")
    assert [r.c for r in df.orderBy(tx.natural_key(F.col("c"))).collect()] == ["A1", "A2", "A10", "B1"]
    assert one(spark, tx.config_environment(F.lit("application-prod.yml"))) == "prod"
    assert one(spark, ranks.rank(F.lit("Red"), ranks.RAG)) == 2
    assert one(spark, es.domain_history_score(F.lit(6))) == 95


def test_rollup_is_worst_child(spark):
    d = spark.createDataFrame
    tasks = d([(1, 1, "Red"), (2, 2, "Green")], "id long, milestone_id long, rag_status string")
    milestones = d([(1, 1, "Green"), (2, 2, "Red")], "id long, project_id long, rag_status string")
    projects = d([(1, 1, "Green"), (2, 1, "Green")], "id long, parent_cp_id long, rag_status string")
    cps = d([(1, 1, "Green"), (2, 1, "Yellow")], "id long, parent_mp_id long, rag_status string")
    mps = d([(1, "Green"), (2, "Green")], "id long, rag_status string")
    got = {(r.level, r.id): r.rolled for r in pf.rollup_status(tasks, milestones, projects, cps, mps).collect()}
    assert got["milestone", "1"] == "Red" and got["milestone", "2"] == "Red" and got["cp", "1"] == "Red"
    assert got["cp", "2"] is None and got["mp", "1"] == "Red" and got["mp", "2"] is None


def test_budget_limits(spark):
    d = spark.createDataFrame
    b = d([(1, 100.0), (2, 100.0), (3, 0.0), (4, 100.0)], "project_id long, approved_budget double")
    t = d([(1, "Spend", 90.0), (1, "Refund", 10.0), (1, "PO", 50.0), (2, "Spend", 80.5), (3, "Spend", 5.0), (4, "Spend", 100.5)], "project_id long, transaction_type string, amount double")
    got = {r.project_id: r for r in pf.budget_ledger(b, t).collect()}
    assert got[1].budget_rag == "Green" and got[1].committed == 50 and got[1].spent == 80
    assert got[2].budget_rag == "Yellow" and got[3].budget_rag == "Green" and got[4].budget_rag == "Red" and got[4].over_budget


def test_track_and_delay_context(spark):
    d = spark.createDataFrame
    got = pf.reconcile_track(d([(1,)], "id long"), d([(1, "Design", 3, "In_Progress"), (1, "Design", 4, "Completed")], "project_id long, stage string, stage_order int, status string"))
    got = [tuple(r) for r in got.orderBy("stage_order").collect()]
    assert len(got) == 8 and got[2] == (1, "Design", 3, "In_Progress") and got[7][1] == "Closure"
    assert one(spark, pf.rag_context_missing(F.lit("Red"), {"what": F.lit(" "), "why": F.lit("x"), "how": F.lit(None)})) == ["what", "how"]


def test_bm25_and_fusion(spark):
    d = spark.createDataFrame
    chunks = d([(1, "alpha beta"), (2, "alpha alpha gamma"), (3, "gamma delta"), (4, None), (5, "beta alpha")], "chunk_id long, display_text string")
    hits = rt.bm25_topk(d([(9, "beta zeta"), (8, "none")], "query_id long, text string"), chunks).collect()
    assert [(r.query_id, r.rank, r.id) for r in hits] == [(9, 1, 1), (9, 2, 5)]
    lists = d([(1, "a", 10, 1), (1, "a", 10, 2), (1, "a", 11, 3), (1, "b", 11, 1), (1, "b", 12, 2)], "query_id long, list string, id long, rank int")
    assert [r.id for r in rt.rrf(lists).orderBy("rank").collect()] == [11, 10, 12]


def test_duplicates_are_symmetric(spark):
    d = spark.createDataFrame
    v = [(1, "r", [1.0, 0.0]), (2, "r", [1.0, 0.0]), (3, "r", [0.0, 1.0]), (4, "s", [1.0, 0.0])]
    got = rows(rt.near_duplicates(d(v, "chunk_id long, repo_name string, vector array<double>")).select("id", "other"))
    assert got == [(1, 2), (2, 1)]
    types = d([(1, "ticket"), (2, "wiki")], "id long, doc_type string")
    assert rows(rt.resolve_canonical(d([(1, 2), (2, 1)], "id long, other long"), types)) == [(1, 2)]
    assert rows(rt.exact_duplicates(d([(5, "h", "ticket"), (6, "h", "wiki"), (7, "k", "docs")], "chunk_id long, text_hash string, doc_type string"))) == [(5, 6, True), (6, 6, False), (7, 7, False)]


def test_reach_and_paths(spark):
    d = lambda x: spark.createDataFrame(x, "src string, dst string")
    got = rows(gr.reach(d([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")]), hops=2).where("root = 'a'"))
    assert got == [("a", "a", 2), ("a", "b", 1), ("a", "c", 1)]
    entry = spark.createDataFrame([("ui",)], "node string")
    paths = lambda x, n=5: sorted((tuple(r.path), r.truncated) for r in gr.maximal_paths(d(x), entry, n).collect())
    assert paths([("ui", "a"), ("a", "b"), ("b", "a"), ("b", "c")]) == [(("ui", "a", "b", "c"), False)]
    chain = [("ui", "n1"), *[(f"n{i}", f"n{i + 1}") for i in range(1, 8)]]
    assert paths(chain) == [(("ui", "n1", "n2", "n3", "n4"), True)]


def test_merges(spark):
    d = spark.createDataFrame
    t = d([("a", "x", "h1", 1, 1), ("b", "y", "h2", 1, 1)], "source_id string, title string, text_hash string, updated_at int, created_at int")
    b = d([("a", "z", "h1", 2, 2), ("b", None, "h3", 2, 2), ("c", "n", "h4", 2, 2)], t.schema)
    assert rows(gr.upsert_decisions(t, b)) == [("a", "SKIPPED"), ("b", "UPDATED"), ("c", "CREATED")]
    after = gr.apply_upsert(t, b)
    assert rows(after) == [("a", "x", "h1", 1, 1), ("b", "y", "h3", 2, 1), ("c", "n", "h4", 2, 2)]
    assert {r.decision for r in gr.upsert_decisions(after, b).collect()} == {"SKIPPED"}
    e = d([("a", "R", "b"), ("a", "R", "zz"), ("b", "R", "a")], "source_id string, rel_type string, target_id string")
    assert [x[3] for x in rows(gr.upsert_edges_checked(e, t, e.where("source_id = 'b'")))] == ["CREATED", "REJECTED", "SKIPPED"]
    assert one(spark, gr.is_stale(F.lit("not a date"), F.lit(dt.datetime(2024, 1, 1)))) is True


def test_routes_and_hosts(spark):
    d = spark.createDataFrame
    routes = d([("r1", "svc", "GET", "/v1/a/{id}"), ("r2", "other", "GET", "/v1/b/{id}"), ("r3", "third", None, "/b/{x}")], "route_id string, sid string, method string, path string")
    calls = d([(1, "GET", "/v1/a/5"), (2, "POST", "/v1/a/5"), (3, "GET", "/v1/b/list"), (4, "GET", "/zz/{p}")], "call_id long, method string, path string")
    got = rows(rs.pick_route(rs.match_routes(calls, routes)).select("call_id", "outcome", F.array_join("sids", ",")))
    assert got == [(1, "edge", "svc"), (3, "edge", "other")]
    hosts = d([("h", "/api", "s1"), ("h", "/api/x", "s2"), ("h", "", "s0")], "host string, prefix string, sid string")
    asked = d([(1, "h", "/api/x/1"), (2, "h", "/api/y"), (3, "h", "/apix")], "call_id long, host string, path string")
    assert rows(rs.resolve_host(asked, hosts)) == [(1, "s2"), (2, "s1"), (3, "s0")]


def test_aliases_claims_and_contracts(spark):
    d = spark.createDataFrame
    table = rs.alias_table(d([("pay", "s1", "low", "n"), ("pay", "s2", "high", "t"), ("bill", "s1", "high", "t")], "alias string, sid string, confidence string, source string"), d([("bill", "s3")], "alias string, sid string"))
    assert rows(table.select("alias", "sid", "confidence", "ambiguous")) == [("bill", "s3", "manual", False), ("pay", "s1", "low", True), ("pay", "s2", "high", True)]
    claims = d([(1, "A", "b ", "odd"), (2, "a", "B", "high"), (3, "a", "A", "low"), (4, "a", "q", "low")], "ordinal int, src string, dst string, confidence string")
    assert rows(rs.known_only(claims, d([("a",), ("b",)], "name string"))) == [("a", "b", "low")]
    diff = rs.contract_diff(d([("e", "Name"), ("e", "more")], "edge_id string, field string"), d([("e", "name", True), ("e", "id", True), ("e", "opt", False)], "edge_id string, field string, required boolean"))
    assert rows(diff) == [("e", "Name", "name_case"), ("e", "id", "missing_required"), ("e", "more", "extra")]
    ids = rs.service_ids(d([("my-repo",), ("My Repo",)], "repo string"))
    got = dict(rows(ids))
    assert got["my-repo"] == "my-repo" and got["My Repo"].startswith("my-repo-")


def test_estimation_arithmetic(spark):
    d = spark.createDataFrame
    items = d([(1, 1, "s", "simple", 2.0), (1, 1, "s", "odd", 1.0), (1, 9, "s", "simple", 5.0), (1, 2, "q", "complex", 1.0)], "request_id long, unit_id long, system string, complexity string, quantity double")
    units = d([(1, 1.0, 2.0, 3.0), (2, None, None, None)], "unit_id long, simple double, medium double, complex double")
    got = es.base_effort(items, units, d([("s", 1.5)], "system string, multiplier double"))
    assert sorted(r.days for r in got.collect()) == [0.0, 2.4, 3.0, 3.0]
    effort = d([(1, "backend", 22.0, 1.0), (1, "qa", 11.0, 0.5)], "request_id long, discipline string, person_days double, person_months double")
    assert es.cost(effort, d([("qa", 1000.0)], "discipline string, monthly_rate double"), 2000.0).first().total_cost == 2500.0
    assert es.duration(effort, d([(1, "backend", 4, "v")], "request_id long, discipline string, people int, variant string")).count() == 2
    options = d([(1, 100.0, [10.0, 20.0], 5)], "option_id long, one_time double, yearly array<double>, users int")
    assert es.tco(options, 3).first().total == 150.0
    v = d([(1, 125.0, 100.0, 5.0, 10.0, 120.0), (2, 126.0, 100.0, 7.0, 10.0, -1.0)], "proposal_id long, vendor_cost double, internal_cost double, vendor_timeline double, internal_timeline double, coverage double")
    got = {r.proposal_id: r for r in es.vendor_compare(v).collect()}
    assert not got[1].cost_flag and got[2].cost_flag and got[1].delivery_flag and not got[2].delivery_flag and got[1].coverage == 100 and got[2].coverage == 0
