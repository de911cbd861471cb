"""Hand-made cases of the jobs over scope, phases, endpoints, flows, owners and links."""

from quarryline.operators import scope_views as sc


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_scope(spark):
    d = spark.createDataFrame
    requests = d([(1, "A"), (1, "B"), (2, "A"), (2, "HUB1"), (3, "?"), (4, "C"), (4, "A"), (4, "B"), (4, "HUB1")], "request_id long, system string")
    systems = d([("A", "north"), ("B", "south")], "system string, domain string")
    links = d([("C", "ERP"), ("C", "ERP")], "src string, dst string")
    got = sc.cross_domain(requests, systems, links, ("north", "south"), 0.2, {"HUB1": 0.25}, {"ERP": 0.3})
    assert rows(got) == [(1, True, 0.2), (2, False, 0.25), (3, False, 0.0), (4, True, 0.6)]
    kinds = d([(1, "brd"), (2, "brd"), (2, "prd"), (3, "prd"), (3, "hld"), (4, "prd"), (4, "hld"), (4, "dependent_docs"), (5, None)], "project_id long, doc_kind string")
    assert rows(sc.input_tier(kinds)) == [(1, 0, False), (2, 1, True), (3, 2, False), (4, 3, False), (5, 0, False)]
    items = d([(1, 1, "Order Export"), (1, 2, "order of the day now"), (1, 3, "nothing here"), (1, 4, " "), (1, 5, None), (2, 6, "Order")], "doc_id long, id long, name string")
    status = sc.scope_status(items, d([(1, "ORDER export jobs")], "doc_id long, effort_text string"))
    assert [r[3] for r in sorted(status.select("doc_id", "id", "name", "status").collect(), key=lambda r: r.id)] == ["fully_estimated", "partially_estimated", *["not_estimable"] * 4]
    assert rows(sc.scope_coverage(status)) == [(1, 0.3), (2, 0.0)]


def test_phases(spark):
    d = spark.createDataFrame
    repos = d([("o", "a", "1", "x"), ("o", "b", "1", None), ("o", "c", "1", "x")], "org string, repo string, head_sha string, ledger_at string")
    phases = d([("o", "a", "clone", "done", "1", "0", None), ("o", "a", "extract", "done", "1", "1", "y"), ("o", "b", "extract", "done", "1", "1", "y"), ("o", "c", "extract", "skipped", "1", "0", "x"), ("o", "b", "inventory", "done", "1", "1", None)], "org string, repo string, phase string, status string, version string, input_sha string, ledger_at string")
    states = sc.phase_status(repos, phases, {"inventory": "2"})
    assert rows(states) == [("o", "a", "clone", "done"), ("o", "a", "extract", "stale"), ("o", "a", "inventory", "pending"), ("o", "b", "extract", "done"), ("o", "b", "inventory", "stale"), ("o", "c", "extract", "skipped"), ("o", "c", "inventory", "pending")]
    assert rows(sc.repos_needing(states, "extract")) == [("o", "a")]
    assert rows(sc.repos_needing(states, "extract", True)) == [("o", "a"), ("o", "b")]
    assert ("o", "inventory", "pending", 2) in rows(sc.phase_summary(states))


def test_owners_endpoints_links(spark):
    d = spark.createDataFrame
    files = d([("r", "# @no\n*.md\t@org/a @b # @c\r\n@first @b\n\nx y @\n"), ("s", None), ("t", "")], "repo_id string, text string")
    assert [r.name for r in sc.extract_owners(files).orderBy("name").collect()] == ["b", "org/a"]
    routes = d([("r1", "s", "GET", "/v1/{id}/x"), ("r2", "t", "POST", "/v1/{id}/x")], "route_id string, sid string, method string, path string")
    asked = d([(1, "get", "/v1/7/x", None), (2, None, "/v1/{id}/x", "t"), (3, None, "/v2", None)], "ask_id long, method string, path string, sid string")
    assert [(r[0], r[1]) for r in rows(sc.find_endpoints(asked, routes).select("ask_id", "route_id"))] == [(1, "r1"), (2, "r2")]
    schemas = d([("r1", "response", "200", "X")], "route_id string, role string, status string, schema string")
    assert sc.find_endpoints(asked, routes, schemas).where("size(schemas) = 1").count() == 1
    docs = d([(1, "wiki", True), (2, "wiki", False)], "doc_id long, doc_type string, in_graph boolean")
    links = d([(1, "s", "high", ["pay"]), (1, "t", "low", ["pay", "q"])], "doc_id long, sid string, confidence string, matched array<string>")
    told = rows(sc.link_coverage(docs, links, 1))
    assert {("docs", "wiki", 2), ("linked_docs", "wiki", 1), ("links", "wiki", 2), ("not_in_graph", "wiki", 1), ("term", "pay", 2), ("service", "s wiki high", 1), ("confidence", "low", 1)} <= set(told) and len(told) == 9
    context = d([(1, s, i) for i, s in enumerate("abcde")], "query_id long, sid string, place int")
    hits = d([(1, "b", 5, 0.9), (1, "b", 6, 0.9), (1, "c", 7, 0.7), (1, "e", 8, 0.99), (1, "a", 9, 1.0)], "query_id long, sid string, chunk_id long, score double")
    assert rows(sc.gap_retrieval(context, d([(1, "a")], "query_id long, sid string"), hits)) == [(1, "b", 5, 0.9)]


def test_endpoint_calls(spark):
    d = spark.createDataFrame
    routes = d([("r1", "s", "GET", "/v1/{id}"), ("r2", "s", "POST", "/v1/{id}"), ("r3", "s", "GET", "/v1/:key"), ("r4", "t", "GET", "/v1/{id}")], "route_id string, sid string, method string, path string")
    edges = d([(1, "a", "s", [("PUT", "/v1/7"), ("POST", "/v1/8"), ("GET", "/v1/9")]), (2, "a", "s", [("GET", "/v1/9")]), (3, "a", "s", []), (4, "a", None, [("GET", "/v1/9")]), (5, "a", "s", None)], "edge_id long, src string, dst string, items array<struct<method: string, path: string>>")
    assert rows(sc.endpoint_calls(edges, routes)) == [(1, "a", "r2"), (2, "a", "r1"), (2, "a", "r3")]
