"""Hand-made cases of the jobs over payloads, chunks, registries, links, context, planning."""

from pyspark.sql import functions as F

from quarryline.operators import context as cx
from quarryline.operators import estimation as es
from quarryline.operators import ingest as ig
from quarryline.operators import linking as ln
from quarryline.operators import planning as pl
from quarryline.operators import registry as rg


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


MARKDOWN = "intro\n# A\ntext a\n```\n# no heading\n```\n## B\n" + "A sentence here. " * 60 + "\n\n" + "x" * 900 + "\n##### not one\n# C\nend"


def test_markdown_sections_and_round_trip():
    parts = ig.sections(MARKDOWN)
    assert "".join(p[2] for p in parts) == MARKDOWN
    assert [p[1] for p in parts] == ["", "A", "B", "C"] and parts[2][0] == "# A > ## B" and parts[3][0] == "# C"
    chunks = ig.markdown_chunks(MARKDOWN, 400, 100)
    assert "".join(c[2] for c in chunks) == MARKDOWN and max(len(c[2]) for c in chunks) < 500
    assert all(len(c[2]) >= 100 for c in chunks[:-1])
    assert ig.pieces("", 5) == [] and ig.pieces("abcdefgh", 3) == ["abc", "def", "gh"]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, MARKDOWN, 5), (2, None, 5), (3, "", 5)], "doc_id long, text string, chunk_index int")
    got = ig.chunk_markdown(docs, 100, 25).orderBy("chunk_index").collect()
    assert {r.doc_id for r in got} == {1} and "".join(r.original_segment for r in got) == MARKDOWN
    assert any(r.display_text.startswith("# A > ## B\n\n") for r in got)
    fields = spark.createDataFrame([("K-1", 1, "Summary", "one"), ("K-1", 2, "Comment 2", "word. " * 40), ("K-1", 3, "Empty", ""), ("K-1", 4, "None", None)], "ticket string, ordinal int, field string, text string")
    got = ig.chunk_ticket(fields, 20).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got))) and len(got) > 2
    assert got[0].display_text == "K-1 — Summary\n\none" and {r.section_title for r in got[1:]} == {"Comment"} and got[1].display_text.startswith("K-1 — Comment 2\n\n")
    api = "---\nservice: pay\nx\n---\n# Endpoints\n## GET /pay\nReturns Order.\n# Schemas\n## Order\nid\n"
    got = ig.chunk_api_doc(spark.createDataFrame([(1, api), (2, None)], "doc_id long, text string")).orderBy("chunk_index").collect()
    call = next(r for r in got if r.section_title == "GET /pay")
    assert call.display_text.startswith("service: pay\n\n## GET /pay") and "## Order\nid" in call.display_text


def test_payloads(spark):
    repos = spark.createDataFrame([(1, "Pay", "org/Pay", ("ann",), "t")], "id long, name string, full_name string, owner struct<login:string>, updated_at string")
    entities, edges = ig.extract_repo(repos)
    assert rows(entities.select("label", "source_id")) == [("Repository", "repo:org/Pay"), ("Service", "service:pay")]
    assert rows(edges) == [("repo:org/Pay", "CONTAINS", "service:pay")]
    requests = spark.createDataFrame([("org/Pay", 7, "Fix", "closed", "t", ("Ann", None), "t"), ("org/Pay", 8, "New", "open", None, None, "t")], "repo string, number int, title string, state string, merged_at string, user struct<login:string,name:string>, updated_at string")
    entities, edges = ig.extract_pr(requests)
    assert ("PullRequest", "pr:org/Pay#7", "Fix", "merged", "t") in rows(entities) and ("Person", "person:ann", "Ann", None, None) in rows(entities)
    assert ("pr:org/Pay#8", "MODIFIES", "repo:org/Pay") in rows(edges) and len(rows(edges)) == 3
    page = ig.extract_page(spark.createDataFrame([(3, "T", "<h1>A</h1><p>b&amp;c</p><script>x</script>", "t")], "id long, title string, html string, updated_at string")).first()
    assert page.source_id == "page:3" and page.description == "# A\n\nb&c"


def test_registry(spark):
    d = spark.createDataFrame
    services = d([("s1", "payment-service", "Payments")], "sid string, name string, title string")
    packages = d([("s1", "com.x:pay-lib")], "sid string, name string")
    routes = d([("s1", "/api/v1/Orders/{id}"), ("s1", None)], "sid string, path string")
    got = rows(rg.alias_candidates(services, packages, routes, d([("s1", "pay.example.org")], "sid string, host string"), d([("s1", "PayClient")], "sid string, client string")))
    assert got == [("order", "s1", "low", "route"), ("orders", "s1", "medium", "route"), ("pay client", "s1", "low", "client"), ("pay lib", "s1", "medium", "package"), ("pay", "s1", "low", "client"), ("pay", "s1", "medium", "host"), ("payment service", "s1", "high", "name"), ("payment", "s1", "low", "name"), ("payment", "s1", "low", "title"), ("payments", "s1", "high", "title")]
    items = d([("i", "code", "tests_target", {"m": "GET", "p": ""}, "high", ["b"]), ("i", "code", "runtime", {"m": "POST"}, "high", ["a"]), ("i", "contract", None, {"m": "PUT", "p": "/x"}, "high", ["a"]), ("j", "contract", None, {"m": "A"}, "medium", [])], "id string, source string, role string, attributes map<string,string>, confidence string, evidence array<string>")
    got = {r.id: r for r in rg.merge_items(items).collect()}
    assert got["i"].attributes == {"m": ["POST"], "p": ["/x"]} and got["i"].confidence == "high" and got["i"].evidence == ["a", "b"]
    assert got["j"].confidence == "medium" and got["j"].source == "contract"
    defs = d([("a.b", "default", "x", "1-${C_D:z}", "property", "f", 1), ("c-d", "uat", "y", "${e}", "property", "f", 2), ("e", "default", "y", "2", "other", "f", 3), ("lost", "default", "x", "${nowhere}", "property", "f", 4)], "key string, env string, subproject string, value string, source string, file string, line int")
    asked = d([("A.B", "uat", "x"), ("A.B", "prod", "x"), ("lost", "uat", "x"), ("none", "uat", "x")], "key string, env string, subproject string")
    got = {(r.key, r.env): r.value for r in rg.resolve_config(asked, defs).collect()}
    assert got == {("A.B", "uat"): "1-2", ("A.B", "prod"): "1-z", ("lost", "uat"): None, ("none", "uat"): None}


def test_terms_and_links(spark):
    d = spark.createDataFrame
    texts = d([(1, "The Pay Service calls pay, not payment service."), (2, None), (3, "")], "id long, text string")
    terms = d([("pay",), ("pay service",), ("service calls pay",), ("payment",)], "term string")
    assert rows(ln.find_terms(texts, terms)) == [(1, "pay service", 1), (1, "pay", 1), (1, "payment", 1)]
    aliases = d([("pay service", "s1", "high", False), ("core", "s1", "low", False), ("core", "s2", "low", False), ("billing", "s3", "low", True)], "term string, sid string, confidence string, canonical boolean")
    docs = d([(1, "pay service core"), (2, "core"), (3, "billing core")], "id long, text string")
    assert rows(ln.link_documents(docs, aliases)) == [(1, "s1", "medium", ["core", "pay service"], 2), (3, "s3", "high", ["billing"], 1)]
    assert rows(ln.skipped_terms(docs, aliases)) == [(2, "core", ["s1", "s2"]), (3, "core", ["s1", "s2"])]
    nodes, edges = ln.service_graph_rows(d([("s", "S")], "sid string, name string"), d([("s", "get", "/A/{id}")], "sid string, method string, path string"), d([("s", "db", "t", "both")], "sid string, store string, table string, access string"), d([("s", "k")], "sid string, key string"), d([("s", "dev.x", "publish")], "sid string, topic string, direction string"))
    assert ("Endpoint", "s GET /a/{}", "GET /A/{id}") in rows(nodes) and len(rows(nodes)) == 5
    assert rows(edges) == [("s", "EXPOSES", "s GET /a/{}"), ("s", "PUBLISHES", "x"), ("s", "READS", "db.t"), ("s", "USES_CONFIG", "s:k"), ("s", "WRITES", "db.t")]


def test_context_and_planning(spark):
    d = spark.createDataFrame
    asked = d([(1, 1, "a"), (1, 2, "b")], "question_id long, ordinal int, entity string")
    describes = d([("a", 1, "index"), ("a", 2, "primary"), ("b", 2, "primary"), ("b", 3, "odd")], "entity string, chunk_id long, role string")
    chunks = d([(1, "x" * 5), (2, "y" * 6), (3, "z" * 9)], "chunk_id long, text string")
    assert rows(cx.describing_chunks(asked, describes, chunks, 2, 14)) == [(1, "a", 1, "xxxxx"), (1, "a", 2, "yyyyyy"), (1, "b", 3, "zzz")]
    links = d([(1, "a", "b", "U", "critical"), (2, "b", "a", "U", "low"), (3, "a", "ERP", "U", "high")], "ordinal int, src string, dst string, unit_id string, criticality string")
    requests = d([(1, "a"), (1, "b"), (1, "ERP")], "request_id long, system string")
    assert rows(pl.missing_integrations(requests, d([], "request_id long, system string, unit_id string"), links, "ERP")) == [(1, "a", "U", "complex")]
    areas = d([(1, "Order handling"), (2, "Reports")], "ordinal int, area string")
    matches = pl.template_match(d([(1, 1, "reports of all"), (1, 2, "none")], "doc_id long, id long, name string"), areas)
    assert rows(matches) == [(1, 1, "Reports"), (1, 2, None)] and rows(pl.uncovered_areas(matches, areas)) == [(1, "Order handling")]
    effort = d([(1, "dev", 10.0), (1, "qa", 2.0)], "request_id long, discipline string, person_months double")
    team = d([(1, "dev", 15), (1, "qa", 9), (2, "dev", 3)], "request_id long, discipline string, people int")
    assert rows(es.normalized_team(effort, team)) == [(1, "dev", 10), (1, "qa", 2), (2, "dev", 3)]
    points = d([(0, 50.0)], "tier int, x double").select(es.confidence(F.col("tier"), F.col("x"), F.lit(-5.0), F.lit(300.0), F.lit(None)).alias("c")).first().c
    assert points == round(0.3 * 25 + 0.25 * 50 + 0.15 * 100, 4)
