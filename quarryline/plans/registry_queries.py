"""More registered queries: values and forms, registries, linking, context, planning, ingest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import context as cx
from ..operators import estimation as es
from ..operators import ingest as ig
from ..operators import linking as ln
from ..operators import planning as pl
from ..operators import registry as rg
from .bindings import VIEWS
from .queries import _BM25, job

VIEWS |= {
    # estimation
    "factor_rows": "SELECT o_orderkey AS request_id, CAST(o_orderkey % 4 AS INT) AS tier, o_totalprice / CAST(1999.7 AS DOUBLE) - 20 AS detail, CAST(o_custkey % 130 - 10 AS DOUBLE) AS clarity, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) END AS history, CAST(o_custkey % 101 AS DOUBLE) AS coverage FROM orders",
    "request_flags": "SELECT o_orderkey AS request_id, CAST(o_custkey % 14 AS INT) AS team_size, o_orderkey % 3 = 0 AS cross_domain, CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE NULL END AS familiarity, CASE WHEN o_custkey % 4 = 0 THEN 'large' ELSE 'small' END AS volume, o_orderkey % 4 = 1 AS multi_region, CAST(o_custkey % 13 AS INT) AS regions, o_orderkey % 7 = 0 AS security, o_custkey % 5 = 0 AS legacy FROM orders",
    "factor_table": "SELECT 'familiarity' AS factor, 'high' AS level, CAST(1.25 AS DOUBLE) AS multiplier UNION ALL SELECT 'volume', 'large', CAST(1.1 AS DOUBLE) UNION ALL SELECT 'legacy', 'heavy', CAST(1.4 AS DOUBLE)",
    "sized_requests": "SELECT o_orderkey AS request_id, o_totalprice / 3000 AS effort, CASE o_orderstatus WHEN 'F' THEN 'Enhancement' WHEN 'O' THEN 'New Module' ELSE 'Other' END AS scope, o_orderkey % 6 = 0 AS security FROM orders",
    "unit_items": "SELECT DISTINCT l_orderkey AS request_id, CASE CAST(l_partkey % 12 AS INT) WHEN 0 THEN 'QA-02' WHEN 1 THEN 'QA-05' WHEN 2 THEN 'QA-06' WHEN 3 THEN 'INT-13' WHEN 4 THEN 'INT-07' WHEN 5 THEN 'BE-08' ELSE concat('FE-', CAST(l_partkey % 12 AS VARCHAR(20))) END AS unit_id, concat('S', CAST(l_suppkey % 24 AS VARCHAR(20))) AS system FROM lineitem",
    "guards": "SELECT 'Enhancement' AS scope, CAST(10.0 AS DOUBLE) AS least, CAST(90.0 AS DOUBLE) AS most UNION ALL SELECT 'New Module', CAST(20.0 AS DOUBLE), NULL",
    "months": "SELECT l_orderkey AS request_id, CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'backend' WHEN 1 THEN 'frontend' ELSE 'qa' END AS discipline, sum(l_quantity) / 20 AS person_months FROM lineitem GROUP BY l_orderkey, CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'backend' WHEN 1 THEN 'frontend' ELSE 'qa' END",
    "suggested_team": "SELECT DISTINCT l_orderkey AS request_id, CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'backend' WHEN 1 THEN 'frontend' ELSE 'devops' END AS discipline, CAST(1 + l_orderkey % 13 AS INT) AS people FROM lineitem",
    # names whose forms are known by how they were made
    "path_forms": "SELECT DISTINCT concat('/Api/', upper(event_type), '/[id]//X?a=1') AS path, concat('/api/', event_type, '/{}/x') AS form FROM events UNION SELECT DISTINCT concat('/a/{x:regex([0-9]{3})}/', event_type, '/'), concat('/a/{}/', event_type) FROM events UNION SELECT DISTINCT concat('~/', event_type, '/*/:name/%s#top'), concat('/', event_type, '/{}/{}/{}') FROM events UNION SELECT DISTINCT concat('/', event_type, '/[...rest]/<id>/items$', '{query}'), concat('/', event_type, '/{}/{}/items') FROM events",
    "topic_forms": "SELECT DISTINCT concat('sit-', event_type, '.STG') AS topic, event_type AS form FROM events UNION SELECT DISTINCT concat('perf_local.', upper(event_type), '-prd'), event_type FROM events UNION SELECT DISTINCT concat('develop-', 'prod'), 'prod' FROM events UNION SELECT DISTINCT concat('devices.', event_type), concat('devices.', event_type) FROM events",
    # registries
    "infra_items": "SELECT concat('s', CAST(p_partkey % 30 AS VARCHAR(20))) AS sid, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'k8s-service' WHEN 1 THEN 'compose-service' WHEN 2 THEN 'k8s-ingress' ELSE 'pipeline' END AS infra_kind, concat('App', CAST(p_size AS VARCHAR(20))) AS name, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE concat('ns', CAST(p_size % 3 AS VARCHAR(20))) END AS namespace, split(concat('h', CAST(p_size AS VARCHAR(20)), '.example.org,', CASE WHEN p_size % 5 = 0 THEN '$(host)' ELSE 'www.example.org' END), ',') AS hosts, split(concat('/V', CAST(p_size % 3 AS VARCHAR(20)), '/,/Items/{id}'), ',') AS paths, split(concat('webAppName=web', CAST(p_size AS VARCHAR(20)), ',slot=x'), ',') AS targets FROM part",
    "found_items": "SELECT concat('i', CAST(l_partkey % 400 AS VARCHAR(20))) AS id, CASE WHEN l_linenumber % 3 = 0 THEN 'contract' ELSE 'code' END AS source, CASE WHEN l_linenumber % 2 = 0 THEN 'runtime' ELSE 'tests_target' END AS role, CASE WHEN l_suppkey % 7 = 0 THEN '' WHEN l_suppkey % 7 < 5 THEN 'GET' ELSE 'POST' END AS method, concat('/v', CAST(l_linenumber % 2 AS VARCHAR(20))) AS path, CASE WHEN l_quantity > 49 THEN 'medium' ELSE 'high' END AS confidence FROM lineitem",
    "services": "SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))) AS source_id, s_name AS name, split(concat('Svc', CAST(s_nationkey AS VARCHAR(20)), ',SVC', CAST(s_nationkey AS VARCHAR(20)), ',,x', CAST(s_suppkey % 5 AS VARCHAR(20))), ',') AS aliases, CASE WHEN s_suppkey % 10 = 0 THEN 'gone' ELSE NULL END AS deleted_at FROM supplier",
    "linked_aliases": "SELECT concat('X', CAST(c_custkey % 7 AS VARCHAR(20))) AS alias, concat('s', CAST(c_custkey % 90 AS VARCHAR(20))) AS source_id, CASE WHEN c_custkey % 11 = 0 THEN 'gone' ELSE NULL END AS deleted_at FROM customer",
    "open_items": "SELECT event_id AS id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'outbound_http' WHEN 1 THEN 'messaging' WHEN 2 THEN 'inbound_http' ELSE 'table' END AS kind, concat('f', CAST(user_id AS VARCHAR(20))) AS file, CASE WHEN event_id % 3 = 0 THEN 'unknown' WHEN event_id % 3 = 1 THEN 'config' ELSE NULL END AS base_url_source, CASE WHEN user_id % 2 = 0 THEN 'POST' WHEN user_id % 5 = 0 THEN NULL ELSE 'GET' END AS method, concat('/', event_type) AS path, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE 'literal' END AS name_from, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS entity, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'p' END AS payload, CASE WHEN event_id % 3 = 1 THEN NULL ELSE 'r' END AS request, CASE WHEN event_id % 5 = 2 THEN '' ELSE 's' END AS response_schema FROM events",
    "ledger_files": "SELECT concat('f', CAST(o_orderkey AS VARCHAR(20))) AS path, CASE WHEN o_custkey % 3 = 0 THEN 'source' ELSE 'config' END AS class, CASE o_orderstatus WHEN 'F' THEN 'pending' WHEN 'O' THEN 'extracted' ELSE 'skipped:large' END AS status, o_custkey % 2 = 0 AS touched, o_custkey % 5 = 0 AS partial, o_orderkey % 3 = 0 AS silent_client FROM orders",
    "evidence": "SELECT CASE WHEN event_id % 3 = 0 THEN 'package' ELSE 'host' END AS matched_by, CASE WHEN event_id % 3 = 0 THEN concat('com.', event_type, '.client') ELSE concat('api.', event_type, '.example.net') END AS text, event_id AS item, concat('sub', CAST(user_id % 4 AS VARCHAR(20))) AS subproject FROM events",
    "external_registry": "SELECT DISTINCT CAST(1 AS INT) AS ordinal, 'first' AS system, 'host' AS matched_by, concat('*.', min(event_type), '.example.net') AS pattern FROM events UNION ALL SELECT DISTINCT 2, 'second', 'host', concat('api.', max(event_type), '.*') FROM events UNION ALL SELECT DISTINCT 3, 'third', 'host', '*.example.???' FROM events UNION ALL SELECT DISTINCT 4, 'fourth', 'package', concat('com.', max(event_type), '*') FROM events",
    "settings": "SELECT concat('App-', event_type, ':Url') AS key, CASE WHEN user_id % 2 = 0 THEN 'default' ELSE 'uat' END AS env, concat('sub', CAST(user_id % 3 AS VARCHAR(20))) AS subproject, CASE WHEN event_type = 'click' THEN concat('https://c', CAST(min(user_id) AS VARCHAR(20))) ELSE concat('x/$', '{app_click.url}/$', '{none:y}') END AS value, 'property' AS source, 'f' AS file, CAST(min(user_id) AS INT) AS line FROM events GROUP BY concat('App-', event_type, ':Url'), CASE WHEN user_id % 2 = 0 THEN 'default' ELSE 'uat' END, concat('sub', CAST(user_id % 3 AS VARCHAR(20))), event_type",
    # linking
    "terms": "SELECT DISTINCT term, sid, confidence, canonical FROM (SELECT translate(lower(concat(split_part(replace(text, chr(10), ' '), ' ', 1), ' ', split_part(replace(text, chr(10), ' '), ' ', 2))), '.,;:!?', '') AS term, concat('s', CAST(item_id % 9 AS VARCHAR(20))) AS sid, CASE WHEN item_id % 3 = 0 THEN 'high' ELSE 'low' END AS confidence, item_id % 5 = 0 AS canonical FROM benchmark UNION ALL SELECT translate(lower(split_part(replace(text, chr(10), ' '), ' ', 3)), '.,;:!?', ''), concat('s', CAST(item_id % 9 AS VARCHAR(20))), 'medium', item_id % 13 = 0 FROM benchmark) t WHERE term NOT LIKE ' %' AND term NOT LIKE '% ' AND term != ''",
    "named_texts": "SELECT doc_id AS id, text FROM documents",
    "described": "SELECT concat('c', CAST(p_partkey AS VARCHAR(20))) AS chunk_id, concat('s', CAST(p_size % 4 AS VARCHAR(20))) AS sid, concat('# Calls', chr(10), CASE WHEN p_size % 2 = 0 THEN '## ' ELSE '| ' END, 'GET /Items/{id}', chr(10), '| `POST` | /orders |', chr(10), 'on `dev.orders-', CAST(p_size % 3 AS VARCHAR(20)), '` and `none`') AS text FROM part",
    "described_endpoints": "SELECT DISTINCT concat('e', CAST(p_size % 4 AS VARCHAR(20)), '-get') AS entity, concat('s', CAST(p_size % 4 AS VARCHAR(20))) AS sid, 'get' AS method, '/items/:key' AS path FROM part UNION SELECT DISTINCT concat('e', CAST(p_size % 4 AS VARCHAR(20)), '-post'), concat('s', CAST(p_size % 4 AS VARCHAR(20))), 'POST', '/orders' FROM part",
    "described_topics": "SELECT DISTINCT concat('t', CAST(p_size % 3 AS VARCHAR(20))) AS entity, concat('orders-', CAST(p_size % 3 AS VARCHAR(20))) AS name FROM part",
    # context
    "asked_entities": "SELECT item_id % 8 AS question_id, item_id % 5 AS ordinal, concat('e', CAST(item_id % 7 AS VARCHAR(20))) AS entity FROM benchmark",
    "describes": "SELECT concat('e', CAST(doc_id % 7 AS VARCHAR(20))) AS entity, doc_id AS chunk_id, CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'primary' WHEN 1 THEN 'index' WHEN 2 THEN 'events' ELSE 'other' END AS role FROM documents UNION ALL SELECT concat('e', CAST(doc_id % 5 AS VARCHAR(20))), doc_id, 'index' FROM documents",
    "question_nodes": "SELECT DISTINCT concat('q', CAST(l_partkey % 11 AS VARCHAR(20))) AS question_id, concat('n', CAST(l_partkey % 40 AS VARCHAR(20))) AS node FROM lineitem",
    "named_nodes": "SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))) AS source_id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE repeat(s_name, 20) END AS description FROM supplier",
    "flow_chains": "SELECT l_orderkey % 50 AS question_id, concat('s', CAST(l_suppkey % 20 AS VARCHAR(20))) AS service, CAST(l_linenumber AS INT) AS hop FROM lineitem",
    "flow_hits": "SELECT l_orderkey % 50 AS question_id, concat('s', CAST(l_suppkey % 20 AS VARCHAR(20))) AS service, l_partkey AS chunk_id, max(l_extendedprice) AS score FROM lineitem GROUP BY l_orderkey % 50, concat('s', CAST(l_suppkey % 20 AS VARCHAR(20))), l_partkey",
    # planning
    "phase_docs": "SELECT p_partkey AS doc_id, concat('intro', chr(10), '- before', chr(10), '## Phase ', CAST(p_size AS VARCHAR(20)), ': ', p_name, ' ', chr(10), '- ', p_brand, chr(10), 'text', chr(10), '2) ', p_type, ' ', chr(10), CASE WHEN p_size % 2 = 0 THEN 'release - 2' ELSE 'Phased out 3' END, chr(10), '* last') AS text FROM part",
    "doc_sections": "SELECT p_partkey AS doc_id, CASE CAST(p_size % 5 AS INT) WHEN 0 THEN 'Overview' WHEN 1 THEN 'Scope and Goals (all)' WHEN 2 THEN 'Non functional requirements list' WHEN 3 THEN 'Risk' ELSE 'Other' END AS section FROM part UNION ALL SELECT p_partkey, p_brand FROM part",
    "section_template": "SELECT 'Overview (short)' AS section, CAST(3.0 AS DOUBLE) AS weight UNION ALL SELECT 'Scope and Goals', CAST(2.0 AS DOUBLE) UNION ALL SELECT 'Non functional requirements of the system', CAST(2.5 AS DOUBLE) UNION ALL SELECT 'Risks', CAST(0.5 AS DOUBLE)",
    "section_docs": "SELECT p_partkey AS doc_id, concat('Some Title', chr(10), 'Overview', chr(10), CASE CAST(p_size % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'to be defined later' WHEN 2 THEN 'short one' ELSE concat('This section, it tells of ', p_name, ', and at length.') END, chr(10), 'Next Heading', chr(10), 'more') AS text FROM part",
    "template_areas": "SELECT p_size AS ordinal, min(p_name) AS area FROM part GROUP BY p_size",
    "always_rules": "SELECT 'HUB1' AS system, 'HUB2' AS requires UNION ALL SELECT 'S3', 'HUB3' UNION ALL SELECT 'S4', 'unknown'",
    "known_systems": "SELECT DISTINCT concat('S', CAST(s_suppkey % 24 AS VARCHAR(20))) AS system FROM supplier UNION SELECT 'HUB2' UNION SELECT 'HUB3'",
    "hub_links": "SELECT DISTINCT concat('S', CAST(s_suppkey % 24 AS VARCHAR(20))) AS src, concat('HUB', CAST(s_nationkey % 4 + 1 AS VARCHAR(20))) AS dst FROM supplier",
    "hub_systems": "SELECT 'HUB1' AS system UNION ALL SELECT 'HUB2' UNION ALL SELECT 'HUB4'",
    "system_chains": "SELECT DISTINCT concat('chain ', CAST(s_suppkey % 24 % 3 AS VARCHAR(20))) AS chain, CAST(s_suppkey % 24 AS INT) AS position, concat('S', CAST(s_suppkey % 24 AS VARCHAR(20))) AS system FROM supplier",
    "integration_links": "SELECT CAST(s_suppkey AS INT) AS ordinal, concat('S', CAST(s_suppkey % 24 AS VARCHAR(20))) AS src, CASE WHEN s_suppkey % 10 = 0 THEN 'ERP' ELSE concat('S', CAST(s_nationkey % 24 AS VARCHAR(20))) END AS dst, CASE WHEN s_suppkey % 3 = 0 THEN 'INT-13' ELSE 'INT-01' END AS unit_id, CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'odd' END AS criticality FROM supplier",
    # ingest
    "page_rows": "SELECT page_id AS id, html FROM pages",
    "rich_trees": "SELECT event_id AS id, concat('{\"type\":\"doc\",\"content\":[{\"type\":\"p\",\"content\":[{\"text\":\"', event_type, '\"},{\"text\":\"a \\\\\"b\\\\\"\"}]},{\"content\":[{\"text\": \"', CAST(user_id AS VARCHAR(20)), '\"}]}]}') AS tree, concat(event_type, ' a \"b\" ', CAST(user_id AS VARCHAR(20))) AS plain FROM events UNION ALL SELECT -event_id, event_type, event_type FROM events",
    "connections": "SELECT DISTINCT concat('postgresql://u:pw@Db', CAST(s_nationkey AS VARCHAR(20)), ':5432/Shop?x=1') AS text, 'postgresql' AS type, concat('db', CAST(s_nationkey AS VARCHAR(20))) AS host, 'Shop' AS database FROM supplier UNION SELECT DISTINCT concat('Server=tcp:SQL', CAST(s_nationkey AS VARCHAR(20)), ',1433;Initial Catalog=Main;Password=x'), 'sqlserver', concat('sql', CAST(s_nationkey AS VARCHAR(20))), 'Main' FROM supplier UNION SELECT DISTINCT concat('jdbc:sqlserver://h', CAST(s_nationkey AS VARCHAR(20)), ':1433;databaseName=orders'), 'sqlserver', concat('h', CAST(s_nationkey AS VARCHAR(20))), 'orders' FROM supplier UNION SELECT DISTINCT s_name, NULL, NULL, NULL FROM supplier",
    "built_pages": "SELECT p_partkey AS id, concat('<html><head><title>T &amp; t</title><style>a > b</style></head><body>', CASE WHEN p_partkey % 3 = 0 THEN '<noscript><p>off</p></noscript><template>x</template>' ELSE '<!-- <p>no</p> -->' END, '<h1 class=\"a\">', trim(p_name), '</h1> <H2>&Uuml;ber</H2><script>if (a < b) x</script><ul><li>', trim(p_brand), ' &amp; co</li><LI> caf&eacute; &#8217; &#x20AC; a&nbsp; b &unknown; &</LI></ul><div>one <b>two</b> &lt;x&gt;<br/>three</div>', CASE WHEN p_partkey % 2 = 0 THEN concat('<p></p>', chr(13), chr(10), chr(10), chr(10), '<p>last') ELSE '' END, ' </body></html>') AS html FROM part UNION ALL SELECT -1 - page_id, html FROM pages",
    "ticket_fields": "SELECT o_orderkey AS ticket, CAST(1 AS INT) AS ordinal, 'Summary' AS field, o_orderpriority AS text FROM orders UNION ALL SELECT o_orderkey, 2, 'Comment 1', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE repeat(concat(o_orderstatus, ' word. '), CAST(o_custkey % 400 AS INT)) END FROM orders",
    "issues": "SELECT concat('K-', CAST(o_orderkey AS VARCHAR(20))) AS key, CASE WHEN o_orderkey % 10 = 0 THEN 'Epic' ELSE 'Story' END AS kind, o_orderpriority AS summary, o_orderstatus AS status, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE concat('K-', CAST(o_orderkey - o_orderkey % 10 AS VARCHAR(20))) END AS parent, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS VARCHAR(20)) END AS account, CAST(o_orderdate AS VARCHAR(30)) AS updated FROM orders",
}

# values and forms

_POINTS = "CASE tier WHEN 0 THEN 25.0::DOUBLE WHEN 1 THEN 45.0 WHEN 2 THEN 62.5 ELSE 77.5 END"


@job(f"SELECT request_id, round(0.3::DOUBLE * {_POINTS} + 0.25::DOUBLE * greatest(0.0::DOUBLE, least(100.0::DOUBLE, detail)) + 0.2::DOUBLE * greatest(0.0::DOUBLE, least(100.0::DOUBLE, clarity)) + 0.15::DOUBLE * coalesce(history, 0.0::DOUBLE) + 0.1::DOUBLE * least(100.0::DOUBLE, coverage), 2) AS confidence FROM factor_rows", ("factor_rows",))
def confidence(rows):
    return rows.select("request_id", es.confidence(*[F.col(c) for c in ("tier", "detail", "clarity", "history", "coverage")]).alias("confidence"))


@job(
    """SELECT request_id, round((CASE WHEN team_size <= 2 THEN 1.0::DOUBLE WHEN team_size <= 5 THEN 1.1 WHEN team_size <= 10 THEN 1.2 ELSE 1.35 END) * (CASE WHEN cross_domain THEN 1.2::DOUBLE ELSE 1 END) * (CASE WHEN familiarity = 'high' THEN 1.25::DOUBLE ELSE 1 END)
    * (CASE WHEN volume = 'large' THEN 1.1::DOUBLE ELSE 1 END) * (CASE WHEN NOT multi_region OR regions <= 0 THEN 1.0::DOUBLE WHEN regions <= 3 THEN 1.2 WHEN regions <= 10 THEN 1.35 ELSE 1.5 END) * (CASE WHEN security THEN 1.2::DOUBLE ELSE 1 END) * (CASE WHEN legacy THEN 1.4::DOUBLE ELSE 1 END), 6) AS overhead FROM request_flags""",
    ("request_flags", "factor_table"),
)
def overhead_multiplier(flags, factors):
    return es.overhead_multiplier(flags, factors)


@job(
    """SELECT r.request_id, concat_ws(',', CASE WHEN effort < least THEN 'BELOW_LEAST' END, CASE WHEN effort > most THEN 'ABOVE_MOST' END, CASE WHEN hub AND NOT coalesce(ints, false) THEN 'HUB_WITHOUT_INTEGRATION' END, CASE WHEN pay AND NOT qa2 THEN 'PAYMENT_WITHOUT_TEST' END,
    CASE WHEN n >= 3 AND NOT coalesce(qa2, false) THEN 'SYSTEMS_WITHOUT_TEST' END, CASE WHEN erp AND NOT coalesce(erp_unit, false) THEN 'ERP_WITHOUT_UNIT' END, CASE WHEN security AND NOT coalesce(qa6, false) THEN 'SECURITY_WITHOUT_SCAN' END, CASE WHEN effort > 50 AND NOT coalesce(qa5, false) THEN 'LARGE_WITHOUT_LOAD_TEST' END) AS warnings
    FROM sized_requests r LEFT JOIN guards USING (scope)
    LEFT JOIN (SELECT request_id, bool_or(unit_id LIKE 'INT-%') AS ints, bool_or(unit_id IN ('BE-08', 'BE-09', 'INT-13')) AS pay, bool_or(unit_id IN ('BE-17', 'INT-07', 'INT-08')) AS erp_unit, bool_or(unit_id = 'QA-02') AS qa2, bool_or(unit_id = 'QA-06') AS qa6, bool_or(unit_id = 'QA-05') AS qa5 FROM unit_items GROUP BY 1) u ON u.request_id = r.request_id
    LEFT JOIN (SELECT request_id, count(DISTINCT system) AS n, bool_or(system IN ('HUB1', 'HUB2')) AS hub, bool_or(contains(system, 'ERP')) AS erp FROM request_systems GROUP BY 1) s ON s.request_id = r.request_id""",
    ("sized_requests", "request_systems", "unit_items", "guards"),
)
def sanity_warnings(requests, systems, items, guards):
    return es.sanity_warnings(requests, systems, items, guards, ["HUB1", "HUB2"], "ERP").select("request_id", F.array_join("warnings", ",").alias("warnings"))


@job(
    """, top AS (SELECT request_id, discipline AS top, person_months AS most FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY person_months DESC, discipline) AS n FROM months) WHERE n = 1),
    lead AS (SELECT top.*, greatest(1, least(10, coalesce(people, 5))) AS lead FROM top LEFT JOIN suggested_team t ON t.request_id = top.request_id AND t.discipline = top.top)
    SELECT t.request_id, t.discipline, CAST(CASE WHEN l.top IS NULL THEN t.people WHEN t.discipline = l.top THEN l.lead ELSE greatest(1, round_even(l.lead * coalesce(m.person_months, 0.0) / l.most, 0)) END AS INTEGER) AS people
    FROM suggested_team t LEFT JOIN lead l ON l.request_id = t.request_id LEFT JOIN months m ON m.request_id = t.request_id AND m.discipline = t.discipline""",
    ("months", "suggested_team"),
)
def normalized_team(months, team):
    return es.normalized_team(months, team)


@job("SELECT request_id, discipline, CAST(greatest(1, round_even(person_months / 4, 0)) AS INTEGER) AS people FROM months", ("months",))
def team_sizes(months):
    return es.team_sizes(months)


@job("SELECT id, earlier, CAST(CASE WHEN earlier >= 6 THEN 95 WHEN earlier >= 4 THEN 80 WHEN earlier >= 2 THEN 60 WHEN earlier = 1 THEN 30 ELSE 0 END AS INTEGER) AS points FROM (SELECT id, (SELECT count(*) FROM projects q WHERE q.domain IS NOT DISTINCT FROM p.domain AND q.stream = p.stream AND q.planned_end < p.planned_end) AS earlier FROM projects p)", ("projects",))
def domain_history(projects):
    return es.domain_history(projects.withColumn("created_at", F.col("planned_end").cast("timestamp"))).select("id", "earlier", "points")


@job("SELECT path, form FROM path_forms", ("path_forms",))
def norm_path(paths):
    return paths.select("path", tx.norm_path(F.col("path")).alias("form"))


@job("SELECT topic, form FROM topic_forms", ("topic_forms",))
def norm_topic(topics):
    return topics.select("topic", tx.norm_topic(F.col("topic")).alias("form"))


# registries

@job(
    """, names AS (SELECT sid, infra_kind AS k, name, namespace AS ns FROM infra_items WHERE infra_kind IN ('k8s-service', 'compose-service')), i AS (SELECT sid, unnest(hosts) AS host, paths FROM infra_items WHERE infra_kind = 'k8s-ingress'),
    every AS (SELECT lower(name) AS host, sid, k AS source, CAST(NULL AS VARCHAR) AS prefix FROM names UNION SELECT lower(name || '.' || ns), sid, k, NULL FROM names WHERE k = 'k8s-service' AND ns IS NOT NULL UNION SELECT lower(name || '.' || ns || '.svc.cluster.local'), sid, k, NULL FROM names WHERE k = 'k8s-service' AND ns IS NOT NULL
    UNION SELECT host, sid, 'k8s-ingress', CASE WHEN p LIKE '/V%' THEN rtrim(lower(p), '/') ELSE '/items/{}' END FROM (SELECT sid, host, unnest(paths) AS p FROM i) UNION SELECT replace(lower(targets[1]), 'webappname=', '') || '.azurewebsites.net', sid, 'app-service', NULL FROM infra_items)
    SELECT host, sid, source, prefix FROM every WHERE host NOT LIKE '$(%'""",
    ("infra_items",),
)
def host_index(items):
    return rg.host_index(items)


_LONG = "SELECT id, source, role, 'method' AS name, method AS value FROM found_items UNION ALL SELECT id, source, role, 'path', path FROM found_items"


@job(
    f""", f AS (SELECT *, bool_or(source = 'code') OVER (PARTITION BY id) AS has FROM ({_LONG})), p AS (SELECT *, NOT has OR source = 'code' AS mine FROM f), r AS (SELECT *, bool_or(mine AND role = 'runtime') OVER (PARTITION BY id) AS runs FROM p),
    q AS (SELECT *, mine AND (NOT runs OR role = 'runtime') AS first FROM r), s AS (SELECT id, name, list_sort(list(DISTINCT value)) AS every, list_sort(list(DISTINCT value) FILTER (first)) AS own FROM q WHERE value != '' GROUP BY ALL),
    v AS (SELECT id, name, CASE WHEN len(every) > 1 AND len(own) > 0 THEN own ELSE every END AS vals FROM s) SELECT id, name, array_to_string(vals, ',') AS vals, len(vals) > 1 AS conflict FROM v""",
    ("found_items",),
)
def merged_attributes(items):
    rows = items.withColumn("attributes", F.create_map(F.lit("method"), "method", F.lit("path"), "path"))
    return rg.merged_attributes(rows).select("id", "name", F.array_join("values", ",").alias("vals"), "conflict")


@job(
    """, r AS (SELECT sid, count(DISTINCT (method, path)) AS routes FROM routes GROUP BY 1), p AS (SELECT sid, string_agg(DISTINCT topic, ',' ORDER BY topic) AS publishes FROM publishers GROUP BY 1), s AS (SELECT sid, string_agg(DISTINCT topic, ',' ORDER BY topic) AS subscribes FROM subscribers GROUP BY 1),
    a AS (SELECT sid, string_agg(DISTINCT store, ',' ORDER BY store) AS stores FROM access GROUP BY 1), e AS (SELECT dst AS sid, string_agg(DISTINCT src, ',' ORDER BY src) AS callers FROM raw_edges WHERE src != dst GROUP BY 1)
    SELECT sid, coalesce(routes, 0) AS routes, coalesce(publishes, '') AS publishes, coalesce(subscribes, '') AS subscribes, coalesce(stores, '') AS stores, coalesce(callers, '') AS callers FROM r FULL JOIN p USING (sid) FULL JOIN s USING (sid) FULL JOIN a USING (sid) FULL JOIN e USING (sid)""",
    ("routes", "publishers", "subscribers", "access", "raw_edges"),
)
def service_registry(routes, publishers, subscribers, access, edges):
    calls = edges.select(F.col("src").alias("caller"), F.col("dst").alias("sid"))
    return rg.service_registry(routes, publishers, subscribers, access, calls).select("sid", "routes", *[F.array_join(c, ",").alias(c) for c in ("publishes", "subscribes", "stores", "callers")])


@job(
    """, m AS (SELECT source_id, list_sort(list(DISTINCT alias)) AS more FROM linked_aliases WHERE deleted_at IS NULL GROUP BY 1), e AS (SELECT s.source_id, name, unnest(list_concat(aliases, coalesce(more, []))) AS a, generate_subscripts(list_concat(aliases, coalesce(more, [])), 1) AS i FROM services s LEFT JOIN m USING (source_id) WHERE deleted_at IS NULL),
    f AS (SELECT *, row_number() OVER (PARTITION BY source_id, lower(a) ORDER BY i) AS n FROM e WHERE a != '') SELECT source_id, name, string_agg(a, ',' ORDER BY i) AS aliases FROM f WHERE n = 1 GROUP BY ALL""",
    ("services", "linked_aliases"),
)
def list_services(services, linked):
    return rg.list_services(services, linked).select("source_id", "name", F.array_join("aliases", ",").alias("aliases"))


_ROUTE = "coalesce(method, 'ANY') || ' ' || path"


@job(
    f"""SELECT 'unresolved_base_url' AS type, file, id AS item, {_ROUTE} || ': base URL source unknown' AS reason FROM open_items WHERE kind = 'outbound_http' AND coalesce(base_url_source, 'unknown') = 'unknown'
    UNION SELECT 'unresolved_entity', file, id, 'entity name not resolved' FROM open_items WHERE kind = 'messaging' AND (name_from = 'unknown' OR entity IS NULL) UNION SELECT 'missing_payload', file, id, 'payload type not resolved' FROM open_items WHERE kind = 'messaging' AND payload IS NULL
    UNION SELECT 'missing_schema', file, id, {_ROUTE} || ': no request schema' FROM open_items WHERE kind = 'inbound_http' AND method = 'POST' AND request IS NULL UNION SELECT 'missing_schema', file, id, {_ROUTE} || ': no response schema' FROM open_items WHERE kind = 'inbound_http' AND response_schema = ''
    UNION SELECT 'partial_parse', path, NULL, 'unresolved or unsupported construct' FROM ledger_files WHERE status = 'pending' AND partial UNION SELECT 'untouched_source', path, NULL, 'no extractor opened this source file' FROM ledger_files WHERE status = 'pending' AND NOT partial AND class = 'source' AND NOT touched
    UNION SELECT 'untouched_file', path, NULL, class || ' file left pending' FROM ledger_files WHERE status = 'pending' AND NOT partial AND (class != 'source' OR touched) UNION SELECT 'silent_client_file', path, NULL, 'uses a client but yielded no item' FROM ledger_files WHERE status NOT LIKE 'skipped%' AND class = 'source' AND touched AND silent_client""",
    ("open_items", "ledger_files"),
)
def gap_report(items, files):
    return rg.gap_report(items, files)


@job(
    """, h AS (SELECT e.*, r.system, row_number() OVER (PARTITION BY e.matched_by, e.text, e.item ORDER BY r.ordinal) AS n FROM evidence e JOIN external_registry r ON r.matched_by = e.matched_by AND e.text LIKE replace(replace(r.pattern, '*', '%'), '?', '_'))
    SELECT system, subproject, min({'a': matched_by, 'b': text}).a AS matched_by, min({'a': matched_by, 'b': text}).b AS "match", count(DISTINCT item) AS items FROM h WHERE n = 1 GROUP BY system, subproject""",
    ("evidence", "external_registry"),
)
def external_systems(evidence, registry):
    return rg.external_systems(evidence, registry)


@job(
    """, d AS (SELECT *, CASE WHEN env = 'uat' THEN 0 ELSE 1 END AS e FROM settings), pick AS (SELECT key, subproject, arg_min(value, (e, line)) AS value FROM d GROUP BY key, subproject)
    SELECT p.key, 'uat' AS env, p.subproject, CASE WHEN p.key = 'App-click:Url' THEN p.value ELSE 'x/' || c.value || '/y' END AS value FROM pick p LEFT JOIN pick c ON c.key = 'App-click:Url' AND c.subproject = p.subproject""",
    ("settings",),
)
def resolve_config(settings):
    return rg.resolve_config(settings.select(F.lower("key").alias("key"), F.lit("uat").alias("env"), "subproject").distinct(), settings).join(settings.select(F.lower("key").alias("key"), F.col("key").alias("_key")).distinct(), "key").select(F.col("_key").alias("key"), "env", "subproject", "value")


# linking

_GRAM = r"' ' || array_to_string(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), '  ') || ' '"
_FOUND = f""", pattern AS (SELECT string_agg(gram, '|' ORDER BY length(gram) - length(replace(gram, '  ', ' ')) DESC, gram) AS p FROM (SELECT DISTINCT ' ' || replace(term, ' ', '  ') || ' ' AS gram FROM terms)),
    found AS (SELECT id, replace(trim(m), '  ', ' ') AS term, count(*) AS count FROM (SELECT id, unnest(regexp_extract_all({_GRAM.format("text")}, (SELECT p FROM pattern))) AS m FROM named_texts) GROUP BY ALL)"""


@job(_FOUND + " SELECT id, term, count FROM found", ("terms", "named_texts"))
def find_terms(terms, texts):
    return ln.find_terms(texts, terms)


_RANKED = "CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END"


@job(
    _FOUND + f""", sure AS (SELECT term, list_sort(list(DISTINCT sid)) AS c, max({_RANKED}) AS s FROM terms GROUP BY term)
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY CASE WHEN len(c) = 1 THEN 0 ELSE 1 END, s DESC NULLS LAST, length(term) DESC, term) AS INTEGER) AS rank, term, CASE WHEN len(c) = 1 THEN c[1] END AS entity, array_to_string(c, ',') AS candidates FROM found JOIN sure USING (term)""",
    ("terms", "named_texts"),
)
def resolve_entities(terms, texts):
    return ln.resolve_entities(texts, terms.withColumnRenamed("sid", "entity")).withColumn("candidates", F.array_join("candidates", ","))


_LINKED = _FOUND + """, whole AS (SELECT term, count(DISTINCT sid) > 1 AS many, bool_or(canonical) AS known FROM terms GROUP BY term), hit AS (SELECT f.id, f.term, f.count, t.sid, t.confidence, t.canonical, many, many AND NOT known AS unsure FROM found f JOIN terms t USING (term) JOIN whole USING (term)),
    tiered AS (SELECT *, CASE WHEN canonical THEN 'high' WHEN many THEN 'weak' WHEN contains(term, ' ') AND confidence IN ('high', 'medium') THEN 'medium' ELSE 'weak' END AS tier FROM hit WHERE NOT unsure),
    links AS (SELECT * FROM (SELECT id, sid, CASE WHEN bool_or(tier = 'high') THEN 'high' WHEN bool_or(tier = 'medium') THEN 'medium' WHEN count(DISTINCT CASE WHEN tier = 'weak' THEN term END) >= 2 AND bool_or(tier = 'weak' AND contains(term, ' ')) THEN 'low' END AS confidence, list(DISTINCT term) AS ts, sum(count) AS n FROM tiered GROUP BY id, sid) WHERE confidence IS NOT NULL),
    amb AS (SELECT h.id, h.term, h.sid, h.count, count(*) OVER (PARTITION BY h.id, h.term) AS k FROM hit h JOIN links l ON l.id = h.id AND l.sid = h.sid WHERE unsure), more AS (SELECT id, sid, list(DISTINCT term) AS ts2, sum(count) AS n2 FROM amb WHERE k = 1 GROUP BY id, sid)"""


@job(_LINKED + " SELECT l.id, l.sid, confidence, array_to_string(list_sort(list_distinct(list_concat(ts, coalesce(ts2, [])))), ',') AS matched, CAST(n + coalesce(n2, 0) AS BIGINT) AS hits FROM links l LEFT JOIN more m ON m.id = l.id AND m.sid = l.sid", ("terms", "named_texts"))
def link_documents(terms, texts):
    return ln.link_documents(texts, terms).withColumn("matched", F.array_join("matched", ","))


@job(_LINKED + " SELECT h.id, h.term, string_agg(DISTINCT h.sid, ',' ORDER BY h.sid) AS candidates FROM hit h LEFT JOIN links l ON l.id = h.id AND l.sid = h.sid WHERE unsure GROUP BY h.id, h.term HAVING count(l.sid) != 1", ("terms", "named_texts"))
def skipped_terms(terms, texts):
    return ln.skipped_terms(texts, terms).withColumn("candidates", F.array_join("candidates", ","))


@job(_LINKED + " SELECT n.id AS chunk_id, coalesce(string_agg(DISTINCT l.sid, ',' ORDER BY l.sid), '') AS service_ids FROM named_texts n LEFT JOIN links l ON l.id = n.id GROUP BY n.id", ("terms", "named_texts"))
def tag_chunks(terms, texts):
    chunks = texts.select(F.col("id").alias("chunk_id"), F.col("id").alias("parent"))
    former = chunks.select("chunk_id", F.lit("s0").alias("sid"), F.lit("names").alias("source"))
    return ln.tag_chunks(chunks, ln.link_documents(texts, terms), former, "names")[0].select("chunk_id", F.array_join("service_ids", ",").alias("service_ids"))


@job("SELECT chunk_id, concat('e', substr(sid, 2), '-get') AS entity, CASE WHEN contains(text, '## GET') THEN 'primary' ELSE 'index' END AS role FROM described UNION ALL SELECT chunk_id, concat('e', substr(sid, 2), '-post'), 'index' FROM described UNION ALL SELECT chunk_id, 't' || regexp_extract(text, 'dev.orders-(\\d)', 1), 'events' FROM described", ("described", "described_endpoints", "described_topics"))
def link_chunks(chunks, endpoints, topics):
    return ln.link_chunks(chunks, endpoints, topics)


@job(
    """, msg AS (SELECT sid, topic, 'publish' AS d FROM publishers UNION ALL SELECT sid, topic, 'subscribe' FROM subscribers), e AS (SELECT DISTINCT sid AS source, 'EXPOSES' AS rel_type, sid || ' ' || upper(method) || ' ' || CASE WHEN path LIKE '%items' THEN regexp_replace(path, ':id', '{}') ELSE replace(replace(path, ':id', '{}'), ':kind', '{}') END AS target FROM routes
    UNION SELECT sid, CASE WHEN access = 'write' THEN 'WRITES' ELSE 'READS' END, store || '.' || "table" FROM access UNION SELECT subproject, 'USES_CONFIG', subproject || ':' || key FROM settings UNION SELECT sid, CASE WHEN d = 'publish' THEN 'PUBLISHES' ELSE 'SUBSCRIBES' END, replace(replace(topic, 'prod-', ''), '.dev', '') FROM msg)
    SELECT rel_type, count(*) AS edges, count(DISTINCT target) AS targets, min(target) AS first, max(target) AS last FROM e GROUP BY rel_type""",
    ("services", "routes", "access", "settings", "publishers", "subscribers"),
)
def service_graph_rows(services, routes, access, settings, publishers, subscribers):
    messaging = publishers.select("sid", "topic", F.lit("publish").alias("direction")).unionByName(subscribers.select("sid", "topic", F.lit("subscribe").alias("direction")))
    _, edges = ln.service_graph_rows(services.select(F.col("source_id").alias("sid"), "name"), routes, access, settings.select(F.col("subproject").alias("sid"), "key"), messaging)
    return edges.groupBy("rel_type").agg(F.count("*").alias("edges"), F.count_distinct("target").alias("targets"), F.min("target").alias("first"), F.max("target").alias("last"))


# context

@job(
    """, a AS (SELECT question_id, entity, min(ordinal) AS ordinal FROM asked_entities GROUP BY ALL), b AS (SELECT entity, chunk_id, min(CASE role WHEN 'primary' THEN 1 WHEN 'events' THEN 2 WHEN 'index' THEN 3 ELSE 4 END) AS role FROM describes GROUP BY ALL),
    r AS (SELECT question_id, entity, ordinal, b.chunk_id, role, display_text AS text, length(display_text) AS n FROM a JOIN b USING (entity) JOIN chunks c ON c.chunk_id = b.chunk_id), f AS (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY ordinal, entity) AS u FROM r),
    t AS (SELECT *, row_number() OVER (PARTITION BY question_id, entity ORDER BY role, n, chunk_id) AS nth FROM f WHERE u = 1), s AS (SELECT *, sum(n) OVER (PARTITION BY question_id ORDER BY ordinal, entity, nth) - n AS before FROM t WHERE nth <= 2)
    SELECT question_id, entity, chunk_id, substring(text, 1, CAST(200 - before AS BIGINT)) AS text FROM s WHERE before < 200""",
    ("asked_entities", "describes", "chunks"),
)
def describing_chunks(asked, describes, chunks):
    return cx.describing_chunks(asked, describes, chunks.select("chunk_id", F.col("display_text").alias("text")), 2, 200)


VIEWS["titled"] = "SELECT page_id AS chunk_id, split_part(split_part(html, '<title>', 2), '</title>', 1) AS display_text FROM pages"


@job(_BM25.replace("FROM chunks", "FROM titled") + " SELECT query_id, rank, id, score FROM sparse WHERE rank <= 5", ("titled", "questions"))
def keyword_pages(pages, questions):
    return cx.keyword_pages(questions, pages.select(F.col("chunk_id").alias("page_id"), F.col("display_text").alias("title")))


@job(
    """, sides AS (SELECT src, dst FROM depends_on UNION SELECT dst, src FROM depends_on), roots AS (SELECT DISTINCT node FROM question_nodes), h1 AS (SELECT r.node AS root, b.dst AS node, 1 AS hop FROM roots r JOIN sides b ON b.src = r.node), h2 AS (SELECT DISTINCT h1.root, b.dst AS node, 2 AS hop FROM h1 JOIN sides b ON b.src = h1.node),
    near AS (SELECT root, node, min(hop) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) WHERE root != node GROUP BY ALL), q AS (SELECT question_id, near.node, min(hop) AS hop FROM question_nodes qn JOIN near ON near.root = qn.node GROUP BY ALL),
    n AS (SELECT question_id, '- ' || name || coalesce(': ' || left(description, 200), '') AS line, row_number() OVER (PARTITION BY question_id ORDER BY hop, q.node) AS nth FROM q JOIN named_nodes e ON e.source_id = q.node WHERE name != '') SELECT question_id, string_agg(line, chr(10) ORDER BY nth) AS block FROM n WHERE nth <= 20 GROUP BY question_id""",
    ("depends_on", "question_nodes", "named_nodes"),
)
def context_block(depends_on, asked, entities):
    return cx.context_block(asked, depends_on, entities)


@job(
    """, f AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY hop, service) AS place FROM (SELECT question_id, service, min(hop) AS hop FROM flow_chains GROUP BY ALL)), b AS (SELECT h.*, place, row_number() OVER (PARTITION BY h.question_id, h.service ORDER BY score DESC, chunk_id) AS nth FROM flow_hits h JOIN f ON f.question_id = h.question_id AND f.service = h.service WHERE place <= 5)
    SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY place, nth) AS INTEGER) AS ref, service, chunk_id FROM b WHERE nth <= 2""",
    ("flow_chains", "flow_hits"),
)
def per_service_topk(chains, hits):
    return cx.per_service_topk(chains, hits)


# planning

@job(
    """SELECT doc_id, CAST(1 AS INTEGER) AS ordinal, concat('Phase ', p_size, ': ', trim(p_name)) AS name, trim(p_brand) || '|' || trim(p_type) || CASE WHEN p_size % 2 = 0 THEN '' ELSE '|last' END AS use_cases FROM phase_docs JOIN part ON p_partkey = doc_id UNION ALL SELECT p_partkey, 2, 'Phase 2', 'last' FROM part WHERE p_size % 2 = 0""",
    ("phase_docs",),
)
def detect_phases(docs):
    return pl.detect_phases(docs).withColumn("use_cases", F.array_join("use_cases", "|"))


@job("SELECT p_partkey AS doc_id, round(100.0::DOUBLE * CASE p_size % 5 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 2.0 WHEN 2 THEN 2.5 WHEN 3 THEN 0.5 ELSE 0 END / 8.0::DOUBLE, 1) AS percent FROM part", ("doc_sections", "section_template"))
def readiness(present, template):
    return pl.readiness(present, template)


@job("SELECT p_partkey AS doc_id, 'Overview (all of it)' AS section, CASE p_size % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'placeholder' WHEN 2 THEN 'insufficient' ELSE 'filled' END AS status FROM part", ("section_docs",))
def section_quality(docs):
    return pl.section_quality(docs, docs.select("doc_id", F.lit("Overview (all of it)").alias("section")))


_LONG_WORDS = "list_distinct(list_filter(string_split_regex({}, '\\s+'), lambda w: length(w) > 3))"


@job(
    f""", i AS (SELECT DISTINCT name, lower(trim(name)) AS n FROM scope_items), a AS (SELECT ordinal, area, lower(trim(area)) AS a FROM template_areas), w AS (SELECT i.name, ordinal, area, n, a, {_LONG_WORDS.format("n")} AS nw, {_LONG_WORDS.format("a")} AS aw FROM i, a),
    m AS (SELECT name, arg_min(area, ordinal) AS area FROM w WHERE contains(n, a) OR contains(a, n) OR (len(nw) > 0 AND len(aw) > 0 AND len(list_intersect(nw, aw)) >= least(len(nw), len(aw)) * 0.5) GROUP BY name) SELECT doc_id, id, area FROM scope_items LEFT JOIN m USING (name)""",
    ("scope_items", "template_areas"),
)
def template_match(items, areas):
    return pl.template_match(items, areas)


@job(
    """, have AS (SELECT DISTINCT request_id, system, count(*) OVER (PARTITION BY request_id) AS n FROM request_systems), near AS (SELECT src AS system, dst AS hub FROM hub_links UNION SELECT dst, src FROM hub_links),
    more AS (SELECT request_id, requires AS system, 1 AS why FROM have JOIN always_rules USING (system) WHERE n > 1 AND requires IN (SELECT system FROM known_systems) UNION ALL SELECT request_id, hub, 2 FROM have JOIN near USING (system) WHERE n >= 3 AND hub IN (SELECT system FROM hub_systems) GROUP BY request_id, hub HAVING count(*) >= 2
    UNION ALL SELECT s.request_id, c.system, 3 FROM (SELECT request_id, chain, min(position) AS lo, max(position) AS hi FROM have JOIN system_chains USING (system) GROUP BY ALL HAVING count(*) >= 3) s JOIN system_chains c ON c.chain = s.chain AND c.position BETWEEN lo AND hi WHERE c.system IN (SELECT system FROM known_systems))
    SELECT request_id, system, CASE min(why) WHEN 1 THEN 'always' WHEN 2 THEN 'hub' ELSE 'chain' END AS reason FROM more WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.request_id = more.request_id AND h.system = more.system) GROUP BY request_id, system""",
    ("request_systems", "known_systems", "always_rules", "hub_links", "hub_systems", "system_chains"),
)
def augment_systems(requests, known, always, links, hubs, chains):
    return pl.augment_systems(requests, known, always, links, hubs, chains)


@job(
    """, have AS (SELECT DISTINCT request_id, system FROM request_systems), met AS (SELECT a.request_id, l.* FROM integration_links l JOIN have a ON a.system = l.src JOIN have b ON b.system = l.dst AND b.request_id = a.request_id WHERE src != 'ERP' AND dst != 'ERP'
      AND NOT EXISTS (SELECT 1 FROM unit_items u WHERE u.request_id = a.request_id AND u.unit_id = l.unit_id AND u.system IN (l.src, l.dst))),
    fresh AS (SELECT * FROM met m WHERE NOT EXISTS (SELECT 1 FROM met e WHERE e.request_id = m.request_id AND e.unit_id = m.unit_id AND e.src = m.dst AND e.ordinal < m.ordinal)),
    one AS (SELECT request_id, src AS system, unit_id, min(ordinal) AS ordinal, arg_min(CASE criticality WHEN 'critical' THEN 'complex' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'simple' WHEN 'low' THEN 'simple' ELSE 'medium' END, ordinal) AS complexity FROM fresh GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE complexity WHEN 'complex' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, ordinal) AS nth FROM one) SELECT request_id, system, unit_id, complexity FROM n WHERE nth <= 8""",
    ("request_systems", "unit_items", "integration_links"),
)
def missing_integrations(requests, items, links):
    return pl.missing_integrations(requests, items, links, "ERP")


# ingest

def _steps(column: str) -> str:
    """The given pages' text by the same steps in the other engine's replacements."""
    entities = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
    out = f"coalesce({column}, '')"
    for pattern, replacement in (*ig.HTML_STEPS, *entities, *ig.SPACE_STEPS):
        flags = "g" + ("i" if "i" in pattern[:5] and pattern.startswith("(?") else "") + ("s" if pattern.startswith("(?") and "s" in pattern[:5] else "")
        bare = pattern.split(")", 1)[1] if pattern.startswith("(?") else pattern
        out = f"regexp_replace({out}, '{bare}', {' || chr(10) || '.join(repr(x) for x in replacement.split(chr(10))) if chr(10) in replacement else chr(39) + replacement.replace(chr(39), 2 * chr(39)) + chr(39)}, '{flags}')"
    return out


@job(
    f"""SELECT p_partkey AS id, concat('# ', trim(p_name), chr(10), chr(10), '## Über', chr(10), chr(10), '- ', trim(p_brand), ' & co', chr(10), chr(10), '- café ’ € a b &unknown; &', chr(10), chr(10), 'one two <x>', chr(10), 'three', CASE WHEN p_partkey % 2 = 0 THEN concat(chr(10), chr(10), 'last') ELSE '' END) AS text FROM part
    UNION ALL SELECT -1 - page_id, {_steps('html')} FROM pages""",
    ("built_pages",),
)
def html_to_text(pages):
    return pages.select("id", ig.html_to_text(F.col("html")).alias("text"))


@job("SELECT id, plain AS text FROM rich_trees", ("rich_trees",))
def rich_text(trees):
    return trees.select("id", ig.rich_text(F.col("tree")).alias("text"))



@job("SELECT text, type, host, database FROM connections", ("connections",))
def store_identity(rows):
    return rows.select("text", ig.store_identity(F.col("text")).alias("s")).select("text", "s.*")


@job("SELECT chunk_id AS doc_id, md5(display_text) AS joined, 0::BIGINT AS too_long, 0::BIGINT AS too_short FROM chunks WHERE display_text != ''", ("chunks",))
def chunk_markdown(chunks):
    """The segments joined again, and how many have more than the bound (of 100 and nearly 40
    tokens) or, the last one aside, fewer than 40."""
    parts = ig.chunk_markdown(chunks.select(F.col("chunk_id").alias("doc_id"), F.col("display_text").alias("text")), 100, 40)
    whole = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "original_segment"))), lambda x: x["original_segment"])
    size = F.length("original_segment")
    last = F.max("chunk_index").over(Window.partitionBy("doc_id"))
    marked = parts.withColumn("short", (size < 160) & (F.col("chunk_index") < last))
    return marked.groupBy("doc_id").agg(F.md5(F.array_join(whole, "").cast("binary")).alias("joined"), F.count_if(size >= 560).alias("too_long"), F.count_if("short").alias("too_short"))


@job("SELECT ticket, md5(string_agg(text, '' ORDER BY ordinal)) AS joined, max(CASE WHEN ordinal = 2 THEN 'Comment' ELSE 'Summary' END) AS last_title, sum(CAST(ceil(length(text) / 240.0) AS BIGINT))::BIGINT AS chunks, max(least(length(text), 240))::BIGINT AS longest FROM ticket_fields WHERE text != '' GROUP BY ticket", ("ticket_fields",))
def chunk_ticket(fields):
    """The segments joined again, their number and the longest one: 30 sentences of 8 signs fit."""
    parts = ig.chunk_ticket(fields, 60)
    whole = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "original_segment"))), lambda x: x["original_segment"])
    return parts.groupBy("ticket").agg(F.md5(F.array_join(whole, "").cast("binary")).alias("joined"), F.replace(F.max("section_title"), F.lit("Comments"), F.lit("Comment")).alias("last_title"), F.count("*").alias("chunks"), F.max(F.length("original_segment")).cast("long").alias("longest"))


@job(
    """SELECT label, count(*) AS n, count(DISTINCT source_id) AS ids FROM (SELECT CASE WHEN kind = 'Epic' THEN 'Epic' ELSE 'Ticket' END AS label, 'ticket:' || key AS source_id FROM issues UNION ALL SELECT DISTINCT 'Person', 'person:' || account FROM issues WHERE account IS NOT NULL
    UNION ALL SELECT 'ASSIGNED_TO', 'ticket:' || key FROM issues WHERE account IS NOT NULL UNION ALL SELECT 'PART_OF', 'ticket:' || key FROM issues WHERE parent IS NOT NULL) GROUP BY label""",
    ("issues",),
)
def extract_issue(issues):
    rows = issues.withColumn("assignee", F.when(F.col("account").isNotNull(), F.struct(F.col("account").alias("accountId"), F.concat(F.lit("name "), "account").alias("displayName"))))
    entities, edges = ig.extract_issue(rows)
    both = entities.select("label", "source_id").unionByName(edges.select(F.col("rel_type").alias("label"), "source_id"))
    return both.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("ids"))
