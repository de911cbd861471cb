"""The test tables in the roles that jobs expect, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.records import table

#: line items with one row for each (order, line)
LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_shipdate) AS l_shipdate, min(l_quantity) AS l_quantity, min(l_linestatus) AS l_linestatus, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber)"

VIEWS: dict[str, str] = {
    "mps": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, 'Green' AS rag_status FROM region",
    "cps": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS parent_mp_id, CASE WHEN n_nationkey % 3 = 0 THEN 'Yellow' ELSE 'Green' END AS rag_status FROM nation",
    "projects": """SELECT o.o_orderkey AS id, concat('Project ', CAST(o.o_orderkey AS VARCHAR(20))) AS name, o.o_orderpriority AS project_type,
        CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE c.c_mktsegment END AS vendor, concat('owner ', CAST(o.o_custkey % 20 AS VARCHAR(20))) AS product_owner,
        CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE concat('lob ', CAST(c.c_nationkey % 4 AS VARCHAR(20))) END AS lob, 'bu' AS bu, CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE concat('domain ', CAST(c.c_nationkey % 5 AS VARCHAR(20))) END AS domain,
        concat('stream ', CAST(c.c_nationkey % 3 AS VARCHAR(20))) AS stream, CAST(c.c_nationkey AS BIGINT) AS parent_cp_id,
        CASE o.o_orderstatus WHEN 'F' THEN 'Green' WHEN 'O' THEN 'Yellow' ELSE 'Red' END AS rag_status, CAST(o.o_orderdate AS DATE) AS planned_end,
        CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 17 - 5 AS INT) END AS actual_end
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "milestones": f"""SELECT l.l_orderkey * 10 + l.l_linenumber AS id, l.l_orderkey AS project_id, CAST(l.l_shipdate AS DATE) AS planned_start, CAST(l.l_shipdate AS DATE) + CAST(l.l_quantity AS INT) AS planned_end,
        CAST(l.l_shipdate AS DATE) + 2 AS actual_start, CASE WHEN l.l_linestatus = 'F' THEN CAST(l.l_shipdate AS DATE) + CAST(l.l_quantity + l.l_partkey % 9 - 4 AS INT) ELSE NULL END AS actual_end,
        CASE l.l_returnflag WHEN 'A' THEN 'Green' WHEN 'N' THEN 'Green' ELSE 'Yellow' END AS rag_status FROM {LINES} l""",
    "tasks": f"""SELECT l.l_orderkey * 100 + l.l_linenumber AS id, l.l_orderkey * 10 + l.l_linenumber AS milestone_id, CAST(l.l_shipdate AS DATE) + 1 AS planned_start, CAST(l.l_shipdate AS DATE) + 5 AS planned_end,
        CASE WHEN l.l_partkey % 4 = 0 THEN NULL ELSE CAST(l.l_shipdate AS DATE) + 1 END AS actual_start, CASE WHEN l.l_partkey % 4 = 0 THEN NULL ELSE CAST(l.l_shipdate AS DATE) + 8 END AS actual_end,
        CASE WHEN l.l_partkey % 97 = 0 THEN 'Red' ELSE 'Green' END AS rag_status FROM {LINES} l""",
    "dependencies": f"SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS project_id, CASE WHEN l_returnflag = 'R' THEN 'Escalated' WHEN l_returnflag = 'A' THEN 'Resolved' ELSE 'Open' END AS status, CAST(l_shipdate AS DATE) AS cutoff_date FROM {LINES} l",
    "transactions": "SELECT l_orderkey AS project_id, CASE CAST(l_linenumber % 4 AS INT) WHEN 0 THEN 'PO' WHEN 1 THEN 'CR' WHEN 2 THEN 'Spend' ELSE 'Refund' END AS transaction_type, l_extendedprice AS amount FROM lineitem",
    "budgets": "SELECT o_orderkey AS project_id, CASE WHEN o_orderkey % 50 = 0 THEN 0.0 ELSE floor(o_totalprice * 25) / 100 END AS approved_budget FROM orders",
    "stages": f"SELECT l_orderkey AS project_id, CASE CAST(l_partkey % 8 AS INT) WHEN 0 THEN 'Initiation' WHEN 1 THEN 'Requirements' WHEN 2 THEN 'Design' WHEN 3 THEN 'Build' WHEN 4 THEN 'Test' WHEN 5 THEN 'Deploy' WHEN 6 THEN 'Hypercare' ELSE 'Closure' END AS stage, l_linenumber AS stage_order, CASE l_returnflag WHEN 'A' THEN 'Completed' WHEN 'R' THEN 'In_Progress' ELSE 'Not_Started' END AS status FROM {LINES} l",
    "history": "SELECT user_id AS entity, event_type AS field, ts, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'a' WHEN event_id % 3 = 1 THEN 'b' ELSE 'c' END AS value FROM events",
    "items": "SELECT l_orderkey AS request_id, CAST(l_partkey % 90 AS BIGINT) AS unit_id, concat('system ', CAST(l_suppkey % 60 AS VARCHAR(20))) AS system, CASE CAST(l_linenumber % 3 AS INT) WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'odd' END AS complexity, l_quantity AS quantity, CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN 'api' WHEN 1 THEN 'ui' WHEN 2 THEN 'test' ELSE 'other' END AS category FROM lineitem",
    "units": "SELECT p_partkey AS unit_id, CAST(p_size AS DOUBLE) / 10 AS simple, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 5 END AS medium, CAST(p_size AS DOUBLE) AS complex FROM part WHERE p_partkey < 81",
    "systems": "SELECT concat('system ', CAST(s_suppkey AS VARCHAR(20))) AS system, 1.0 + CAST(s_nationkey AS DOUBLE) / 50 AS multiplier FROM supplier WHERE s_suppkey < 44",
    "disciplines": "SELECT 'api' AS category, 'backend' AS discipline UNION ALL SELECT 'ui', 'frontend' UNION ALL SELECT 'test', 'qa'",
    "overrides": "SELECT concat('system ', CAST(s_suppkey AS VARCHAR(20))) AS system, 'integration' AS discipline FROM supplier WHERE s_suppkey < 10",
    "rates": "SELECT 'backend' AS discipline, 12000.0 AS monthly_rate UNION ALL SELECT 'qa', 8000.0",
    "proposals": "SELECT s_suppkey AS proposal_id, CAST(s_nationkey AS BIGINT) AS request_id, s_acctbal + 2000 AS vendor_cost, CASE WHEN s_suppkey % 9 = 0 THEN 0.0 ELSE 5000.0 END AS internal_cost, CAST(s_suppkey % 20 AS DOUBLE) AS vendor_timeline, 10.0 AS internal_timeline, CAST(s_suppkey % 130 AS DOUBLE) AS coverage, CAST(s_suppkey % 100 AS DOUBLE) AS quality, CAST(s_suppkey % 71 AS DOUBLE) AS cost, CAST(s_suppkey % 37 AS DOUBLE) - 5 AS delivery FROM supplier",
    "chunks": "SELECT doc_id AS chunk_id, text AS display_text, lang AS doc_type, source AS repo_name FROM documents",
    "questions": "SELECT item_id AS query_id, text FROM benchmark",
    "vectors": "SELECT vec_id AS id, embedding AS vector FROM embeddings",
    "vector_questions": "SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 25 = 0",
    "question_vectors": "SELECT item_id AS query_id, embedding AS vector FROM benchmark JOIN embeddings ON vec_id = item_id",
    "rankings": "SELECT user_id AS query_id, event_type AS list, event_id % 97 AS id, 1 + event_id % 13 AS rank FROM events",
    "depends_on": "SELECT DISTINCT concat('s', CAST(l_suppkey AS VARCHAR(20))) AS src, concat('n', CAST(l_partkey % 40 AS VARCHAR(20))) AS dst FROM lineitem UNION SELECT DISTINCT concat('n', CAST(l_partkey % 40 AS VARCHAR(20))), concat('c', CAST(l_partkey % 7 AS VARCHAR(20))) FROM lineitem",
    "entity_target": "SELECT o_orderkey AS source_id, o_orderstatus AS status, CAST(o_totalprice AS VARCHAR(30)) AS text_hash, CAST(o_orderdate AS DATE) AS updated_at, CAST(o_orderdate AS DATE) AS created_at FROM orders WHERE o_orderkey % 4 < 3",
    "entity_batch": "SELECT o_orderkey AS source_id, 'N' AS status, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS VARCHAR(30)) ELSE 'changed' END AS text_hash, CAST(o_orderdate AS DATE) + 9 AS updated_at, CAST(o_orderdate AS DATE) + 9 AS created_at FROM orders WHERE o_orderkey % 4 > 0",
    "calls": "SELECT event_id AS call_id, CASE event_type WHEN 'click' THEN 'GET' WHEN 'view' THEN 'POST' ELSE 'ANY' END AS method, concat('/v1/', event_type, '/', CAST(user_id % 50 AS VARCHAR(20)), '/items') AS path FROM events",
    "routes": "SELECT DISTINCT concat('r', event_type, CAST(user_id % 2 AS VARCHAR(20))) AS route_id, concat('svc', CAST(user_id % 2 AS VARCHAR(20))) AS sid, 'GET' AS method, concat('/v1/', event_type, CASE WHEN user_id % 2 = 0 THEN '/:id/items' ELSE '/:id/:kind' END) AS path FROM events",
    "publishers": "SELECT DISTINCT 'bus' AS broker, concat('prod-', event_type) AS topic, concat('p', CAST(user_id % 30 AS VARCHAR(20))) AS sid, CASE WHEN user_id % 3 = 0 THEN NULL ELSE concat('ns', CAST(user_id % 2 AS VARCHAR(20))) END AS namespace FROM events",
    "subscribers": "SELECT DISTINCT 'bus' AS broker, concat(event_type, '.dev') AS topic, concat('q', CAST(user_id % 20 AS VARCHAR(20))) AS sid, CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat('ns', CAST(user_id % 2 AS VARCHAR(20))) END AS namespace FROM events",
    "access": "SELECT DISTINCT 'db' AS store, concat('t', CAST(l_partkey % 200 AS VARCHAR(20))) AS \"table\", concat('s', CAST(l_suppkey % 50 AS VARCHAR(20))) AS sid, CASE WHEN l_linenumber % 2 = 0 THEN 'write' ELSE 'read' END AS access FROM lineitem",
    "packages": "SELECT DISTINCT concat('repo', CAST(l_suppkey % 20 AS VARCHAR(20))) AS repo, 'maven' AS ecosystem, concat('com.x:lib', CAST(l_partkey % 150 AS VARCHAR(20))) AS name, concat('1.', CAST(l_linenumber AS VARCHAR(20))) AS version FROM lineitem UNION SELECT DISTINCT concat('repo', CAST(l_suppkey % 20 AS VARCHAR(20))), 'maven', concat(CASE WHEN l_linenumber % 2 = 0 THEN 'com.y:only' ELSE 'org.z:only' END, CAST(l_partkey % 23 AS VARCHAR(20))), '2.0' FROM lineitem",
    "artifacts": "SELECT DISTINCT concat('repo', CAST(p_partkey % 20 AS VARCHAR(20))) AS repo, CASE WHEN p_partkey % 3 = 0 THEN 'maven' ELSE 'npm' END AS ecosystem, concat('com.x:lib', CAST(p_partkey % 150 AS VARCHAR(20))) AS name FROM part UNION SELECT DISTINCT concat('repo', CAST(p_partkey % 20 AS VARCHAR(20))), 'maven', concat('com.y:only', CAST(p_partkey % 20 AS VARCHAR(20))) FROM part",
    "raw_edges": "SELECT concat('s', CAST(l_suppkey % 30 AS VARCHAR(20))) AS src, concat('s', CAST(l_partkey % 30 AS VARCHAR(20))) AS dst, CASE WHEN l_linenumber % 3 = 0 THEN 'event' ELSE 'http' END AS kind, concat('via', CAST(l_linenumber AS VARCHAR(20))) AS via, CAST(l_orderkey AS VARCHAR(20)) AS item, CAST(l_suppkey AS VARCHAR(20)) AS repo, CAST(l_partkey AS VARCHAR(20)) AS evidence, CASE WHEN l_quantity > 49 THEN 'high' WHEN l_quantity > 20 THEN 'medium' ELSE 'low' END AS confidence FROM lineitem",
    "ledger": "SELECT o_orderpriority AS repo, o_orderstatus AS class, CASE WHEN o_orderkey % 1000 = 5 THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'scanned' ELSE 'extracted' END AS status, concat('l', CAST(o_custkey % 6 AS VARCHAR(20))) AS language FROM orders",
    "branches": "SELECT DISTINCT CAST(s_suppkey AS VARCHAR(20)) AS dealer, CAST(n_nationkey AS VARCHAR(20)) AS branch, n_name AS state, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "invoices": "SELECT concat(CAST(s_suppkey AS VARCHAR(20)), '_', CAST(s_nationkey AS VARCHAR(20))) AS dealer_branch, count(*) AS invoices FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_nationkey",
    "request_systems": "SELECT DISTINCT l_orderkey AS request_id, CASE CAST(l_suppkey % 24 AS INT) WHEN 0 THEN 'HUB1' WHEN 1 THEN 'HUB2' WHEN 2 THEN 'HUB3' WHEN 3 THEN 'HUB4' WHEN 4 THEN 'ERP' ELSE concat('S', CAST(l_suppkey % 24 AS VARCHAR(20))) END AS system FROM lineitem",
    "system_domains": "SELECT DISTINCT concat('S', CAST(s_suppkey % 24 AS VARCHAR(20))) AS system, CASE CAST(s_suppkey % 24 % 4 AS INT) WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'other' END AS domain FROM supplier",
    "system_links": "SELECT DISTINCT concat('S', CAST(s_suppkey % 24 AS VARCHAR(20))) AS src, CASE WHEN s_suppkey % 24 % 7 = 0 THEN 'ERP' ELSE 'HUB1' END AS dst FROM supplier",
    "document_kinds": "SELECT l_orderkey AS project_id, CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN 'brd' WHEN 1 THEN 'prd' WHEN 2 THEN 'hld' WHEN 3 THEN 'dependent_docs' ELSE 'other' END AS doc_kind FROM lineitem",
    "scope_items": "SELECT p_size AS doc_id, p_partkey AS id, p_name AS name FROM part",
    "scope_efforts": "SELECT p_size AS doc_id, concat(min(p_name), ' ', max(p_name)) AS effort_text FROM part GROUP BY p_size",
    "phase_repos": "SELECT o_orderpriority AS org, o_orderkey AS repo, CAST(o_custkey % 3 AS VARCHAR(20)) AS head_sha, CAST(o_custkey % 2 AS VARCHAR(20)) AS ledger_at FROM orders",
    "repo_phases": "SELECT o_orderpriority AS org, o_orderkey AS repo, CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'clone' WHEN 1 THEN 'inventory' ELSE 'extract' END AS phase, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'done' ELSE 'failed' END AS status, CAST(1 + o_custkey % 2 AS VARCHAR(20)) AS version, CAST(o_custkey % 6 AS VARCHAR(20)) AS input_sha, CAST(o_custkey % 4 AS VARCHAR(20)) AS ledger_at FROM orders",
    "flow_members": "SELECT concat('s', CAST(l_suppkey % 30 AS VARCHAR(20))) AS service, l_orderkey AS flow_id, min(CASE WHEN l_linenumber = 1 THEN 'entry' ELSE 'step' END) AS role, max(CAST(l_quantity AS INT)) AS length FROM lineitem GROUP BY concat('s', CAST(l_suppkey % 30 AS VARCHAR(20))), l_orderkey",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "conversations")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A binding as a DataFrame."""
    return bound(spark, folder, VIEWS[name])


def bound(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """The text of a binding as a DataFrame."""
    import re

    text = text.replace('"table"', "`table`")
    used = {t: table(spark, folder, t) for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)}
    text = text.replace("{", "{{").replace("}", "}}") if used else text
    return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], text), **used)


def with_views(*names: str) -> str:
    """The bindings as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n"
