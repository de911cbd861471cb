"""More registered queries: domains, tiers, scope items, phases, endpoints, flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scope_views as sc
from .queries import job

_HUBS = {"HUB1": 0.25, "HUB2": 0.15, "HUB3": 0.2, "HUB4": 0.1}
_SUM = " + ".join(["CASE WHEN in_north AND in_south THEN 0.2::DOUBLE ELSE 0 END", *[f"CASE WHEN {k.lower()} THEN {v}::DOUBLE ELSE 0 END" for k, v in _HUBS.items()], "CASE WHEN erp THEN 0.3::DOUBLE ELSE 0 END"])


@job(
    f"""SELECT request_id, in_north AND in_south AS is_cross_domain, least(round({_SUM}, 4), 0.6::DOUBLE) AS overhead FROM (SELECT request_id, coalesce(bool_or(domain = 'north'), false) AS in_north, coalesce(bool_or(domain = 'south'), false) AS in_south,
    {", ".join(f"bool_or(system = '{k}') AS {k.lower()}" for k in _HUBS)}, bool_or(system IN (SELECT src FROM system_links WHERE dst = 'ERP' UNION SELECT dst FROM system_links WHERE dst = 'ERP')) AS erp
    FROM request_systems LEFT JOIN system_domains USING (system) GROUP BY request_id)""",
    ("request_systems", "system_domains", "system_links"),
)
def cross_domain(requests, systems, links):
    return sc.cross_domain(requests, systems, links, ("north", "south"), 0.2, _HUBS, {"ERP": 0.3})


@job(
    "SELECT project_id, CAST(CASE WHEN NOT p THEN 0 WHEN h AND d THEN 3 WHEN h THEN 2 ELSE 1 END AS INT) AS tier, b AND p AS is_valid FROM (SELECT project_id, bool_or(doc_kind = 'brd') AS b, bool_or(doc_kind = 'prd') AS p, bool_or(doc_kind = 'hld') AS h, bool_or(doc_kind = 'dependent_docs') AS d FROM document_kinds GROUP BY project_id)",
    ("document_kinds",),
)
def input_tier(kinds):
    return sc.input_tier(kinds)


@job(
    """SELECT doc_id, avg(CASE WHEN share >= 0.5 THEN 1.0::DOUBLE WHEN share >= 0.2 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS coverage FROM (SELECT i.doc_id, len([x for x in string_split(lower(name), ' ') if length(x) > 3 AND contains(lower(effort_text), x)]) / len(string_split(name, ' ')) AS share
    FROM scope_items i JOIN scope_efforts e ON i.doc_id = e.doc_id) GROUP BY doc_id""",
    ("scope_items", "scope_efforts"),
)
def scope_coverage(items, efforts):
    return sc.scope_coverage(sc.scope_status(items, efforts))


@job(
    """SELECT org, phase, status, count(*) AS n FROM (SELECT org, phase, CASE WHEN status = 'done' AND ((phase = 'inventory' AND version != '2') OR (phase != 'clone' AND input_sha != head_sha) OR (phase = 'extract' AND p.ledger_at != r.ledger_at)) THEN 'stale' ELSE status END AS status
    FROM repo_phases p JOIN phase_repos r USING (org, repo) UNION ALL SELECT org, 'inventory', 'pending' FROM phase_repos WHERE (org, repo) NOT IN (SELECT (org, repo) FROM repo_phases WHERE phase = 'inventory')) GROUP BY org, phase, status""",
    ("phase_repos", "repo_phases"),
)
def phase_summary(repos, phases):
    return sc.phase_summary(sc.phase_status(repos, phases, {"inventory": "2"}))


@job(
    r"SELECT DISTINCT call_id AS ask_id, route_id, sid, r.method, r.path FROM calls c JOIN routes r ON regexp_replace(c.path, '/\d+/', '/{}/') = regexp_replace(r.path, ':\w+', '{}', 'g') AND (c.method = 'ANY' OR c.method = r.method)",
    ("calls", "routes"),
)
def find_endpoints(calls, routes):
    return sc.find_endpoints(calls.select(F.col("call_id").alias("ask_id"), F.when(F.col("method") != "ANY", F.col("method")).alias("method"), "path", F.lit(None).cast("string").alias("sid")), routes)


@job(
    "SELECT service, CAST(rank AS INT) AS rank, flow_id, role, length FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY CASE role WHEN 'entry' THEN 0 ELSE 1 END, length DESC, flow_id) AS rank FROM flow_members) WHERE rank <= 20",
    ("flow_members",),
)
def service_flows(members):
    return sc.service_flows(members)


@job(
    r"SELECT DISTINCT call_id AS edge_id, c.method AS src, route_id FROM calls c JOIN routes r ON regexp_replace(c.path, '/\d+/', '/{}/') = regexp_replace(r.path, ':\w+', '{}', 'g') AND r.sid = 'svc0' AND r.method IN (c.method, 'GET')",
    ("calls", "routes"),
)
def endpoint_calls(calls, routes):
    item = lambda method: F.struct(method.alias("method"), F.col("path").alias("path"))
    edges = calls.select(F.col("call_id").alias("edge_id"), F.col("method").alias("src"), F.lit("svc0").alias("dst"), F.array(item(F.col("method")), item(F.lit("GET"))).alias("items"))
    return sc.endpoint_calls(edges, routes)
