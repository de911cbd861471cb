"""Registered queries over the test tables, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import estimation as es
from ..operators import graph as gr
from ..operators import portfolio as pf
from ..operators import resolution as rs
from ..operators import retrieval as rt
from ..sources.records import table
from ..streaming import events as ev
from .bindings import VIEWS, bound, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "1997-01-01"


def job(sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query under its function's name; it gets the bindings it names, as they are
    now: the SQL holds these texts, and a module that comes later may use a name again."""
    texts = [VIEWS[v] for v in views]

    def keep(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(*[bound(spark, folder, text) for text in texts]) if views else f(spark, folder)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = (with_views(*views) if views and not sql.lstrip().startswith("WITH") else "") + sql
        return f

    return keep


# portfolio

@job("SELECT id, name, rag_status FROM projects WHERE rag_status = 'Red' AND vendor = 'BUILDING' AND lower(name) LIKE '%1%'", ("projects",))
def filter_projects(projects):
    return pf.filter_projects(projects, "1", rag_status="Red", vendor="BUILDING", lob=None).select("id", "name", "rag_status")


@job("SELECT p.id, concat_ws(' > ', coalesce(m.name, '?'), coalesce(c.name, '?'), p.name) AS path FROM projects p LEFT JOIN cps c ON p.parent_cp_id = c.id LEFT JOIN mps m ON c.parent_mp_id = m.id", ("projects", "cps", "mps"))
def project_paths(projects, cps, mps):
    return pf.project_paths(projects, cps, mps)


_LEDGER = """SELECT b.project_id, b.approved_budget, round(coalesce(sum(CASE WHEN transaction_type IN ('PO', 'CR') THEN amount ELSE 0 END), 0), 2) AS committed,
  round(coalesce(sum(CASE transaction_type WHEN 'Spend' THEN amount ELSE 0 END) - sum(CASE transaction_type WHEN 'Refund' THEN amount ELSE 0 END), 0), 2) AS spent
  FROM budgets b LEFT JOIN transactions t ON b.project_id = t.project_id GROUP BY b.project_id, b.approved_budget"""


@job(f"SELECT *, round(approved_budget - committed, 2) AS remaining, CASE WHEN approved_budget > 0 AND spent > approved_budget THEN 'Red' WHEN approved_budget > 0 AND spent > 0.8::DOUBLE * approved_budget THEN 'Yellow' ELSE 'Green' END AS budget_rag, spent > approved_budget AND approved_budget > 0 AS over_budget FROM (SELECT *, CASE WHEN approved_budget > 0 THEN round(100 * spent / approved_budget, 2) ELSE 0.0 END AS used_percent FROM ({_LEDGER}))", ("budgets", "transactions"))
def budget_ledger(budgets, transactions):
    return pf.budget_ledger(budgets, transactions)


_COUNTS = "count(*) AS total, count_if(rag_status = 'Green') AS green, count_if(rag_status = 'Yellow') AS yellow, count_if(rag_status = 'Red') AS red"


@job(
    f"""SELECT 'overall' AS "grouping", 'all' AS key, {_COUNTS} FROM projects"""
    + "".join(f""" UNION ALL SELECT '{c}', coalesce({c}, 'Unassigned'), {_COUNTS} FROM projects GROUP BY coalesce({c}, 'Unassigned')""" for c in ("vendor", "product_owner", "project_type", "lob"))
    + f""" UNION ALL SELECT 'place', concat_ws(' / ', coalesce(domain, 'N/A'), coalesce(bu, 'N/A'), coalesce(stream, 'N/A')), {_COUNTS} FROM projects GROUP BY 2
    UNION ALL SELECT 'open_dependencies', 'all', count(*), 0, 0, 0 FROM dependencies WHERE status != 'Resolved' AND project_id IN (SELECT id FROM projects)
    UNION ALL SELECT 'over_budget', 'all', count(*), 0, 0, 0 FROM ({_LEDGER}) WHERE spent > approved_budget AND approved_budget > 0 AND project_id IN (SELECT id FROM projects)""",
    ("projects", "dependencies", "budgets", "transactions"),
)
def dashboard(projects, dependencies, budgets, transactions):
    return pf.dashboard(projects, dependencies, pf.budget_ledger(budgets, transactions))


_RANK = "CASE {} WHEN 'Green' THEN 0 WHEN 'Yellow' THEN 1 WHEN 'Red' THEN 2 END"
_NAME = "CASE {} WHEN 0 THEN 'Green' WHEN 1 THEN 'Yellow' WHEN 2 THEN 'Red' END"


@job(
    f""", m AS (SELECT m.id, m.project_id, m.rag_status AS own, greatest({_RANK.format('m.rag_status')}, max({_RANK.format('t.rag_status')})) AS r FROM milestones m LEFT JOIN tasks t ON t.milestone_id = m.id GROUP BY m.id, m.project_id, m.rag_status),
    p AS (SELECT p.id, p.parent_cp_id, p.rag_status AS own, greatest({_RANK.format('p.rag_status')}, max(m.r)) AS r FROM projects p LEFT JOIN m ON m.project_id = p.id GROUP BY p.id, p.parent_cp_id, p.rag_status),
    c AS (SELECT c.id, c.parent_mp_id, c.rag_status AS own, max(p.r) AS r FROM cps c LEFT JOIN p ON p.parent_cp_id = c.id GROUP BY c.id, c.parent_mp_id, c.rag_status),
    q AS (SELECT q.id, q.rag_status AS own, max(coalesce(c.r, {_RANK.format('c.own')})) AS r FROM mps q LEFT JOIN c ON c.parent_mp_id = q.id GROUP BY q.id, q.rag_status)
    SELECT level, CAST(id AS VARCHAR) AS id, own, {_NAME.format('r')} AS rolled FROM (SELECT 'milestone' AS level, id, own, r FROM m UNION ALL SELECT 'project', id, own, r FROM p UNION ALL SELECT 'cp', id, own, r FROM c UNION ALL SELECT 'mp', id, own, r FROM q)""",
    ("tasks", "milestones", "projects", "cps", "mps"),
)
def rollup_status(tasks, milestones, projects, cps, mps):
    return pf.rollup_status(tasks, milestones, projects, cps, mps)


@job("SELECT m.id, count(DISTINCT c.id) AS cp_count, count(p.id) AS project_count FROM mps m LEFT JOIN cps c ON c.parent_mp_id = m.id LEFT JOIN projects p ON p.parent_cp_id = c.id GROUP BY m.id", ("projects", "cps", "mps"))
def hierarchy_counts(projects, cps, mps):
    return pf.hierarchy_counts(projects, cps, mps)


@job("SELECT project_id, least(min(planned_start), min(actual_start)) AS axis_start, greatest(max(planned_end), max(actual_end)) AS axis_end, CAST(sum(planned_end - planned_start) AS BIGINT) AS planned_days, CAST(sum(actual_end - actual_start) AS BIGINT) AS actual_days, CAST(sum(CASE WHEN actual_end > planned_end THEN actual_end - planned_end ELSE 0 END) AS BIGINT) AS slippage_days, CAST(sum(CASE WHEN actual_end < planned_end THEN planned_end - actual_end ELSE 0 END) AS BIGINT) AS fast_track_days FROM milestones GROUP BY project_id", ("milestones",))
def milestone_span(milestones):
    return pf.milestone_span(milestones)


@job("SELECT *, CAST(actual_end - planned_end AS INTEGER) AS slippage FROM (SELECT m.id, coalesce(min(t.planned_start), m.planned_start) AS planned_start, coalesce(max(t.planned_end), m.planned_end) AS planned_end, coalesce(min(t.actual_start), m.actual_start) AS actual_start, coalesce(max(t.actual_end), m.actual_end) AS actual_end FROM milestones m LEFT JOIN tasks t ON t.milestone_id = m.id GROUP BY m.id, m.planned_start, m.planned_end, m.actual_start, m.actual_end)", ("milestones", "tasks"))
def infer_milestone_dates(milestones, tasks):
    return pf.infer_milestone_dates(milestones, tasks)


@job("SELECT project_id, stage FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY CASE status WHEN 'In_Progress' THEN 0 WHEN 'Not_Started' THEN 1 ELSE 2 END, CASE WHEN status IN ('In_Progress', 'Not_Started') THEN stage_order ELSE -stage_order END) AS n FROM stages) WHERE n = 1", ("stages",))
def current_stage(stages):
    return pf.current_stage(stages)


@job("SELECT project_id, stage, stage_order, status FROM (SELECT *, min(CASE WHEN status IN ('Completed', 'Skipped') THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY stage_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ready FROM stages) WHERE ready = 0 AND status != 'Not_Started'", ("stages",))
def stage_order_violations(stages):
    return pf.stage_order_violations(stages)


@job(f", names AS (SELECT unnest({list(pf.STAGES)}) AS stage, unnest(range(1, 9)) AS stage_order), have AS (SELECT project_id, stage, status FROM (SELECT *, row_number() OVER (PARTITION BY project_id, stage ORDER BY stage_order, status) AS n FROM stages) WHERE n = 1) SELECT p.id AS project_id, n.stage, CAST(n.stage_order AS INTEGER) AS stage_order, coalesce(h.status, 'Not_Started') AS status FROM projects p CROSS JOIN names n LEFT JOIN have h ON h.project_id = p.id AND h.stage = n.stage", ("projects", "stages"))
def reconcile_track(projects, stages):
    return pf.reconcile_track(projects, stages)


@job("SELECT id, project_id, CAST(actual_end - planned_end AS INTEGER) AS slippage FROM milestones WHERE actual_end > planned_end ORDER BY 3 DESC, id LIMIT 5", ("milestones",))
def top_slippages(milestones):
    return pf.top_slippages(milestones)


@job(f"SELECT id, project_id, cutoff_date, DATE '{AS_OF}' > cutoff_date AS overdue, CAST(greatest(DATE '{AS_OF}' - cutoff_date, 0) AS INTEGER) AS days_overdue FROM dependencies WHERE status != 'Resolved'", ("dependencies",))
def open_dependencies(dependencies):
    return pf.open_dependencies(dependencies, F.lit(AS_OF).cast("date"))


@job(f"SELECT id, project_id, status, cutoff_date FROM dependencies WHERE status != 'Resolved' AND (status = 'Escalated' OR cutoff_date < DATE '{AS_OF}') ORDER BY cutoff_date, id LIMIT 10", ("dependencies",))
def overdue_dependencies(dependencies):
    return pf.overdue_dependencies(dependencies, F.lit(AS_OF).cast("date"))


@job("SELECT entity, field, ts, old, value AS new FROM (SELECT *, lag(value) OVER w AS old, row_number() OVER w AS n FROM history WINDOW w AS (PARTITION BY entity, field ORDER BY ts, seq)) WHERE n > 1 AND old IS DISTINCT FROM value", ("history",))
def change_log(history):
    return pf.change_log(history)


@job("SELECT 'project' AS level, CAST(id AS VARCHAR) AS id, CAST(parent_cp_id AS VARCHAR) AS parent_id, CAST(actual_end - planned_end AS INTEGER) AS days_late, rag_status FROM projects WHERE actual_end > planned_end UNION ALL SELECT 'milestone', CAST(id AS VARCHAR), CAST(project_id AS VARCHAR), CAST(actual_end - planned_end AS INTEGER), rag_status FROM milestones WHERE actual_end > planned_end UNION ALL SELECT 'task', CAST(id AS VARCHAR), CAST(milestone_id AS VARCHAR), CAST(actual_end - planned_end AS INTEGER), rag_status FROM tasks WHERE actual_end > planned_end", ("projects", "milestones", "tasks"))
def delay_report(projects, milestones, tasks):
    return pf.delay_report(projects, milestones, tasks)


@job("SELECT region, state, sum(coalesce(invoices, 0))::BIGINT AS invoices, count(*) AS branches FROM branches b LEFT JOIN invoices i ON i.dealer_branch = b.dealer || '_' || b.branch GROUP BY ROLLUP (region, state)", ("branches", "invoices"))
def dealer_facts(branches, invoices):
    return pf.dealer_facts(branches, invoices)


# estimation

_DAYS = "SELECT i.*, CASE WHEN u.unit_id IS NULL THEN 0.0 ELSE round(coalesce(CASE complexity WHEN 'simple' THEN simple WHEN 'complex' THEN complex END, medium, 2.0) * quantity * coalesce(multiplier, 1.2), 2) END AS days FROM items i LEFT JOIN units u ON i.unit_id = u.unit_id LEFT JOIN systems s ON i.system = s.system"


@job("SELECT request_id, unit_id, system, complexity, sum(quantity) AS quantity FROM items GROUP BY ALL", ("items",))
def merge_work_items(items):
    return es.merge_work_items(items)


@job(f"SELECT request_id, round(sum(days), 2) AS days, count(*) AS n FROM ({_DAYS}) GROUP BY request_id", ("items", "units", "systems"))
def base_effort(items, units, systems):
    return es.base_effort(items, units, systems).groupBy("request_id").agg(F.round(F.sum("days"), 2).alias("days"), F.count("*").alias("n"))


@job("SELECT request_id, unknown_share, CASE WHEN unknown_share > 0.5 THEN 'New Application' WHEN unknown_share > 0.3 THEN 'New Module' ELSE 'Enhancement' END AS scope FROM (SELECT request_id, avg(CASE WHEN s.system IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS unknown_share FROM (SELECT DISTINCT request_id, system FROM items) i LEFT JOIN systems s ON i.system = s.system GROUP BY request_id)", ("items", "systems"))
def effective_scope(items, systems):
    return es.effective_scope(items, systems)


_BREAKDOWN = f"SELECT request_id, CASE WHEN d.discipline IN ('qa', 'devops') THEN d.discipline ELSE coalesce(o.discipline, d.discipline, 'backend') END AS discipline, sum(days) AS raw FROM ({_DAYS}) e LEFT JOIN disciplines d ON e.category = d.category LEFT JOIN overrides o ON e.system = o.system GROUP BY 1, 2"


@job(f"SELECT request_id, discipline, round(raw, 2) AS person_days, round(raw / 22, 3) AS person_months FROM ({_BREAKDOWN})", ("items", "units", "systems", "disciplines", "overrides"))
def discipline_breakdown(items, units, systems, disciplines, overrides):
    return es.discipline_breakdown(es.base_effort(items, units, systems), disciplines, overrides)


@job(f"SELECT request_id, round(sum(round(raw, 2) / 22 * coalesce(monthly_rate, 10000.0)), 2) AS total_cost, round(sum(round(raw, 2)), 2) AS total_days FROM ({_BREAKDOWN}) b LEFT JOIN rates r ON b.discipline = r.discipline GROUP BY request_id", ("items", "units", "systems", "disciplines", "overrides", "rates"))
def cost(items, units, systems, disciplines, overrides, rates):
    return es.cost(es.discipline_breakdown(es.base_effort(items, units, systems), disciplines, overrides), rates)


@job("SELECT proposal_id, cost_variance, abs(cost_variance) > 25 AS cost_flag, delivery_ratio, delivery_ratio < 0.7 OR delivery_ratio > 1.5 AS delivery_flag, greatest(0.0, least(100.0, coverage)) AS coverage FROM (SELECT *, CASE WHEN internal_cost > 0 THEN round(100 * (vendor_cost - internal_cost) / internal_cost, 2) ELSE 0.0 END AS cost_variance, CASE WHEN internal_timeline > 0 THEN round(vendor_timeline / internal_timeline, 3) ELSE 1.0 END AS delivery_ratio FROM proposals)", ("proposals",))
def vendor_compare(proposals):
    return es.vendor_compare(proposals)


@job("SELECT request_id, proposal_id, composite, CAST(row_number() OVER (PARTITION BY request_id ORDER BY composite DESC, proposal_id) AS INTEGER) AS rank FROM (SELECT *, greatest(0.0::DOUBLE, round(0.40::DOUBLE * quality + 0.35::DOUBLE * cost + 0.25::DOUBLE * delivery, 1)) AS composite FROM proposals)", ("proposals",))
def rank_vendors(proposals):
    return es.rank_vendors(proposals)


# retrieval

_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_BM25 = f""", tok AS (SELECT chunk_id AS id, {_TOKENS.format('display_text')} AS ts FROM chunks), stats AS (SELECT count(*) AS docs, avg(len(ts)) AS avgdl FROM tok),
 post AS (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM tok), tf AS (SELECT id, dl, term, count(*) AS tf FROM post GROUP BY ALL),
 raw AS (SELECT term, ln(docs - df + 0.5) - ln(df + 0.5) AS idf, avgdl FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), stats),
 idf AS (SELECT term, avgdl, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
 ask AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({_TOKENS.format('text')}) AS term FROM questions) GROUP BY ALL),
 hits AS (SELECT query_id, id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN idf USING (term) JOIN ask USING (term) GROUP BY ALL),
 sparse AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM hits QUALIFY rank <= 30)"""


@job(_BM25 + " SELECT query_id, rank, id FROM sparse", ("chunks", "questions"))
def bm25_topk(chunks, questions):
    return rt.bm25_topk(questions, chunks).select("query_id", "rank", "id")


_DENSE = """, dense AS (SELECT q.query_id, v.id, round(list_cosine_similarity(q.vector::DOUBLE[], v.vector::DOUBLE[]), 6) AS score FROM vector_questions q, vectors v),
 top AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM dense QUALIFY rank <= 10)"""


#: of lists of (query_id, list, id, rank)
_RRF = " SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM lists GROUP BY query_id, id) QUALIFY rank <= 30"


@job(_BM25 + """, near AS (SELECT q.query_id, v.id, round(list_cosine_similarity(q.vector::DOUBLE[], v.vector::DOUBLE[]), 6) AS score FROM question_vectors q, vectors v),
 nearest AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id FROM near QUALIFY rank <= 30),
 lists AS (SELECT query_id, id, rank FROM sparse UNION ALL SELECT query_id, id, rank FROM nearest)""" + _RRF, ("chunks", "questions", "vectors", "question_vectors"))
def hybrid_search(chunks, questions, vectors, question_vectors):
    return rt.hybrid_search(questions, chunks, vectors, question_vectors=question_vectors)


@job(", lists AS (SELECT query_id, list, id, min(rank) AS rank FROM rankings GROUP BY ALL)" + _RRF, ("rankings",))
def rrf(rankings):
    return rt.rrf(rankings)


@job(_DENSE + " SELECT query_id, rank, id, score FROM top", ("vectors", "vector_questions"))
def dense_topk(vectors, questions):
    return rt.dense_topk(questions, vectors, 10)


@job(_DENSE + " SELECT q.query_id, coalesce(max(t.score), 0.0) AS best, coalesce(max(t.score), 0.0) >= 0.4 AS answered FROM vector_questions q LEFT JOIN top t ON q.query_id = t.query_id AND t.rank <= 5 AND t.id != q.query_id GROUP BY q.query_id", ("vectors", "vector_questions"))
def relevance_gate(vectors, questions):
    hits = rt.dense_topk(questions, vectors, 10).where("id != query_id")
    return rt.relevance_gate(hits, questions)


@job("SELECT chunk_id, min(chunk_id) OVER (PARTITION BY display_text) AS canonical_id, chunk_id != min(chunk_id) OVER (PARTITION BY display_text) AS is_duplicate FROM chunks", ("chunks",))
def exact_duplicates(chunks):
    return rt.exact_duplicates(chunks.withColumn("text_hash", tx.text_hash(F.col("display_text"))))


@job(""" WITH v AS (SELECT vec_id AS id, label AS repo, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.repo = b.repo AND a.id != b.id)
 SELECT id, other, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS n FROM s WHERE score > 0.3) WHERE n = 1""")
def near_duplicates(spark, folder):
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("repo_name"), F.col("embedding").alias("vector"))
    return rt.near_duplicates(rows, 0.3)


@job(""" WITH v AS (SELECT vec_id AS id, vec_id % 2 AS repo, embedding::DOUBLE[] AS e FROM embeddings UNION ALL SELECT -1 - vec_id, vec_id % 2, list_transform(embedding::DOUBLE[], lambda x, i: x * CASE WHEN (i + vec_id) % 16 = 0 THEN 0.8::DOUBLE ELSE 1 END) FROM embeddings),
 s AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.repo = b.repo AND a.id != b.id)
 SELECT id, other, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS n FROM s WHERE score > 0.95) WHERE n = 1""")
def near_duplicates_hashed(spark, folder):
    """The same by buckets, as for large repos: each vector and an edited copy of it."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 2).alias("repo_name"), F.col("embedding").cast("array<double>").alias("vector"))
    edited = F.transform("vector", lambda x, i: x * F.when((i + 1 + F.col("chunk_id")) % 16 == 0, 0.8).otherwise(1.0))
    copies = rows.withColumn("vector", edited).withColumn("chunk_id", -1 - F.col("chunk_id"))
    both = rows.unionByName(copies)
    return rt.near_duplicates(both, exact_rows=0, bucket_rows=64)


# graph

@job("SELECT b.source_id, CASE WHEN t.source_id IS NULL THEN 'CREATED' WHEN t.text_hash = b.text_hash THEN 'SKIPPED' ELSE 'UPDATED' END AS decision FROM entity_batch b LEFT JOIN entity_target t ON t.source_id = b.source_id", ("entity_target", "entity_batch"))
def upsert_decisions(target, batch):
    return gr.upsert_decisions(target, batch)


@job("SELECT coalesce(t.source_id, b.source_id) AS source_id, CASE WHEN t.text_hash IS NOT DISTINCT FROM b.text_hash THEN t.status ELSE coalesce(b.status, t.status) END AS status, CASE WHEN t.text_hash IS NOT DISTINCT FROM b.text_hash THEN t.text_hash ELSE coalesce(b.text_hash, t.text_hash) END AS text_hash, CASE WHEN t.text_hash IS NOT DISTINCT FROM b.text_hash THEN t.updated_at ELSE coalesce(b.updated_at, t.updated_at) END AS updated_at, coalesce(t.created_at, b.created_at) AS created_at FROM entity_target t FULL JOIN entity_batch b ON t.source_id = b.source_id", ("entity_target", "entity_batch"))
def apply_upsert(target, batch):
    return gr.apply_upsert(target, batch)


_REACH = ", e AS (SELECT DISTINCT src, dst FROM depends_on), h AS (SELECT src AS root, dst AS node, 1 AS hop FROM e UNION ALL SELECT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src)"


@job(_REACH + " SELECT root, node, CAST(min(hop) AS INTEGER) AS hop FROM h GROUP BY root, node", ("depends_on",))
def dependencies_of_all(depends_on):
    return gr.reach(depends_on, hops=2)


@job(", e AS (SELECT DISTINCT dst AS src, src AS dst FROM depends_on), h AS (SELECT src AS root, dst AS node FROM e UNION SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src) SELECT root AS service, count(DISTINCT node) AS affected, count(DISTINCT CASE WHEN kind = 'epic' THEN ticket END) AS epics, count(DISTINCT CASE WHEN kind = 'ticket' THEN ticket END) AS tickets FROM h LEFT JOIN (SELECT item AS ticket, src AS service, CASE kind WHEN 'event' THEN 'epic' ELSE 'ticket' END AS kind FROM raw_edges) l ON l.service = h.node GROUP BY root", ("depends_on", "raw_edges"))
def impact(depends_on, raw_edges):
    links = raw_edges.select(F.col("item").alias("ticket"), F.col("src").alias("service"), F.when(F.col("kind") == "event", "epic").otherwise("ticket").alias("kind"))
    return gr.impact(depends_on, links)


@job(""", x AS (SELECT CASE WHEN kind = 'event' THEN dst ELSE src END AS src, CASE WHEN kind = 'event' THEN src ELSE dst END AS dst, kind, via, confidence FROM raw_edges)
 SELECT src, dst, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, array_to_string(list_sort(list(DISTINCT via))[1:20], ',') AS vias, CASE max(CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence FROM x WHERE src != dst GROUP BY src, dst""", ("raw_edges",))
def dependency_rollup(edges):
    return gr.dependency_rollup(edges.withColumn("id", F.col("item"))).select("src", "dst", F.array_join("kinds", ",").alias("kinds"), F.array_join("vias", ",").alias("vias"), "confidence")


@job(" WITH m AS (SELECT max(ts) AS now FROM events) SELECT count(*) AS total, count_if(age <= 3600) AS within_hour, count_if(age <= 86400) AS within_day, count_if(age > 86400) AS older, round_even(100.0 * count_if(age <= 3600) / count(*), 2) AS hour_percent, round_even(100.0 * count_if(age <= 86400) / count(*), 2) AS day_percent FROM (SELECT floor(epoch(now)) - floor(epoch(ts)) AS age FROM events, m)")
def freshness_summary(spark, folder):
    rows = table(spark, folder, "events").select(F.col("ts").alias("updated_at"))
    now = rows.agg(F.max("updated_at").alias("now"))
    return gr.freshness_summary(rows.crossJoin(F.broadcast(now)), F.col("now"))


@job(""", w AS (SELECT DISTINCT src, dst FROM depends_on WHERE src != dst)
 SELECT array_to_string(path, '>') AS path, CAST(len(path) AS INTEGER) AS length, truncated FROM (
  SELECT [a.src, a.dst] AS path, FALSE AS truncated FROM w a WHERE a.src LIKE 's%' AND NOT EXISTS (SELECT 1 FROM w b WHERE b.src = a.dst AND b.dst != a.src)
  UNION ALL SELECT [a.src, a.dst, b.dst], EXISTS (SELECT 1 FROM w c WHERE c.src = b.dst AND c.dst NOT IN (a.src, a.dst, b.dst)) FROM w a JOIN w b ON a.dst = b.src AND b.dst != a.src WHERE a.src LIKE 's%')""", ("depends_on",))
def maximal_paths(depends_on):
    entries = depends_on.where("src like 's%'").select(F.col("src").alias("node")).distinct()
    return gr.maximal_paths(depends_on, entries, 3).select(F.array_join("path", ">").alias("path"), "length", "truncated")


# resolution

@job("SELECT CAST(c.call_id AS BIGINT) AS call_id, 'edge' AS outcome, 'svc0' AS sids FROM calls c JOIN (SELECT DISTINCT path FROM routes) r ON r.path = regexp_replace(c.path, '/[0-9]+/', '/:id/') WHERE c.method IN ('GET', 'ANY')", ("calls", "routes"))
def match_routes(calls, routes):
    return rs.pick_route(rs.match_routes(calls, routes)).select("call_id", "outcome", F.array_join("sids", ",").alias("sids"))


@job(""", p AS (SELECT DISTINCT broker, regexp_replace(topic, '^prod-', '') AS topic, sid, namespace FROM publishers), s AS (SELECT DISTINCT broker, regexp_replace(topic, '\\.dev$', '') AS topic, sid, namespace FROM subscribers)
 SELECT p.sid AS publisher, s.sid AS subscriber, p.topic, CASE WHEN bool_or(p.namespace IS NOT NULL AND s.namespace IS NOT NULL) THEN 'high' ELSE 'medium' END AS confidence FROM p JOIN s ON p.broker = s.broker AND p.topic = s.topic AND (p.namespace IS NULL OR s.namespace IS NULL OR p.namespace = s.namespace) WHERE p.sid != s.sid GROUP BY ALL""", ("publishers", "subscribers"))
def link_topics(publishers, subscribers):
    return rs.link_topics(publishers, subscribers)


@job("""SELECT a.sid AS a, b.sid AS b, count(*) AS tables FROM (SELECT DISTINCT store, "table", sid FROM access WHERE access = 'write') a JOIN (SELECT DISTINCT store, "table", sid FROM access WHERE access = 'write') b ON a.store = b.store AND a."table" = b."table" AND a.sid < b.sid GROUP BY ALL""", ("access",))
def shared_tables(access):
    return rs.shared_tables(access)


@job("""SELECT store, "table", array_to_string(list_sort(list(DISTINCT sid)), ',') AS readers FROM access r WHERE access = 'read' AND NOT EXISTS (SELECT 1 FROM access w WHERE w.access = 'write' AND w.store = r.store AND w."table" = r."table" AND w.sid = r.sid) GROUP BY ALL""", ("access",))
def readers_only(access):
    return rs.readers_only(access).select("store", "table", F.array_join("readers", ",").alias("readers"))


@job("SELECT name, array_to_string(list_sort(list(DISTINCT version)), ',') AS versions FROM packages GROUP BY name HAVING count(DISTINCT version) > 1", ("packages",))
def version_drift(packages):
    return rs.version_drift(packages).select("name", F.array_join("versions", ",").alias("versions"))


@job(""", one AS (SELECT ecosystem, name, min(repo) AS library FROM artifacts GROUP BY ALL HAVING count(DISTINCT repo) = 1),
 tails AS (SELECT ecosystem, regexp_extract(name, '([^./:@]+)$', 1) AS t, min(repo) AS library FROM artifacts GROUP BY ALL HAVING count(DISTINCT repo) = 1)
 SELECT p.repo, p.name, o.library, 'exact' AS how FROM packages p JOIN one o USING (ecosystem, name) WHERE p.repo != o.library
 UNION ALL SELECT p.repo, p.name, t.library, 'name' FROM packages p JOIN tails t ON t.ecosystem = p.ecosystem AND t.t = regexp_extract(p.name, '([^./:@]+)$', 1) WHERE p.repo != t.library AND NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.ecosystem = p.ecosystem AND a.name = p.name)""", ("packages", "artifacts"))
def link_libraries(packages, artifacts):
    return rs.link_libraries(packages, artifacts)


@job("SELECT sha1(concat_ws('|', src, dst, kind, via)) AS id, src, dst, kind, via, count(DISTINCT item) AS items, least(25, count(DISTINCT evidence)) AS evidence, CASE WHEN bool_or(confidence = 'high') THEN 'high' ELSE arg_min(confidence, {'a': repo, 'b': item}) END AS confidence FROM raw_edges GROUP BY src, dst, kind, via", ("raw_edges",))
def merge_edges(edges):
    return rs.merge_edges(edges.dropDuplicates(["src", "dst", "kind", "via", "repo", "item", "confidence", "evidence"])).select("id", "src", "dst", "kind", "via", F.size("items").cast("long").alias("items"), F.size("evidence").cast("long").alias("evidence"), "confidence")


@job("SELECT repo, 'class' AS \"grouping\", class AS key, count(*) AS files FROM ledger GROUP BY ALL UNION ALL SELECT repo, 'status', status, count(*) FROM ledger GROUP BY ALL UNION ALL SELECT repo, 'language', language, count(*) FROM ledger GROUP BY ALL", ("ledger",))
def ledger_summary(ledger):
    return rs.ledger_summary(ledger)


@job("SELECT repo, count_if(status IN ('failed', 'pending')) = 0 AS passed, count_if(status = 'failed') AS failed, count_if(status = 'pending') AS pending FROM ledger GROUP BY repo", ("ledger",))
def ledger_gate(ledger):
    return rs.ledger_gate(ledger)


# text

@job(r"SELECT doc_id, sha256(text) AS hash, CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS INTEGER) AS words, CAST(floor(length(text) / 4) AS INTEGER) AS tokens FROM documents")
def text_statistics(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.text_hash(F.col("text")).alias("hash"), F.size(tx.tokenize(F.col("text"))).alias("words"), tx.token_count(F.col("text")).alias("tokens"))


@job(r"SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1) AS host, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS base FROM pages")
def url_parts(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.host(F.col("url")).alias("host"), tx.base_path(F.col("url")).alias("base"))


# events

@job("SELECT user_id, session_start, session_end, events FROM (SELECT user_id, g, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) GROUP BY user_id, g)")
def activity_sessions(spark, folder):
    return ev.activity_sessions(table(spark, folder, "events"))


@job("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events FROM events GROUP BY ALL")
def hourly_updates(spark, folder):
    return ev.hourly_updates(table(spark, folder, "events"))


@job()
def rate_limit(spark, folder):
    return ev.rate_limit_batch(table(spark, folder, "events"), 3, 3600)
