"""Portfolio jobs: status roll-up, ledgers, schedules, stages, dashboards, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import RAG, named, rank

STAGES = ("Initiation", "Requirements", "Design", "Build", "Test", "Deploy", "Hypercare", "Closure")


def filter_projects(projects: DataFrame, name: str | None = None, **equal: str | None) -> DataFrame:
    """Rows that meet every filter given; an empty filter filters nothing.  ``name`` is a
    case-insensitive part of the name."""
    conditions: list[Column] = [F.col(k) == v for k, v in equal.items() if v]
    if name:
        conditions.append(F.lower("name").contains(name.lower()))
    return projects.where(reduce(lambda a, b: a & b, conditions)) if conditions else projects


def project_paths(projects: DataFrame, cps: DataFrame, mps: DataFrame) -> DataFrame:
    """(id, path): managing point > checkpoint > project; ? for a missing parent."""
    cp = cps.select(F.col("id").alias("parent_cp_id"), F.col("name").alias("_cp"), "parent_mp_id")
    mp = mps.select(F.col("id").alias("parent_mp_id"), F.col("name").alias("_mp"))
    rows = projects.join(cp, "parent_cp_id", "left").join(mp, "parent_mp_id", "left")
    return rows.select("id", F.concat_ws(" > ", F.coalesce("_mp", F.lit("?")), F.coalesce("_cp", F.lit("?")), "name").alias("path"))


def dashboard(projects: DataFrame, dependencies: DataFrame, budgets: DataFrame) -> DataFrame:
    """One pass over grouping sets: (grouping, key, total, green, yellow, red), overall and
    by vendor, owner, type, line of business, and (domain, unit, stream); then open
    dependencies and budgets of those projects as groupings of their own."""
    none = lambda c: F.coalesce(F.col(c), F.lit("Unassigned")).alias(c)
    place = F.concat_ws(" / ", *[F.coalesce(F.col(c), F.lit("N/A")) for c in ("domain", "bu", "stream")])
    facts = projects.select("id", "rag_status", *[none(c) for c in ("vendor", "product_owner", "project_type", "lob")], place.alias("place"))
    keys = ["vendor", "product_owner", "project_type", "lob", "place"]
    counts = [F.count("*").alias("total")] + [F.count_if(F.col("rag_status") == s).alias(s.lower()) for s in RAG]
    sets = facts.groupingSets([[], *[[F.col(k)] for k in keys]], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("gid"), *counts)
    top = (1 << len(keys)) - 1
    label, key = F.when(F.col("gid") == top, "overall"), F.when(F.col("gid") == top, "all")
    for i, k in enumerate(keys):
        gid = top - (1 << (len(keys) - 1 - i))
        label, key = label.when(F.col("gid") == gid, k), key.when(F.col("gid") == gid, F.col(k))
    main = sets.select(label.alias("grouping"), key.alias("key"), "total", "green", "yellow", "red")
    ids = projects.select(F.col("id").alias("project_id"))
    zero = [F.lit(0).cast("long").alias(s.lower()) for s in RAG]
    unresolved = dependencies.join(ids, "project_id", "left_semi").where("status != 'Resolved'").agg(F.count("*").alias("total"))
    over = budgets.join(ids, "project_id", "left_semi").where("spent > approved_budget and approved_budget > 0").agg(F.count("*").alias("total"))
    extra = [df.select(F.lit(n).alias("grouping"), F.lit("all").alias("key"), "total", *zero) for n, df in (("open_dependencies", unresolved), ("over_budget", over))]
    return reduce(DataFrame.unionByName, extra, main)


def _worst(children: DataFrame, parent: str, status: str) -> DataFrame:
    return children.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("id")).agg(F.max(rank(status, RAG)).alias("_worst"))


def rollup_status(tasks: DataFrame, milestones: DataFrame, projects: DataFrame, cps: DataFrame, mps: DataFrame) -> DataFrame:
    """(level, id, own, rolled): a child's worse status raises milestones and projects;
    checkpoints take the worst project's and managing points the worst of each
    checkpoint's rolled, or else own, status; no children give null."""
    def raised(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
        rows = parents.join(_worst(children, key, "rag_status"), "id", "left")
        return rows.withColumn("own", F.col("rag_status")).withColumn("rag_status", named(F.greatest(rank("rag_status", RAG), F.col("_worst")), RAG)).drop("_worst")

    m = raised(milestones, tasks, "milestone_id")
    p = raised(projects, m, "project_id")
    c = cps.join(_worst(p, "parent_cp_id", "rag_status"), "id", "left").withColumn("rolled", named(F.col("_worst"), RAG)).drop("_worst")
    used = c.withColumn("_used", F.coalesce("rolled", "rag_status"))
    q = mps.join(_worst(used, "parent_mp_id", "_used"), "id", "left").withColumn("rolled", named(F.col("_worst"), RAG))
    shown = lambda df, level, own, rolled: df.select(F.lit(level).alias("level"), F.col("id").cast("string").alias("id"), F.col(own).alias("own"), F.col(rolled).alias("rolled"))
    return shown(m, "milestone", "own", "rag_status").unionByName(shown(p, "project", "own", "rag_status")).unionByName(shown(c, "cp", "rag_status", "rolled")).unionByName(shown(q, "mp", "rag_status", "rolled"))


def hierarchy_counts(projects: DataFrame, cps: DataFrame, mps: DataFrame) -> DataFrame:
    """(id, cp_count, project_count) for each managing point."""
    per_cp = projects.groupBy(F.col("parent_cp_id").alias("id")).agg(F.count("*").alias("n"))
    per_mp = cps.join(per_cp, "id", "left").groupBy("parent_mp_id").agg(F.count("*").alias("cp_count"), F.sum(F.coalesce("n", F.lit(0))).alias("project_count"))
    zero = F.lit(0).cast("long")
    return mps.select("id").join(per_mp.withColumnRenamed("parent_mp_id", "id"), "id", "left").select("id", F.coalesce("cp_count", zero).alias("cp_count"), F.coalesce("project_count", zero).alias("project_count"))


def budget_ledger(budgets: DataFrame, transactions: DataFrame) -> DataFrame:
    """Committed (orders and change requests), spent (less refunds), remaining, used
    percent, status (spent above 80 percent Yellow, above 100 Red, not rounded), over_budget."""
    amount = lambda *kinds: F.sum(F.when(F.col("transaction_type").isin(*kinds), F.col("amount")).otherwise(0.0))
    sums = transactions.groupBy("project_id").agg(amount("PO", "CR").alias("committed"), (amount("Spend") - amount("Refund")).alias("spent"))
    rows = budgets.join(sums, "project_id", "left").select("project_id", "approved_budget", F.round(F.coalesce("committed", F.lit(0.0)), 2).alias("committed"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))
    used = F.when(F.col("approved_budget") > 0, F.round(100 * F.col("spent") / F.col("approved_budget"), 2)).otherwise(F.lit(0.0))
    rows = rows.withColumn("used_percent", used)
    budget = F.col("approved_budget")
    status = F.when((budget > 0) & (F.col("spent") > budget), "Red").when((budget > 0) & (F.col("spent") > 0.8 * budget), "Yellow").otherwise("Green")
    return rows.select("*", F.round(F.col("approved_budget") - F.col("committed"), 2).alias("remaining"), status.alias("budget_rag"), ((F.col("spent") > F.col("approved_budget")) & (F.col("approved_budget") > 0)).alias("over_budget"))


def milestone_span(milestones: DataFrame) -> DataFrame:
    """Per project: first and last date, planned and actual days, days late in all and
    days gained."""
    late = F.datediff("actual_end", "planned_end")
    return milestones.groupBy("project_id").agg(
        F.least(F.min("planned_start"), F.min("actual_start")).alias("axis_start"), F.greatest(F.max("planned_end"), F.max("actual_end")).alias("axis_end"),
        F.sum(F.datediff("planned_end", "planned_start")).cast("long").alias("planned_days"), F.sum(F.datediff("actual_end", "actual_start")).cast("long").alias("actual_days"),
        F.sum(F.when(late > 0, late).otherwise(0)).cast("long").alias("slippage_days"), F.sum(F.when(late < 0, -late).otherwise(0)).cast("long").alias("fast_track_days"),
    )


def infer_milestone_dates(milestones: DataFrame, tasks: DataFrame) -> DataFrame:
    """Start and end from the tasks, own where no task has a date; slippage anew."""
    dates = ("planned_start", "planned_end", "actual_start", "actual_end")
    found = tasks.groupBy(F.col("milestone_id").alias("id")).agg(*[(F.min if d.endswith("start") else F.max)(d).alias(f"_{d}") for d in dates])
    rows = milestones.join(found, "id", "left").select("id", *[F.coalesce(f"_{d}", d).alias(d) for d in dates])
    return rows.withColumn("slippage", F.datediff("actual_end", "planned_end"))


def current_stage(stages: DataFrame) -> DataFrame:
    """(project_id, stage): the first in progress, else the first not started, else the last."""
    first = lambda s: F.min(F.when(F.col("status") == s, F.struct("stage_order", "stage")))
    got = stages.groupBy("project_id").agg(F.coalesce(first("In_Progress"), first("Not_Started"), F.max(F.struct("stage_order", "stage"))).alias("s"))
    return got.select("project_id", F.col("s.stage").alias("stage"))


def stage_order_violations(stages: DataFrame) -> DataFrame:
    """Stages begun while an earlier one isn't completed or skipped."""
    before = Window.partitionBy("project_id").orderBy("stage_order").rowsBetween(Window.unboundedPreceding, -1)
    done = F.col("status").isin("Completed", "Skipped")
    rows = stages.withColumn("_ready", F.min(done.cast("int")).over(before))
    return rows.where((F.col("_ready") == 0) & (F.col("status") != "Not_Started")).select("project_id", "stage", "stage_order", "status")


def reconcile_track(projects: DataFrame, stages: DataFrame) -> DataFrame:
    """Exactly the eight stages in order for each project; of duplicates the first."""
    first = Window.partitionBy("project_id", "stage").orderBy("stage_order", "status")
    have = stages.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("project_id", "stage", "status")
    plan = projects.select(F.col("id").alias("project_id"), F.posexplode(F.array(*[F.lit(s) for s in STAGES])).alias("pos", "stage"))
    return plan.join(have, ["project_id", "stage"], "left").select("project_id", "stage", (F.col("pos") + 1).alias("stage_order"), F.coalesce("status", F.lit("Not_Started")).alias("status"))


def top_slippages(milestones: DataFrame, k: int = 5) -> DataFrame:
    """The k latest milestones."""
    rows = milestones.withColumn("slippage", F.datediff("actual_end", "planned_end")).where("slippage > 0")
    return rows.orderBy(F.desc("slippage"), "id").limit(k).select("id", "project_id", "slippage")


def open_dependencies(dependencies: DataFrame, as_of: Column) -> DataFrame:
    """Unresolved ones with how long they are overdue."""
    late = F.greatest(F.datediff(as_of, "cutoff_date"), F.lit(0))
    return dependencies.where("status != 'Resolved'").select("id", "project_id", "cutoff_date", (late > 0).alias("overdue"), late.alias("days_overdue"))


def overdue_dependencies(dependencies: DataFrame, as_of: Column, k: int = 10) -> DataFrame:
    """Escalated or overdue, the earliest cutoff first."""
    rows = dependencies.where("status != 'Resolved'").where((F.col("status") == "Escalated") | (F.col("cutoff_date") < as_of))
    return rows.orderBy("cutoff_date", "id").limit(k).select("id", "project_id", "status", "cutoff_date")


def change_log(history: DataFrame, always: tuple[str, ...] = ("budget", "transaction")) -> DataFrame:
    """(entity, field, ts, old, new) where a value changed; first values only of the
    fields in ``always``."""
    order = Window.partitionBy("entity", "field").orderBy("ts", "seq")
    rows = history.withColumn("old", F.lag("value").over(order)).withColumn("_n", F.row_number().over(order))
    changed = ((F.col("_n") > 1) & ~F.col("old").eqNullSafe(F.col("value"))) | ((F.col("_n") == 1) & F.col("field").isin(*always))
    return rows.where(changed).select("entity", "field", "ts", "old", F.col("value").alias("new"))


def delay_report(projects: DataFrame, milestones: DataFrame, tasks: DataFrame) -> DataFrame:
    """Late projects, milestones and tasks under one schema."""
    part = lambda df, level, parent: df.withColumn("days_late", F.datediff("actual_end", "planned_end")).where("days_late > 0").select(F.lit(level).alias("level"), F.col("id").cast("string").alias("id"), F.col(parent).cast("string").alias("parent_id"), "days_late", "rag_status")
    return part(projects, "project", "parent_cp_id").unionByName(part(milestones, "milestone", "project_id")).unionByName(part(tasks, "task", "milestone_id"))


def rag_context_missing(status: Column, context: dict[str, Column]) -> Column:
    """For Yellow and Red: which parts of the explanation are empty."""
    blank = [F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) == "", F.lit(n)) for n, c in context.items()]
    return F.when(status.isin("Yellow", "Red"), F.filter(F.array(*blank), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def dealer_facts(branches: DataFrame, invoices: DataFrame) -> DataFrame:
    """Invoice counts by region and state with subtotals; invoices are keyed
    dealer_branch."""
    keyed = invoices.select(F.split("dealer_branch", "_")[0].alias("dealer"), F.split("dealer_branch", "_")[1].alias("branch"), "invoices")
    rows = branches.join(keyed, ["dealer", "branch"], "left").withColumn("invoices", F.coalesce("invoices", F.lit(0).cast("long")))
    return rows.rollup("region", "state").agg(F.sum("invoices").alias("invoices"), F.count("*").alias("branches"))


def portfolio_report(mps: DataFrame, cps: DataFrame, projects: DataFrame, milestones: DataFrame, dependencies: DataFrame, budgets: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a portfolio report: overview (the dashboard's counts), hierarchy (programmes
    and their projects), projects (with their path), execution (milestones that ended late)
    and budget (a ledger, see ``budget_ledger``)."""
    counts = hierarchy_counts(projects, cps, mps).join(mps.select("id", "name", "rag_status"), "id")
    late = F.datediff("actual_end", "planned_end")
    return {
        "overview": dashboard(projects, dependencies, budgets),
        "hierarchy": counts.select("id", "name", "rag_status", "cp_count", "project_count"),
        "projects": project_paths(projects, cps, mps).join(projects.select("id", "rag_status", "vendor", "planned_end"), "id"),
        "execution": milestones.withColumn("days_late", late).where("days_late > 0").select("id", "project_id", "planned_end", "actual_end", "days_late", "rag_status"),
        "budget": budgets,
    }
