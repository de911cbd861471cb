"""Effort, cost, timeline and vendor arithmetic over many requests at once.

Catalogues are dimension tables given by the caller; they are joined, and Spark
broadcasts them when their size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: multiplier of a system that the catalogue doesn't know, effort of a unit without any
UNKNOWN_SYSTEM, DEFAULT_EFFORT = 1.2, 2.0
DAYS_PER_MONTH = 22


def merge_work_items(items: DataFrame) -> DataFrame:
    """Quantities summed over (request, unit, system, complexity)."""
    return items.groupBy("request_id", "unit_id", "system", "complexity").agg(F.sum("quantity").alias("quantity"))


def base_effort(items: DataFrame, units: DataFrame, systems: DataFrame) -> DataFrame:
    """Days of each item: the unit's effort at its complexity (else medium, else 2) times
    quantity times the system's multiplier; a unit that isn't known counts nothing."""
    u = units.select("unit_id", "simple", "medium", "complex", F.lit(True).alias("_known"))
    rows = items.join(u, "unit_id", "left").join(systems.select("system", "multiplier"), "system", "left")
    effort = F.when(F.col("complexity") == "simple", F.col("simple")).when(F.col("complexity") == "complex", F.col("complex"))
    days = F.coalesce(effort, F.col("medium"), F.lit(DEFAULT_EFFORT)) * F.col("quantity") * F.coalesce("multiplier", F.lit(UNKNOWN_SYSTEM))
    return rows.select(*items.columns, F.when(F.col("_known"), F.round(days, 2)).otherwise(F.lit(0.0)).alias("days"))


def surcharges(request_parts: DataFrame, costs: DataFrame) -> DataFrame:
    """Sum of the catalogue's costs of a request's parts (patterns, hubs); unknown: 0."""
    return request_parts.join(costs, "part", "left").groupBy("request_id").agg(F.sum(F.coalesce("cost", F.lit(0.0))).alias("surcharge"))


#: factors that a table leaves out (fixed values)
DEFAULT_FACTORS = {("team", "1-2"): 1.0, ("team", "3-5"): 1.1, ("team", "6-10"): 1.2, ("team", "11+"): 1.35, ("cross_domain", "yes"): 1.2, ("regions", "2-3"): 1.2, ("regions", "4-10"): 1.35, ("regions", "11+"): 1.5, ("security", "payment"): 1.2, ("legacy", "heavy"): 1.3}


def overhead_multiplier(flags: DataFrame, factors: DataFrame) -> DataFrame:
    """(request_id, overhead): product of the factors that apply to a request (request_id,
    team_size, cross_domain, familiarity, volume, multi_region, regions, security,
    legacy), from a table (factor, level, multiplier); what neither it nor
    ``DEFAULT_FACTORS`` has counts once."""
    n, k = F.coalesce("team_size", F.lit(0)), F.coalesce("regions", F.lit(0))
    band = F.when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 10, "6-10").otherwise("11+")
    spread = F.when(F.col("multi_region") & (k > 0), F.when(k <= 3, "2-3").when(k <= 10, "4-10").otherwise("11+"))
    flag = lambda c, level: F.when(F.col(c), level)
    levels = {"team": band, "cross_domain": flag("cross_domain", "yes"), "familiarity": F.col("familiarity"), "volume": F.col("volume"), "regions": spread, "security": flag("security", "payment"), "legacy": flag("legacy", "heavy")}
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), level.alias("level")) for f, level in levels.items()]))
    rows = flags.select("request_id", pairs.alias("p")).select("request_id", "p.*")
    default = F.lit(1.0)
    for (factor, level), value in DEFAULT_FACTORS.items():
        default = F.when((F.col("factor") == factor) & (F.col("level") == level), value).otherwise(default)
    found = rows.join(factors.select("factor", "level", "multiplier"), ["factor", "level"], "left")
    return found.groupBy("request_id").agg(F.round(F.product(F.coalesce("multiplier", default)), 6).alias("overhead"))


def effective_scope(items: DataFrame, systems: DataFrame) -> DataFrame:
    """New Application above half unknown systems, New Module above three tenths."""
    rows = items.select("request_id", "system").distinct().join(systems.select("system", F.lit(1).alias("known")), "system", "left")
    share = F.avg(F.when(F.col("known").isNull(), 1.0).otherwise(0.0))
    got = rows.groupBy("request_id").agg(share.alias("unknown_share"))
    return got.withColumn("scope", F.when(F.col("unknown_share") > 0.5, "New Application").when(F.col("unknown_share") > 0.3, "New Module").otherwise("Enhancement"))


def estimate(efforts: DataFrame, ai_multiplier: float = 1.0, contingency: float = 1.05) -> DataFrame:
    """(request_id, total_days, low, high) from base, surcharge, overhead, scope_factor
    and band (0.1, 0.25 or 0.4); at least half a day."""
    total = F.greatest((F.col("base") + F.coalesce("surcharge", F.lit(0.0))) * F.col("overhead") * F.col("scope_factor") * contingency * ai_multiplier, F.lit(0.5))
    rows = efforts.withColumn("total_days", F.round(total, 2))
    return rows.select("request_id", "total_days", F.round(F.col("total_days") * (1 - F.col("band")), 2).alias("low"), F.round(F.col("total_days") * (1 + F.col("band")), 2).alias("high"))


def discipline_breakdown(effort: DataFrame, disciplines: DataFrame, overrides: DataFrame) -> DataFrame:
    """Days and months by discipline of the unit's category; a system's own discipline
    takes its place except for qa and devops."""
    rows = effort.join(disciplines, "category", "left").join(overrides.withColumnRenamed("discipline", "_own"), "system", "left")
    kind = F.when(F.col("discipline").isin("qa", "devops"), F.col("discipline")).otherwise(F.coalesce("_own", "discipline", F.lit("backend")))
    sums = rows.groupBy("request_id", kind.alias("discipline")).agg(F.sum("days").alias("_days"))
    return sums.select("request_id", "discipline", F.round("_days", 2).alias("person_days"), F.round(F.col("_days") / DAYS_PER_MONTH, 3).alias("person_months"))


def distribution_correction(breakdown: DataFrame, rules: DataFrame, least_total: float = 20.0) -> DataFrame:
    """Disciplines under their least share are raised to the expected share, where a
    request has at least ``least_total`` days."""
    total = F.sum("person_days").over(Window.partitionBy("request_id"))
    rows = breakdown.withColumn("_total", total).join(rules, "discipline", "left")
    low = (F.col("_total") >= least_total) & (F.col("person_days") < F.col("min_share") * F.col("_total"))
    return rows.select("request_id", "discipline", "person_days", F.round(F.when(low, F.col("expected_share") * F.col("_total")).otherwise(F.col("person_days")), 2).alias("corrected_days"))


#: units that the warnings look for (fixed values)
PAYMENT_UNITS, ERP_UNITS, INTEGRATION_TEST, SECURITY_TEST, LOAD_TEST = ("BE-08", "BE-09", "INT-13"), ("BE-17", "INT-07", "INT-08"), "QA-02", "QA-06", "QA-05"


def sanity_warnings(requests: DataFrame, systems: DataFrame, items: DataFrame, guards: DataFrame, hubs: list[str], erp: str) -> DataFrame:
    """(request_id, warnings): codes of what looks wrong, in a fixed order.  requests:
    request_id, effort, scope, security; systems: request_id, system; items: request_id,
    unit_id; guards: scope, least, most days (null: none)."""
    present = items.groupBy("request_id").agg(
        F.bool_or(F.col("unit_id").startswith("INT-")).alias("_int"), F.bool_or(F.col("unit_id").isin(*PAYMENT_UNITS)).alias("_pay"), F.bool_or(F.col("unit_id").isin(*ERP_UNITS)).alias("_erp"),
        *[F.bool_or(F.col("unit_id") == u).alias(n) for u, n in ((INTEGRATION_TEST, "_it"), (SECURITY_TEST, "_st"), (LOAD_TEST, "_lt"))],
    )
    touched = systems.groupBy("request_id").agg(F.count_distinct("system").alias("_n"), F.bool_or(F.col("system").isin(*hubs)).alias("_hub"), F.bool_or(F.col("system").contains(erp)).alias("_touches"))
    rows = requests.join(guards, "scope", "left").join(present, "request_id", "left").join(touched, "request_id", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    codes = [
        ("BELOW_LEAST", F.col("effort") < F.col("least")), ("ABOVE_MOST", F.col("effort") > F.col("most")), ("HUB_WITHOUT_INTEGRATION", F.col("_hub") & no("_int")), ("PAYMENT_WITHOUT_TEST", F.col("_pay") & no("_it")),
        ("SYSTEMS_WITHOUT_TEST", (F.col("_n") >= 3) & no("_it")), ("ERP_WITHOUT_UNIT", F.col("_touches") & no("_erp")), ("SECURITY_WITHOUT_SCAN", F.col("security") & no("_st")), ("LARGE_WITHOUT_LOAD_TEST", (F.col("effort") > 50) & no("_lt")),
    ]
    return rows.select("request_id", F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in codes])).alias("warnings"))


def cost(effort: DataFrame, rates: DataFrame, default_rate: float = 10_000.0, working_days: int = DAYS_PER_MONTH) -> DataFrame:
    """Cost of each estimate: days / working days x the discipline's monthly rate."""
    rows = effort.join(rates, "discipline", "left")
    each = F.col("person_days") / working_days * F.coalesce("monthly_rate", F.lit(default_rate))
    return rows.groupBy("request_id").agg(F.round(F.sum(each), 2).alias("total_cost"), F.round(F.sum("person_days"), 2).alias("total_days"))


def duration(effort: DataFrame, team: DataFrame) -> DataFrame:
    """Months of each variant: the longest discipline's, at least a tenth, and which."""
    rows = effort.join(team, ["request_id", "discipline"], "left").withColumn("months", F.col("person_months") / F.greatest(F.coalesce("people", F.lit(1)), F.lit(1)))
    got = rows.groupBy("request_id", F.coalesce("variant", F.lit("default")).alias("variant"))
    return got.agg(F.round(F.greatest(F.max("months"), F.lit(0.1)), 2).alias("months"), F.max_by("discipline", F.struct("months", "discipline")).alias("critical_discipline"))


def team_sizes(effort: DataFrame) -> DataFrame:
    """(request_id, discipline, people): a quarter of the months, at least one."""
    return effort.select("request_id", "discipline", F.greatest(F.lit(1), F.bround(F.col("person_months") / 4).cast("int")).alias("people"))


def normalized_team(effort: DataFrame, team: DataFrame, unknown: int = 5, most: int = 10) -> DataFrame:
    """(request_id, discipline, people) of a suggested team (request_id, discipline,
    people), in proportion to effort: the discipline with most effort (ties: the first by
    name) keeps its people, held to 1..``most`` (``unknown`` if not suggested), the others
    get its number times their share of its effort, at least one.  A request without
    effort keeps its team."""
    order = Window.partitionBy("request_id").orderBy(F.desc("person_months"), "discipline")
    top = effort.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("request_id", F.col("discipline").alias("_top"), F.col("person_months").alias("_most"))
    lead = top.join(team.select("request_id", F.col("discipline").alias("_top"), F.col("people").alias("_people")), ["request_id", "_top"], "left")
    lead = lead.select("request_id", "_top", "_most", F.greatest(F.lit(1), F.least(F.coalesce("_people", F.lit(unknown)), F.lit(most))).alias("_lead"))
    rows = team.join(lead, "request_id", "left").join(effort.select("request_id", "discipline", "person_months"), ["request_id", "discipline"], "left")
    scaled = F.greatest(F.lit(1), F.bround(F.col("_lead") * F.coalesce("person_months", F.lit(0.0)) / F.col("_most")).cast("int"))
    people = F.when(F.coalesce(F.col("_most") > 0, F.lit(False)), F.when(F.col("discipline") == F.col("_top"), F.col("_lead")).otherwise(scaled)).otherwise(F.col("people"))
    return rows.select("request_id", "discipline", people.cast("int").alias("people"))


#: weights of input tier, document detail, requirement clarity, domain history, scope
#: coverage, and what a tier counts (fixed values)
CONFIDENCE_WEIGHTS = (0.30, 0.25, 0.20, 0.15, 0.10)
TIER_POINTS = (25.0, 45.0, 62.5, 77.5)


def confidence(tier: Column, detail: Column, clarity: Column, history: Column, coverage: Column) -> Column:
    """Weighted mean of factors held to 0..100, to two places; a tier counts with the middle of its
    range."""
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(c.cast("double"), F.lit(0.0))))
    points = F.element_at(F.array(*map(F.lit, TIER_POINTS)), tier.cast("int") + 1)
    parts = [points, held(detail), held(clarity), held(history), held(coverage)]
    total = sum((w * p for w, p in zip(CONFIDENCE_WEIGHTS[1:], parts[1:], strict=True)), CONFIDENCE_WEIGHTS[0] * parts[0])
    return F.round(total, 2)


def domain_history(estimates: DataFrame) -> DataFrame:
    """``estimates`` (domain, stream, created_at and others) with earlier, how many of the
    same domain and stream came before (ties in time don't), and its points."""
    before = Window.partitionBy("domain", "stream").orderBy("created_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("domain", "stream", "created_at")
    rows = estimates.withColumn("earlier", F.count("*").over(before) - F.count("*").over(same))
    return rows.withColumn("points", domain_history_score(F.col("earlier")))


def domain_history_score(earlier: Column) -> Column:
    """Points for how many estimates a domain has had: 0, 1, 2-3, 4-5, more."""
    return F.when(earlier >= 6, 95).when(earlier >= 4, 80).when(earlier >= 2, 60).when(earlier == 1, 30).otherwise(0)


def tco(options: DataFrame, years: int = 5) -> DataFrame:
    """One-time plus running cost over the years; years without a figure repeat the last;
    options: option_id, one_time, yearly ARRAY<DOUBLE>, users."""
    year = F.explode(F.sequence(F.lit(1), F.lit(years)))
    rows = options.select("option_id", "one_time", "users", "yearly", year.alias("year"))
    each = F.when(F.size("yearly") > 0, F.element_at("yearly", F.least(F.col("year"), F.size("yearly")))).otherwise(F.lit(0.0))
    sums = rows.groupBy("option_id").agg(F.first("one_time").alias("one_time"), F.first("users").alias("users"), F.sum(each).alias("running"))
    return sums.select("option_id", F.round(F.col("one_time") + F.col("running"), 2).alias("total"), F.round(F.col("running") / years, 2).alias("running_per_year"), F.when(F.col("users") > 0, F.round((F.col("one_time") + F.col("running")) / F.col("users"), 2)).alias("per_user"))


def vendor_compare(proposals: DataFrame) -> DataFrame:
    """Cost variance over 25 percent and delivery ratios under 0.7 or over 1.5 are flagged;
    coverage is held to 0..100."""
    variance = F.when(F.col("internal_cost") > 0, F.round(100 * (F.col("vendor_cost") - F.col("internal_cost")) / F.col("internal_cost"), 2)).otherwise(F.lit(0.0))
    ratio = F.when(F.col("internal_timeline") > 0, F.round(F.col("vendor_timeline") / F.col("internal_timeline"), 3)).otherwise(F.lit(1.0))
    rows = proposals.withColumns({"cost_variance": variance, "delivery_ratio": ratio})
    return rows.select("proposal_id", "cost_variance", (F.abs("cost_variance") > 25).alias("cost_flag"), "delivery_ratio", ((F.col("delivery_ratio") < 0.7) | (F.col("delivery_ratio") > 1.5)).alias("delivery_flag"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), "coverage")).alias("coverage"))


def rank_vendors(scored: DataFrame) -> DataFrame:
    """Composite of quality, cost and delivery, 40/35/25, not under 0, to one place; ties by
    proposal.  Tenths are rounded as doubles: rounding to a place would go by the sum's digits,
    in which half a tenth can be missing (13.549999999999999)."""
    raw = 0.40 * F.col("quality") + 0.35 * F.col("cost") + 0.25 * F.col("delivery")
    total = F.greatest(F.lit(0.0), F.when(F.abs(raw) < 1e307, F.round(raw * 10) / 10).otherwise(raw))
    rows = scored.withColumn("composite", total)
    return rows.select("request_id", "proposal_id", "composite", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("composite"), "proposal_id")).alias("rank"))


def rank_options(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Options scored in every dimension, by weighted total."""
    n = weights.agg(F.count("*").alias("_n"))
    sums = scores.join(weights, "dimension").groupBy("evaluation_id", "option_id").agg(F.sum(F.col("score") * F.col("weight")).alias("_total"), F.countDistinct("dimension").alias("_have"))
    rows = sums.join(F.broadcast(n), F.col("_have") == F.col("_n")).withColumn("total", F.round("_total", 4))
    return rows.select("evaluation_id", "option_id", "total", F.rank().over(Window.partitionBy("evaluation_id").orderBy(F.desc("total"))).alias("rank"))


def evaluation_status(options: DataFrame, scores: DataFrame, costs: DataFrame, dimensions: int = 8) -> DataFrame:
    """Draft without options, Scoring_Complete if each has all dimensions and a cost row,
    else In_Progress.  options: evaluation_id, option_id (null for none)."""
    have = scores.groupBy("option_id").agg(F.countDistinct("dimension").alias("_d"))
    paid = costs.select("option_id", F.lit(1).alias("_c")).distinct()
    rows = options.join(have, "option_id", "left").join(paid, "option_id", "left")
    whole = F.bool_and(F.coalesce((F.col("_d") >= dimensions) & (F.col("_c") == 1), F.lit(False)) | F.col("option_id").isNull())
    got = rows.groupBy("evaluation_id").agg(F.count("option_id").alias("_n"), whole.alias("_whole"))
    return got.select("evaluation_id", F.when(F.col("_n") == 0, "Draft").when(F.col("_whole"), "Scoring_Complete").otherwise("In_Progress").alias("status"))


def cloud_cost(resources: DataFrame, prices: DataFrame, deployments: DataFrame) -> DataFrame:
    """Monthly production and all-environment cost: distinct resources x price x the
    request's largest deployment multiplier."""
    unit = resources.groupBy("request_id", "resource").agg(F.sum("quantity").alias("quantity")).join(prices, "resource", "left")
    factor = deployments.groupBy("request_id").agg(F.max("multiplier").alias("multiplier"), F.max("environments").alias("environments"))
    sums = unit.groupBy("request_id").agg(F.sum(F.col("quantity") * F.coalesce("price", F.lit(0.0))).alias("base")).join(factor, "request_id", "left")
    prod = F.col("base") * F.coalesce("multiplier", F.lit(1.0))
    return sums.select("request_id", F.round(prod, 2).alias("production"), F.round(prod * F.coalesce("environments", F.lit(1)), 2).alias("all_environments"))
