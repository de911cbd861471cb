"""Monthly cloud cost of requests: what resources rules call for, how many, at what price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: multiplier of a deployment model that holds all of these words (fixed values); the largest counts
DEPLOYMENTS = ((("ib", "country"), 3.0), (("ib", "region"), 2.0), (("multi",), 2.0))
#: category of an item whose unit isn't known, and share of production that other environments take (fixed values)
DEFAULT_CATEGORY, NON_PRODUCTION = "backendLogic", 0.6
#: reasons shown for a resource
REASONS = 2


def deployment_multiplier(model: Column) -> Column:
    """How many times a deployment model needs everything; 1 for none of the known ones.  A
    country-wise one stands before a region-wise one and that before any with several regions."""
    out = F.lit(1.0)
    for words, factor in reversed(DEPLOYMENTS):
        met = F.lit(True)
        for w in words:
            met = met & F.contains(F.lower(model), F.lit(w))
        out = F.when(met, factor).otherwise(out)
    return out


def called_for(items: DataFrame, units: DataFrame, systems: DataFrame, rules: DataFrame) -> DataFrame:
    """(request_id, step, seen, ordinal, resource, quantity, reason): each rule that a request meets.

    items: request_id, ordinal, unit_id, reason; units: unit_id, category; systems: request_id,
    ordinal, system; rules: kind, key, ordinal, resource, quantity, reason.  A rule's kind is
    category (of an item's unit), system, baseline (every request) or keyword (its key stands
    in the items' reasons put together in order, any case; a key of two words may begin in one
    reason and end in the next; a null reason isn't there).  A category, and a system, counts once, where it is seen first."""
    of = lambda kind: rules.where(F.col("kind") == kind).select(F.col("key").alias("_key"), F.col("ordinal").alias("_rule"), "resource", "quantity", F.col("reason").alias("_why"))
    shape = lambda df, step, seen, why: df.select("request_id", F.lit(step).alias("step"), seen.cast("long").alias("seen"), F.col("_rule").cast("long").alias("ordinal"), "resource", F.col("quantity").cast("long").alias("quantity"), why.alias("reason"))
    category = items.join(units.select("unit_id", "category"), "unit_id", "left").groupBy("request_id", F.coalesce("category", F.lit(DEFAULT_CATEGORY)).alias("_key")).agg(F.min("ordinal").alias("_seen"))
    system = systems.groupBy("request_id", F.col("system").alias("_key")).agg(F.min("ordinal").alias("_seen"))
    requests = items.select("request_id").unionByName(systems.select("request_id")).distinct()
    before = F.lag("reason").over(Window.partitionBy("request_id").orderBy("ordinal"))
    texts = items.where("reason is not null").select("request_id", F.lower(F.concat_ws(" ", before, "reason")).alias("_text"))
    # the keys are one row; each text is gone through once for all of them
    keys = of("keyword").agg(F.collect_list(F.struct("_key", "_rule", "resource", "quantity", "_why")).alias("_keys"))
    met = texts.crossJoin(F.broadcast(keys)).select("request_id", F.explode(F.filter("_keys", lambda k: F.contains(F.col("_text"), F.lower(k["_key"])))).alias("_k")).select("request_id", "_k.*").distinct()
    parts = [
        shape(category.join(of("category"), "_key"), 1, F.col("_seen"), F.col("_why")),
        shape(system.join(of("system"), "_key"), 2, F.col("_seen"), F.concat("_key", F.lit(": "), "_why")),
        shape(requests.crossJoin(of("baseline")), 3, F.lit(0), F.col("_why")),
        shape(met, 4, F.lit(0), F.col("_why")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def request_multiplier(systems: DataFrame, models: DataFrame) -> DataFrame:
    """(request_id, multiplier): the largest of a request's systems (request_id, system); models:
    system, deployment_model.  A system without a model has 1."""
    return systems.join(models.select("system", "deployment_model"), "system", "left").groupBy("request_id").agg(F.max(F.coalesce(deployment_multiplier(F.col("deployment_model")), F.lit(1.0))).alias("multiplier"))


def cloud_lines(called: DataFrame, multipliers: DataFrame, prices: DataFrame) -> DataFrame:
    """(request_id, line, resource, quantity, unit_cost, cost, reason): one line for each resource
    of a request, dearest first and then as it was called for first: the largest quantity that
    any rule names, at its price (0 if there is none) times the request's multiplier, and the
    first two distinct reasons."""
    order = F.array_sort(F.collect_list(F.struct("step", "seen", "ordinal", "reason")))
    merged = called.groupBy("request_id", "resource").agg(F.max("quantity").alias("quantity"), order.alias("_why"))
    rows = merged.join(prices.select("resource", "price"), "resource", "left").join(multipliers, "request_id", "left")
    unit = F.coalesce(F.col("price").cast("double"), F.lit(0.0))
    rows = rows.withColumn("unit_cost", unit).withColumn("cost", F.col("unit_cost") * F.col("quantity") * F.coalesce("multiplier", F.lit(1.0)))
    first = F.col("_why")[0]
    line = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc(F.col("unit_cost") * F.col("quantity")), first["step"], first["seen"], first["ordinal"], "resource"))
    reason = F.array_join(F.slice(F.array_distinct(F.transform("_why", lambda x: x["reason"])), 1, REASONS), "; ")
    return rows.select("request_id", line.alias("line"), "resource", "quantity", "unit_cost", "cost", reason.alias("reason"))


def cloud_totals(lines: DataFrame, multipliers: DataFrame) -> DataFrame:
    """(request_id, resources, monthly_total, non_production, with_non_production, multiplier):
    production's cost, what other environments add, and both, in whole units, half to even."""
    whole = lambda c: F.bround(c).cast("long")
    sums = lines.groupBy("request_id").agg(F.count("*").alias("resources"), F.sum("cost").alias("_total")).join(multipliers, "request_id", "left")
    other = F.bround(F.col("_total") * NON_PRODUCTION)
    return sums.select("request_id", "resources", whole(F.col("_total")).alias("monthly_total"), other.cast("long").alias("non_production"), whole(F.col("_total") + other).alias("with_non_production"), F.coalesce("multiplier", F.lit(1.0)).alias("multiplier"))
