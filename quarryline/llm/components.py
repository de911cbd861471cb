"""Connected components by alternating large-star and small-star steps.

Only groupings and joins of edge tables; each step's edges are written to the
shared folder, so no plan grows with the number of steps and nothing is gathered
on the driver but a count that tells when all components are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stored


def _smallest(sides: DataFrame) -> DataFrame:
    return sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    step = sides.join(_smallest(sides), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return step.where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _smallest(sides)
    step = sides.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return step.unionByName(own).where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or none, and no node both has one and is one."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("to")))
    roles = ends.groupBy("node").agg(F.min("to").alias("lo"), F.max("to").alias("hi"), F.count_if(F.col("to").isNull()).alias("leads"))
    return roles.where("lo != hi or (lo is not null and leads > 0)").count() == 0


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Self-links and repeated edges are harmless; nodes without an edge to another
    node are left out.  No edges give no rows."""
    now = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
    table = Stored(now.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(table.read()):
        step = Stored(_small_star(_large_star(table.read())))
        table.discard()
        table = step
    stars = table.read()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
