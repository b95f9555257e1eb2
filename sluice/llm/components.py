"""Connected components by alternating large-star and small-star steps.

Every step is a grouping with a map-side minimum and a join, so a node with very
many neighbours is no group in one task; nothing reaches the driver but whether
the edges are stars yet. Links that come later join the components found before:
only the least nodes of these take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges lead from larger to smaller; a node and its smaller neighbours move to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour that has none itself, or only larger ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    sides = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return sides.filter((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).limit(1).count() == 0


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(node, component)`` of every node of the edges ``(u, v)``, stored; a component is named by its least node.

    With ``known``, an earlier result, the edges are added to those it came from.
    """
    if known is not None:
        return _extended(edges, known)
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _all_stars(now):
        last = now
        now = stored(_small_star(_large_star(last)), "edges")
        discard(last)
    out = stored(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    discard(now)
    return out


def _extended(edges: DataFrame, known: DataFrame) -> DataFrame:
    ends = edges.select("u", "v")
    for end in "uv":
        least = known.select(F.col("node").alias(end), F.col("component").alias("least"))
        ends = ends.join(least, end, "left").withColumn(end, F.coalesce("least", end)).drop("least")
    moved = components(ends)
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = known.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = stored(old.unionByName(moved.join(known, "node", "left_anti")), "components")
    discard(moved)
    return out
