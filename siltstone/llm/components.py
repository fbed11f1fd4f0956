"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouping and a join of edges; nothing is gathered on the driver. Components come
out as (node, component) with the smallest node of each as its name; the smallest nodes
themselves are not listed. A centre of more than HUB edges is joined without gathering them in one
task; while there is none, plain joins do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, written

HUB = 1 << 16


def least(edges: DataFrame) -> DataFrame:
    """u, its smallest neighbour, and how many it has."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size"))


def met(edges: DataFrame, top: DataFrame, total: int | None) -> DataFrame:
    return edges.join(top.drop("size"), "u") if total is None else join_groups(edges, top, "u", "size", total)


def large_star(edges: DataFrame, total: int | None = None) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    top = least(both).select("u", F.least("u", "m").alias("m"), "size")
    return met(both, top, total and 2 * total).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, total: int | None = None) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    top = least(down)
    others = met(down, top, total).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(top.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node that is not its component's smallest."""
    edges = written(edges.where("u <> v").select("u", "v"), "edges")
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        # stars are left when no node points to two others, and none that points is pointed to
        state = ends.agg(F.sum("up").alias("edges"), F.max(F.col("up") + F.col("down")).alias("degree"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("open")).first()
        if not state["open"] and edges.where("u < v").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        total = state["edges"] if (state["degree"] or 0) > HUB else None
        edges = written(small_star(large_star(edges, total), total), "edges")
