"""Connected components of a graph given as edges, by alternating large and small stars.

Every round is two aggregates with map-side combine and two joins; tables are written between them,
so that a join sees its sides as they are and can split the rows of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, scratch


def _star(edges: DataFrame, larger: bool, keep: bool = False) -> DataFrame:
    """`edges` are (u, v) with u > v. Link the larger (or all smaller) neighbours of a node to its smallest one."""
    ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
    least = materialise(ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least")), "component-least")
    joined = ways.join(least, "u")
    if larger:
        linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        linked = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))
    return materialise(linked.where("u <> v").distinct(), "component-edges", keep)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge but the roots: root is the smallest node it can reach.

    `edges` has two columns of ids in any direction; loops and null ends are ignored.
    """
    a, b = edges.columns
    edges = (
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    spark = edges.sparkSession
    edges = materialise(edges, "component-edges")
    state, last = _state(edges), None
    while state != last:
        with scratch(spark):
            edges = _star(_star(edges, True), False, keep=True)
        state, last = _state(edges), state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
