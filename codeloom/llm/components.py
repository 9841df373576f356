"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.storage import drop, kept


def _least(edges: DataFrame) -> DataFrame:
    """Rows u, v, m: each edge with the least neighbour (or u itself) of u; pre-aggregated, then joined back, so that a
    node with very many neighbours is split like any skewed key."""
    least = edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is a centre, or a leaf of one centre."""
    ends = edges.selectExpr("u as node", "1 as leaf", "0 as centre").unionByName(edges.selectExpr("v as node", "0 as leaf", "1 as centre"))
    ends = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return ends.filter("leaf > 1 or (leaf = 1 and centre = 1)").isEmpty()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``a, b`` (long) to ``node, component_id``: the smallest node that can be reached; nodes without edges are absent."""
    edges = kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _are_stars(edges):
            return edges.selectExpr("u as node", "v as component_id").unionByName(edges.selectExpr("v as node", "v as component_id").distinct())
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _least(large)
        stars = small.selectExpr("v as u", "m as v").union(small.selectExpr("u", "m as v")).filter("u <> v").distinct()
        before, edges = edges, kept(stars, "stars")
        drop(before)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
