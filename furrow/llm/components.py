"""Connected components of a link table by alternating large-star and small-star
steps: every step is a minimum per node (combined map-side) and a join, so a node
with very many links is never gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import stage


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over edges (u, v), u > v."""
    if small:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        near = edges.join(low, "u")
        out = near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v")))
    else:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Does every node have one edge to a node that has none downwards?"""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), "v").union(
        edges.select(F.col("v"), F.lit(0), F.lit(None).cast(edges.schema["v"].dataType)))
    ends = ends.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.min("v").alias("a"), F.max("v").alias("b"))
    return ends.where("low < high OR a != b").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every linked node."""
    edges = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    while not _settled(edges):
        edges = stage(_star(_star(edges, small=False), small=True), "edges")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v"), F.col("v"))).distinct()
