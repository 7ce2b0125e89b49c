"""Connected components by alternating large and small stars.

Each round replaces every edge by one towards the smallest neighbour seen, first
for the larger neighbours of a node, then for the smaller ones, until nothing
changes; the rounds grow with the logarithm of the component's size. Minima
combine map-side, edges of a hub are split by Spark's skew join, and each round
is written to the shared folder, so no lineage builds up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm.common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.min("v").alias("__m")).select("u", F.least("u", "__m").alias("__m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("__m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("__m"))
    moved = down.join(least, "u").filter("v <> __m").select(F.col("v").alias("u"), F.col("__m").alias("v"))
    return moved.unionByName(least.select("u", F.col("__m").alias("v")))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v); label is the component's smallest node.

    Null ends and loops are left out; no edges give no rows.
    """
    edges = written(edges.filter("u is not null and v is not null and u <> v").distinct())
    before = _state(edges)
    while before[0]:
        edges = written(_small_star(_large_star(edges)).distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
