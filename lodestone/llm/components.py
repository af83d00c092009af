"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import removed, written


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each u, pre-aggregated before its shuffle."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """The smallest member of each vertex's component: vertex, root, for vertices with links.

    Vertices are longs; loops and null ends are ignored, repeated links are one. An empty table
    gives no rows. Every round joins a written table with the written minima, so that the rows of a
    vertex with very many links can be split among tasks; the number of rounds grows with the
    logarithm of the longest path.
    """
    source = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct()
    edges = written(source)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both)
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        lowest = _least(large)
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        for table in (edges, low, large, lowest):
            removed(table)
        before, edges = state, new
        state = _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
