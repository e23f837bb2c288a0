"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import materialise
from .skew import join_keyed


def _least(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``_m``: the smallest ``value`` of their ``key``; a hub's rows are not gathered."""
    least = rows.groupBy(key).agg(F.min(value).alias("_m"), F.count(F.lit(1)).alias("_many"))
    return join_keyed(rows, least, [key], "_many", rows.count())


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex moves to the smallest vertex of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _least(both, "u", "v").where("v > u").select(F.col("v").alias("a"), F.least("u", "_m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """With edges from larger to smaller: a vertex and its smaller neighbours move to the smallest of these."""
    least = _least(edges, "a", "b")
    moved = least.where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.unionByName(least.select("a", F.col("_m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(``a``, ``b``) edges -> (``id``, ``component``) of each vertex that has an edge, component the smallest id in it.

    Rounds grow with the logarithm of the number of vertices; each is a grouped minimum with map-side
    combining and a join that leaves a hub's edges where they are. Self loops and repeats are ignored.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        half = materialise(_large(now), "edges")
        now = materialise(_small(half), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
