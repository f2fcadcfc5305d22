"""Connected components of a link table by alternating large and small stars.

Each round is two grouped minima and two joins on narrow integer rows; the
neighbours of a node are never gathered. Rounds are cut by a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklode.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every larger (large) or every smaller (small) neighbour, and the node itself, on the node's least neighbour."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _print(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum((F.xxhash64("b", "a") % 1000003).cast("long"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every id that has a link to a smaller one (others are their own)."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _print(edges)
    while seen[0]:
        before, edges = edges, materialize(_star(_star(edges, True), False))
        discard(before)
        now = _print(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
