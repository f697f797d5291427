"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.session import cut_lineage


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """Edges (a long, b long) to one row per vertex: id, component (the component's least id).

    Each step keeps the components and is a grouped minimum (combined before the shuffle) and a join that adaptive
    execution splits at hot vertices. Steps are written to the shared folder; their number grows with the
    logarithm of the longest path. Loops and repeats are allowed; vertices without edges are not in the result.
    """
    a, b = F.col("a"), F.col("b")
    now = cut_lineage(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        # Large star: every larger neighbour moves to the least neighbour.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.distinct())
        # Small star: every smaller neighbour moves to the least one.
        least = _least_neighbour(large)
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut_lineage(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        inner = after.select(F.col("v").alias("u")).distinct().join(after, "u", "left_semi")
        if inner.isEmpty():  # stars only: no centre hangs on another
            break
        now = after
    centres = after.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return after.select(F.col("u").alias("id"), F.col("v").alias("component")).union(centres)
