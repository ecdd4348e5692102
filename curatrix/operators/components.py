"""Connected components of a graph that no machine holds: large-star and small-star steps as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.shared import attach, materialise


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex in edges (a, b), except those that are their component's smallest.

    Each round joins every vertex's neighbours to the smallest vertex around; a vertex with many neighbours is summed
    before it moves, and joined by broadcast when hot. The last round's edges are stars around the components' smallest.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, was = materialise(pairs, "edges"), None
    while (stamp := _stamp(now)) != was and stamp[0]:
        was = stamp
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u")), "around")
        large = attach(both, around, "u", "n", 2 * stamp[0]).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        below = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "below")
        small = attach(large, below, "u", "n", large.count()).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.unionByName(below.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
