"""Connected components over a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of ``edges(a, b)``; the component is its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the edges are stars.
    Each step joins edges with the minimum of their neighbourhood, found by a partial aggregate, so no
    neighbourhood is ever held in one place; AQE splits a neighbourhood that is too large to join at once.
    """
    edges = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    star = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())
