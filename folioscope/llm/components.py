"""Connected components of an edge table, by alternating large-star and small-star steps.

The number of rounds grows with the logarithm of the longest path. No step holds a node's neighbours
together: each is a minimum by key (summed up before the shuffle) and a join with that minimum, which
adaptive execution may split where a node has very many neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Scratch


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of the edges (columns u, v, long); root is the smallest node of the component.

    Edges may be in either direction, repeated, or loops; no edge gives an empty table."""
    now = scratch.save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        stars = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(stars) == state or not stars[0]:
            break
        state, n = tuple(stars), stars[0]  # rows of the tables below are bounded by the number of edges
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(_least(both).select("u", F.least("u", "m").alias("m")), "least", 2 * n)
        large = scratch.save(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star", 2 * n)
        lower = scratch.save(_least(large), "lower", 2 * n)
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.save(small, "small-star", 4 * n)
        scratch.drop(now, least, large, lower)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
