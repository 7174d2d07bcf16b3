"""Connected components of an edge table: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewash.llm.common import stored


def _star(edges: DataFrame, least: DataFrame, larger: bool) -> DataFrame:
    joined = edges.join(least, "u")
    if larger:  # neighbours above u hang on the least neighbour
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.where("m < u").select("u", F.col("m").alias("v"))  # u and its smaller neighbours do
    return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``id``, ``component`` (least id reachable) of every id in ``edges`` (a, b: longs).

    Each step sends at most as many edges as there were; steps stop when no edge changes
    (about log of the longest path). The edges of a step live in the shared folder."""
    a_b = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    now = stored(spark, a_b, "edges")
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(spark, _star(both, least, True).where("u != v").distinct(), "edges")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        now = stored(spark, _star(down, least, False).where("u != v").distinct(), "edges")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state:
            roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
        state = seen
