"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import Scratch, written


def _toward_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One step over edges (a, b). Large star: every larger neighbour of a, small star: every smaller one and a, go to the least."""
    if larger_only:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.join(least, "a")
    if larger_only:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
    return moved.where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of edges (a, b) of longs.

    Each round is a few joins on hashed keys and is written to the shared folder, where the round before it is
    removed; the number of rounds grows with the logarithm of the longest chain. Only a count and a checksum reach the driver.
    """
    spark = edges.sparkSession
    kept = Scratch(spark)
    now = kept.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        sums = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (sums["n"], sums["s"]) == state:
            break
        state = (sums["n"], sums["s"])
        following = Scratch(spark)
        now = following.written(_toward_least(_toward_least(now, True), False))
        kept.remove()
        kept = following
    # every edge now leads from a node to the least of its component
    both = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")))
    out = written(both.groupBy("node").agg(F.min("component").alias("component")), "components")
    kept.remove()
    return out
