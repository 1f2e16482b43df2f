"""Exact quantiles of groups of any size, as distributed order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.checkpoints import cut


def quantiles(df: DataFrame, by: list[str], column: str | Column, probabilities: list[float]) -> DataFrame:
    """by, n (values that are not null) and q, an array with the interpolated quantile for each probability, equal to percentile's.

    Values are counted, dealt by ranges of (group, value) and summed per range; the sums say which range holds a rank, and only there are
    counts added up value by value. So a group with a third of all rows fills many tasks, and no buffer holds a group's values.
    A group without values has n = 0 and nulls.
    """
    value = F.col(column) if isinstance(column, str) else column
    counts = df.select(F.struct(*by).alias("_g"), value.alias("_v")).groupBy("_g", "_v").agg(F.count("_v").alias("_c"))
    dealt = cut(counts.repartitionByRange("_g", "_v").withColumn("_part", F.spark_partition_id()), "quantiles")
    group = Window.partitionBy("_g")
    ranges = dealt.groupBy("_g", "_part").agg(F.sum("_c").alias("_s"))
    earlier = F.sum("_s").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("_g", "_part", F.coalesce(earlier, F.lit(0)).alias("_from"), (F.coalesce(earlier, F.lit(0)) + F.col("_s")).alias("_upto"), F.sum("_s").over(group).alias("n"))
    place = [p * (F.col("n") - 1) for p in probabilities]
    ranks = [(F.floor(x), F.ceil(x)) for x in place]
    holds = lambda k: (F.col("_from") <= k) & (k < F.col("_upto"))
    wanted = F.lit(False)
    for pair in ranks:
        for k in pair:
            wanted = wanted | holds(k)
    # the ranges that hold a rank, then the values that hold it
    upto = F.col("_from") + F.sum("_c").over(Window.partitionBy("_g", "_part").orderBy("_v"))
    values = dealt.join(ranges.where(wanted), ["_g", "_part"]).withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_c")).where(wanted)
    ends = [F.max(F.when(holds(k), F.col("_v"))).cast("double").alias(f"_{side}{i}") for i, pair in enumerate(ranks) for side, k in zip("lh", pair)]
    found = values.groupBy("_g").agg(*ends)
    sizes = ranges.groupBy("_g").agg(F.max("n").alias("n"))
    low, high = [F.col(f"_l{i}") for i in range(len(place))], [F.col(f"_h{i}") for i in range(len(place))]
    mixed = [F.when(a == b, a).otherwise((F.ceil(x) - x) * a + (x - F.floor(x)) * b) for a, b, x in zip(low, high, place)]
    return sizes.join(found, "_g", "left").select("_g.*", "n", F.array(*mixed).alias("q"))


def quantile(df: DataFrame, by: list[str], column: str | Column, probability: float, name: str) -> DataFrame:
    """by and one quantile as `name`."""
    return quantiles(df, by, column, [probability]).select(*by, F.get("q", F.lit(0)).alias(name))
