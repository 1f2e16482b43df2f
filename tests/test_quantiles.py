"""Distributed quantiles against the aggregate that holds a group in one buffer."""

import random

from pyspark.sql import functions as F

from tallyscope.operators.quantiles import quantile, quantiles


def test_equal_to_percentile(spark):
    rnd = random.Random(3)
    # one group with a third of all rows, ties, nulls, a group of one value, one of nulls, a null group
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, rnd.randrange(5) / 7, rnd.random() * 1e6, -rnd.random()])) for _ in range(4000)]
    rows += [("hot", rnd.choice([rnd.random(), 0.25])) for _ in range(2000)] + [("one", 3.0)] * 5 + [("none", None)] * 3 + [("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    probabilities = [0.0, 0.15, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]
    want = df.groupBy("g").agg(F.count("x").alias("n"), F.percentile("x", F.array(*[F.lit(p) for p in probabilities])).alias("q"))
    want = {r["g"]: (r["n"], r["q"] or [None] * len(probabilities)) for r in want.collect()}
    got = {r["g"]: (r["n"], r["q"]) for r in quantiles(df, ["g"], "x", probabilities).collect()}
    assert got == want


def test_integers_and_empty(spark):
    df = spark.createDataFrame([(1, i % 10) for i in range(101)], "g int, x int")
    assert [tuple(r) for r in quantile(df, ["g"], "x", 0.5, "m").collect()] == [(1, 4.0)]
    assert quantiles(df.limit(0), ["g"], "x", [0.5]).count() == 0


def test_no_task_holds_a_group(spark):
    """Ranges are dealt by (group, value): the rows of one group lie in several partitions."""
    df = spark.range(20_000).select(F.lit(1).alias("g"), (F.col("id") * 1.5).alias("x"))
    plan = quantiles(df, ["g"], "x", [0.3])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
    assert quantile(df, ["g"], "x", 0.3, "m").first()["m"] == df.agg(F.percentile("x", F.lit(0.3))).first()[0]
