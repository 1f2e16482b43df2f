"""Streaming forms of two signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import text, values
from tallyscope.operators.groups import channel
from tallyscope.params import DEFAULTS, Params


def stateless_flags(tx: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Round, near-threshold, approval and compensation flags; works on a stream and on a table."""
    near = values.nearest_threshold(F.col("movement_amount"), p.near_thresholds)
    described = F.coalesce("descripcion", F.lit("")) if "descripcion" in tx.columns else F.lit("")
    return tx.withColumns({
        "sig_roundsum": values.is_round(F.col("movement_amount"), p.round_bases),
        "sig_near_thr": near["distance"] <= p.near_delta,
        "has_approval": described.rlike(text.APPROVAL),
        "has_comp": described.rlike(text.COMPENSATION),
    })


def channel_bursts(tx: DataFrame, p: Params = DEFAULTS, late: str = "1 day") -> DataFrame:
    """Bins of a channel as they close; people are counted approximately, as exact distinct counts are not kept in stream state."""
    hour = F.hour("fecha_hora_ts")
    off = ((hour < p.work_start) | (hour >= p.work_end)).cast("long")
    bins = tx.withWatermark("fecha_hora_ts", late).groupBy(channel(F.col("origin_application_id")).alias("canal"), F.window("fecha_hora_ts", f"{p.burst_hours} hours").alias("w"))
    g = bins.agg(F.count(F.lit(1)).alias("n"), F.sum(off).alias("fuera"), F.sum("movement_amount").alias("monto"), F.approx_count_distinct("user_id").alias("emisores"))
    ratio = F.col("fuera") / F.col("n")
    return g.select("canal", F.col("w.start").alias("inicio"), F.col("w.end").alias("fin"), "n", "fuera", F.round("monto", 4).alias("monto"), "emisores", ((F.col("n") >= p.burst_min_tx) & (ratio >= p.burst_off_ratio)).alias("evento"))


def gathered(stream: DataFrame, folder: str, make: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame:
    """What `make` gives for each micro-batch of all that is there now, as one table.

    A batch is written to a folder named by its number, over what an attempt before a restart may have left there; progress lies in the
    same folder, so a later call reads new files only and returns old and new together. A stream without rows gives an empty table.
    folder: shared by driver and executors.
    """
    spark = stream.sparkSession
    parts = f"{folder}/parts"
    empty = make(spark.createDataFrame([], stream.schema))
    empty.write.mode("overwrite").parquet(f"{parts}/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{parts}/batch={number}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(empty.schema).parquet(parts).select(*empty.columns)


def burst_parts(tx: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Sums per channel, bin, sender and receiver. Parts of any split of the rows add up to the same bins."""
    hour = F.hour("fecha_hora_ts")
    off = ((hour < p.work_start) | (hour >= p.work_end)).cast("long")
    by = [channel(F.col("origin_application_id")).alias("canal"), F.window("fecha_hora_ts", f"{p.burst_hours} hours").alias("w"), "user_id", "receiver_id"]
    g = tx.groupBy(*by).agg(F.count("movement_amount").alias("n"), F.sum(off).alias("fuera"), F.sum("movement_amount").alias("monto"))
    return g.select("canal", F.col("w.start").alias("inicio"), F.col("w.end").alias("fin"), "user_id", "receiver_id", "n", "fuera", "monto")


def burst_table(parts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The bins (A4) of parts: people are counted exactly."""
    g = parts.groupBy("canal", "inicio", "fin").agg(
        F.sum("n").alias("n"), F.sum("fuera").alias("fuera"), F.sum("monto").alias("monto"), F.count_distinct("user_id").alias("emisores"), F.count_distinct("receiver_id").alias("receptores")
    )
    return g.withColumn("evento", (F.col("n") >= p.burst_min_tx) & (F.try_divide("fuera", "n") >= p.burst_off_ratio))


def streamed_bursts(stream: DataFrame, folder: str, p: Params = DEFAULTS) -> DataFrame:
    """X1 as a stream into a table: equal to A4 over all rows that have come, in whatever order and however late; no state is held between batches."""
    return burst_table(gathered(stream, folder, lambda batch: burst_parts(batch, p)), p)


def streamed_flags(stream: DataFrame, folder: str, p: Params = DEFAULTS) -> DataFrame:
    """X2 as a stream into a table."""
    return gathered(stateless_flags(stream, p), folder)
