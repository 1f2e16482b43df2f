"""Operator 1: shards by jump consistent hashing.

A stable key decides the shard; there is no ring table. When a shard is appended, a key stays
where it is or moves into the new shard, so 1/(n+1) of the rows move.

Defined cases: a null key is a key of its own; a null text has no bytes; texts of any length are measured
whole; repeated rows go to the same shard and take different slots; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import byte_size, text_crc32, written

#: Slots are numbered by (shard, bucket); a bucket holds 1 / (shards * SLOT_BUCKETS) of the rows.
SLOT_BUCKETS = 1024


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach) of many 64-bit keys at once."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    bucket = np.zeros(len(key), dtype=np.int64)
    open_rows = np.arange(len(key))
    jump = np.zeros(len(key), dtype=np.int64)
    with np.errstate(over="ignore"):
        while len(open_rows):
            bucket[open_rows] = jump
            key = key * np.uint64(2862933555777941757) + np.uint64(1)
            jump = ((jump + 1) * (float(1 << 31) / ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
            go = jump < n_shards
            open_rows, key, jump = open_rows[go], key[go], jump[go]
    return bucket


def shard_of(key: Column, n_shards: int) -> Column:
    """Shard 0..n_shards-1 of a key column of any type."""

    @F.pandas_udf("int")
    def jump(mixed: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(mixed.to_numpy(), n_shards).astype(np.int32))

    return jump(F.xxhash64(key))


def assign_shards(rows: DataFrame, key: str, n_shards: int, to: str = "shard") -> DataFrame:
    """Rows with their shard in column `to`: one narrow pass, no shuffle."""
    return rows.withColumn(to, shard_of(F.col(key), n_shards))


def write_shards(rows: DataFrame, key: str, n_shards: int, path: str) -> None:
    """One folder per shard; each task writes what it holds of every shard, so no shard passes through one task."""
    assign_shards(rows, key, n_shards).write.partitionBy("shard").parquet(path)


def number_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Add `slot`, gapless from 0 in each shard.

    A shard is split into buckets that are counted, and each bucket starts where those before it end.
    Buckets also hash the row's place in the input, so one key with a third of the rows fills all of them.
    """
    spread = F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.lit(SLOT_BUCKETS)).cast("int")
    dealt = written(rows.withColumn("_bucket", spread), "slots")
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(shard, "_bucket").count().select(shard, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*order))
    # shards * SLOT_BUCKETS rows at most
    return dealt.withColumn("_place", place).join(F.broadcast(starts), [shard, "_bucket"]).withColumn("slot", F.col("_start") + F.col("_place") - 1).drop("_bucket", "_start", "_place")


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard that one more shard would give."""
    text = F.col("text")
    rows = docs.select("doc_id", (byte_size(text) + 1).alias("size"), text_crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    rows = assign_shards(assign_shards(rows, "doc_id", n_shards), "doc_id", n_shards + 1, "grown_shard")
    return number_slots(rows, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
