"""Cutting lineage in loops: a table written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def shared_folder(df: DataFrame) -> str:
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tallyscope-")
    return _own[app]


def cut(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """codec: how a large table is packed, where the usual one is too light."""
    path = f"{shared_folder(df)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
