"""Writing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    nested = {f.name: F.to_json(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    return df.withColumns(nested)


def write_reports(reports: dict[str, DataFrame], out_dir: str, stamp: str, form: str = "csv") -> None:
    """Every report, partitioned by time frame where it has one. `stamp` is part of the name."""
    for name, df in reports.items():
        writer = (flat(df) if form == "csv" else df).write.mode("overwrite").option("header", True)
        if "timeframe_periodo" in df.columns:
            writer = writer.partitionBy("timeframe_periodo")
        writer.format(form).save(f"{out_dir}/{name}_{stamp}")


def write_cases(reports: dict[str, DataFrame], out_dir: str, stamp: str, include_empty: bool = False) -> list[str]:
    """Only the case tables, and empty ones only if asked for. Returns the names written."""
    chosen = {k: v for k, v in reports.items() if k.startswith("casuistica_") and (include_empty or not v.isEmpty())}
    write_reports(chosen, out_dir, stamp)
    return list(chosen)


def write_answers(answers: dict[str, DataFrame], out_dir: str) -> None:
    """A folder of CSV per question."""
    for name, df in answers.items():
        flat(df).write.mode("overwrite").option("header", True).csv(f"{out_dir}/{name}")


def write_sample(df: DataFrame, path: str, n: int, order: list) -> None:
    """The first n rows by an order that ends in a unique key."""
    flat(df.orderBy(*order).limit(n)).write.mode("overwrite").option("header", True).csv(path)
