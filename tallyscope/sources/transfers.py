"""Reading and canonicalising transfers."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions import text, values

REQUIRED = ("user_id", "receptor-user_id", "movement_amount", "load_date", "transaction_desc")
MANAGERS = tuple(f"manager_{i}_user_id" for i in range(1, 5))
#: Optional columns, filled with nulls where absent, so the schema after ingest is fixed.
OPTIONAL = (*MANAGERS, "companeros_de_equipo", "origin_application_id", "movement_value_date", "reference_number_trans_desc", "tx_tags", "envio-gf_worker_hiring_date", "receptor-gf_worker_hiring_date", "envio-nombre_completo", "envio-puesto", "envio-edad", "envio-state_id", "receptor-nombre_completo", "receptor-puesto", "receptor-edad", "receptor-state_id")
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in (*REQUIRED, *OPTIONAL)])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw transfers as text columns, whatever columns the header names."""
    return spark.read.option("header", True).option("multiLine", False).csv(path)


def check_columns(df: DataFrame, needed: tuple[str, ...]) -> None:
    """S3."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def _plain(name: str) -> str:
    return re.sub("[^a-z0-9]", "", unicodedata.normalize("NFKD", name.lower()).encode("ascii", "ignore").decode())


def standardize_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Rename columns to the canonical names in `aliases` (name -> alternatives).

    A name already present wins; else an equal normalised name; else the only column that contains an alternative.
    """
    taken: set[str] = set()
    renames: dict[str, str] = {}
    for name, others in aliases.items():
        if name in df.columns:
            continue
        free = [c for c in df.columns if c not in taken and c not in aliases]
        wanted = [_plain(x) for x in (name, *others)]
        exact = [c for c in free if _plain(c) in wanted]
        part = [c for c in free if any(w in _plain(c) for w in wanted)]
        found = exact[:1] or (part if len(part) == 1 else [])
        if found:
            renames[found[0]] = name
            taken.add(found[0])
    return df.withColumnsRenamed(renames)


def ensure_time(df: DataFrame, out: str = "fecha_hora_ts") -> DataFrame:
    """The time column under its known names; numbers are seconds, or milliseconds if their median is above 1e11."""
    if out in df.columns:
        return df.withColumn(out, text.parse_time(F.col(out)) if dict(df.dtypes)[out] == "string" else F.col(out).cast("timestamp"))
    source = next((c for c in ("fecha_hora", "timestamp", "ts", "fecha", "datetime") if c in df.columns), None)
    if source is None:
        return df.withColumn(out, F.lit(None).cast("timestamp"))
    if isinstance(df.schema[source].dataType, T.NumericType):
        median = df.agg(F.median(source)).first()[0]
        return df.withColumn(out, values.epoch_time(F.col(source), median is not None and median > 1e11))
    return df.withColumn(out, text.parse_time(F.col(source)) if dict(df.dtypes)[source] == "string" else F.col(source).cast("timestamp"))


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def ingest(raw: DataFrame) -> DataFrame:
    """Typed transfers from raw text columns; rows without an amount or a time are dropped, and `rejected` lists them.

    One narrow projection. Times are read by a fixed list of layouts, ISO first.
    """
    check_columns(raw, REQUIRED)
    absent = [c for c in OPTIONAL if c not in raw.columns]
    df = raw.withColumns({c: F.lit(None).cast("string") for c in absent})
    # rows are filtered by their times, which are parsed once
    steps = text.Steps(df)
    time = text.parse_time(F.col("load_date"), steps.keep)
    df = steps.df
    parts = text.parse_description(F.col("transaction_desc"))
    teammates = text.split_list(F.col("companeros_de_equipo"))
    out = df.select(
        *([F.col("tx_id")] if "tx_id" in df.columns else [F.concat_ws("-", F.lit("tx"), F.monotonically_increasing_id()).alias("tx_id")]),
        "user_id",
        quoted("receptor-user_id").alias("receiver_id"),
        time.alias("fecha_hora_ts"),
        values.month_id(time).alias("month_id"),
        values.to_number(F.col("movement_amount")).alias("movement_amount"),
        text.compose_description(parts, F.col("transaction_desc")).alias("descripcion"),
        "transaction_desc",
        *[parts[k].alias(f"tx_{k}") for k in parts],
        values.relation(F.col("user_id"), quoted("receptor-user_id"), [F.col(m) for m in MANAGERS], teammates).alias("relacion"),
        text.blank_to_null(F.col("origin_application_id")).alias("origin_application_id"),
        "reference_number_trans_desc",
        text.parse_time(F.col("movement_value_date")).alias("movement_value_date"),
        time.alias("load_date"),
        *MANAGERS,
        teammates.alias("companeros_de_equipo"),
        "tx_tags",
        values.tenure_years(time, text.parse_time(quoted("envio-gf_worker_hiring_date"))).alias("user_antiguedad_anios"),
        values.tenure_years(time, text.parse_time(quoted("receptor-gf_worker_hiring_date"))).alias("receptor_antiguedad_anios"),
        *[quoted(f"{side}-{a}").alias(f"{to}_{b}") for side, to in (("envio", "user"), ("receptor", "receptor")) for a, b in (("nombre_completo", "nombre"), ("puesto", "puesto"), ("state_id", "estado"))],
        *[values.to_number(quoted(f"{side}-edad")).alias(f"{to}_edad") for side, to in (("envio", "user"), ("receptor", "receptor"))],
    )
    return out.dropna(subset=["movement_amount", "fecha_hora_ts"])


def rejected(raw: DataFrame) -> DataFrame:
    """The raw rows that `ingest` leaves out, with `reason`: which of movement_amount and load_date cannot be read, and how."""
    check_columns(raw, REQUIRED)
    unread = lambda c, value: F.when(value.isNull(), F.concat(F.lit(c), F.when(text.blank_to_null(F.col(c)).isNull(), " is empty").otherwise(" cannot be read")))
    reason = F.concat_ws(", ", unread("movement_amount", values.to_number(F.col("movement_amount"))), unread("load_date", text.parse_time(F.col("load_date"))))
    return raw.withColumn("reason", reason).where("reason <> ''")


def from_dense(f1: DataFrame) -> DataFrame:
    """Typed transfers from the dense fixture, with managers, teammates and tenures by arithmetic on the person number.

    The fixture's ids hold four digits, so from 10,000 persons on two may share one. Managers and teammates are told by number: one that only
    shares the receiver's id is left out.
    """
    sn, rn = F.col("sn"), F.col("rn")
    quarter, above = F.floor(sn / 4).cast("int"), F.floor(sn / 16).cast("int")
    # ids are made once, as columns of a step of their own: whoever reads one more than once does not make it again
    pid = lambda n: F.concat(F.lit("P"), F.lpad(n.cast("string"), 4, "0"))
    others = {"_q": quarter, "_a": above, **{f"_m{i}": quarter * 4 + i for i in range(4)}}
    f1 = f1.withColumns({**others, **{f"{k}_id": pid(n) for k, n in others.items()}})
    told = lambda k: F.when((F.col(k) == rn) | (F.col(f"{k}_id") != F.col("receiver_id")), F.col(f"{k}_id"))
    f1 = f1.withColumns({**{f"_mate{i}": F.when(F.col(f"_m{i}_id") != F.col("user_id"), told(f"_m{i}")) for i in range(4)}, "_boss": F.when(sn > 0, told("_q")), "_chief": F.when(sn >= 4, told("_a"))})
    mates = F.array(*[F.col(f"_mate{i}") for i in range(4)])
    # ids hold no comma; lambdas over arrays are not compiled
    named = F.concat_ws(",", mates)
    teammates = F.when(named == "", F.array().cast("array<string>")).otherwise(F.split(named, ","))
    hired = lambda n: F.date_add(F.lit("1990-01-01").cast("date"), (n * 977 % 4300).cast("int")).cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    managers = [F.col("_boss"), F.col("_chief")]
    return f1.select(
        F.concat_ws("-", "leg", "order_key", "part_key", "supp_key", "line_number").alias("tx_id"),
        "user_id",
        "receiver_id",
        ts.alias("fecha_hora_ts"),
        values.month_id(ts).alias("month_id"),
        "movement_amount",
        text.blank_to_null(F.col("descripcion")).alias("descripcion"),
        values.relation(F.col("user_id"), F.col("receiver_id"), managers, mates).alias("relacion"),
        "origin_application_id",
        F.col("reference_text").alias("reference_number_trans_desc"),
        F.col("value_ts").cast("timestamp").alias("movement_value_date"),
        ts.alias("load_date"),
        managers[0].alias("manager_1_user_id"),
        managers[1].alias("manager_2_user_id"),
        F.lit(None).cast("string").alias("manager_3_user_id"),
        F.lit(None).cast("string").alias("manager_4_user_id"),
        teammates.alias("companeros_de_equipo"),
        values.tenure_years(ts, hired(sn)).alias("user_antiguedad_anios"),
        values.tenure_years(ts, hired(rn)).alias("receptor_antiguedad_anios"),
    )
