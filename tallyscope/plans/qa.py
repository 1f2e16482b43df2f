"""Short questions over sliced scored transfers (A-qa1 to A-qa9). One row set per time frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.plans import reports
from tallyscope.plans.reports import AMOUNT, TF, mean, pair, total


def flag_months(s: DataFrame, hit) -> DataFrame:
    """timeframe, pair, month_id, hit: whether a directed pair's month has a transfer that hits."""
    return s.groupBy(TF, pair().alias("pair"), "month_id").agg(F.max(F.coalesce(hit, F.lit(False))).alias("hit"))


def months_with(s: DataFrame, hit, name: str, least: int) -> DataFrame:
    return flag_months(s, hit).groupBy(TF, "pair").agg(F.count_if("hit").alias(name)).where(F.col(name) >= least)


def constant_reception(s: DataFrame, min_months: int = 3) -> DataFrame:
    """A-qa1."""
    m = s.groupBy(TF, pair().alias("pair"), "month_id").agg(F.max("sig_recurrent").alias("rec"))
    return m.groupBy(TF, "pair").agg(F.count(F.lit(1)).alias("meses_con_tx"), F.count_if("rec").alias("meses_recurrente")).where(F.col("meses_con_tx") >= min_months)


def person_balance(s: DataFrame) -> DataFrame:
    """A-qa2."""
    return reports.persons(s).select(TF, "persona", "sum_emit", "sum_recv", "net", F.round(F.col("sum_emit") / (F.col("sum_recv") + 1e-9), 6).alias("ratio"))


def manager_concepts(s: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """A-qa3, A-qa7: concepts of transfers to managers by month, with the 95th percentile of their risk; optionally only texts that hold a keyword."""
    m = s.where(F.lower("relacion").contains("manager"))
    if keywords:
        m = m.where(F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.lower(F.coalesce("descripcion", F.lit(""))).contains(k)))
    return m.groupBy(TF, "month_id", "nlp_concepto_sospechoso").agg(F.count("risk_score").alias("tx_count"), F.round(F.percentile("risk_score", F.lit(0.95)), 6).alias("risk_p95"))


def centralizers(s: DataFrame) -> DataFrame:
    """A-qa4."""
    g = s.groupBy(TF, "month_id", "receiver_id").agg(total().alias("inflow"), F.count_distinct("user_id").alias("emisores_unicos"), F.count(AMOUNT).alias("n_tx"), mean("risk_score").alias("risk_avg"))
    return g.withColumn("centralidad", F.round(F.col("inflow") * F.col("emisores_unicos"), 3))


def consecutive_yoyo(s: DataFrame) -> DataFrame:
    """A-qa5, W9: pairs with two active months in a row that have back-and-forth transfers."""
    m = flag_months(s, F.col("sig_yoyo")).withColumn("prev", F.lag("hit").over(Window.partitionBy(TF, "pair").orderBy("month_id")))
    return m.groupBy(TF, "pair").agg(F.max(F.coalesce(F.col("hit") & F.col("prev"), F.lit(False))).alias("tiene_racha_yo_yo")).where("tiene_racha_yo_yo")


def repeated_near(s: DataFrame, min_months: int = 2) -> DataFrame:
    """A-qa6."""
    return months_with(s, F.col("sig_near_thr"), "meses_con_near", min_months)


def loans_and_frequency(s: DataFrame, min_months: int = 2) -> DataFrame:
    """A-qa8."""
    m = s.groupBy(TF, pair().alias("pair"), "month_id").agg(F.max("sig_loan_bad_repay").alias("l"), F.max("sig_freq").alias("f"))
    return m.groupBy(TF, "pair").agg(F.count_if(F.col("l") & F.col("f")).alias("meses_condicion")).where(F.col("meses_condicion") >= min_months)


def chronic_smurfing(s: DataFrame) -> DataFrame:
    """A-qa9."""
    return months_with(s, F.col("sig_smurf"), "meses_smurf", 0)
