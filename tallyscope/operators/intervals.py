"""Interval joins over transfers (J4, J5) and the nearest-holiday join.

A hot pair would meet itself quadratically in a plain range join. Back-and-forth transfers are an equi-join on pair, time bucket and
amount bucket; what came back of a loan is the difference of two running totals, so no rows are paired for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions import text, values
from tallyscope.params import DEFAULTS, Params

HOUR = 3_600_000_000


def yoyo(tx: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Transfers, and whether there is one the other way soon after or before."""
    return tx.join(back_and_forth(tx, "tx_id", p), "tx_id", "left").withColumn("sig_yoyo", F.coalesce("sig_yoyo", F.lit(False)))


def back_and_forth(tx: DataFrame, row: str, p: Params = DEFAULTS) -> DataFrame:
    """(row, sig_yoyo), named by a column that tells rows apart, of transfers with one the other way within yoyo_hours whose amount differs by at most yoyo_tolerance of the larger. Self-transfers never match.

    Buckets of time and of the amount's logarithm are four times as wide as the interval, so a row looks into two of each at most. Only
    amounts above 0 can be near another, but for 0 and 0, which have a bucket of their own.
    """
    wide = p.yoyo_hours * HOUR
    a, b = F.col("user_id"), F.col("receiver_id")
    rows = tx.select(F.col(row).alias("tx_id"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), (a < b).alias("up"), F.unix_micros("fecha_hora_ts").alias("us"), F.col("movement_amount").alias("x")).where("lo <> hi")
    bucket = lambda by: F.floor((F.col("us") + by) / (4 * wide))
    # a hair wider than the tolerance, as logarithms are rounded
    reach = -math.log1p(-p.yoyo_tolerance) * (1 + 1e-6) + 1e-12
    size = lambda by: F.when(F.col("x") > 0, F.floor((F.ln("x") + by) / (4 * reach))).when(F.col("x") == 0, F.lit(-(1 << 62)))
    looks = lambda f, r: F.array_distinct(F.array(f(-r), f(r)))
    ups = rows.where("up").select("lo", "hi", F.col("tx_id").alias("i"), F.col("us").alias("u"), F.col("x").alias("xi"), F.explode(looks(bucket, wide)).alias("bucket"), looks(size, reach).alias("sizes"))
    ups = ups.withColumn("size", F.explode("sizes")).drop("sizes").withColumn("cell", F.xxhash64("bucket", "size")).where("size is not null").drop("bucket", "size")
    downs = rows.where("not up").select("lo", "hi", F.col("tx_id").alias("j"), F.col("us").alias("v"), F.col("x").alias("xj"), F.xxhash64(bucket(0), size(0)).alias("cell")).where(size(0).isNotNull())
    near = (F.abs(F.col("u") - F.col("v")) <= wide) & (F.abs(F.col("xi") - F.col("xj")) <= F.greatest("xi", "xj") * p.yoyo_tolerance)
    # both buckets cross the network as one number: rows that only share it are not near
    met = ups.join(downs, ["lo", "hi", "cell"]).where(near)
    return met.select(F.explode(F.array("i", "j")).alias(row)).distinct().withColumn("sig_yoyo", F.lit(True))


def loan_repay(tx: DataFrame, p: Params = DEFAULTS, stems: bool = False) -> DataFrame:
    """Loan-like transfers, what came back within loan_days over the loan, and whether that is under loan_min_ratio.

    A self-transfer repays itself (Q-6). stems=True also takes 'prestamo', 'adelanto' (Q-5).
    """
    return repay_ratio(tx.join(paid_back(tx, "tx_id", p, stems), "tx_id", "left"), p, stems)


def loan_like(stems: bool) -> Column:
    return text.normalize(F.col("descripcion")).rlike(text.LOAN_STEMS if stems else text.LOAN)


def repay_ratio(out: DataFrame, p: Params = DEFAULTS, stems: bool = False) -> DataFrame:
    """The columns of J5 for transfers with `_back`, what came back."""
    out = out if "sig_loan_like" in out.columns else out.withColumn("sig_loan_like", loan_like(stems))
    ratio = F.when(F.col("sig_loan_like") & (F.col("movement_amount") > 0), F.coalesce("_back", F.lit(0.0)) / F.col("movement_amount")).otherwise(1.0)
    return out.withColumn("feat_repay_ratio", ratio).withColumn("sig_loan_bad_repay", F.col("sig_loan_like") & (F.col("feat_repay_ratio") < p.loan_min_ratio)).drop("_back")


def paid_back(tx: DataFrame, row: str, p: Params = DEFAULTS, stems: bool = False) -> DataFrame:
    """(row, _back), named by a column that tells rows apart: what came back of each loan to which anything did. Only pairs with loans one way and payments the other are read on.

    A loan asks for the total paid back before it and up to its end: two probes among the payments the other way, ordered in time, with totals of
    earlier slices of time carried in, in decimals (of ten digits). So a pair's rows are read once each, in as many tasks as it has slices.
    """
    wide = p.loan_days * values.MICROS_DAY
    us = F.unix_micros("fecha_hora_ts")
    none = F.lit(0).cast("decimal(38,10)")
    pair = ["lender", "debtor"]
    # payments cross the network without their names, in the type that they come in; loans become two probes only afterwards
    loans = tx.where(loan_like(stems)).select(F.col(row).alias("tx_id"), F.col("user_id").alias("lender"), F.col("receiver_id").alias("debtor"), us.alias("us"), F.lit(None).alias("x"), F.lit(True).alias("loan"))
    back = tx.select(F.lit(None).alias("tx_id"), F.col("receiver_id").alias("lender"), F.col("user_id").alias("debtor"), us.alias("us"), F.col("movement_amount").alias("x"), F.lit(False).alias("loan"))
    ways = loans.select(pair).distinct().join(back.select(pair), pair, "left_semi")
    rows = loans.unionByName(back).where("us is not null").join(ways, pair, "left_semi")
    # at one time: probes of what came before, then payments, then probes of what came up to it
    probe = lambda at, kind: F.struct((F.col("us") + at).alias("t"), F.lit(kind).alias("kind"))
    events = F.explode(F.when(F.col("loan"), F.array(probe(0, 0), probe(wide, 2))).otherwise(F.array(probe(0, 1))))
    paid = F.coalesce(F.col("x").try_cast("decimal(38,10)"), none)
    line = rows.select("tx_id", *pair, paid.alias("back"), events.alias("e")).select("tx_id", *pair, "back", "e.*").withColumn("slice", F.floor(F.col("t") / (4 * wide)))
    slices = line.groupBy("lender", "debtor", "slice").agg(F.sum("back").alias("s"))
    earlier = Window.partitionBy("lender", "debtor").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("carried", F.coalesce(F.sum("s").over(earlier), none)).drop("s")
    here = Window.partitionBy("lender", "debtor", "slice").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    asked = line.withColumn("upto", F.sum("back").over(here)).where("kind <> 1").join(carried, ["lender", "debtor", "slice"])
    total = F.col("carried") + F.col("upto")
    return asked.groupBy(F.col("tx_id").alias(row)).agg(F.sum(F.when(F.col("kind") == 2, total).otherwise(-total)).cast("double").alias("_back"))


def holiday_table(years: DataFrame, cultural: bool = True) -> DataFrame:
    """(hol_date, hol_name) of each year in a one-column table of years."""
    y = F.col("year").cast("int")
    day = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    named = [
        (day(1, 1), "Año Nuevo"), (values.nth_monday(y, 2, 1), "Constitución (1er lunes feb)"), (values.nth_monday(y, 3, 3), "Natalicio Benito Juárez (3er lunes mar)"), (day(5, 1), "Día de Trabajo"),
        (day(9, 16), "Independencia"), (values.nth_monday(y, 11, 3), "Revolución Mexicana (3er lunes nov)"), (day(12, 25), "Navidad"), (F.date_sub(values.easter(y), 2), "Viernes Santo"),
    ]
    if cultural:
        named.append((day(11, 2), "Día de Muertos (cultural)"))
    return years.select(F.explode(F.array(*[F.struct(d.alias("hol_date"), F.lit(n).alias("hol_name")) for d, n in named])).alias("h")).select("h.*")


def holiday_proximity(tx: DataFrame, window_days: int = 3, attenuation: float = 0.5, cultural: bool = True) -> DataFrame:
    """Nearest holiday of the years in the data; a tie goes to the later one.

    Distances are found once per distinct date (a few thousand) and joined back by date.
    """
    dates = tx.select(F.to_date("fecha_hora_ts").alias("_date")).distinct()
    years = dates.select(F.year("_date").alias("year")).distinct()
    gap = F.datediff("hol_date", "_date")
    # a date meets the holidays of its own and the neighbouring years, as far as the data has those years
    held = holiday_table(years, cultural).withColumn("_year", F.year("hol_date"))
    near = dates.withColumn("_year", F.explode(F.array(*[F.year("_date") + k for k in (-1, 0, 1)])))
    nearest = near.join(held, "_year").groupBy("_date").agg(F.min_by(F.struct("hol_name", F.abs(gap).alias("days")), F.struct(F.abs(gap), -gap)).alias("h"))
    nearest = nearest.select("_date", F.col("h.hol_name").alias("hol_name"), F.col("h.days").alias("hol_days"))
    out = tx.withColumn("_date", F.to_date("fecha_hora_ts")).join(nearest, "_date", "left").drop("_date")
    return out.withColumn("hol_within", F.col("hol_days") <= window_days).withColumn("hol_attenuation", F.when(F.col("hol_within"), attenuation).otherwise(1.0))
