"""The whole plan from transfers to scored transfers, kept once per session and input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.checkpoints import cut
from tallyscope.operators import graph, groups, intervals, lexicon, scoring
from tallyscope.params import DEFAULTS, Params
from tallyscope.sources import fixtures, transfers


#: The JVM compiles no method of more bytes of code: what Spark generates for a wide projection as one method would be interpreted for ever.
JIT_LIMIT = "8000"


def compiled(spark: SparkSession) -> None:
    """Tells Spark to cut a stage's generated code where it would be too large a method to be compiled, unless the user has set how large it may be."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == "65535":
        spark.conf.set(name, JIT_LIMIT)


#: Tells the rows of one run apart, as ids may repeat.
ROW = "_row"
#: A number of a transfer's pair and month, by which wide rows are dealt.
DEAL = "_deal"


def add_signals(tx: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """All signals but bursts, the network and the texts. tx: with ROW.

    What windows and joins within pairs find is a table of the marked rows and one of the pairs' months, found over narrow rows. The wide rows
    cross the network once, by pair and month, and meet both where they then lie.
    """
    keys = [*groups.PAIR, "month_id"]
    deal = F.xxhash64(*keys)
    name = "_name"
    named = tx.withColumn(name, F.struct(deal.alias(DEAL), ROW))
    marks = [groups.pair_marks(named, name, p), groups.quid_boosts(groups.quid_columns(named), name, p), intervals.back_and_forth(named, name, p)]
    flags = ("sig_freq", "sig_smurf", "sig_yoyo")
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marks).select(f"{name}.*", *flags, "_boost", "_back")
    months = groups.month_marks(tx, p).withColumn(DEAL, deal)
    # marks and months lie beside their transfers as rows of their own, and are told to these: one exchange serves both, where joins by other keys need one each
    dealt = tx.withColumns({DEAL: deal, "_own": F.lit(True)}).unionByName(found, allowMissingColumns=True).unionByName(months, allowMissingColumns=True).repartition(DEAL)
    of_row, of_month = Window.partitionBy(DEAL, ROW), Window.partitionBy(DEAL, *keys)
    told = [c for c in months.columns if c.startswith(("feat_", "sig_"))]
    met = dealt.withColumns({c: F.max(c).over(of_row) for c in (*flags, "_boost", "_back")}).withColumns({c: F.max(c).over(of_month) for c in (*told, "_days")}).where("_own")
    # days count for pairs and months of nobody, too; a change needs both persons and a month
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    recurrent = F.coalesce(F.expr("(shiftright(_days, dayofmonth(fecha_hora_ts)) & 1) = 1"), F.lit(False))
    plain = {**{c: F.when(known, F.col(c)) for c in told}, **{c: F.coalesce(c, F.lit(False)) for c in flags}, "sig_recurrent": recurrent, "_boost": F.coalesce("_boost", F.lit(0.0))}
    given, tx = tx, met.withColumns(plain).drop(DEAL, "_own", "_days")
    tx = groups.reference_reuse(groups.amount_flags(groups.sender_baseline(tx, given), p), p, given)
    return intervals.repay_ratio(groups.quid_score(groups.quid_columns(tx), p), p)


def write_scored(tx: DataFrame, p: Params = DEFAULTS, lex: DataFrame | None = None) -> DataFrame:
    """Signals but bursts, network, texts and score of every transfer, written once. What its readers can compute where they read it is added by `scored_columns`."""
    compiled(tx.sparkSession)
    lex = lexicon.lexicon_table(tx.sparkSession) if lex is None else lex
    given = cut(groups.text_flags(tx).withColumn(ROW, F.monotonically_increasing_id()), "ingested", "zstd")
    tx = lexicon.tag_transfers(graph.network_flags(add_signals(given, p), of=given), lex, of=given)
    return cut(scoring.risk_score(tx, p).drop(ROW), "scored", "zstd")


def scored_columns(written: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Tier and explanation: projections, with a row per month, that only their readers compute."""
    return scoring.explain(scoring.add_tiers(written, cut(scoring.monthly_calibration(written), "calibration")), p)


def score_transfers(tx: DataFrame, p: Params = DEFAULTS, lex: DataFrame | None = None) -> DataFrame:
    """Signals, network, texts, score, tier, rank and explanation of every transfer. Signals and scores are written once; reports fan out from it."""
    return groups.bursts(scoring.add_ranks(scored_columns(write_scored(tx, p, lex), p)), p)


_kept: dict[tuple[str, str], DataFrame] = {}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored transfers of the dense fixture, without ranks and bursts, which few read; computed once per application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        _kept[key] = scored_columns(write_scored(ingested(spark, sf_dir)))
    return _kept[key]


def scored_with_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored transfers with the figures of their bin where that is an event (null elsewhere), and whether it is."""
    tx = scored(spark, sf_dir)
    out = groups.burst_keys(tx).join(groups.burst_events(tx), ["rafaga_canal_id", "rafaga_canal_hora_bin_inicio"], "left")
    # without a time there is no bin
    return out.withColumn("rafaga_canal_flag_evento", F.when(F.col("fecha_hora_ts").isNotNull(), F.coalesce("rafaga_canal_flag_evento", F.lit(False))))


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled(spark)
    return transfers.from_dense(fixtures.dense_transfers(spark, sf_dir))
