"""Signals from groups and windows over transfers.

Every function adds columns to a transfer table. Ties in time are ordered by tx_id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.checkpoints import cut
from tallyscope.functions import text, values
from tallyscope.operators import intervals
from tallyscope.params import DEFAULTS, Params

AMOUNT = "movement_amount"
PAIR = ("user_id", "receiver_id")
DAY = values.MICROS_DAY


def micros() -> Column:
    return F.unix_micros("fecha_hora_ts")


def sender_baseline(tx: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """A1, A2: mean, sample deviation and z of a sender's amounts. Deviation 0 or unknown gives z 0 (Q-4: the reference gives NaN). of: the same transfers with fewer columns."""
    # written, so that Spark knows its size when it plans the join
    stats = cut((tx if of is None else of).groupBy(F.col("user_id").alias("_u")).agg(F.avg(AMOUNT).alias("feat_monto_mean"), F.stddev_samp(AMOUNT).alias("feat_monto_std")), "senders")
    known = F.coalesce(F.nullif(F.col("feat_monto_std"), F.lit(0.0)), F.lit(1.0))
    z = F.when(F.coalesce(F.col("feat_monto_std"), F.lit(0.0)) == 0, 0.0).otherwise((F.col(AMOUNT) - F.col("feat_monto_mean")) / known)
    return tx.join(stats, tx["user_id"].eqNullSafe(F.col("_u")), "left").drop("_u").withColumn("feat_zscore_monto", z)


def amount_flags(tx: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Round sums, and distance to the nearest reporting threshold."""
    near = values.nearest_threshold(F.col(AMOUNT), p.near_thresholds)
    return tx.withColumns({
        "sig_roundsum": values.is_round(F.col(AMOUNT), p.round_bases),
        "feat_delta_near_thr": near["distance"],
        "feat_near_thr_value": near["threshold"],
        "sig_near_thr": near["distance"] <= p.near_delta,
    })


#: A slice of time is this many windows long, so at most half of the rows are read again as halo.
SLICE_WINDOWS = 4


def in_slices(rows: DataFrame, time: Column, reach: int, compute: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """compute(rows, keys) slice by slice of time: a row also visits the slices that begin or end within `reach` of it, and only its own slice's result is kept.

    compute adds columns by windows over the given keys, and may look no further than `reach` back or ahead; so the result is that of
    windows over all time, and a key with a third of all rows is as many tasks as its history has slices. time: whole numbers; rows without one are a slice.
    """
    width = F.lit(SLICE_WINDOWS * reach)
    slice_of = lambda t: F.floor(t / width)
    visits = F.when(time.isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(slice_of(time - reach), slice_of(time + reach)))
    dealt = rows.withColumn("_own", slice_of(time)).withColumn("_slice", F.explode(visits))
    return compute(dealt, ["_slice"]).where(F.col("_own").eqNullSafe(F.col("_slice"))).drop("_own", "_slice")


def pair_windows(tx: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """W4 and W5 over the same slices, so that both need one exchange and one order."""
    return in_slices(timed(tx), F.col("_us"), max(p.freq_days, p.smurf_days) * DAY, lambda rows, keys: _smurfing(_frequency(rows, p, keys), p, keys)).drop("_us")


def timed(tx: DataFrame) -> DataFrame:
    """tx with _us, its time in microseconds, which orders a pair's windows: one sort serves all that share it."""
    return tx.withColumn("_us", micros())


def _same(a: list[str], b: list[str]) -> Column:
    """Equal columns, nulls included."""
    return reduce(lambda x, y: x & y, [F.col(i).eqNullSafe(F.col(j)) for i, j in zip(a, b)])


def of_groups(rows: DataFrame, keys: list[str], kept: Column) -> DataFrame:
    """The rows of the groups (nulls are a group) that satisfy `kept`, an aggregate."""
    names = [f"_g{i}" for i in range(len(keys))]
    groups = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(kept.alias("_kept")).where("_kept").drop("_kept")
    return rows.join(groups, _same(keys, names), "left_semi")


def pair_number() -> Column:
    """A number that the transfers between two people share, whichever way they go; others may share it, too."""
    return F.xxhash64(values.undirected_pair(F.col("user_id"), F.col("receiver_id")))


def pair_marks(tx: DataFrame, row: str, p: Params = DEFAULTS) -> DataFrame:
    """(row, sig_freq, sig_smurf, _back) of the rows that W4 or W5 mark, or of loans of which something came back (J5), named by a column that tells
    rows apart.

    All three read what lies near in time in the pair, so narrow rows cross the network once, by pair and slice of time, for them together.
    """
    narrow = timed(tx.select(row, *PAIR, "fecha_hora_ts", "tx_id", AMOUNT, (F.col("sig_loan_like") if "sig_loan_like" in tx.columns else intervals.loan_like(False)).alias("_loan"), pair_number().alias("_pair"))).drop("fecha_hora_ts")

    def marks(rows: DataFrame, keys: list[str]) -> DataFrame:
        keys = ["_pair", *keys]
        return _paid_back(_smurfing(_frequency(rows.repartition(*keys), p, keys), p, keys), p, keys)

    found = in_slices(narrow, F.col("_us"), max(p.freq_days, p.smurf_days, p.loan_days) * DAY, marks)
    return found.where("sig_freq or sig_smurf or _back <> 0").select(row, "sig_freq", "sig_smurf", "_back")


def _paid_back(tx: DataFrame, p: Params, keys: list[str]) -> DataFrame:
    """With _back, what came back of each loan (_loan) within loan_days: the other way's running total at the end less that before the loan.

    A self-transfer repays itself (Q-6).
    """
    here, there = F.col("user_id"), F.col("receiver_id")
    amount = F.coalesce(F.col(AMOUNT).try_cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)"))
    by = Window.partitionBy("_lo", "_hi", *keys).orderBy("_us")
    upto, before = by.rangeBetween(Window.unboundedPreceding, p.loan_days * DAY), by.rangeBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("decimal(38,10)")
    ways = {"_up": here <= there, "_down": here > there}
    totals = {f"{k}{end}": F.coalesce(F.sum(F.when(way, amount)).over(w), none) for k, way in ways.items() for end, w in (("1", upto), ("0", before))}
    out = tx.withColumns({"_lo": F.least(here, there), "_hi": F.greatest(here, there)}).withColumns(totals)
    back = F.when(here < there, F.col("_down1") - F.col("_down0")).when(here >= there, F.col("_up1") - F.col("_up0"))
    return out.withColumn("_back", F.when(F.col("_loan") & F.col("_us").isNotNull(), back.cast("double"))).drop("_lo", "_hi", *totals)


def frequency(tx: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Rows of a directed pair in any window of freq_days with at least freq_count transfers; all rows of the window are marked.

    Row numbers turn the window into an interval [start, here]; starts never go back, so a row is
    marked when the least start of the hits at or after it is not beyond it.
    """
    return in_slices(timed(tx), F.col("_us"), p.freq_days * DAY, lambda rows, keys: _frequency(rows, p, keys)).drop("_us")


def _frequency(tx: DataFrame, p: Params, keys: list[str]) -> DataFrame:
    by = Window.partitionBy(*PAIR, *keys)
    place = by.orderBy("_us", "tx_id")
    out = (tx if "_us" in tx.columns else timed(tx)).withColumn("_rn", F.row_number().over(place))
    out = out.withColumn("_start", F.min("_rn").over(by.orderBy("_us").rangeBetween(-p.freq_days * DAY, 0)))
    hit = F.when(F.col("_rn") - F.col("_start") + 1 >= p.freq_count, F.col("_start"))
    first = F.min(hit).over(place.rowsBetween(0, Window.unboundedFollowing))
    return out.withColumn("sig_freq", F.coalesce(first <= F.col("_rn"), F.lit(False))).drop("_rn", "_start")


def smurfing(tx: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Rows of a directed pair in a window of smurf_days whose sum reaches a threshold while every amount is below it.

    A window runs from the first row of the last smurf_days to the row itself, ties by tx_id. Its sum, and its number of amounts
    that are not below a threshold, are running totals at the row less those before the start, in decimals: exact for any number of ties.
    """
    return in_slices(timed(tx), F.col("_us"), p.smurf_days * DAY, lambda rows, keys: _smurfing(rows, p, keys)).drop("_us")


def _smurfing(tx: DataFrame, p: Params, keys: list[str]) -> DataFrame:
    by = Window.partitionBy(*PAIR, *keys)
    place = by.orderBy("_us", "tx_id")
    upto = place.rowsBetween(Window.unboundedPreceding, 0)
    amount = F.coalesce(F.col(AMOUNT).try_cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)"))
    tops = {f"n{i}": (F.col(AMOUNT) >= t).cast("long") for i, t in enumerate(p.smurf_thresholds)}
    totals = {"_s": F.sum(amount).over(upto), **{f"_{k}": F.sum(c).over(upto) for k, c in tops.items()}}
    out = (tx if "_us" in tx.columns else timed(tx)).withColumn("_rn", F.row_number().over(place)).withColumns(totals)
    before = F.struct("_rn", (F.col("_s") - amount).alias("s"), *[(F.col(f"_{k}") - c).alias(k) for k, c in tops.items()])
    out = out.withColumn("_from", F.min(before).over(by.orderBy("_us").rangeBetween(-p.smurf_days * DAY, 0)))
    met = text.any_of([(F.col("_s") - F.col("_from.s") >= F.lit(t)) & (F.col(f"_n{i}") == F.col(f"_from.n{i}")) for i, t in enumerate(p.smurf_thresholds)])
    first = F.min(F.when(met, F.col("_from._rn"))).over(place.rowsBetween(0, Window.unboundedFollowing))
    return out.withColumn("sig_smurf", F.coalesce(first <= F.col("_rn"), F.lit(False))).drop("_rn", "_from", *totals)


def recurrent_day(tx: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The same day of the month in at least recurrent_months months of a directed pair."""
    by = Window.partitionBy(*PAIR, "_dom")
    return tx.withColumn("_dom", F.dayofmonth("fecha_hora_ts")).withColumn("sig_recurrent", F.size(F.collect_set("month_id").over(by)) >= p.recurrent_months).drop("_dom")


def channel(c: Column) -> Column:
    return F.coalesce(text.blank_to_null(c), F.lit("sin_canal"))


def burst_bins(tx: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """A4: per channel and bin of burst_hours: transfers, those off hours, people and money; an event if many and mostly off hours."""
    hour = F.hour("fecha_hora_ts")
    off = ((hour < p.work_start) | (hour >= p.work_end)).cast("long")
    bins = tx.groupBy(channel(F.col("origin_application_id")).alias("rafaga_canal_id"), F.window("fecha_hora_ts", f"{p.burst_hours} hours").alias("w")).agg(
        F.count(AMOUNT).alias("rafaga_canal_tx_en_bin"),
        F.sum(off).alias("rafaga_canal_tx_fuera_horario"),
        F.count_distinct("user_id").alias("rafaga_canal_personas_emisoras"),
        F.count_distinct("receiver_id").alias("rafaga_canal_personas_receptoras"),
        F.sum(AMOUNT).alias("rafaga_canal_monto_total"),
    )
    ratio = F.col("rafaga_canal_tx_fuera_horario") / F.col("rafaga_canal_tx_en_bin")
    label = F.concat(F.date_format("w.start", "yyyy-MM-dd HH:mm"), F.lit(" - "), F.date_format("w.end", "HH:mm"))
    return bins.select(
        "rafaga_canal_id",
        F.col("w.start").alias("rafaga_canal_hora_bin_inicio"),
        F.col("w.end").alias("rafaga_canal_hora_bin_fin"),
        label.alias("rafaga_canal_hora_label"),
        *[c for c in bins.columns if c not in ("rafaga_canal_id", "w")],
        F.coalesce(ratio, F.lit(0.0)).alias("rafaga_canal_ratio_fuera_horario"),
        ((F.col("rafaga_canal_tx_en_bin") >= p.burst_min_tx) & (ratio >= p.burst_off_ratio)).alias("rafaga_canal_flag_evento"),
    )


def bursts(tx: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Transfers with the figures of their bin (Q-7: bin end and label keep their values)."""
    return burst_keys(tx, p).join(cut(burst_bins(tx, p), "bins"), ["rafaga_canal_id", "rafaga_canal_hora_bin_inicio"], "left")


def burst_events(tx: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """A4: the bins that are events, written: few, so that transfers meet them without a shuffle."""
    events = burst_bins(tx, p).where("rafaga_canal_flag_evento").drop("rafaga_canal_personas_emisoras", "rafaga_canal_personas_receptoras", "rafaga_canal_monto_total")
    return cut(events, "events")


def burst_keys(tx: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Transfers with the channel and start of their bin."""
    start = F.window("fecha_hora_ts", f"{p.burst_hours} hours")["start"]
    return tx.withColumn("rafaga_canal_id", channel(F.col("origin_application_id"))).withColumn("rafaga_canal_hora_bin_inicio", start)


def reference_summary(tx: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Per usable reference its transfers, undirected pairs, first and last time, and whether it is reused."""
    ref = text.normalize_reference(F.col("reference_number_trans_desc"), p.reference_min_len)
    used = tx.withColumn("reference_norm", ref).where("reference_norm <> ''")
    pair = values.undirected_pair(F.col("user_id"), F.col("receiver_id"))
    sums = used.groupBy("reference_norm").agg(
        F.count(F.lit(1)).alias("tx_count"),
        F.count_distinct(pair).alias("pairs_count"),
        F.min("fecha_hora_ts").alias("first_ts"),
        F.max("fecha_hora_ts").alias("last_ts"),
        F.array_sort(F.collect_set(pair)).alias("pairs"),
        F.sum(AMOUNT).alias("monto_total"),
        F.max(F.length("reference_norm")).alias("reference_len"),
    )
    span = F.unix_micros("last_ts") - F.unix_micros("first_ts")
    return sums.withColumn("span_days", span / DAY).withColumn("sig_reference_reuse", (F.col("pairs_count") >= 2) & (span <= p.reference_days * DAY))


def reference_reuse(tx: DataFrame, p: Params = DEFAULTS, of: DataFrame | None = None) -> DataFrame:
    """Transfers whose reference was used by two or more pairs within reference_days. of: the same transfers with fewer columns."""
    reused = cut(reference_summary(tx if of is None else of, p).where("sig_reference_reuse").select(F.col("reference_norm").alias("feat_reference_norm"), F.lit(True).alias("_reused")), "reused")
    keyed = tx.withColumn("feat_reference_norm", text.normalize_reference(F.col("reference_number_trans_desc"), p.reference_min_len)).withColumn("feat_reference_len", F.length(text.normalize(F.col("reference_number_trans_desc"))))
    return keyed.join(reused, "feat_reference_norm", "left").withColumn("sig_reference_reuse", F.coalesce("_reused", F.lit(False))).drop("_reused")


def pair_months(tx: DataFrame, p: Params = DEFAULTS, dealt: DataFrame | None = None, **more: Column) -> DataFrame:
    """Monthly totals of each directed pair against its previous active month. dealt: the same transfers, dealt by pair; more: other aggregates of them."""
    rows = tx if dealt is None else dealt
    monthly = rows.groupBy(*PAIR, "month_id").agg(F.sum(AMOUNT).alias("month_amount"), F.count(AMOUNT).alias("month_count"), *[c.alias(k) for k, c in more.items()]).withColumn("_m", values.month_number(F.col("month_id")))
    start = tx.agg(values.month_number(F.min("month_id")).alias("_m0"))  # one row
    by = Window.partitionBy(*PAIR).orderBy("_m")
    out = monthly.join(F.broadcast(start)).withColumns({"_pa": F.lag("month_amount").over(by), "_pc": F.lag("month_count").over(by), "_pm": F.lag("_m").over(by)})
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    first, age = F.col("_pa").isNull(), F.col("_m") - F.col("_m0")
    out = out.withColumns({
        "feat_pair_month_amount_ratio": ratio("month_amount", "_pa"),
        "feat_pair_month_count_ratio": ratio("month_count", "_pc"),
        "feat_pair_months_since_prev": F.when(first, age).otherwise(F.col("_m") - F.col("_pm")),
    })
    jump = ((F.col("_pa") > 0) & (F.col("feat_pair_month_amount_ratio") >= p.change_amount_ratio)) | ((F.col("_pc") > 0) & (F.col("feat_pair_month_count_ratio") >= p.change_count_ratio))
    new = first & (F.col("month_amount") > 0) & (F.col("feat_pair_months_since_prev") >= p.change_gap_months) & (age >= p.change_history_months)
    return out.withColumn("sig_pair_change_point", F.coalesce(jump, F.lit(False))).withColumn("sig_pair_new_edge", new).drop("_m", "_m0", "_pa", "_pc", "_pm")


def change_points(tx: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Transfers with the change signals of their pair and month."""
    return tx.join(pair_months(tx, p).drop("month_amount", "month_count"), [*PAIR, "month_id"], "left")


def month_marks(tx: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """pair_months with _days: the days of the month, as bits, on which the pair has transfers in at least recurrent_months months.

    Narrow rows are dealt by pair once; what they are dealt for needs no other exchange.
    """
    narrow = tx.select(*PAIR, "month_id", AMOUNT, F.dayofmonth("fecha_hora_ts").alias("_dom"))
    months = pair_months(narrow, p, narrow.repartition(*PAIR), _on=F.expr("bit_or(shiftleft(1L, _dom))")).drop("month_amount", "month_count")
    # a row per month: bits seen once, twice and so on
    often = [f"c{i}" for i in range(p.recurrent_months)]
    seen = lambda x, m: F.struct(*[x[c].bitwiseOR(m if i == 0 else x[often[i - 1]].bitwiseAND(m)).alias(c) for i, c in enumerate(often)])
    lists = months.withColumn("_each", F.collect_list(F.when(F.col("month_id").isNotNull(), F.col("_on"))).over(Window.partitionBy(*PAIR)))
    days = F.aggregate("_each", F.struct(*[F.lit(0).cast("long").alias(c) for c in often]), seen, lambda x: x[often[-1]])
    return lists.withColumn("_days", F.when(F.size("_each") >= p.recurrent_months, days).otherwise(F.lit(0).cast("long"))).drop("_on", "_each")


QUID_TEXTS = ("transaction_desc", "reference_number_trans_desc", "descripcion", "reference_number", "concept", "tx_detail", "tx_service")


def quid_text(tx: DataFrame) -> Column:
    return text.joined_text([F.col(c) for c in QUID_TEXTS if c in tx.columns])


def text_flags(tx: DataFrame) -> DataFrame:
    """What signals ask of a transfer's texts, found once for all that read it: approval, compensation, loan."""
    asked = tx.withColumn("_text", quid_text(tx))
    flags = {"feat_quid_has_approval": F.col("_text").rlike(text.APPROVAL_LOWER), "feat_quid_has_comp": F.col("_text").rlike(text.COMPENSATION_LOWER), "sig_loan_like": intervals.loan_like(False)}
    return asked.withColumns(flags).drop("_text")


def quid_columns(tx: DataFrame) -> DataFrame:
    """Texts, relation and times that M3 reads, with _v and _s, the value time and its whole seconds. tx: with text_flags or without."""
    tx = tx if "feat_quid_has_approval" in tx.columns else text_flags(tx).drop("sig_loan_like")
    joined = quid_text(tx)
    managers = [F.col(c) for c in tx.columns if c.startswith("manager_") and c.endswith("_user_id")]
    up = text.any_of([F.coalesce(m == F.col("receiver_id"), F.lit(False)) for m in managers])
    down = text.any_of([F.coalesce(m == F.col("user_id"), F.lit(False)) for m in managers])
    value_ts = F.coalesce("movement_value_date", "fecha_hora_ts") if "movement_value_date" not in tx.columns else F.col("movement_value_date")
    work = tx.withColumns({"feat_quid_desc_norm": joined, "feat_quid_rel_label": F.when(up, "Subordinado-Manager").when(down, "Manager-Subordinado").otherwise("Par/Indefinido"), "_v": value_ts})
    return work.withColumns({
        "feat_quid_pair_key": values.undirected_pair(F.col("user_id"), F.col("receiver_id")),
        "feat_quid_value_vs_load_days": values.days_between(F.col("_v"), F.col("load_date")),
        "_s": F.floor(F.unix_micros("_v") / 1_000_000),
    })


def _boosted(work: DataFrame, p: Params) -> DataFrame:
    near = p.quid_days * 86_400

    def boosted(rows: DataFrame, keys: list[str]) -> DataFrame:
        before = Window.partitionBy("feat_quid_pair_key", *keys).orderBy("_v", "tx_id").rowsBetween(Window.unboundedPreceding, -1)
        last = lambda flag: F.last(F.when(F.col(flag), F.col("_s")), ignorenulls=True).over(before)
        close = lambda mine, other: (F.col(mine) & (F.col("_s") - last(other) <= near)).cast("int")
        return rows.withColumn("_boost", 0.8 * F.coalesce(close("feat_quid_has_approval", "feat_quid_has_comp"), F.lit(0)) + 0.8 * F.coalesce(close("feat_quid_has_comp", "feat_quid_has_approval"), F.lit(0)))

    # rows without a value time are a slice of their own and take no part in the pairing
    return in_slices(work, F.col("_s"), near, boosted)


def quid_boosts(work: DataFrame, row: str, p: Params = DEFAULTS) -> DataFrame:
    """(row, _boost) of the rows with a boost (W6). work: quid_columns; row: a column that tells rows apart.

    A row without approval or compensation neither gets nor gives one, and a pair needs both: only rows of such pairs are put in order.
    """
    narrow = work.select(row, "feat_quid_pair_key", "feat_quid_has_approval", "feat_quid_has_comp", "_v", "tx_id", "_s").where("_s is not null and (feat_quid_has_approval or feat_quid_has_comp)")
    both = of_groups(narrow, ["feat_quid_pair_key"], (F.count(F.lit(1)) > 1) & F.max("feat_quid_has_approval") & F.max("feat_quid_has_comp"))
    return _boosted(both, p).where("_boost > 0").select(row, "_boost")


def quid_score(work: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The score of quid_columns with their _boost."""
    on = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    score = (
        on(F.col("feat_quid_rel_label") != "Par/Indefinido") * 1.0
        + on(F.col("feat_quid_has_approval") & F.col("feat_quid_has_comp")) * 1.2
        + on(F.col("feat_zscore_monto") > 2) * 0.4
        + on(F.col("sig_near_thr")) * 0.3
        + on(F.col("feat_quid_value_vs_load_days") < -0.5) * 0.3
        + F.col("_boost")
    )
    # rounded, so that sums of tenths compare with the cut as written
    return work.withColumn("feat_quid_score", F.round(score, 6)).withColumn("sig_quid_pro_quo", F.col("feat_quid_score") >= p.quid_min_score).drop("_v", "_s", "_boost")


def quid_pro_quo(tx: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """M3: score of a favour for a payment between two people. Needs feat_zscore_monto and sig_near_thr.

    Hierarchy 1.0, approval and compensation in one text 1.2, high amount 0.4, near a threshold 0.3,
    value date half a day before load 0.3; and (W6) 0.8 for approval within quid_days after compensation in the pair,
    0.8 for the other way round, whole seconds apart.
    """
    return quid_score(_boosted(quid_columns(tx), p), p)
