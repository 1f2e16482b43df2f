"""Report tables over scored transfers.

`sliced` puts every transfer into the time frames it belongs to; a report is one grouping by time frame and key, for all frames at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions import text, values
from tallyscope.operators import graph
from tallyscope.operators.quantiles import quantile
from tallyscope.params import DEFAULTS, TIMEFRAMES, Params

TF = "timeframe_periodo"
AMOUNT = "movement_amount"
PAIR_FLAGS = {"pct_yoyo": "sig_yoyo", "pct_smurf": "sig_smurf", "pct_freq": "sig_freq", "pct_recurrent": "sig_recurrent", "pct_quid_pro_quo": "sig_quid_pro_quo", "pct_reference_reuse": "sig_reference_reuse", "pct_change_point": "sig_pair_change_point", "pct_new_edge": "sig_pair_new_edge"}
PERSON_FLAGS = PAIR_FLAGS | {"pct_loan_bad": "sig_loan_bad_repay", "pct_roundsum": "sig_roundsum", "pct_near_thr": "sig_near_thr", "pct_in_cycle": "p1_in_cycle", "pct_in_triangle": "p1_in_triangle"}
CLUSTER_FLAGS = {
    "yo_yo_cluster_tasa_flag": "sig_yoyo", "smurf_cluster_tasa_flag": "sig_smurf", "frecuencia_cluster_tasa_flag": "sig_freq", "recurrente_cluster_tasa_flag": "sig_recurrent",
    "prestamo_cluster_tasa_repay_insuficiente": "sig_loan_bad_repay", "monto_cluster_tasa_flag_redondo": "sig_roundsum", "umbral_cluster_tasa_flag_cercania": "sig_near_thr",
    "red_cluster_tasa_en_ciclos": "p1_in_cycle", "red_cluster_tasa_en_triangulos": "p1_in_triangle", "quid_cluster_tasa_flag": "sig_quid_pro_quo", "referencia_cluster_tasa_reutilizada": "sig_reference_reuse",
}


def sliced(tx: DataFrame) -> DataFrame:
    """A row per transfer and time frame, counted back from the latest transfer (inclusive)."""
    latest = tx.agg(F.max("fecha_hora_ts").alias("_latest"))  # one row
    age = F.unix_micros("_latest") - F.unix_micros("fecha_hora_ts")
    frames = [F.when(F.lit(True) if days is None else age <= days * values.MICROS_DAY, F.lit(name)) for name, days in TIMEFRAMES.items()]
    return tx.join(F.broadcast(latest)).withColumn(TF, F.explode(F.filter(F.array(*frames), lambda x: x.isNotNull()))).drop("_latest")


def rate(flag: str) -> Column:
    return F.round(F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("double")), 9)


def mean(c: str) -> Column:
    """Means of amounts keep 8 digits: with two decimals in, 6 would often fall on a tie."""
    return F.round(F.avg(c), 8 if c == AMOUNT else 6)


def total(c: str = AMOUNT) -> Column:
    return F.round(F.sum(c), 4)


def transactions(s: DataFrame) -> DataFrame:
    """K1, K2: the transfers, worst tier first."""
    return s.orderBy(TF, values.tier_rank(F.col("risk_tier")), F.desc("risk_score"), "tx_id")


def suspicious(s: DataFrame) -> DataFrame:
    return s.where("nlp_concepto_sospechoso <> ''")


def top_concepts(s: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """The n most frequent concepts and texts per key, ties by name."""

    def best(item: str, to: str) -> DataFrame:
        counts = s.where(F.col(item) != "").groupBy(*keys, item).agg(F.count(F.lit(1)).alias("c"))
        ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("c"), item))).where(F.col("r") <= n)
        return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", item))), lambda x: x[item]).alias(to))

    return best("nlp_concepto_sospechoso", "top_conceptos").join(best("descripcion", "top_textos"), keys, "full")


def sides(s: DataFrame) -> DataFrame:
    """Each transfer seen from both ends (persona, sent), so a person's two sides need one shuffle."""
    ends = F.array(F.struct(F.col("user_id").alias("persona"), F.lit(True).alias("sent")), F.struct(F.col("receiver_id").alias("persona"), F.lit(False).alias("sent")))
    return s.withColumn("_e", F.explode(ends)).select("*", "_e.persona", "_e.sent").drop("_e")


def persons(s: DataFrame) -> DataFrame:
    """A person's sent and received totals, risks, texts, flag rates and balance."""
    e = sides(s)
    sent, got = F.col("sent"), ~F.col("sent")
    if_ = lambda cond, c: F.when(cond, F.col(c))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    r6 = lambda c: F.round(zero(c), 6)
    concept = F.when(sent & (F.col("nlp_concepto_sospechoso") != ""), F.col("nlp_concepto_sospechoso"))
    rates = [F.round(zero(F.avg(F.when(sent, F.coalesce(F.col(f), F.lit(False)).cast("double")))), 9).alias(k) for k, f in PERSON_FLAGS.items()]
    p = e.groupBy(TF, "persona").agg(
        F.count_if(sent).alias("n_tx_emit"),
        F.round(zero(F.sum(if_(sent, AMOUNT))), 4).alias("sum_emit"),
        F.round(zero(F.avg(if_(sent, AMOUNT))), 8).alias("avg_emit"),
        r6(F.avg(if_(sent, "risk_score"))).alias("risk_avg_em"),
        r6(F.max(if_(sent, "risk_score"))).alias("risk_max_emit"),
        F.count_if(got).alias("n_tx_recv"),
        F.round(zero(F.sum(if_(got, AMOUNT))), 4).alias("sum_recv"),
        F.round(zero(F.avg(if_(got, AMOUNT))), 8).alias("avg_recv"),
        r6(F.avg(if_(got, "risk_score"))).alias("risk_avg_re"),
        r6(F.max(if_(got, "risk_score"))).alias("risk_max_recv"),
        F.count(concept).alias("nlp_persona_total_transacciones_sospechosas"),
        F.count_distinct(concept).alias("nlp_persona_conceptos_sospechosos_unicos"),
        r6(F.avg(if_(sent, "feat_nlp_coi_score"))).alias("nlp_score_emit_avg"),
        r6(F.max(if_(sent, "feat_nlp_coi_score"))).alias("nlp_score_emit_max"),
        r6(F.avg(if_(got, "feat_nlp_coi_score"))).alias("nlp_score_recv_avg"),
        r6(F.max(if_(got, "feat_nlp_coi_score"))).alias("nlp_score_recv_max"),
        r6(F.avg(if_(sent, "feat_nlp_sentimiento"))).alias("nlp_sent_emit_avg"),
        r6(F.avg(if_(got, "feat_nlp_sentimiento"))).alias("nlp_sent_recv_avg"),
        *rates,
    )
    p = p.withColumns({
        "risk_avg_person": F.round((F.col("risk_avg_em") + F.col("risk_avg_re")) / 2, 7),
        # the mean always divides by two (Q-16)
        "nlp_sentimiento_promedio": F.round((F.col("nlp_sent_emit_avg") + F.col("nlp_sent_recv_avg")) / 2, 7),
        "nlp_score_max": F.greatest("nlp_score_emit_avg", "nlp_score_emit_max", "nlp_score_recv_avg", "nlp_score_recv_max"),
        "net": F.round(F.col("sum_emit") - F.col("sum_recv"), 4),
        "movements": F.col("n_tx_emit") + F.col("n_tx_recv"),
        "pct_emit": F.round(F.when(F.col("sum_emit") + F.col("sum_recv") > 0, F.col("sum_emit") / (F.col("sum_emit") + F.col("sum_recv"))).otherwise(0.0), 9),
    })
    # population z across persons: one row per time frame, broadcast
    stats = p.groupBy(TF).agg(*[f(c).alias(f"_{k}_{c}") for c in ("sum_emit", "sum_recv", "net") for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {f"z_{c}": F.round(F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0), 6) for c in ("sum_emit", "sum_recv", "net")}
    out = p.join(F.broadcast(stats), TF).withColumns(z).drop(*[f"_{k}_{c}" for c in ("sum_emit", "sum_recv", "net") for k in "ms"])
    said = text.sentences(
        F.concat(F.lit("Riesgo "), values.fixed_tier(F.greatest("risk_max_emit", "risk_max_recv"))),
        F.when(F.abs("z_net") >= 2, F.concat(F.lit("Desbalance neto de "), text.money(F.col("net")))),
        F.when(F.col("nlp_persona_total_transacciones_sospechosas") > 0, F.concat(F.col("nlp_persona_total_transacciones_sospechosas").cast("string"), F.lit(" textos sospechosos"))),
    )
    return out.withColumn("interp_person", said)


def person_months(s: DataFrame) -> DataFrame:
    """A person's net per month, its z among the month's persons, and whether it is extreme."""
    m = sides(s).groupBy(TF, "month_id", "persona").agg(F.round(F.sum(F.when(F.col("sent"), F.col(AMOUNT)).otherwise(-F.col(AMOUNT))), 4).alias("net"))
    stats = m.groupBy(TF, "month_id").agg(F.avg("net").alias("_m"), F.stddev_pop("net").alias("_s"))
    z = F.round(F.when(F.col("_s") > 0, (F.col("net") - F.col("_m")) / F.col("_s")).otherwise(0.0), 6)
    return m.join(stats, [TF, "month_id"]).withColumn("z_net", z).withColumn("extremo", F.abs("z_net") >= 2).drop("_m", "_s")


def person_imbalance(s: DataFrame) -> DataFrame:
    """Extreme months per person, by sign, with their share."""
    m = person_months(s)
    return m.groupBy(TF, "persona").agg(
        F.count(F.lit(1)).alias("meses_activos"),
        F.count_if(F.col("extremo") & (F.col("z_net") > 0)).alias("meses_extremos_emisor"),
        F.count_if(F.col("extremo") & (F.col("z_net") < 0)).alias("meses_extremos_receptor"),
        F.round(F.avg(F.col("extremo").cast("double")), 9).alias("tasa_meses_extremos"),
    )


def case13(s: DataFrame, new_years: float = 0.5, min_senders: int = 3, min_high: int = 2, new_limit: str | None = None) -> DataFrame:
    """Newcomers who receive high amounts (at or above the 90th percentile of the time frame). new_limit: a column with the limit in years instead of new_years."""
    cut = quantile(s, [TF], AMOUNT, 0.9, "_cut")
    new = s.where(F.col("receptor_antiguedad_anios") <= (F.lit(new_years) if new_limit is None else F.col(new_limit))).join(F.broadcast(cut), TF)  # a row per time frame
    g = new.groupBy(TF, F.col("receiver_id").alias("persona")).agg(
        F.count(AMOUNT).alias("caso13_persona_tx_recibidas"),
        total().alias("caso13_persona_monto_total"),
        F.count_distinct("user_id").alias("caso13_persona_emisores_unicos"),
        F.count_if(F.col(AMOUNT) >= F.col("_cut")).alias("caso13_persona_tx_altos"),
        mean(AMOUNT).alias("caso13_persona_monto_promedio"),
    )
    return g.withColumn("caso13_persona_flag_nuevo_receptor_altos_montos", ((F.col("caso13_persona_emisores_unicos") >= min_senders) & (F.col("caso13_persona_tx_altos") >= min_high)).cast("int"))


def case14(s: DataFrame, new_years: float = 0.5, old_years: float = 5.0, min_senders: int = 3, min_tx: int = 5) -> DataFrame:
    """Veterans paid by newcomers."""
    g = s.where((F.col("user_antiguedad_anios") <= new_years) & (F.col("receptor_antiguedad_anios") >= old_years)).groupBy(TF, F.col("receiver_id").alias("persona")).agg(
        F.count(AMOUNT).alias("caso14_persona_tx_de_emisores_nuevos"),
        total().alias("caso14_persona_monto_de_emisores_nuevos"),
        F.count_distinct("user_id").alias("caso14_persona_emisores_nuevos_unicos"),
        mean(AMOUNT).alias("caso14_persona_monto_promedio_de_emisores_nuevos"),
    )
    return g.withColumn("caso14_persona_flag_antiguo_recibe_de_nuevos", ((F.col("caso14_persona_emisores_nuevos_unicos") >= min_senders) & (F.col("caso14_persona_tx_de_emisores_nuevos") >= min_tx)).cast("int"))


def pair() -> Column:
    return values.directed_pair(F.col("user_id"), F.col("receiver_id"))


def pairs(s: DataFrame) -> DataFrame:
    """Directed pairs with totals, risks and flag rates."""
    g = s.groupBy(TF, pair().alias("pair"), "user_id", "receiver_id").agg(
        F.count(AMOUNT).alias("tx_count"),
        total().alias("tx_sum"),
        F.round(F.max("risk_score"), 6).alias("risk_max"),
        mean("risk_score").alias("risk_avg"),
        *[rate(f).alias(k) for k, f in PAIR_FLAGS.items()],
        F.count_if(F.col("nlp_concepto_sospechoso") != "").alias("nlp_par_total_transacciones_sospechosas"),
        F.count_distinct(F.nullif(F.col("nlp_concepto_sospechoso"), F.lit(""))).alias("nlp_par_conceptos_sospechosos_unicos"),
    )
    return g.withColumn("interp_pair", F.concat(F.lit("Riesgo "), values.fixed_tier(F.col("risk_max")), F.lit(", "), F.col("tx_count").cast("string"), F.lit(" tx")))


def case12(s: DataFrame, min_tx: int = 3, tolerance: float = 0.03) -> DataFrame:
    """Savings rounds among teammates: equal amounts, or nearly equal ones."""
    g = s.where("relacion = 'companero_equipo'").groupBy(TF, pair().alias("pair")).agg(F.count(AMOUNT).alias("caso12_par_tanda_tx_count"), F.count_distinct(AMOUNT).alias("_u"), F.avg(AMOUNT).alias("_avg"), (F.max(AMOUNT) - F.min(AMOUNT)).alias("_range"))
    enough = F.col("caso12_par_tanda_tx_count") >= min_tx
    return g.select(
        TF,
        "pair",
        "caso12_par_tanda_tx_count",
        F.round("_avg", 8).alias("caso12_par_tanda_monto_promedio"),
        (enough & (F.col("_u") == 1)).cast("int").alias("caso12_par_tanda_no_ofuscada_flag"),
        (enough & (F.col("_u") > 1) & (F.col("_range") <= F.abs("_avg") * tolerance)).cast("int").alias("caso12_par_tanda_ofuscada_flag"),
    )


def concepts(s: DataFrame) -> DataFrame:
    """Concepts with transfers, money, people and risk."""
    return suspicious(s).groupBy(TF, "nlp_concepto_sospechoso").agg(
        F.count(AMOUNT).alias("nlp_concepto_tx_total"),
        total().alias("nlp_concepto_monto_total"),
        F.count_distinct("user_id").alias("nlp_concepto_emisores_unicos"),
        F.count_distinct("receiver_id").alias("nlp_concepto_receptores_unicos"),
        mean("risk_score").alias("nlp_concepto_riesgo_promedio"),
        F.round(F.percentile("risk_score", F.lit(0.95)), 6).alias("nlp_concepto_riesgo_p95"),
        F.array_sort(F.collect_set("descripcion")).alias("nlp_concepto_textos"),
    )


def person_concepts(s: DataFrame) -> DataFrame:
    """A21."""
    return suspicious(s).groupBy(TF, F.col("user_id").alias("persona"), "nlp_concepto_sospechoso").agg(F.count(AMOUNT).alias("nlp_persona_concepto_tx_total"), total().alias("nlp_persona_concepto_monto_total"), mean("risk_score").alias("nlp_persona_concepto_riesgo_promedio"))


def pair_concepts(s: DataFrame) -> DataFrame:
    """A21."""
    return suspicious(s).groupBy(TF, pair().alias("pair"), "nlp_concepto_sospechoso").agg(F.count(AMOUNT).alias("nlp_par_concepto_tx_total"), total().alias("nlp_par_concepto_monto_total"), mean("risk_score").alias("nlp_par_concepto_riesgo_promedio"))


def quid_cases(s: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Transfers at or above the quid score."""
    return s.where(F.col("feat_quid_score") >= p.quid_min_score).select(TF, "tx_id", "fecha_hora_ts", "user_id", "receiver_id", AMOUNT, "relacion", "feat_quid_rel_label", "feat_quid_has_approval", "feat_quid_has_comp", "feat_quid_value_vs_load_days", "feat_quid_score", "feat_quid_pair_key", "feat_quid_desc_norm", "descripcion", "reference_number_trans_desc", "risk_score")


def quid_pairs(s: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Undirected pairs of those transfers."""
    g = quid_cases(s, p).groupBy(TF, F.col("feat_quid_pair_key").alias("quid_pair_clave")).agg(
        F.count(F.lit(1)).alias("quid_tx_count"),
        F.max("feat_quid_score").alias("quid_score_max"),
        mean("feat_quid_score").alias("quid_score_avg"),
        F.round(F.avg(F.col("feat_quid_rel_label").contains("Manager").cast("double")), 9).alias("quid_manager_ratio"),
        rate("feat_quid_has_approval").alias("quid_aprob_ratio"),
        rate("feat_quid_has_comp").alias("quid_comp_ratio"),
    )
    return g.withColumn("quid_pair_label", F.replace("quid_pair_clave", F.lit("|"), F.lit("↔")))


def change_events(s: DataFrame) -> DataFrame:
    """Months in which a directed pair changed or began, with the most common relation (ties by name)."""
    g = s.where("sig_pair_change_point or sig_pair_new_edge").groupBy(TF, "user_id", "receiver_id", pair().alias("pair"), "month_id").agg(
        F.mode("relacion", True).alias("relacion"),
        F.max("sig_pair_change_point").alias("sig_pair_change_point"),
        F.max("sig_pair_new_edge").alias("sig_pair_new_edge"),
        F.round(F.max("feat_pair_month_amount_ratio"), 6).alias("feat_pair_month_amount_ratio"),
        F.round(F.max("feat_pair_month_count_ratio"), 6).alias("feat_pair_month_count_ratio"),
        F.max("feat_pair_months_since_prev").alias("feat_pair_months_since_prev"),
        F.count(AMOUNT).alias("month_tx_count"),
        total().alias("month_tx_sum"),
        F.round(F.max("risk_score"), 6).alias("risk_score_max"),
    )
    return g


def change_pairs(s: DataFrame) -> DataFrame:
    """A23."""
    return change_events(s).groupBy(TF, "user_id", "receiver_id", "pair").agg(F.sum(F.col("sig_pair_change_point").cast("long")).alias("change_point_eventos"), F.sum(F.col("sig_pair_new_edge").cast("long")).alias("new_edge_eventos"), F.max("risk_score_max").alias("risk_score_max"))


def references(s: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """References that two or more pairs used within reference_days in a time frame; transfers outside of it decide nothing."""
    pair_key = values.undirected_pair(F.col("user_id"), F.col("receiver_id"))
    used = s.where("feat_reference_norm <> ''")
    g = used.groupBy(TF, F.col("feat_reference_norm").alias("reference_norm")).agg(F.min("fecha_hora_ts").alias("first_ts"), F.max("fecha_hora_ts").alias("last_ts"), F.count_distinct(pair_key).alias("pairs_count"), F.array_sort(F.collect_set(pair_key)).alias("pairs"), F.count(F.lit(1)).alias("tx_count"), total().alias("monto_total"), F.max("feat_reference_len").alias("reference_len"))
    span = F.unix_micros("last_ts") - F.unix_micros("first_ts")
    return g.where((F.col("pairs_count") > 1) & (span <= p.reference_days * values.MICROS_DAY)).withColumn("span_days", F.round(span / values.MICROS_DAY, 6))


def reference_transfers(s: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The transfers of those references, with their place in time among the reference's."""
    rows = s.join(references(s, p).select(TF, F.col("reference_norm").alias("feat_reference_norm")), [TF, "feat_reference_norm"], "left_semi")
    place = Window.partitionBy(TF, "feat_reference_norm").orderBy("fecha_hora_ts", "tx_id")
    return rows.select(TF, "tx_id", "fecha_hora_ts", "user_id", "receiver_id", "reference_number_trans_desc", "feat_reference_norm", "feat_reference_len", "sig_reference_reuse", F.round("risk_score", 6).alias("risk_score"), F.row_number().over(place).alias("orden"))


def bursts(s: DataFrame) -> DataFrame:
    """A5: channel bins that are events, with money and risk."""
    g = s.where("rafaga_canal_flag_evento").groupBy(TF, "rafaga_canal_id", "rafaga_canal_hora_bin_inicio")
    return g.agg(
        F.first("rafaga_canal_hora_bin_fin").alias("rafaga_canal_hora_bin_fin"),
        F.first("rafaga_canal_hora_label").alias("rafaga_canal_hora_label"),
        F.first("rafaga_canal_tx_en_bin").alias("rafaga_canal_tx_en_bin"),
        F.first("rafaga_canal_ratio_fuera_horario").alias("rafaga_canal_ratio_fuera_horario"),
        mean(AMOUNT).alias("monto_promedio"),
        total().alias("monto_total"),
        mean("risk_score").alias("riesgo_promedio"),
        F.round(F.max("risk_score"), 6).alias("riesgo_maximo"),
    )


def cluster_members(s: DataFrame) -> DataFrame:
    """The persons of each cluster, a row each. The components of all time frames are found in one run."""
    return graph.cluster_ids(graph.distinct_edges(s, TF), TF).select(TF, "cluster_id", F.col("node").alias("persona"))


def clusters(s: DataFrame) -> DataFrame:
    """Connected components of each time frame with totals, flag rates and the most unbalanced person (ties by id)."""
    keys = [TF, "cluster_id"]
    labelled = s.join(cluster_members(s).withColumnRenamed("persona", "user_id"), [TF, "user_id"])
    g = labelled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cluster_tx_count"),
        total().alias("cluster_tx_sum"),
        F.round(F.max("risk_score"), 6).alias("riesgo_cluster_maximo"),
        mean("risk_score").alias("riesgo_cluster_promedio"),
        F.count_if(F.col("nlp_concepto_sospechoso") != "").alias("nlp_cluster_total_transacciones_sospechosas"),
        F.count_distinct(F.nullif(F.col("nlp_concepto_sospechoso"), F.lit(""))).alias("nlp_cluster_conceptos_sospechosos_unicos"),
        *[rate(f).alias(k) for k, f in CLUSTER_FLAGS.items()],
    )
    net = sides(labelled).groupBy(*keys, "persona").agg(F.round(F.sum(F.when(F.col("sent"), F.col(AMOUNT)).otherwise(-F.col(AMOUNT))), 4).alias("net"))
    main = net.groupBy(*keys).agg(F.count(F.lit(1)).alias("cluster_personas_total"), F.min_by(F.struct("persona", "net"), F.struct(-F.abs("net"), "persona")).alias("m"))
    out = g.join(main, keys).withColumn("desbalance_cluster_persona_principal", F.col("m.persona")).withColumn("desbalance_cluster_persona_principal_monto", F.col("m.net")).drop("m")
    said = F.concat(F.col("cluster_personas_total").cast("string"), F.lit(" personas con "), F.col("cluster_tx_count").cast("string"), F.lit(" tx. Riesgo max "), F.format_number("riesgo_cluster_maximo", 2))
    return out.withColumn("interp_cluster", said)


def build_all(scored: DataFrame) -> dict[str, DataFrame]:
    """M1: every report by name, lazily."""
    s = sliced(scored)
    makers = {
        "transaccion": transactions, "persona": persons, "persona_desbalance": person_imbalance, "casuistica_13": case13, "casuistica_14": case14, "par": pairs, "casuistica_12": case12,
        "concepto": concepts, "persona_concepto": person_concepts, "par_concepto": pair_concepts, "casuistica_quid_casos": quid_cases, "casuistica_quid_pares": quid_pairs,
        "casuistica_cambio_eventos": change_events, "casuistica_cambio_pares": change_pairs, "casuistica_referencia": references, "casuistica_referencia_tx": reference_transfers, "cluster": clusters, "rafaga": bursts,
    }
    return {k: f(s) for k, f in makers.items()}

