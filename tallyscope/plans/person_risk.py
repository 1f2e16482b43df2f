"""Question 18: composite risk of persons over fourteen scenarios.

Every scenario is a set of rows (time frame, persona, metric), pairs counted for both ends. They are one
long table, so scores, totals and summaries are a few groupings instead of fourteen joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.checkpoints import cut
from tallyscope.functions import text, values
from tallyscope.operators.quantiles import quantiles
from tallyscope.plans import questions, reports
from tallyscope.plans.reports import AMOUNT, TF

# Scenario -> (quantile of the medium level, weight).
SCENARIOS = {
    "manager_nlp": (0.50, 10), "manager_concepts": (0.60, 9), "quid_pairs": (0.60, 10), "quid_value_vs_load": (0.50, 8), "reference_reuse": (0.55, 7), "centralizer": (0.55, 7), "net_imbalance": (0.60, 3),
    "case13": (0.60, 6), "case14": (0.60, 9), "yoyo": (0.55, 8), "near_threshold": (0.55, 6), "smurfing": (0.55, 9), "bad_loans": (0.55, 8), "recurrent_payroll": (0.55, 8),
}
HIGH_QUANTILE = 0.9


def both_ends(df: DataFrame, a: Column, b: Column, metric: Column, how=F.sum) -> DataFrame:
    """U4: a metric of pairs as a metric of persons."""
    return df.select(TF, F.explode(F.array_distinct(F.array(a, b))).alias("persona"), metric.cast("double").alias("m")).groupBy(TF, "persona").agg(how("m").alias("metric"))


def scenario_metrics(s: DataFrame) -> dict[str, DataFrame]:
    """C2."""
    ends = lambda c, i: F.get(text.split_pair(F.col(c)), F.lit(i))
    by_pair = lambda df, c, metric: both_ends(df, ends(c, 0), ends(c, 1), metric)
    one = lambda df, persona, metric, how=F.sum: df.groupBy(TF, F.col(persona).alias("persona")).agg(how(F.col(metric).cast("double")).alias("metric"))
    q1 = questions.q1(s)
    hits = questions.category_hits(questions.manager_transfers(s)).select(TF, "month_id", F.col("categoria").alias("nlp_concepto_sospechoso"), "manager_user_id", "subordinado_user_id").distinct()
    severe = hits.join(questions.q2(s).select(TF, "month_id", "nlp_concepto_sospechoso", "risk_p95"), [TF, "month_id", "nlp_concepto_sospechoso"])
    refs = reports.references(s).select(TF, "tx_count", F.explode("pairs").alias("p"))
    q4 = questions.q4(s).where("dias_valor_vs_carga < 0")
    thousand = lambda n, x: F.col(n) + F.col(x) / 1000
    return {
        "manager_nlp": both_ends(q1, F.col("manager_user_id"), F.col("subordinado_user_id"), F.col("tx_count")),
        "manager_concepts": both_ends(severe, F.col("manager_user_id"), F.col("subordinado_user_id"), F.col("risk_p95"), F.max),
        "quid_pairs": by_pair(questions.q3(s, min_score=1.0, min_manager_ratio=0.0), "quid_pair_clave", F.col("quid_tx_count") * F.greatest("quid_score_max", "quid_score_avg", F.lit(0.0))),
        "quid_value_vs_load": both_ends(q4, F.col("user_id"), F.col("receiver_id"), F.abs("dias_valor_vs_carga") + F.col("feat_quid_score")),
        "reference_reuse": by_pair(refs, "p", F.col("tx_count")),
        "centralizer": one(questions.q6(s), "receiver_id", "inflow"),
        "net_imbalance": reports.persons(s).select(TF, "persona", F.abs("net").alias("metric")),
        "case13": one(questions.q8(s), "persona", "caso13_persona_monto_total"),
        "case14": one(questions.q9(s), "persona", "caso14_persona_monto_de_emisores_nuevos"),
        "yoyo": by_pair(questions.q10(s), "par_bidir", F.col("tx_yo_yo_totales") + F.col("racha_max_yo_yo") + F.greatest(F.col("riesgo_max_par") - 1, F.lit(0.0))),
        "near_threshold": by_pair(questions.q11(s), "pair", thousand("tx_near_totales", "monto_total_near")),
        "smurfing": by_pair(questions.q12(s), "pair", thousand("transacciones_fraccionadas", "monto_fraccionado_total")),
        "bad_loans": by_pair(questions.q13(s), "pair", F.col("monto_prestamos_incumplidos") + 1000 * F.col("prestamos_incumplidos") + 500 * F.col("eventos_alta_frecuencia")),
        "recurrent_payroll": both_ends(questions.q14(s), F.col("emisor"), F.col("receptor"), F.col("monto_total") + 1000 * F.col("meses_recurrentes")),
    }


def scenario_scores(metrics: DataFrame) -> DataFrame:
    """3, 2 or 1 by quantiles of the positive metrics of a scenario and time frame; a single positive one scores 3.

    Metrics and quantiles are compared with six digits, so that the order of a sum decides nothing.
    """
    metrics = metrics.withColumn("metric", F.round("metric", 6))
    positive = metrics.where("metric > 0")
    medium = F.element_at(F.create_map(*[F.lit(x) for k, (q, _) in SCENARIOS.items() for x in (k, q)]), F.col("scenario"))
    cuts = quantiles(positive, [TF, "scenario"], "metric", [0.5, 0.55, 0.6, HIGH_QUANTILE]).withColumn("q", F.transform("q", lambda x: F.round(x, 6)))
    at = F.when(medium == 0.5, F.get("q", F.lit(0))).when(medium == 0.55, F.get("q", F.lit(1))).otherwise(F.get("q", F.lit(2)))
    cuts = cuts.select(TF, "scenario", "n", at.alias("mid"), F.get("q", F.lit(3)).alias("high"))  # scenarios times time frames
    m = F.col("metric")
    score = F.when(m <= 0, 1).when(F.col("n") == 1, 3).when(m >= F.col("high"), 3).when(m >= F.col("mid"), 2).otherwise(1)
    return metrics.join(F.broadcast(cuts), [TF, "scenario"], "left").withColumn("score", F.coalesce(score, F.lit(1))).drop("n", "mid", "high")


def payment_months(s: DataFrame, *more: Column) -> DataFrame:
    """A sender's monthly totals and mean day of payment."""
    return s.groupBy(TF, F.col("user_id").alias("persona"), "month_id").agg(F.round(F.sum(AMOUNT), 4).alias("monto_total"), F.round(F.avg(F.dayofmonth("fecha_hora_ts")), 6).alias("dia_pago_promedio"), *more)


def payment_profile(s: DataFrame) -> DataFrame:
    """A sender's monthly totals, mean day of payment, spread of both, and the payments nested by month."""
    month = payment_months(s, F.array_sort(F.collect_list(F.struct(F.col("fecha_hora_ts").alias("fecha"), F.col(AMOUNT).alias("monto")))).alias("pagos"))
    detail = F.struct(F.col("month_id").alias("mes"), "monto_total", "dia_pago_promedio", "pagos")
    return month.groupBy(TF, "persona").agg(F.count(F.lit(1)).alias("meses"), F.round(F.stddev_pop("monto_total"), 4).alias("std_monto_mensual"), F.round(F.stddev_pop("dia_pago_promedio"), 6).alias("std_dia_pago_mensual"), F.array_sort(F.collect_list(detail)).alias("detalle_pagos_mensuales"))


def payment_rows(s: DataFrame) -> DataFrame:
    """The payments that payment_profile nests, a row each: their month's figures are joined to them, so nobody's payments are gathered."""
    months = payment_months(s).select(F.col(TF).alias("_tf"), "persona", F.col("month_id").alias("mes"), "monto_total", "dia_pago_promedio")
    rows = s.select(TF, F.col("user_id").alias("_u"), F.col("month_id").alias("_m"), F.col("fecha_hora_ts").alias("fecha"), F.col(AMOUNT).alias("monto"))
    met = rows.join(months, (F.col(TF) == F.col("_tf")) & F.col("_u").eqNullSafe(F.col("persona")) & F.col("_m").eqNullSafe(F.col("mes")))
    return met.select(TF, "persona", "mes", "monto_total", "dia_pago_promedio", "fecha", "monto")


def q18(s: DataFrame, top_n: int = 25) -> DataFrame:
    """Persons by weighted scenario scores, with tier, main scenarios, flags, balance and the total over all time frames."""
    long = reduce(DataFrame.unionByName, [df.select(TF, "persona", "metric").withColumn("scenario", F.lit(k)) for k, df in scenario_metrics(s).items()])
    # the metrics feed quantiles and scores: fourteen plans run once
    long = cut(long.withColumn("metric", F.round("metric", 6)), "metrics")
    scored = scenario_scores(long)
    weight = F.element_at(F.create_map(*[F.lit(x) for k, (_, w) in SCENARIOS.items() for x in (k, w)]), F.col("scenario"))
    all_weight = sum(w for _, w in SCENARIOS.values())
    # a scenario without a row scores 1: only what lies above that is added to the base
    extra = (F.col("score") - 1) * weight
    main = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("score") > 1, F.struct((-F.col("score") * weight).alias("o"), "scenario", "score")))), 1, 3), lambda x: F.concat(x["scenario"], F.lit("="), x["score"].cast("string")))
    totals = scored.groupBy(TF, "persona").agg((F.sum(extra) + all_weight).cast("long").alias("puntaje_total"), F.array_join(main, ", ").alias("casuistica_resumen"))
    p = reports.persons(s).join(totals, [TF, "persona"], "left").withColumn("puntaje_total", F.coalesce("puntaje_total", F.lit(all_weight).cast("long")))
    everywhere = F.sum("puntaje_total").over(Window.partitionBy("persona"))
    flags = F.array(*[F.struct((-F.col(k)).alias("o"), F.lit(k).alias("k")) for k in reports.PERSON_FLAGS])
    active = F.filter(F.array_sort(flags), lambda x: x["o"] < 0)
    named = F.array_join(F.transform(F.slice(active, 1, 3), lambda x: F.concat(x["k"], F.lit("="), F.format_number(-x["o"], 2))), ", ")
    out = p.select(
        TF,
        "persona",
        "puntaje_total",
        F.round(F.col("puntaje_total") / all_weight, 6).alias("puntaje_promedio"),
        everywhere.alias("puntaje_total_todos"),
        F.coalesce(F.nullif(F.col("casuistica_resumen"), F.lit("")), F.lit("sin escenarios")).alias("casuistica_resumen"),
        "risk_avg_person",
        values.fixed_tier(F.col("risk_avg_person")).alias("risk_tier"),
        "movements",
        "n_tx_emit",
        "sum_emit",
        "n_tx_recv",
        "sum_recv",
        F.col("net").alias("net_flow"),
        F.size(active).alias("flags_activas"),
        F.greatest(*reports.PERSON_FLAGS).alias("flag_rate_max"),
        F.coalesce(F.nullif(named, F.lit("")), F.lit("SIN_ALERTA")).alias("banderas_destacadas"),
    )
    order = [F.desc("puntaje_total"), F.desc("risk_avg_person"), F.desc(F.abs("net_flow")), F.desc("flag_rate_max"), F.desc("flags_activas"), F.col("persona")]
    ranked = out.withColumn("ranking_prioridad", F.row_number().over(Window.partitionBy(TF).orderBy(*order))).where(F.col("ranking_prioridad") <= top_n)
    return ranked.withColumn("interpretabilidad", questions.say(F.col("persona"), ": ", F.col("puntaje_total"), " puntos; ", F.col("casuistica_resumen")))
