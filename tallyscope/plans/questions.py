"""Audit questions Q1-Q17 over sliced scored transfers.

Every question answers for all time frames at once (column timeframe_periodo). Filters that relax
when nothing passes are levels: each row gets the first level it passes, and per time frame the lowest level present
is kept (`relaxed`). Ties in every ranking are broken by a unique key. Texts are built last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.checkpoints import cut
from tallyscope.functions import text
from tallyscope.operators.lexicon import DEFAULT_LEXICON
from tallyscope.operators.quantiles import quantile, quantiles
from tallyscope.plans import qa, reports
from tallyscope.plans.reports import AMOUNT, TF, mean, pair, total


def relaxed(df: DataFrame, levels: list[Column], keys: tuple[str, ...] = (TF,)) -> DataFrame:
    """Rows at the lowest level that has any, per time frame, with that level as nivel_relajado (0: strict)."""
    level = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(levels)])
    leveled = df.withColumn("nivel_relajado", level).where("nivel_relajado is not null")
    best = leveled.groupBy(*keys).agg(F.min("nivel_relajado").alias("_best"))  # a row per time frame
    return leveled.join(F.broadcast(best), list(keys)).where("nivel_relajado = _best").drop("_best")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """K3: the first n per time frame."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(TF).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def num(c: str) -> Column:
    return F.format_number(F.col(c), 2)


def manager_transfers(s: DataFrame) -> DataFrame:
    """Transfers between a manager and a subordinate, with who is who and the direction.

    The relation text decides where it names a manager; else the manager columns do, unless the other is a teammate.
    """
    rel = F.regexp_replace(F.upper(F.translate(F.coalesce("relacion", F.lit("")), text.ACCENTED, text.PLAIN)), "[^A-Z0-9]", "")
    managers = [F.col(c) for c in s.columns if c.startswith("manager_") and c.endswith("_user_id")]
    listed = text.any_of([F.coalesce(m == F.col("receiver_id"), F.lit(False)) for m in managers]) if managers else F.lit(False)
    theirs = [F.col(f"`{c}`") for c in s.columns if c.startswith(("receptor-manager_", "receptor_manager_"))]
    boss_sends = text.any_of([F.coalesce(m == F.col("user_id"), F.lit(False)) for m in theirs]) if theirs else F.lit(False)
    mate = F.coalesce(F.array_contains("companeros_de_equipo", F.col("receiver_id")), F.lit(False)) if "companeros_de_equipo" in s.columns else F.lit(False)
    up = rel.contains("MANAGERDELEMISOR") | rel.contains("SUBORDINADOAMANAGER") | (~rel.contains("MANAGER") & listed & ~mate)
    down = rel.contains("MANAGERDELRECEPTOR") | rel.contains("MANAGERASUBORDINADO") | (~rel.contains("MANAGER") & boss_sends & ~mate)
    direction = F.when(up, "subordinado_a_manager").when(down, "manager_a_subordinado").when(rel.contains("MANAGER"), "subordinado_a_manager")
    out = s.withColumn("direction", direction).where("direction is not null")
    to_boss = F.col("direction") == "subordinado_a_manager"
    return out.withColumn("manager_user_id", F.when(to_boss, F.col("receiver_id")).otherwise(F.col("user_id"))).withColumn("subordinado_user_id", F.when(to_boss, F.col("user_id")).otherwise(F.col("receiver_id")))


def category_hits(m: DataFrame) -> DataFrame:
    """A row per transfer and category found in its text."""
    return m.withColumn("categoria", F.explode("nlp_categorias"))


def q1(s: DataFrame, categories: list[str] | None = None, direction: str = "both") -> DataFrame:
    """Suspicious concepts between managers and subordinates. A transfer with k categories counts in each (Q-12); tx_distinct counts it once.

    A direction without rows falls back to the other one.
    """
    hits = category_hits(manager_transfers(s)).where(F.col("categoria").isin(categories or list(DEFAULT_LEXICON)))
    if direction != "both":
        hits = relaxed(hits, [F.col("direction") == direction, F.lit(True)])
    g = hits.groupBy(TF, "month_id", "manager_user_id", "subordinado_user_id", "direction").agg(
        F.array_sort(F.collect_set("categoria")).alias("conceptos"),
        F.array_sort(F.collect_set("descripcion")).alias("textos"),
        F.count(F.lit(1)).alias("tx_count"),
        F.count_distinct("tx_id").alias("tx_distinct"),
        total().alias("monto_total"),
    )
    return g.select(TF, "month_id", "manager_user_id", "subordinado_user_id", "direction", F.array_join("conceptos", ", ").alias("nlp_concepto_sospechoso"), F.array_join("textos", " | ").alias("nlp_descripciones"), "tx_count", "tx_distinct", "monto_total", say(F.col("tx_count"), " transferencias por ", num("monto_total"), " entre ", F.col("subordinado_user_id"), " y ", F.col("manager_user_id")).alias("interpretabilidad"))


def q2(s: DataFrame) -> DataFrame:
    """Severity of concepts between managers and subordinates by month."""
    g = category_hits(manager_transfers(s)).groupBy(TF, "month_id", F.col("categoria").alias("nlp_concepto_sospechoso")).agg(F.count(F.lit(1)).alias("tx_count"), F.round(F.percentile("risk_score", F.lit(0.95)), 6).alias("risk_p95"))
    return g.withColumn("interpretabilidad", say(F.col("nlp_concepto_sospechoso"), ": ", F.col("tx_count"), " casos, p95 ", num("risk_p95")))


def q3(s: DataFrame, min_score: float = 2.2, min_manager_ratio: float = 0.5, top_n: int = 10) -> DataFrame:
    """Pairs with favours for payments: strict, then by score and hierarchy, then the highest scores of all pairs."""
    g = s.groupBy(TF, F.col("feat_quid_pair_key").alias("quid_pair_clave")).agg(
        F.count(F.lit(1)).alias("quid_tx_count"),
        F.max("feat_quid_score").alias("quid_score_max"),
        mean("feat_quid_score").alias("quid_score_avg"),
        F.round(F.avg(F.col("feat_quid_rel_label").contains("Manager").cast("double")), 9).alias("quid_manager_ratio"),
        reports.rate("feat_quid_has_approval").alias("quid_aprob_ratio"),
        reports.rate("feat_quid_has_comp").alias("quid_comp_ratio"),
        total().alias("quid_tx_amount_sum"),
        F.round(F.max("risk_score"), 6).alias("quid_tx_risk_max"),
        F.min("fecha_hora_ts").alias("quid_tx_first_fecha"),
        F.max("fecha_hora_ts").alias("quid_tx_last_fecha"),
        # The best example: highest score, then amount, then key
        F.min_by(F.struct("tx_id", AMOUNT, "feat_quid_score", "descripcion"), F.struct(-F.col("feat_quid_score"), -F.col(AMOUNT), "tx_id")).alias("t"),
    )
    found = F.col("quid_score_max") >= min_score
    strict = found & (F.col("quid_manager_ratio") > min_manager_ratio) & ((F.col("quid_aprob_ratio") > 0) | (F.col("quid_comp_ratio") > 0))
    kept = relaxed(g, [strict, found & (F.col("quid_manager_ratio") > min_manager_ratio), F.lit(True)])
    last = top(kept.where("nivel_relajado = 2"), top_n, F.desc("quid_score_max"), F.desc("quid_tx_count"), F.col("quid_pair_clave"))
    out = kept.where("nivel_relajado < 2").unionByName(last)
    return out.select("*", F.col("t.tx_id").alias("quid_top_tx_id"), F.col(f"t.{AMOUNT}").alias("quid_top_tx_monto"), F.col("t.feat_quid_score").alias("quid_top_tx_score"), F.col("t.descripcion").alias("quid_top_tx_descripcion"), say(F.col("quid_tx_count"), " transferencias, puntaje máximo ", num("quid_score_max")).alias("interpretabilidad")).drop("t")


def q3_with_details(s: DataFrame, **how: float) -> DataFrame:
    """Pair rows and the transfers of their pairs in one table, with the columns that each kind has."""
    pairs = q3(s, **how).withColumn("tipo", F.lit("par"))
    rows = s.select(TF, F.col("feat_quid_pair_key").alias("quid_pair_clave"), "tx_id", "fecha_hora_ts", AMOUNT, "feat_quid_score").join(pairs.select(TF, "quid_pair_clave"), [TF, "quid_pair_clave"], "left_semi")
    return pairs.unionByName(rows.withColumn("tipo", F.lit("detalle")), allowMissingColumns=True)


def pair_concepts(s: DataFrame) -> DataFrame:
    """The tagged concepts and the cleaned texts of each pair, in one long form, and joined in order of their names."""
    both = F.array(F.col("nlp_concepto_sospechoso"), text.clean_concept(F.col("descripcion")))
    long = s.select(TF, F.col("feat_quid_pair_key").alias("quid_pair_clave"), F.explode(both).alias("c")).where("trim(c) <> ''").distinct()
    return long.groupBy(TF, "quid_pair_clave").agg(F.array_join(F.array_sort(F.collect_list("c")), ", ").alias("conceptos_par"))


def q3_enriched(s: DataFrame, **how: float) -> DataFrame:
    """Pairs of Q3 with counts, amounts, relations, concepts and the best example of all their transfers; what a pair already has stays where there is nothing new.

    Pairs meet by both persons whatever the direction (Q-11). The best example has the highest score, then risk, then comes first.
    """
    best = F.struct(-F.col("feat_quid_score"), -F.col("risk_score"), F.unix_micros("fecha_hora_ts"), "tx_id")
    more = s.groupBy(TF, F.col("feat_quid_pair_key").alias("quid_pair_clave")).agg(
        F.count_if("feat_quid_has_approval").alias("quid_aprob_count"),
        F.count_if("feat_quid_has_comp").alias("quid_comp_count"),
        F.max(AMOUNT).alias("quid_tx_amount_max"),
        mean("risk_score").alias("quid_tx_risk_avg"),
        F.array_join(F.array_distinct(F.array_sort(F.concat(F.collect_set("relacion"), F.collect_set("feat_quid_rel_label")))), ", ").alias("quid_tx_relaciones"),
        F.min_by(F.struct("tx_id", "fecha_hora_ts", AMOUNT, "feat_quid_score", "risk_score", "relacion", "feat_quid_rel_label", "feat_quid_value_vs_load_days", "feat_quid_has_approval", "feat_quid_has_comp", "descripcion"), best).alias("b"),
    )
    names = {"tx_id": "quid_top_tx_id", AMOUNT: "quid_top_tx_monto", "feat_quid_score": "quid_top_tx_score", "descripcion": "quid_top_tx_descripcion"}
    new = {"quid_top_tx_fecha": "fecha_hora_ts", "quid_top_tx_relacion": "relacion", "quid_top_tx_rel_label": "feat_quid_rel_label", "quid_top_tx_aprob": "feat_quid_has_approval", "quid_top_tx_comp": "feat_quid_has_comp"}
    out = q3(s, **how).join(more, [TF, "quid_pair_clave"], "left").join(pair_concepts(s), [TF, "quid_pair_clave"], "left")
    out = out.withColumns({old: F.coalesce(F.col(f"b.{c}"), F.col(old)) for c, old in names.items()}).withColumns({k: F.col(f"b.{c}") for k, c in new.items()})
    return out.withColumns({"quid_top_tx_risk": F.round("b.risk_score", 6), "quid_top_tx_value_vs_load_days": F.round("b.feat_quid_value_vs_load_days", 6)}).drop("b")


def responsible() -> Column:
    """The manager where one is named by the relation, else the sender."""
    return F.coalesce(F.when(F.col("relacion") == "manager_del_emisor", F.col("receiver_id")), F.col("manager_1_user_id"), F.col("user_id"))


def q4(s: DataFrame, n: int = 10) -> DataFrame:
    """Transfers valued before they were loaded; without any, the n nearest to it."""
    days = F.col("feat_quid_value_vs_load_days")
    kept = relaxed(s, [days < 0, days.isNotNull(), F.lit(True)])
    strict = kept.where("nivel_relajado = 0")
    rest = top(kept.where("nivel_relajado > 0"), n, days.asc_nulls_last(), F.desc("feat_quid_score"), F.col("tx_id"))
    return strict.unionByName(rest).select(TF, "tx_id", "fecha_hora_ts", "user_id", "receiver_id", AMOUNT, "feat_quid_score", F.round(days, 6).alias("dias_valor_vs_carga"), responsible().alias("responsable"), "nivel_relajado", say("Fecha valor ", F.format_number(-days, 1), " días antes de la carga").alias("interpretabilidad"))


# Concepts that Q5 finds in a text that lists several.
FORCED_CONCEPTS = ["SOBORNO", "VIATICOS_LUJOSOS", "EXTORSION", "DONATIVO_CRUZADO", "FAVORES_SEXUALES", "REGALOS_LUJO"]


def in_order_of_use(rows: DataFrame, keys: list[str], value: Column, to: str) -> DataFrame:
    """The different texts of each key in order of first use, joined by ' | '. Texts are made distinct before they are gathered."""
    first = rows.groupBy(*keys, value.alias("t")).agg(F.min(F.struct("fecha_hora_ts", "tx_id")).alias("f"))
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "t"))), lambda x: x["t"]), " | ").alias(to))


def q5(s: DataFrame, min_senders: int = 2, forced: bool = False, include_raw_concept: bool = False, texts: bool = True) -> DataFrame:
    """One concept to one receiver from several senders, with the texts in order of first use.

    forced: concepts are read from nlp_concepto_sospechoso, which may list several of FORCED_CONCEPTS (P35), and months and mean risk
    are added; include_raw_concept: the cleaned texts are added; texts=False leaves the texts out, for readers of the rest.
    """
    concepts = F.col("nlp_categorias")
    if forced:
        listed = text.forced_concepts(F.col("nlp_concepto_sospechoso"), FORCED_CONCEPTS)
        named = F.when(F.size(listed) > 0, listed).otherwise(F.filter(F.array(F.trim("nlp_concepto_sospechoso")), lambda c: c != ""))
        # every different text is read once; written, so that Spark knows how few they are
        lists = cut(s.select("nlp_concepto_sospechoso").distinct().select(F.col("nlp_concepto_sospechoso").alias("_said"), named.alias("_listed")), "concepts")
        s = s.join(lists, F.col("nlp_concepto_sospechoso") == F.col("_said"), "left").drop("_said")
        concepts = F.col("_listed")
    keys = [TF, "receiver_id", "concepto"]
    rows = s.withColumn("concepto", F.explode(F.when(F.size(concepts) > 0, concepts)))
    more = [F.count_distinct("month_id").alias("meses_distintos"), F.array_join(F.array_sort(F.collect_set("month_id")), ", ").alias("meses_detalle"), mean("risk_score").alias("riesgo_promedio")] if forced else []
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("user_id")).alias("emisores"), F.count(F.lit(1)).alias("tx_count"), total().alias("monto_total"), F.round(F.percentile("risk_score", F.lit(0.95)), 6).alias("risk_p95"), *more)
    out = g.where(F.size("emisores") >= min_senders).dropna(subset=keys)
    if texts:
        out = out.join(in_order_of_use(rows, keys, F.coalesce("descripcion", F.lit("")), "textos"), keys)
    if include_raw_concept:
        out = out.join(in_order_of_use(rows, keys, text.clean_concept(F.col("descripcion")), "conceptos_crudos"), keys)
    said = say(F.size("emisores"), " personas pagaron a ", F.col("receiver_id"), " por ", F.col("concepto")).alias("interpretabilidad")
    added = (["meses_distintos", "meses_detalle", "riesgo_promedio"] if forced else []) + (["conceptos_crudos"] if include_raw_concept else [])
    return out.select(*keys, F.size("emisores").alias("emisores_unicos"), F.array_join("emisores", ", ").alias("emisores_lista"), "tx_count", "monto_total", "risk_p95", *(["textos"] if texts else []), *added, said)


def q6(s: DataFrame) -> DataFrame:
    """Receivers who centralise money by month, with what each has received up to that month."""
    run = Window.partitionBy(TF, "receiver_id").orderBy("month_id").rowsBetween(Window.unboundedPreceding, 0)
    g = qa.centralizers(s).withColumn("inflow_acumulado", F.round(F.sum("inflow").over(run), 3))
    return g.withColumn("interpretabilidad", say(F.col("receiver_id"), " recibió ", num("inflow"), " de ", F.col("emisores_unicos"), " personas en ", F.col("month_id")))


def q7(s: DataFrame) -> DataFrame:
    """Persons by net imbalance, with their extreme months."""
    p = reports.persons(s).select(TF, "persona", F.col("net").alias("desbalance_persona_monto_neto"))
    m = reports.person_imbalance(s).select(TF, "persona", F.col("meses_extremos_emisor").alias("desbalance_persona_meses_envia_extremo"), F.col("meses_extremos_receptor").alias("desbalance_persona_meses_recibe_extremo"))
    return p.join(m, [TF, "persona"], "left").withColumn("interpretabilidad", say(F.col("persona"), " tiene un neto de ", num("desbalance_persona_monto_neto")))


def tenure_limit(s: DataFrame, column: str, definition: tuple[str, float]) -> DataFrame:
    """A row per time frame with the limit in years: ('months', m), or ('percentile', p) of the column."""
    kind, x = definition
    if kind == "months":
        return s.groupBy(TF).agg(F.max(F.lit(x / 12.0)).alias("limite"))
    return quantile(s, [TF], column, float(x), "limite")


def q8(s: DataFrame, new: tuple[str, float] = ("months", 6)) -> DataFrame:
    """Newcomers who receive high amounts from several people; any who receive, if none is flagged."""
    limited = s.join(F.broadcast(tenure_limit(s, "receptor_antiguedad_anios", new)), TF)
    high = reports.case13(limited, new_limit="limite")
    senders = limited.where(F.col("receptor_antiguedad_anios") <= F.col("limite")).groupBy(TF, F.col("receiver_id").alias("persona")).agg(F.array_join(F.array_sort(F.collect_set("user_id")), ", ").alias("caso13_persona_emisores_lista"))
    kept = relaxed(high, [F.col("caso13_persona_flag_nuevo_receptor_altos_montos") > 0, F.lit(True)])
    return kept.join(senders, [TF, "persona"], "left").withColumn("interpretabilidad", say(F.col("persona"), " recibió ", num("caso13_persona_monto_total"), " de ", F.col("caso13_persona_emisores_unicos"), " personas"))


def q9(s: DataFrame, newcomer_months: float = 6, veteran_months: float = 60) -> DataFrame:
    """Veterans paid by newcomers: flagged, then any, then wider limits, then the quartiles of tenure."""
    new, old = newcomer_months / 12, veteran_months / 12
    young, aged = F.col("user_antiguedad_anios"), F.col("receptor_antiguedad_anios")
    quart = quantile(s, [TF], "user_antiguedad_anios", 0.25, "_q1").join(quantile(s, [TF], "receptor_antiguedad_anios", 0.75, "_q3"), TF)
    ranked = s.join(F.broadcast(quart), TF).withColumn("_tier", F.when((young <= new) & (aged >= old), 0).when((young <= 2 * new) & (aged >= 0.8 * old), 1).when((young <= 3 * new) & (aged >= 0.7 * old), 2).when((young <= F.col("_q1")) & (aged >= F.col("_q3")), 3))
    best = ranked.groupBy(TF).agg(F.min("_tier").alias("_best"))
    chosen = ranked.join(F.broadcast(best), TF).where(F.col("_tier") <= F.col("_best"))
    g = chosen.groupBy(TF, F.col("receiver_id").alias("persona")).agg(
        F.count(AMOUNT).alias("caso14_persona_tx_de_emisores_nuevos"),
        total().alias("caso14_persona_monto_de_emisores_nuevos"),
        F.count_distinct("user_id").alias("caso14_persona_emisores_nuevos_unicos"),
        mean(AMOUNT).alias("caso14_persona_monto_promedio_de_emisores_nuevos"),
        F.array_join(F.array_sort(F.collect_set("user_id")), ", ").alias("caso14_persona_emisores_nuevos_lista"),
        F.max("_tier").alias("limites_usados"),
    )
    flagged = (F.col("caso14_persona_emisores_nuevos_unicos") >= 3) & (F.col("caso14_persona_tx_de_emisores_nuevos") >= 5)
    return relaxed(g, [flagged, F.lit(True)]).withColumn("interpretabilidad", say(F.col("persona"), " recibió ", num("caso14_persona_monto_de_emisores_nuevos"), " de ", F.col("caso14_persona_emisores_nuevos_unicos"), " personas nuevas"))


def reverse_gap() -> Column:
    """Microseconds between a transfer and the one the other way in its pair: the latest earlier one, or the next transfer, if that goes the other way."""
    order = Window.partitionBy(TF, "par_bidir").orderBy("fecha_hora_ts", "tx_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    up = F.col("user_id") < F.col("receiver_id")
    us = F.unix_micros("fecha_hora_ts")
    back = us - F.when(up, F.last(F.when(~up, us), True).over(before)).otherwise(F.last(F.when(up, us), True).over(before))
    ahead = F.when(F.lead(up).over(order) != up, F.lead(us).over(order) - us)
    return F.least(back, ahead)


def q10(s: DataFrame, min_consecutive: int = 2, risk: float = 1.8) -> DataFrame:
    """Pairs with long runs of back-and-forth transfers; without flags, runs of transfers within 8, 24 or 72 hours of one the other way; without these, pairs that pay both ways."""
    keyed = s.where("user_id <> receiver_id").withColumn("par_bidir", F.concat_ws("⇄", F.least("user_id", "receiver_id"), F.greatest("user_id", "receiver_id")))
    whole = Window.partitionBy(TF, "par_bidir")
    gap = keyed.withColumn("_gap", reverse_gap()).withColumn("_both", F.min("user_id").over(whole) != F.max("user_id").over(whole))
    hours = lambda h: F.coalesce(F.col("_gap") <= h * 3_600_000_000, F.lit(False))
    levels = gap.withColumn("_lv", F.when(F.col("sig_yoyo"), 0).when(hours(8), 1).when(hours(24), 2).when(hours(72), 3).when(F.col("_both"), 4))
    best = levels.groupBy(TF).agg(F.min("_lv").alias("_best"))
    marked = levels.join(F.broadcast(best), TF).withColumn("_hit", F.coalesce(F.col("_lv") <= F.col("_best"), F.lit(False)))
    # Gaps and islands
    order = Window.partitionBy(TF, "par_bidir").orderBy("fecha_hora_ts", "tx_id")
    same = Window.partitionBy(TF, "par_bidir", "_hit").orderBy("fecha_hora_ts", "tx_id")
    runs = marked.withColumn("_island", F.row_number().over(order) - F.row_number().over(same))
    longest = runs.where("_hit").groupBy(TF, "par_bidir", "_island").agg(F.count(F.lit(1)).alias("n")).groupBy(TF, "par_bidir").agg(F.max("n").alias("racha_max_yo_yo"))
    hit = F.col("_hit")
    g = marked.groupBy(TF, "par_bidir").agg(
        F.count_if(hit).alias("tx_yo_yo_totales"),
        F.count_distinct(F.when(hit, F.col("month_id"))).alias("meses_con_yo_yo"),
        F.round(F.max("risk_score"), 6).alias("riesgo_max_par"),
        mean("risk_score").alias("riesgo_promedio_par"),
        F.round(F.max(F.when(hit, F.col("risk_score"))), 6).alias("riesgo_max_yo_yo"),
        F.round(F.avg(F.when(hit, F.col("risk_score"))), 6).alias("riesgo_promedio_yo_yo"),
        F.round(F.sum(F.when(hit, F.col(AMOUNT))), 4).alias("monto_total_yo_yo"),
        F.round(F.avg(F.when(hit, F.col(AMOUNT))), 8).alias("monto_promedio_yo_yo"),
        F.max("_best").alias("criterio"),
    )
    both = g.join(longest, [TF, "par_bidir"])
    kept = relaxed(both, [(F.col("racha_max_yo_yo") >= min_consecutive) & (F.col("riesgo_max_par") >= risk), F.col("racha_max_yo_yo") >= min_consecutive, F.lit(True)])
    return kept.withColumn("interpretabilidad", say(F.col("par_bidir"), ": ", F.col("racha_max_yo_yo"), " idas y vueltas seguidas"))


def by_month_then_pair(rows: DataFrame, per_month: dict[str, Column], per_pair: dict[str, Column]) -> DataFrame:
    """Two chained groupings, directed pair by month, then by pair."""
    m = rows.groupBy(TF, pair().alias("pair"), "month_id").agg(*[c.alias(k) for k, c in per_month.items()])
    return m.groupBy(TF, "pair").agg(*[c.alias(k) for k, c in per_pair.items()])


def q11(s: DataFrame, min_months: int = 3, delta: float = 10.0) -> DataFrame:
    """Amounts kept near the thresholds over several months; without any, the nearest 15 % (half, if these are all at a threshold)."""
    d = F.col("feat_delta_near_thr")
    least, middle = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    p15 = quantiles(s, [TF], "feat_delta_near_thr", [0.15, 0.5]).select(TF, F.when(least > 0, least).otherwise(middle).alias("_p15"))
    near = relaxed(s.join(F.broadcast(p15), TF), [F.col("sig_near_thr") & (d <= delta), d <= delta, d <= 2 * delta, d <= F.col("_p15")])
    g = by_month_then_pair(near, {"n": F.count(AMOUNT), "x": F.sum(AMOUNT), "d": F.avg("feat_delta_near_thr"), "r": F.max("risk_score"), "lv": F.max("nivel_relajado")}, {"meses_con_near": F.count(F.lit(1)), "tx_near_totales": F.sum("n"), "monto_total_near": F.round(F.sum("x"), 4), "delta_promedio": F.round(F.avg("d"), 6), "riesgo_max": F.round(F.max("r"), 6), "criterio": F.max("lv")})
    months = F.col("meses_con_near")
    kept = relaxed(g, [months >= k for k in range(min_months, 0, -1)])
    return kept.withColumn("interpretabilidad", say(F.col("pair"), " se mantuvo cerca de un umbral en ", months, " meses"))


def q12_order() -> list[Column]:
    return [F.desc("monto_fraccionado_total"), F.desc("transacciones_fraccionadas"), F.desc("meses_con_fraccionamiento"), F.col("pair")]


def q12(s: DataFrame, min_months: int | None = None, top_n: int = 25) -> DataFrame:
    """Split payments by pair with the trend of their risk; without flags, the amounts in the lowest quarter of each pair.

    Every pair that passes; top_n holds only where none has min_months.
    """
    quarter = quantile(s.withColumn("_p", pair()), [TF, "_p"], AMOUNT, 0.25, "_q")
    half = quantile(s, [TF], AMOUNT, 0.5, "_half")  # a row per time frame
    rows = s.withColumn("_p", pair()).join(quarter, [TF, "_p"]).join(F.broadcast(half), TF)
    found = relaxed(rows, [F.col("sig_smurf"), F.col(AMOUNT) <= F.coalesce("_q", "_half")]).drop("_half")
    trend = F.max_by("r", "month_id") - F.min_by("r", "month_id")
    g = by_month_then_pair(found, {"n": F.count(AMOUNT), "x": F.sum(AMOUNT), "r": F.avg("risk_score"), "rm": F.max("risk_score")}, {"meses_con_fraccionamiento": F.count(F.lit(1)), "transacciones_fraccionadas": F.sum("n"), "monto_fraccionado_total": F.round(F.sum("x"), 4), "riesgo_promedio": F.round(F.avg("r"), 6), "riesgo_maximo": F.round(F.max("rm"), 6), "_t": F.round(trend, 6)})
    g = g.withColumn("tendencia_riesgo", F.when(F.col("_t") > 0.05, "al alza").when(F.col("_t") < -0.05, "a la baja").otherwise("estable")).drop("_t")
    if min_months:
        kept = relaxed(g, [F.col("meses_con_fraccionamiento") >= min_months, F.lit(True)])
        g = kept.where("nivel_relajado = 0").unionByName(top(kept.where("nivel_relajado = 1"), top_n, *q12_order()))
    return g.withColumn("interpretabilidad", say(F.col("pair"), " fraccionó ", num("monto_fraccionado_total"), ", riesgo ", F.col("tendencia_riesgo")))


def estimated_loans(s: DataFrame) -> DataFrame:
    """Q13 without loan flags: in each month of two persons, the larger direction counts as the loan and the other as its return.

    A row per time frame, directed pair and month, at level 2 (many transfers: the upper quarter, three at least; half or less came
    back), 3 (the upper 40 %, two at least) or 4 (the 50 busiest months); of the levels that a time frame has, the lowest is kept.
    """
    ways = s.groupBy(TF, F.least("user_id", "receiver_id").alias("lo"), F.greatest("user_id", "receiver_id").alias("hi"), "month_id", "user_id", "receiver_id").agg(F.sum(AMOUNT).alias("x"), F.count(F.lit(1)).alias("n"), F.max("risk_score").alias("r"), F.sum("risk_score").alias("rs"))
    larger = F.min_by(F.struct("user_id", "receiver_id", "x", "n"), F.struct(-F.col("x"), "user_id")).alias("loan")
    m = ways.groupBy(TF, "lo", "hi", "month_id").agg(larger, F.sum("x").alias("all_x"), F.sum("n").alias("f"), F.max("r").alias("r"), (F.sum("rs") / F.sum("n")).alias("ra"))
    back = F.when(F.col("lo") == F.col("hi"), F.col("loan.x")).otherwise(F.col("all_x") - F.col("loan.x"))
    m = m.select(TF, F.concat_ws("→", "loan.user_id", "loan.receiver_id").alias("pair"), "month_id", F.col("loan.n").alias("l"), F.greatest(F.col("loan.x") - back, F.lit(0.0)).alias("x"), "f", "r", "ra", F.coalesce(F.try_divide(back, F.col("loan.x")), F.lit(0.0)).alias("ratio"))
    cuts = quantiles(m, [TF], "f", [0.75, 0.6]).drop("n")
    m = m.join(F.broadcast(cuts), TF)
    owed = F.col("ratio") <= 0.5
    level = F.when(owed & (F.col("f") >= F.greatest(F.get("q", F.lit(0)), F.lit(3))), 2).when(owed & (F.col("f") >= F.greatest(F.get("q", F.lit(1)), F.lit(2))), 3)
    busiest = top(m, 50, F.desc("f"), F.desc(F.round("x", 4)), F.col("pair"), F.col("month_id"))
    every = m.withColumn("criterio", level).where("criterio is not null").unionByName(busiest.withColumn("criterio", F.lit(4)))
    best = every.groupBy(TF).agg(F.min("criterio").alias("_best"))
    return every.join(F.broadcast(best), TF).where("criterio = _best").drop("q", "ratio", "_best")


def q13(s: DataFrame, min_months: int = 2, top_n: int = 25) -> DataFrame:
    """Loans that do not come back, and many transfers, in the same months of a pair.

    criterio 0: in the same months; 1: in different months of a pair; 2 to 4: no loan is flagged, see estimated_loans.
    Then pairs with min_months, else with a month less, else the first top_n.
    """
    bad, often = F.col("sig_loan_bad_repay"), F.col("sig_freq")
    m = s.groupBy(TF, pair().alias("pair"), "month_id").agg(F.count_if(bad).alias("l"), F.sum(F.when(bad, F.col(AMOUNT))).alias("x"), F.count_if(often).alias("f"), F.max("risk_score").alias("r"), F.avg("risk_score").alias("ra"))
    sums = [F.sum("l").alias("prestamos_incumplidos"), F.round(F.coalesce(F.sum("x"), F.lit(0.0)), 4).alias("monto_prestamos_incumplidos"), F.sum("f").alias("eventos_alta_frecuencia"), F.round(F.max("r"), 6).alias("riesgo_max"), F.round(F.avg("ra"), 6).alias("riesgo_promedio")]
    together = m.where("l > 0 and f > 0").groupBy(TF, "pair").agg(F.count(F.lit(1)).alias("meses_con_coincidencia"), *sums).withColumn("criterio", F.lit(0))
    apart = m.groupBy(TF, "pair").agg(F.least(F.count_if(F.col("l") > 0), F.count_if(F.col("f") > 0)).alias("meses_con_coincidencia"), *sums).where("meses_con_coincidencia > 0").withColumn("criterio", F.lit(1))
    flagged = m.groupBy(TF).agg(F.sum("l").alias("_flagged")).where("_flagged > 0").select(TF)  # a row per time frame
    estimated = estimated_loans(s.join(F.broadcast(flagged), TF, "left_anti")).groupBy(TF, "pair").agg(F.count(F.lit(1)).alias("meses_con_coincidencia"), *sums, F.max("criterio").alias("criterio"))
    every = together.unionByName(apart).unionByName(estimated)
    best = every.groupBy(TF).agg(F.min("criterio").alias("_best"))
    months = F.col("meses_con_coincidencia")
    kept = relaxed(every.join(F.broadcast(best), TF).where("criterio = _best").drop("_best"), [months >= min_months, months >= max(min_months - 1, 1), F.lit(True)])
    last = top(kept.where("nivel_relajado = 2"), top_n, F.desc("meses_con_coincidencia"), F.desc("monto_prestamos_incumplidos"), F.desc("eventos_alta_frecuencia"), F.col("pair"))
    kept = kept.where("nivel_relajado < 2").unionByName(last)
    return kept.withColumn("interpretabilidad", say(F.col("pair"), ": ", F.col("prestamos_incumplidos"), " préstamos sin retorno en ", F.col("meses_con_coincidencia"), " meses"))


def q14_order() -> list[Column]:
    return [F.desc("meses_recurrentes"), F.desc("monto_total"), F.col("emisor"), F.col("receptor"), F.col("dia_corte")]


def q14(s: DataFrame, min_months: int = 3, top_n: int = 25) -> DataFrame:
    """Payments that recur on the same day of the month: all with min_months, else with a month less, else the first top_n."""
    g = s.groupBy(TF, F.col("user_id").alias("emisor"), F.col("receiver_id").alias("receptor"), F.dayofmonth("fecha_hora_ts").alias("dia_corte")).agg(F.count_distinct("month_id").alias("meses_recurrentes"), F.count(AMOUNT).alias("tx_totales"), total().alias("monto_total"), mean(AMOUNT).alias("monto_promedio"))
    months = F.col("meses_recurrentes")
    kept = relaxed(g, [months >= min_months, months >= max(min_months - 1, 1), F.lit(True)])
    kept = kept.where("nivel_relajado < 2").unionByName(top(kept.where("nivel_relajado = 2"), top_n, *q14_order()))
    return kept.withColumn("interpretabilidad", say(F.col("emisor"), " paga a ", F.col("receptor"), " el día ", F.col("dia_corte"), " en ", F.col("meses_recurrentes"), " meses"))


SIGNALS5 = ("yo_yo_cluster_tasa_flag", "smurf_cluster_tasa_flag", "frecuencia_cluster_tasa_flag", "recurrente_cluster_tasa_flag", "prestamo_cluster_tasa_repay_insuficiente")


def q15(s: DataFrame, top_n: int = 10) -> DataFrame:
    """Clusters of each time frame with several coordinated signals."""
    c = reports.clusters(s)
    n = sum([(F.col(k) > 0).cast("int") for k in SIGNALS5], F.lit(0))
    c = c.withColumn("senales_activas", n)
    return top(c, top_n, F.desc("senales_activas"), F.desc("riesgo_cluster_maximo"), F.col("cluster_id")).withColumn("interpretabilidad", say(F.col("cluster_id"), ": ", F.col("senales_activas"), " señales en ", F.col("cluster_personas_total"), " personas"))


SIGNALS6 = ("sig_smurf", "sig_yoyo", "sig_loan_bad_repay", "sig_freq", "sig_near_thr", "sig_roundsum")


def q16(s: DataFrame, top_n: int = 25) -> DataFrame:
    """Transfers with three or more of six signals; fewer, if none has three."""
    n = sum([F.coalesce(F.col(c), F.lit(False)).cast("int") for c in SIGNALS6], F.lit(0))
    kept = relaxed(s.withColumn("senales", n), [F.col("senales") >= 3, F.col("senales") >= 2, F.col("senales") >= 1, F.lit(True)])
    kept = top(kept, top_n, F.desc("senales"), F.desc("risk_score"), F.col("tx_id"))
    named = F.array_join(F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in SIGNALS6]), lambda x: x.isNotNull()), ", ")
    return kept.select(TF, "tx_id", "user_id", "receiver_id", AMOUNT, F.round("risk_score", 6).alias("risk_score"), "risk_tier", "senales", "nivel_relajado", say(F.col("senales"), " señales: ", named).alias("interpretabilidad"))


def q17(s: DataFrame, top_n: int = 15) -> DataFrame:
    """Persons by their texts: share of suspicious ones, mood and main concepts."""
    p = reports.persons(s)
    tops = reports.top_concepts(reports.suspicious(s).withColumn("persona", F.col("user_id")), [TF, "persona"]).select(TF, "persona", F.array_join("top_conceptos", ", ").alias("conceptos_principales"))
    mood = F.col("nlp_sentimiento_promedio")
    out = p.select(
        TF,
        "persona",
        "movements",
        F.col("nlp_persona_total_transacciones_sospechosas").alias("tx_sospechosas_nlp"),
        F.col("nlp_persona_conceptos_sospechosos_unicos").alias("conceptos_unicos"),
        F.round(F.col("nlp_persona_total_transacciones_sospechosas") / F.greatest("n_tx_emit", F.lit(1)), 9).alias("proporcion_sospechosa"),
        F.col("nlp_score_max").alias("score_probable_coi"),
        mood.alias("sentimiento_promedio"),
        F.when(mood > 0.2, "positivo").when(mood < -0.2, "negativo").otherwise("neutral").alias("sentimiento_etiqueta"),
        "risk_avg_person",
        "sum_emit",
        "sum_recv",
        F.col("net").alias("net_flow"),
    ).join(tops, [TF, "persona"], "left")
    kept = top(out, top_n, F.desc("tx_sospechosas_nlp"), F.desc("score_probable_coi"), F.col("persona"))
    return kept.withColumn("interpretabilidad", say(F.col("persona"), ": ", F.col("tx_sospechosas_nlp"), " textos sospechosos"))


QUESTIONS: dict[str, Callable[[DataFrame], DataFrame]] = {f"q{i}": f for i, f in enumerate((q1, q2, q3, q4, q5, q6, q7, q8, q9, q10, q11, q12, q13, q14, q15, q16, q17), 1)}


def overview(s: DataFrame) -> DataFrame:
    """M1: rows and time frames of every question, in one table. Texts are not put together to be counted."""
    counted = QUESTIONS | {"q5": lambda s: q5(s, texts=False)}
    parts = [f(s).groupBy().agg(F.count(F.lit(1)).alias("filas"), F.count_distinct(TF).alias("marcos")).withColumn("pregunta", F.lit(k)) for k, f in counted.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("pregunta", "filas", "marcos")


def digest(s: DataFrame, n: int = 3) -> DataFrame:
    """M1: the first n explanations of every question."""
    said = QUESTIONS | {"q5": lambda s: q5(s, texts=False)}
    parts = [f(s).select(F.lit(k).alias("pregunta"), "interpretabilidad").orderBy("interpretabilidad").limit(n) for k, f in said.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def pair_month_pivot(s: DataFrame, months: list[str], frame: str = "todo_el_tiempo") -> DataFrame:
    """Transfers per directed pair and month, a column per month given."""
    return s.where(F.col(TF) == frame).groupBy(pair().alias("pair")).pivot("month_id", months).agg(F.count(F.lit(1))).fillna(0)


def pair_month_counts(s: DataFrame, frame: str = "todo_el_tiempo") -> DataFrame:
    """Transfers per directed pair and month, a row for every month of the pair, so no list of months is needed."""
    return s.where(F.col(TF) == frame).groupBy(pair().alias("pair"), "month_id").agg(F.count(F.lit(1)).alias("n"))


def yoyo_timeline(s: DataFrame, n: int = 10, frame: str = "todo_el_tiempo") -> DataFrame:
    """K5, M2: monthly share of back-and-forth transfers of the n pairs with the highest mean share."""
    t = s.where(F.col(TF) == frame)
    m = t.groupBy(pair().alias("pair"), "month_id").agg(reports.rate("sig_yoyo").alias("pct_yoyo"))
    best = m.groupBy("pair").agg(F.avg("pct_yoyo").alias("m")).orderBy(F.desc(F.round("m", 9)), "pair").limit(n)
    return m.join(F.broadcast(best.select("pair")), "pair", "left_semi")


def top_summary(report: DataFrame, key: str, score: str, n: int = 10) -> DataFrame:
    """K6: the first n rows of a report per time frame by a score."""
    return top(report, n, F.desc(score), F.col(key))

