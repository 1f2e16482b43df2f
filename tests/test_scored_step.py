"""The step that reports share: what it finds, and how often wide rows cross the network for it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyscope.checkpoints import cut
from tallyscope.functions import text
from tallyscope.operators import groups, intervals
from tallyscope.plans import pipeline, reports

TX = "tx_id string, user_id string, receiver_id string, ts string, movement_amount double, descripcion string, reference_number_trans_desc string, companeros_de_equipo array<string>"


def given(spark, rows):
    tx = spark.createDataFrame(rows, TX).withColumn("fecha_hora_ts", F.col("ts").cast("timestamp")).drop("ts")
    more = {"month_id": F.date_format("fecha_hora_ts", "yyyy-MM"), "load_date": F.col("fecha_hora_ts"), "movement_value_date": F.col("fecha_hora_ts"), "relacion": F.lit("otro"), "origin_application_id": F.lit("app"), "manager_1_user_id": F.lit(None).cast("string")}
    return cut(tx.withColumns(more).withColumn(pipeline.ROW, F.monotonically_increasing_id()), "given")


def dealt(n, seed=0):
    """Transfers among few, some of nobody, some without a time."""
    rnd = random.Random(seed)
    people = ["A", "B", "C", None]
    texts = ["abono 25", "prestam urgente", "mordida para firma", "", None]
    row = lambda i: (f"t{rnd.randrange(n)}", rnd.choice(people), rnd.choice(people), rnd.choice([None, *[f"2024-{rnd.randrange(1, 9):02d}-{rnd.randrange(1, 4):02d} 0{rnd.randrange(9)}:00:00"] * 20]), rnd.choice([4000.0, 6000.0, 6050.0, 12000.0]), rnd.choice(texts), None, ["x"])
    return [row(i) for i in range(n)]


def test_searches_equal_their_patterns(spark):
    rnd = random.Random(1)
    parts = ["autoriza", "aprob", "firma", "liber", "palome", "oc", "po", "ocx", "orden de compra", "licitacion", "licitación", "contrato", "alta proveedor", "agradec", "detalle", "incentiv", "bono", "regalo", "mordida", "moche", "coima", "chayote", "por fuera", "sin factura", "sin cfdi", "no timbrar", "off the record", "favor sexual", "salida íntima", "salida intima", "cita privada", "trato especial"]
    pieces = [*parts, *[p[:-1] for p in parts], *[p[1:] for p in parts], " ", " | ", "x", "7", "_"]
    rows = [(p,) for p in parts] + [("".join(rnd.choice(pieces) for _ in range(rnd.randrange(5))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t string").select("t", text.joined_text([F.col("t")]).alias("norm"))
    c = F.col("norm")
    assert df.where((c.rlike(text.APPROVAL) != c.rlike(text.APPROVAL_LOWER)) | (c.rlike(text.COMPENSATION) != c.rlike(text.COMPENSATION_LOWER))).count() == 0
    assert df.where(c.rlike(text.APPROVAL)).count() > 500 < df.where(c.rlike(text.COMPENSATION)).count()


@pytest.mark.parametrize("seed", range(2))
def test_signals_of_nobody_and_of_shared_ids(spark, seed):
    """What the shared exchanges find equals each signal's own operator, row by row, with nulls and repeated ids."""
    tx = given(spark, dealt(400, seed))
    got = {r[pipeline.ROW]: r for r in pipeline.add_signals(tx).collect()}
    assert len(got) == tx.count()
    alone = {"sig_freq": groups.frequency(tx), "sig_smurf": groups.smurfing(tx), "sig_recurrent": groups.recurrent_day(tx)}
    for flag, df in alone.items():
        want = {r[pipeline.ROW]: r[flag] for r in df.select(pipeline.ROW, flag).collect()}
        assert {k: r[flag] for k, r in got.items()} == want, flag
        assert 0 < sum(map(bool, want.values())) < len(want)
    loans = intervals.repay_ratio(tx.join(intervals.paid_back(tx, pipeline.ROW), pipeline.ROW, "left"))
    assert {k: (r["feat_repay_ratio"], r["sig_loan_bad_repay"]) for k, r in got.items()} == {r[pipeline.ROW]: (r["feat_repay_ratio"], r["sig_loan_bad_repay"]) for r in loans.collect()}
    names = ["feat_pair_month_amount_ratio", "feat_pair_month_count_ratio", "feat_pair_months_since_prev", "sig_pair_change_point", "sig_pair_new_edge"]
    changes = {r[pipeline.ROW]: tuple(r[c] for c in names) for r in groups.change_points(tx).collect()}
    assert {k: tuple(r[c] for c in names) for k, r in got.items()} == changes


def exchanges(df, column):
    """Exchanges whose rows hold a column."""
    plan = df._jdf.queryExecution().executedPlan()
    seen, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.inputPlan())
            continue
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            seen += bool(re.search(rf"\b{column}#", node.output().toString()))
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return seen


def test_wide_rows_cross_the_network_once_for_pairs(spark):
    """Small tables are broadcast; nothing else that pairs need moves the wide rows a second time."""
    assert exchanges(pipeline.add_signals(given(spark, dealt(50))), "companeros_de_equipo") == 1


def test_tiers_move_no_rows(spark):
    """Ranks and bursts are left to their readers; a tier is found where a transfer lies."""
    scored = pipeline.scored(spark, "/root/testdata/sf0.001")
    assert "risk_score_norm" not in scored.columns and "rafaga_canal_tx_en_bin" not in scored.columns
    assert exchanges(scored.select("tx_id", "risk_tier", "interp_tx"), "tx_id") == 0
    events = pipeline.scored_with_events(spark, "/root/testdata/sf0.001")
    bins = groups.burst_bins(pipeline.ingested(spark, "/root/testdata/sf0.001"))
    assert events.where("rafaga_canal_flag_evento").groupBy().sum().columns and events.count() == scored.count()
    assert events.where("rafaga_canal_flag_evento").count() == (bins.where("rafaga_canal_flag_evento").agg(F.sum("rafaga_canal_tx_en_bin")).first()[0] or 0)


def test_scored_transfers_have_every_column(spark):
    tx = given(spark, dealt(60)).drop(pipeline.ROW).where("user_id is not null and receiver_id is not null and fecha_hora_ts is not null")
    scored = pipeline.score_transfers(tx)
    assert {"risk_score_norm", "risk_tier", "interp_tx", "rafaga_canal_tx_en_bin", "rafaga_canal_monto_total", "rafaga_canal_flag_evento", "feat_quid_desc_norm"} <= set(scored.columns)
    assert "monto_total" in reports.bursts(reports.sliced(scored)).columns and scored.count() == tx.count()


def test_texts_that_are_not_read_are_not_put_together(spark):
    from tallyscope.plans import questions

    rows = [(f"t{i}", f"A{i % 3}", r, "2024-01-05 10:00:00", 10.0 + i, "mordida", None, ["x"]) for i in range(9) for r in ("B", "C", None)]
    s = given(spark, rows).withColumns({reports.TF: F.lit("todo_el_tiempo"), "nlp_categorias": F.array(F.lit("SOBORNO")), "nlp_concepto_sospechoso": F.lit("SOBORNO"), "risk_score": F.col("movement_amount")})
    for forced in (False, True):
        whole, rest = questions.q5(s, forced=forced), questions.q5(s, forced=forced, texts=False)
        assert sorted(map(tuple, whole.drop("textos").collect())) == sorted(map(tuple, rest.collect())) and rest.count() == 2
        joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
        # the concepts that a text lists are joined to it
        assert joins(rest) == int(forced) < joins(whole)
