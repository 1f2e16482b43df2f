"""Queries over the whole input, against DuckDB and by hand."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyscope import queries
from tallyscope.operators import groups
from tallyscope.plans import person_risk, pipeline, questions

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def equal_to_sql(spark, con, name):
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    plain = lambda row: tuple(round(v, 5) if isinstance(v, float) else v for v in row)
    got = Counter(plain(r) for r in df.select(columns).collect())
    assert got == Counter(map(plain, want.fetchall()))
    return got


@pytest.mark.parametrize("name", ["triangles_whole", "cycles_whole", "components_whole", "pair_months_all", "q5_textos", "payment_details"])
def test_whole_query_equals_sql(spark, con, name):
    print(name, sum(equal_to_sql(spark, con, name).values()))


def test_every_order_and_month_counts(spark, con):
    edges = con.execute("select count(distinct (o_custkey, l_partkey * 7 % (select count(*) from customer))) from lineitem join orders on l_orderkey = o_orderkey").fetchone()[0]
    assert queries.whole_edges(spark, SF).count() == edges
    months = {r["month_id"] for r in queries.QUERIES["pair_months_all"](spark, SF).select("month_id").distinct().collect()}
    assert len(months) > 12


@pytest.mark.parametrize("name", ["q12", "q12_all", "q14", "q14_all"])
def test_audit_question_equals_sql(spark, con, name):
    rows = equal_to_sql(spark, con, name)
    print(name, sum(rows.values()))


def test_all_passing_pairs_count(spark):
    """More passing pairs than the old caps; a frame without any falls back to the first ones."""
    rows = [(f"t{i}-{m}", f"A{i}", f"B{i}", f"2024-0{m}-05 10:00:00", 100.0 + i) for i in range(60) for m in (1, 2, 3)]
    s = spark.createDataFrame(rows, "tx_id string, user_id string, receiver_id string, ts string, movement_amount double")
    s = s.withColumn("fecha_hora_ts", F.col("ts").cast("timestamp")).withColumn("month_id", F.substring("ts", 1, 7)).withColumns({"timeframe_periodo": F.lit("todo_el_tiempo"), "risk_score": F.lit(1.0), "sig_smurf": F.lit(True)})
    assert questions.q12(s).count() == 60
    assert questions.q12(s, min_months=3).count() == 60
    assert questions.q12(s, min_months=4).count() == 25
    assert questions.q14(s).count() == 60
    assert questions.q14(s.where("month_id < '2024-03'")).count() == 60
    assert questions.q14(s.where("month_id < '2024-02'")).count() == 25


def test_smurfing_beyond_1024_ties(spark):
    """1,500 transfers at one time: the row of exactly seven days before counts for all of them."""
    rows = [("a", "2024-01-01 00:00:00", 9000.0)] + [(f"b{i:04d}", "2024-01-08 00:00:00", 0.5) for i in range(1499)] + [("c", "2024-01-08 00:00:00", 300.0)]
    tx = spark.createDataFrame(rows, "tx_id string, ts string, movement_amount double").withColumns({"user_id": F.lit("A"), "receiver_id": F.lit("B"), "fecha_hora_ts": F.col("ts").cast("timestamp")})
    assert groups.smurfing(tx).where("sig_smurf").count() == 1501
    assert groups.smurfing(tx.where("tx_id <> 'c'")).where("sig_smurf").count() == 0


@pytest.mark.parametrize("name", ["case12", "case13", "case14", "cluster_members", "pair_months_all", "pair_month_pivot", "payment_details", "payment_profile", "person_imbalance_months", "q8", "q9", "q14", "q14_all"])
def test_reports_without_signals_score_nothing(spark, monkeypatch, name):
    def scored(*_):
        raise AssertionError("transfers are scored for a report that reads no score")

    monkeypatch.setattr(pipeline, "score_transfers", scored)
    monkeypatch.setattr(pipeline, "_kept", {})
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns


def test_payments_of_nobody_and_without_a_month_keep_their_rows(spark):
    rows = [("A", "2024-01", "2024-01-05 10:00:00", 10.0), ("A", "2024-01", "2024-01-05 10:00:00", 10.0), (None, "2024-01", "2024-01-07 10:00:00", 5.0), ("A", None, None, 3.0), ("A", "2024-02", "2024-02-01 00:00:00", None)]
    s = spark.createDataFrame(rows, "user_id string, month_id string, ts string, movement_amount double").withColumns({"fecha_hora_ts": F.col("ts").cast("timestamp"), "timeframe_periodo": F.lit("todo_el_tiempo")})
    got = Counter((r["persona"], r["mes"], r["monto_total"], r["dia_pago_promedio"], r["monto"]) for r in person_risk.payment_rows(s).collect())
    assert got == Counter([("A", "2024-01", 20.0, 5.0, 10.0)] * 2 + [(None, "2024-01", 5.0, 7.0, 5.0), ("A", None, 3.0, None, 3.0), ("A", "2024-02", None, 1.0, None)])
    assert "collect" not in person_risk.payment_rows(s)._jdf.queryExecution().optimizedPlan().toString()
