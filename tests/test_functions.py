"""Column functions on hand-made values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyscope.functions import text, values
from tallyscope.sources import sinks, transfers


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_texts(spark):
    lit = F.lit
    got = one(spark, text.normalize(lit("  ÁRBOL  Ñandú ")), text.clean_concept(lit("BNET pago N123 extra")), text.clean_concept(lit("BNET")), text.canonical_concept(lit("Pago-Extra, año")), text.first_non_empty(lit(" "), lit("NaN"), lit("x")), text.normalize_reference(lit("abc"), 4), text.normalize_reference(lit("Abcd"), 4))
    assert tuple(got) == ("arbol nandu", "pago extra", "BNET", "pago extra ano", "x", "", "abcd")
    assert one(spark, text.split_list(lit("a, b;c|d_e  f")))[0] == list("abcdef")
    assert one(spark, text.split_pair(lit("P1⇄P2")))[0] == ["P1", "P2"]
    assert one(spark, text.forced_concepts(lit("['soborno'; favores sexuales]"), ["SOBORNO", "FAVORES_SEXUALES"]))[0] == ["SOBORNO", "FAVORES_SEXUALES"]
    assert tuple(one(spark, text.to_bool(lit("Sí")), text.to_bool(lit("0")), text.to_bool(lit(None)))) == (True, False, False)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("8 Trp redondeo de tarjeta1234 K82", ("Trp redondeo de tarjeta", 8, "1234", None, None, "K82")),
        ("BNET 299XXX4746 pago renta 202509XXX H09", ("BNET", None, "299XXX4746", "202509XXX", "pago renta", "H09")),
        ("solo texto", ("solo texto", None, None, None, None, None)),
        (None, (None,) * 6),
    ],
)
def test_description(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "d string")
    parts = text.parse_description(F.col("d"))
    assert tuple(df.select(*[parts[k] for k in ("service", "count", "id1", "id2", "detail", "code")]).first()) == want


def test_times(spark):
    got = one(spark, *[text.parse_time(F.lit(x)) for x in ("2024-01-05 10:00:00", "05/01/2024 03:04:05 p. m.", "05/01/2024", "nonsense", " ")])
    assert tuple(got) == (dt.datetime(2024, 1, 5, 10), dt.datetime(2024, 1, 5, 15, 4, 5), dt.datetime(2024, 1, 5), None, None)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2024-01-01 10:00:00.123", dt.datetime(2024, 1, 1, 10, 0, 0, 123000)),
        ("2024-01-01T10:00:00Z", dt.datetime(2024, 1, 1, 10)),
        ("2024-01-01T10:00:00.5", dt.datetime(2024, 1, 1, 10, 0, 0, 500000)),
        ("2024-01-01T10:00:00+02:00", dt.datetime(2024, 1, 1, 8)),
        ("2024-01-01T10:00", dt.datetime(2024, 1, 1, 10)),
        ("2024-01-01 10:00", dt.datetime(2024, 1, 1, 10)),
        ("2024-01-01", dt.datetime(2024, 1, 1)),
        ("2024-1-5", dt.datetime(2024, 1, 5)),
        ("01/02/2024 10:00 a. m.", dt.datetime(2024, 2, 1, 10)),
        ("01/02/2024 10:00:05 PM", dt.datetime(2024, 2, 1, 22, 0, 5)),
        ("1/2/2024 09:05", dt.datetime(2024, 2, 1, 9, 5)),
        ("01-02-2024", dt.datetime(2024, 2, 1)),
        ("31/12/2023 23:59:59.25", dt.datetime(2023, 12, 31, 23, 59, 59, 250000)),
        ("2024/3/4 5:06", dt.datetime(2024, 3, 4, 5, 6)),
        ("10:00:00", None),
        ("32/01/2024", None),
        ("2024-13-01", None),
        (None, None),
    ],
)
def test_time_layouts(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.parse_time(F.col("t"))).first()[0] == want


def test_rejected_rows_are_listed(spark):
    columns = ["user_id", "receptor-user_id", "movement_amount", "load_date", "transaction_desc"]
    rows = [("a", "b", "10", "2024-01-01 10:00:00.123", "x"), ("a", "b", "ten", "2024-01-01", "x"), ("a", "b", "5", "soon", "x"), ("a", "b", None, " ", "x")]
    raw = spark.createDataFrame(rows, columns)
    assert transfers.ingest(raw).count() == 1
    assert [r["reason"] for r in transfers.rejected(raw).collect()] == ["movement_amount cannot be read", "load_date cannot be read", "movement_amount is empty, load_date is empty"]


def test_values(spark):
    lit = F.lit
    ts = lambda s: F.to_timestamp(lit(s))
    assert one(spark, values.tenure_years(ts("2024-01-02"), ts("2020-01-01")))[0] == pytest.approx(4.0)
    assert [one(spark, values.is_round(lit(x), (10, 50)))[0] for x in (20.0, 25.0, 0.0)] == [True, False, True]
    near = one(spark, values.nearest_threshold(lit(17010.0), (17000.0, 85000.0)))[0]
    assert (near["distance"], near["threshold"]) == (10.0, 17000.0)
    rel = lambda s, r, m, t: one(spark, values.relation(lit(s), lit(r).cast("string"), [lit(m)], F.array(*[lit(x) for x in t])))[0]
    assert [rel("a", None, "b", ["c"]), rel("a", "a", "a", ["a"]), rel("a", "b", "b", ["b"]), rel("a", "c", "b", ["c"]), rel("a", "d", "b", ["c"])] == ["sin_dato", "mismo_usuario", "manager_del_emisor", "companero_equipo", "otro"]
    years = {2019: (4, 21), 2024: (3, 31), 2025: (4, 20), 2000: (4, 23)}
    for y, (m, d) in years.items():
        assert one(spark, values.easter(lit(y)))[0] == dt.date(y, m, d)
    assert one(spark, values.nth_monday(lit(2024), 2, 1), values.nth_monday(lit(2024), 3, 3), values.nth_monday(lit(2027), 2, 1))[:] == (dt.date(2024, 2, 5), dt.date(2024, 3, 18), dt.date(2027, 2, 1))


def test_ingest_and_sinks(spark, tmp_path):
    rows = [("a", "b", "100.5", "2024-01-05 10:00:00", "BNET pago", "b"), ("a", "c", "bad", "2024-01-05 10:00:00", "x", None), ("a", "c", "1", "never", "x", None)]
    raw = spark.createDataFrame(rows, "user_id string, `receptor-user_id` string, movement_amount string, load_date string, transaction_desc string, manager_1_user_id string")
    raw.write.option("header", True).csv(f"{tmp_path}/raw")
    got = transfers.ingest(transfers.read_csv(spark, f"{tmp_path}/raw")).collect()
    assert [(r["receiver_id"], r["movement_amount"], r["relacion"], r["month_id"]) for r in got] == [("b", 100.5, "manager_del_emisor", "2024-01")]
    with pytest.raises(ValueError, match="load_date"):
        transfers.ingest(raw.drop("load_date"))
    renamed = transfers.standardize_columns(spark.createDataFrame([(1, 2)], "Destinatario_ID int, monto_movimiento int"), {"receiver_id": ["destinatario_id"], "movement_amount": ["monto"]})
    assert renamed.columns == ["receiver_id", "movement_amount"]
    df = spark.createDataFrame([("todo", [1, 2])], "timeframe_periodo string, xs array<int>")
    sinks.write_reports({"r": df}, str(tmp_path), "s1")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r_s1").first()["xs"] == "[1,2]"
    assert sinks.write_cases({"casuistica_a": df, "casuistica_b": df.limit(0), "par": df}, str(tmp_path), "s2") == ["casuistica_a"]
    assert [r[0] for r in transfers.ensure_time(spark.createDataFrame([(1700000000000,), (1700000001000,)], "ts long")).select(F.unix_seconds("fecha_hora_ts")).collect()] == [1700000000, 1700000001]


def test_layouts_are_tried_on_texts_that_they_may_read_only(spark):
    dates = ["5/1/2024", "05/01/2024", "005/1/2024", "31/12/12024", "5/1/24", "2024/1/5", "2024/01/05", "5-1-2024", "2024-1-5", "-5/1/2024", "+5/1/2024", "32/1/2024", "5/13/2024", "2024-01-05", "5/1/-2024", "5/1/+12024", "5.1.2024", ""]
    clocks = ["", " 7:05", " 07:05", " 007:05", " 7:5", " 7:05:09", " 7:05:09.5", " 7:05:09.123456789", " 23:59:59.123456", " 13:05 PM", " 7:05 pm", " 7:05:09 AM", " 7:05:09.5 a. m.", "  7:05", " 7:05 XM", " 12:00 p.m.", " 0:30 AM", "T07:05", " 7:05Z", " x"]
    df = spark.createDataFrame([(d + c,) for d in dates for c in clocks], "t string")
    t = text.blank_to_null(text.spanish_ampm(F.col("t")))
    every = F.coalesce(F.when(t.rlike(text.ISO), t.try_cast("timestamp")), *[F.try_to_timestamp(t, F.lit(f)) for f, _ in text.TIME_FORMATS])
    rows = df.select("t", text.parse_time(F.col("t")).cast("string").alias("got"), every.cast("string").alias("want")).collect()
    assert [r for r in rows if r["got"] != r["want"]] == [] and sum(r["got"] is not None for r in rows) > 60


def test_steps_are_computed_once(spark):
    df = spark.createDataFrame([("5/1/2024 7:05 p. m.", "3 SPEI123 abc 456 X12"), ("x", "BNET"), (None, None)], "t string, d string")
    steps = text.Steps(df)
    time, parts = text.parse_time(F.col("t"), steps.keep), text.parse_description(F.col("d"), steps.keep)
    out = steps.df.select(time.alias("time"), *[c.alias(k) for k, c in parts.items()]).where("time is not null or code is null")
    plain = df.select(text.parse_time(F.col("t")).alias("time"), *[c.alias(k) for k, c in text.parse_description(F.col("d")).items()]).where("time is not null or code is null")
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect())) and out.count() == 3
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_to_timestamp") == len(text.TIME_FORMATS)
