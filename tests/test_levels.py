"""Levels of the audit questions that the derived transfers do not reach, text helpers, and sinks, by hand and in plain Python."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest

from tallyscope.functions import text
from tallyscope.operators import lexicon
from tallyscope.plans import questions
from tallyscope.sources import sinks

COLUMNS = "timeframe_periodo string, tx_id string, user_id string, receiver_id string, fecha_hora_ts timestamp, month_id string, movement_amount double, risk_score double, sig_yoyo boolean, sig_loan_bad_repay boolean, sig_freq boolean, sig_near_thr boolean, feat_delta_near_thr double, sig_smurf boolean"


def rows_of(rnd, n, people=4, bad=0.0, freq=0.0, hours=24 * 300):
    out = []
    for i in range(n):
        a, b = rnd.sample(range(people), 2)
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(hours))
        out.append(("t", f"x{i:03d}", f"p{a}", f"p{b}", ts, ts.strftime("%Y-%m"), float(rnd.randrange(1, 90)), round(rnd.random() * 3, 2), False, rnd.random() < bad, rnd.random() < freq, False, float(rnd.randrange(20, 900)), False))
    return out


def estimated(rows):
    """Q13 without loan flags, month by month."""
    groups = defaultdict(list)
    for r in rows:
        groups[tuple(sorted(r[2:4])), r[5]].append(r)
    months = []
    for (_, month), g in groups.items():
        sums, counts = defaultdict(float), defaultdict(int)
        for r in g:
            sums[r[2], r[3]] += r[6]
            counts[r[2], r[3]] += 1
        loan = min(sums, key=lambda k: (-sums[k], k))
        back = sums.get(loan[::-1], 0.0)
        months.append({"pair": "→".join(loan), "month": month, "l": counts[loan], "x": max(sums[loan] - back, 0.0), "f": len(g), "ratio": back / sums[loan], "r": max(r[7] for r in g), "ra": np.mean([r[7] for r in g])})
    f = [m["f"] for m in months]
    for level, least in ((2, max(3, np.quantile(f, 0.75))), (3, max(2, np.quantile(f, 0.6)))):
        kept = [m for m in months if m["f"] >= least and m["ratio"] <= 0.5]
        if kept:
            break
    else:
        level, kept = 4, sorted(months, key=lambda m: (-m["f"], -round(m["x"], 4), m["pair"], m["month"]))[:50]
    pairs = defaultdict(list)
    for m in kept:
        pairs[m["pair"]].append(m)
    out = {p: (len(ms), sum(m["l"] for m in ms), round(sum(m["x"] for m in ms), 4), sum(m["f"] for m in ms), round(max(m["r"] for m in ms), 6), level) for p, ms in pairs.items()}
    for least in (2, 1):
        some = {p: v for p, v in out.items() if v[0] >= least}
        if some:
            return some
    return {}


def got13(df):
    return {r["pair"]: (r["meses_con_coincidencia"], r["prestamos_incumplidos"], r["monto_prestamos_incumplidos"], r["eventos_alta_frecuencia"], r["riesgo_max"], r["criterio"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_loans_are_estimated_where_none_is_flagged(spark, seed):
    rows = rows_of(random.Random(seed), 90 if seed == 1 else 12, people=4 if seed == 1 else 9)
    assert got13(questions.q13(spark.createDataFrame(rows, COLUMNS))) == estimated(rows)


def test_loans_and_frequency_in_different_months(spark):
    base = rows_of(random.Random(3), 2)[0]
    at = lambda i, month, bad, freq: (*base[:1], f"y{i}", "a", "b", dt.datetime(2024, month, 3), f"2024-{month:02d}", 10.0, 1.0, False, bad, freq, False, 50.0, False)
    rows = [at(0, 1, True, False), at(1, 2, False, True), at(2, 3, True, False)]
    assert got13(questions.q13(spark.createDataFrame(rows, COLUMNS))) == {"a→b": (1, 2, 20.0, 1, 1.0, 1)}


def brute_runs(rows):
    """Q10 without flags: hits within 8, 24 or 72 hours of the one the other way, else pairs that pay both ways."""
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[4], r[1])):
        groups["⇄".join(sorted(r[2:4]))].append(r)
    for level, hours in ((1, 8), (2, 24), (3, 72), (4, None)):
        hits = {}
        for key, g in groups.items():
            flags = [False] * len(g)
            if hours is None:
                flags = [len({r[2] for r in g}) > 1] * len(g)
            else:
                for i, r in enumerate(g):
                    for j in range(i - 1, -1, -1):
                        if (r[4] - g[j][4]).total_seconds() / 3600 > hours:
                            break
                        if g[j][2] == r[3]:
                            flags[i] = flags[j] = True
                            break
            hits[key] = flags
        if any(map(any, hits.values())):
            out = {}
            for key, flags in hits.items():
                run = best = 0
                for x in flags:
                    run = run + 1 if x else 0
                    best = max(best, run)
                if best:
                    out[key] = (sum(flags), best, level)
            return out
    return {}


@pytest.mark.parametrize(("seed", "n", "hours"), [(4, 60, 2000), (5, 8, 9000), (6, 30, 24 * 300)])
def test_runs_of_back_and_forth_without_flags(spark, seed, n, hours):
    rows = rows_of(random.Random(seed), n, hours=hours)
    rows = [(*r[:4], r[4] + dt.timedelta(seconds=i), *r[5:]) for i, r in enumerate(rows)]
    want = brute_runs(rows)
    got = {r["par_bidir"]: (r["tx_yo_yo_totales"], r["racha_max_yo_yo"], r["criterio"]) for r in questions.q10(spark.createDataFrame(rows, COLUMNS), min_consecutive=0, risk=-1.0).collect()}
    assert got == want and want


def test_near_amounts_fall_back_to_the_nearest(spark):
    rows = rows_of(random.Random(7), 40)
    got = questions.q11(spark.createDataFrame(rows, COLUMNS)).collect()
    cut = np.quantile([r[12] for r in rows], 0.15)
    assert sum(r["tx_near_totales"] for r in got) <= sum(r[12] <= cut for r in rows) and all(r["criterio"] == 3 for r in got) and got


def test_lists_in_texts(spark):
    given = {'["a", "b", "a"]': ["a", "b"], "['x']": ["x"], "plain": ["plain"], " nan ": [], "": [], None: [], "[]": [], "a, b": ["a, b"]}
    df = spark.createDataFrame([(k,) for k in given], "c string")
    assert {r["c"]: r["l"] for r in df.select("c", text.as_list(df["c"]).alias("l")).collect()} == given


def test_forced_and_raw_concepts(spark):
    ts = dt.datetime(2024, 1, 5)
    rows = [("t", f"x{i}", who, "r", ts + dt.timedelta(days=i), "2024-01", 10.0, 1.0, c, [c], d) for i, (who, c, d) in enumerate([("a", "Soborno; Extorsión", "pago uno"), ("b", "SOBORNO", "pago dos"), ("c", "OTRO", "tres"), ("d", "OTRO", "tres"), ("e", "OTRO", "cuatro")])]
    df = spark.createDataFrame(rows, "timeframe_periodo string, tx_id string, user_id string, receiver_id string, fecha_hora_ts timestamp, month_id string, movement_amount double, risk_score double, nlp_concepto_sospechoso string, nlp_categorias array<string>, descripcion string")
    got = {r["concepto"]: (r["emisores_lista"], r["tx_count"], r["conceptos_crudos"]) for r in questions.q5(df, forced=True, include_raw_concept=True).collect()}
    assert got == {"SOBORNO": ("a, b", 2, "pago uno | pago dos"), "OTRO": ("c, d, e", 3, "tres | cuatro")}


def test_tagging_sees_entities_near_matches_and_similarity(spark):
    texts = spark.createDataFrame([("m&oacute;rdida",), ("ｍｏｒｄｉｄａ",), ("mordidas",), ("mordidx por algo",), ("buen dia",)], "raw string")
    table = lexicon.lexicon_table(spark)
    got = {r["raw"]: r for r in lexicon.tag_texts(texts, table).collect()}
    assert all("SOBORNO" in got[t]["cats"] for t in ("m&oacute;rdida", "ｍｏｒｄｉｄａ", "mordidas"))
    assert got["buen dia"]["cats"] == []
    assert "~mordida" in lexicon.tag_texts(texts, table).where("raw = 'mordidas'").first()["frases"]
    exact = {r["raw"]: r["cats"] for r in lexicon.tag_texts(texts, table, fuzzy=False).collect()}
    assert exact["mordidas"] == []
    more = {r["raw"]: r["_base"] for r in lexicon.tag_texts(texts, table, similarity=True).collect()}
    assert more["mordidas"] > got["mordidas"]["_base"]


def test_lexicon_from_a_file(spark, tmp_path):
    (tmp_path / "lex.csv").write_text("family,ord,weight,kind,term\nUNO,0,2.0,word,Propóleo\nUNO,0,2.0,word,dos palabras\nDOS,1,1.0,pattern,x\\d+\nDOS,1,1.0,word,\n")
    table = lexicon.lexicon_file(spark, str(tmp_path / "lex.csv"))
    assert {(r["family"], r["kind"], r["term"]) for r in table.collect()} == {("UNO", "word", "propoleo"), ("UNO", "phrase", "dos palabras"), ("DOS", "pattern", "x\\d+")}
    hits = lexicon.lexicon_hits(spark.createDataFrame([("el propoleo y dos palabras",)], "norm string"), table.unionByName(lexicon.lexicon_table(spark).where("family = 'FACILITACION'")))
    assert {r["term"] for r in hits.collect()} == {"propoleo", "dos palabras"}


def test_sinks_write_what_they_are_given(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", 2, [])], "k string, n int, l array<string>")
    sinks.write_answers({"q": df}, str(tmp_path / "answers"))
    sinks.write_sample(df, str(tmp_path / "sample"), 1, [df["n"].desc()])
    back = spark.read.option("header", True).csv(str(tmp_path / "sample"))
    assert [r["k"] for r in back.collect()] == ["b"]
    assert spark.read.option("header", True).csv(str(tmp_path / "answers/q")).count() == 2
