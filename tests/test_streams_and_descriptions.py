"""Streams into tables, descriptions by given families, and closed walks around hubs."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import descriptions, graph, groups
from tallyscope.streaming import bursts

TX = "tx_id string, user_id string, receiver_id string, origin_application_id string, movement_amount double, us long"


def transfers(spark, rows):
    return spark.createDataFrame(rows, TX).withColumn("fecha_hora_ts", F.timestamp_micros("us")).drop("us")


def some_rows(n, seed, start=1_700_000_000_000_000):
    rnd = random.Random(seed)
    return [(f"t{seed}-{i}", rnd.choice(["a", "b", "c", None]), rnd.choice(["x", "y"]), rnd.choice(["app", "web", None]), rnd.choice([1.0, 20.5, None]), start + rnd.randrange(40) * 1_200_000_000) for i in range(n)]


def test_streamed_bursts_are_the_batch_ones(spark, tmp_path):
    """Files that come later, with rows of the first bins too, a restart, and a batch that was written but not noted as done."""
    schema = transfers(spark, []).schema
    batches = [some_rows(120, 1), some_rows(90, 2, 1_700_400_000_000_000), some_rows(60, 3)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    folder = f"file://{tmp_path}/state"
    assert bursts.streamed_bursts(stream, folder).count() == 0
    for i in range(len(batches)):
        transfers(spark, batches[i]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i == 1:  # an attempt that ended before its progress was noted left rows behind
            bursts.burst_parts(transfers(spark, some_rows(10, 9))).write.parquet(f"{folder}/parts/batch=1")
        for _ in range(2):  # the second call starts again and finds nothing new
            got = bursts.streamed_bursts(stream, folder)
        b = groups.burst_bins(transfers(spark, sum(batches[: i + 1], [])))
        want = b.select("rafaga_canal_id", "rafaga_canal_hora_bin_inicio", "rafaga_canal_hora_bin_fin", "rafaga_canal_tx_en_bin", "rafaga_canal_tx_fuera_horario", "rafaga_canal_monto_total", "rafaga_canal_personas_emisoras", "rafaga_canal_personas_receptoras", F.coalesce("rafaga_canal_flag_evento", F.lit(False)))
        key = lambda r: (r[0], r[1])
        rows = got.withColumn("evento", F.coalesce("evento", F.lit(False))).select("canal", "inicio", "fin", "n", "fuera", "monto", "emisores", "receptores", "evento").collect()
        assert sorted(map(tuple, rows), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_streamed_flags_are_the_batch_ones(spark, tmp_path):
    tx = transfers(spark, some_rows(80, 4) + [("n", "a", "b", "app", 17_005.0, 1_700_000_000_000_000)])
    tx.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = bursts.streamed_flags(stream, f"file://{tmp_path}/state").collect()
    assert sorted(map(str, got)) == sorted(map(str, bursts.stateless_flags(tx).collect())) and any(r["sig_near_thr"] for r in got)


def brute_description(raw, emotions, families):
    s = " ".join((raw or "").strip().lower().translate(str.maketrans("áéíóúüñ", "aeiouun")).split())
    words = s.split(" ") if s else []
    hits = len(re.findall(families["VAGUEDAD"], s)) if "VAGUEDAD" in families else 0
    share = hits / max(1, len(words))
    flags = sorted(k for k, rx in families.items() if re.search(rx, s))
    return share if len(words) > 2 else max(0.8, share), float(sum(e in s for e in emotions)), flags if s else ["SIN_DESCRIPCION"]


@pytest.mark.parametrize("families", [None, {"Z": r"pag[oa]", "A": r"\d+"}, {"VAGUEDAD": "o"}, {}])
def test_descriptions(spark, families):
    texts = [None, "", "  ", "Pago", "pago  varios servicio", "GRACIAS MIL por el abono, eres el mejor", "sin más que decir 12", "deuda\ty proyecto", "x" * 5000 + " gastos y pago", "Te debo la vida te debo la vida", "varios varios varios varios"]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id int, descripcion string, feat_nlp_x string")
    got = {r["id"]: (r["feat_nlp_vaguedad"], r["feat_nlp_emocion"], r["desc_flags"]) for r in descriptions.describe(df, families=families).collect()}
    assert got == {i: brute_description(t, descriptions.EMOTIONS, descriptions.FAMILIES if families is None else families) for i, t in enumerate(texts)}
    felt = descriptions.describe(df, emotions=("  PAGO ",), families=families).where("descripcion = 'Pago'").first()
    assert felt["feat_nlp_emocion"] == 1.0
    assert descriptions.describe(df.limit(0)).count() == 0


def brute_walks(edges, simple):
    out, ahead = set(), {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    for a, b in edges:
        for c in ahead.get(b, ()):
            if a in ahead.get(c, ()) and (not simple or len({a, b, c}) == 3):
                out |= {a, b, c}
            for d in ahead.get(c, ()):
                if a in ahead.get(d, ()) and d != a and b != d and (not simple or len({a, b, c, d}) == 4):
                    out |= {a, b, c, d}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_closed_walks_are_those_of_a_loop(spark, seed):
    rnd = random.Random(seed)
    n = 30
    edges = {(f"n{rnd.randrange(n):02d}", f"n{rnd.randrange(n):02d}") for _ in range([18, 26, 34, 42, 50, 60][seed])}
    if seed % 2:
        edges = {(a, b) for a, b in edges if a != b}
    df = spark.createDataFrame(sorted(edges), "a string, b string")
    for simple in (False, True):
        assert {r["node"] for r in graph.cycle_nodes(df, simple).collect()} == brute_walks(edges, simple)


def test_paths_of_hubs_are_bounded(spark):
    """Two hubs that pay all others, half of whom pay them back: paths stay below E * sqrt(2 E), not the square of a hub's degree."""
    leaves = [f"l{i:04d}" for i in range(400)]
    edges = [(h, x) for h in ("h0", "h1") for x in leaves] + [(x, h) for h in ("h0", "h1") for x in leaves[::2]]
    df = spark.createDataFrame(edges, "a string, b string")
    near = graph.ranked(graph.both_ways(df))
    assert graph.paths_below(near).count() <= len(leaves) * 4
    assert {r["node"] for r in graph.four_cycle_nodes(near).collect()} == {"h0", "h1", *leaves[::2]}
    star = spark.createDataFrame([(x, "h0") for x in leaves] + [("h0", x) for x in leaves], "a string, b string")
    assert graph.paths_below(graph.ranked(graph.both_ways(star))).count() == 0
    assert graph.cycle_nodes(star).count() == 401 and graph.cycle_nodes(star, simple=True).count() == 0
    grid = list(itertools.product(range(5), range(5)))
    ring = [(f"{a}{b}", f"{a}{(b + 1) % 5}") for a, b in grid] + [(f"{a}{b}", f"{(a + 1) % 5}{b}") for a, b in grid]
    assert graph.cycle_nodes(spark.createDataFrame(ring, "a string, b string")).count() == 0
