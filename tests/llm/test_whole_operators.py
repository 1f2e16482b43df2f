"""The operators' whole jobs against plain Python."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyscope.llm import html_crf, jaccard_join, quality_rules


def shingles_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def near_copies(seed=3):
    rnd = random.Random(seed)
    rows = []
    for _ in range(10):
        base = [f"w{rnd.randrange(400)}" for _ in range(140)]
        for _ in range(rnd.choice([1, 9, 12])):
            copy = list(base)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = f"w{rnd.randrange(400)}"
            rows.append((len(rows), " ".join(copy)))
    return rows + [(500, rows[0][1]), (501, rows[0][1]), (502, None), (503, ""), (504, "a b"), (505, "A  b")]


def test_jaccard_gives_every_link(spark):
    rows = near_copies()
    sets = {d: frozenset(shingles_of(t)) for d, t in rows}
    texts = set(filter(None, sets.values()))
    want = {}
    for x, y in itertools.combinations(texts, 2):
        both = len(x & y)
        if 100 * both >= 75 * len(x | y):
            want[frozenset((x, y))] = both
    pairs, rows_ = jaccard_join.join_links(spark.createDataFrame(rows, "doc_id long, text string"))
    found = rows_.collect()
    text_of = {r["node"]: sets[r["doc_id"]] for r in found if r["node"] is not None}
    got = [(frozenset((text_of[r["a"]], text_of[r["b"]])), r["overlap"]) for r in pairs.collect()]
    assert len(got) == len(want) > 40 and dict(got) == want
    degree, copies = Counter(x for p in want for x in p), Counter(sets.values())
    assert len(found) == len(rows)
    for r in found:
        x = sets[r["doc_id"]]
        assert (r["n_links"], r["n_copies"]) == ((degree[x], copies[x] - 1) if x else (0, 0))
    same = jaccard_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in same} == {(r["doc_id"], r["component_id"]) for r in found}


def test_keep_one_goes_by_row(spark):
    def near(k, i):
        return " ".join(f"t{k}_{j}" if j != i else "other" for j in range(60))

    rows = [(1, near(0, -1)), (7, near(0, 5)), (7, near(1, -1)), (None, near(2, -1)), (None, near(2, 9)), (None, near(1, 3)), (8, near(3, 1)), (8, near(3, 1)), (9, ""), (9, None), (9, near(0, 7)), (None, "")]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, place int").repartition(5)
    got = sorted(r["place"] for r in jaccard_join.keep_one(df).select("place").collect())
    assert [p for p in got if p not in (3, 4, 6, 7)] == [0, 2, 8, 9, 11]
    assert len({3, 4} & set(got)) == len({6, 7} & set(got)) == 1 and len(got) == 7


def test_binomial_tail_is_exact_beyond_a_million_rows(spark):
    n, k, risk = 1_500_000, 14_750, 0.01
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log(1 - risk) for i in range(k + 1)]
    want = max(terms) + math.log(math.fsum(math.exp(t - max(terms)) for t in terms))
    got = spark.range(1).select(quality_rules.log_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), risk).alias("p")).first()["p"]
    assert abs(got - want) < 1e-6


@pytest.mark.parametrize(("html", "want"), [
    ("<body><p>one</p><script>for(i=0;i<n;i++){f(i)}</script><p>two</p>", ["one", "two"]),
    ("<body><p>one</p><script>s = '<!-- <p>';</script><p>two</p>", ["one", "two"]),
    ("<head><title>t < u</title><meta a><h1>one</h1><p>two", ["one", "two"]),
    ("<html><head><style>p > a {}</style>one<p>two", ["one", "two"]),
    ("<div><select><option>x<option>y</div><p>one</p>", ["one"]),
    ("<select><option>x<p>one</p>", ["one"]),
    ("<div><svg><path d=''></div><p>one</p>", ["one"]),
    ("<div><svg><path d=''><p>one</p>", ["one"]),
    ("<p>a <select><option>x</option></select> b</p><textarea><p>no</textarea><p>c", ["a", "b", "c"]),
    ("<p>let <math><mi>x</mi></math> be</p><object><p>kept</p></object><button>go</button>", ["let x be", "kept", "go"]),
    ("<noscript>one<p>two", ["one", "two"]),
])
def test_html_loses_no_block(html, want):
    assert [b.text for b in html_crf.leaf_blocks(html)] == want
