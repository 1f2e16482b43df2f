"""Lexicon hits and near matches against loops over all texts and terms."""

import random
import re
from difflib import SequenceMatcher

import pytest

from tallyscope.operators import lexicon

ROWS = [
    ("A", 0, 1.0, "word", "mordida"), ("A", 0, 1.0, "word", "oro"), ("A", 0, 1.0, "word", "ab"), ("B", 1, 2.0, "phrase", "te debo la vida"), ("B", 1, 2.0, "phrase", "en sobre"),
    ("B", 1, 2.0, "phrase", "favor"), ("B", 1, 2.0, "phrase", "sobre la mesa"), ("C", 2, 0.5, "pattern", r"pag(?:o|ue)s?\b"), ("C", 2, 0.5, "pattern", r"(.)\1 x"), ("C", 2, 0.5, "pattern", "luj[oa]"),
    ("D", 3, 0.7, "pattern", "sobre.{0,5}mesa"), ("D", 3, 0.7, "pattern", "vida"), ("A", 0, 1.0, "word", "comision"), ("D", 3, 0.7, "word", "mordida"), ("E", 4, 1.1, "phrase", "x en"),
]


def some_texts(rnd, n):
    words = ["mordida", "mordidas", "mordia", "te", "debo", "la", "vida", "en", "sobre", "mesa", "tesoro", "cabo", "pagos", "pague", "lujo", "aax", "xx", "x", "favores", "comisiones", "comsion", "visa", "sobres", "te debo la vda", "on"]
    return sorted({" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 12))) for _ in range(n)})


def brute_hits(texts):
    out = set()
    for t in texts:
        words = re.findall("[a-z0-9]+", t)
        for family, ord_, weight, kind, term in ROWS:
            if (term in words if kind == "word" and len(term) >= 4 else term in t) if kind != "pattern" else re.search(term, t):
                out.add((t, family, ord_, weight, term))
    return out


def test_hits_are_those_of_a_loop(spark):
    texts = some_texts(random.Random(1), 400)
    df = spark.createDataFrame([(t,) for t in texts], "norm string")
    hits = lexicon.lexicon_hits(df, lexicon.lexicon_table(spark, ROWS))
    found = {tuple(r) for r in hits.collect()}
    assert found == brute_hits(texts) and {r[1] for r in found} == set("ABCDE")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_parts_of_a_lexicon_may_be_missing(spark):
    df = spark.createDataFrame([("mordida en sobre",), ("",)], "norm string")
    for kinds in (["word"], ["phrase"], ["pattern"], []):
        rows = [r for r in ROWS if r[3] in kinds]
        got = {r["term"] for r in lexicon.lexicon_hits(df, lexicon.lexicon_table(spark, rows)).collect()}
        assert got == {t for t in ("mordida", "en sobre", "favor") if t in "mordida en sobre" and any(r[4] == t for r in rows)}
    assert lexicon.fuzzy_hits(df, lexicon.lexicon_table(spark, [])).count() == 0


def brute_near(texts, rows, word_ratio, phrase_ratio, most):
    out = set()
    for t in texts:
        words = set(re.findall("[a-z0-9]+", t))
        for family, ord_, weight, kind, term in rows:
            if kind not in ("word", "phrase") or len(term) < 4 or (term in t if " " in term else term in words):
                continue
            ratio = phrase_ratio if " " in term else word_ratio
            segments = [m[0][: len(term) + 3] for m in re.finditer(r"[a-z0-9][a-z0-9\s]{0,%d}" % (len(term) + 6), t)][:most]
            near = any(SequenceMatcher(None, s, term).ratio() >= ratio for s in segments)
            if near or SequenceMatcher(None, t[:600], term).ratio() >= ratio + 0.03:
                out.add((t, family, ord_, weight, "~" + term))
    return out


@pytest.mark.parametrize(("ratios", "most"), [((0.9, 0.88), 50), ((0.8, 0.75), 2), ((0.6, 0.6), None)])
def test_near_matches_are_those_of_a_loop(spark, ratios, most):
    rnd = random.Random(2)
    texts = set(some_texts(rnd, 150))
    for _ in range(500):
        term = list(rnd.choice([r[4] for r in ROWS if r[3] != "pattern"]))
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(term))
            term[at : at + rnd.randrange(2)] = rnd.choice(["", "e", "ss", " "])
            term = term or ["a"]
        texts.add("".join(term).strip() + rnd.choice(["", " ", " en la casa", " de"]))
    texts = sorted(texts)
    df = spark.createDataFrame([(t,) for t in texts], "norm string")
    got = {tuple(r) for r in lexicon.fuzzy_hits(df, lexicon.lexicon_table(spark, ROWS), *ratios, segments=most).collect()}
    want = brute_near(texts, ROWS, *ratios, most)
    assert got == want and len(want) > 20


def test_gram_bounds_hold():
    """Strings that reach a ratio share as many grams as the filters ask for."""
    rnd = random.Random(4)
    for _ in range(4000):
        a = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(4, 16)))
        b = list(a)
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(3)] = rnd.choice(["", "a", "bc"])
        b = "".join(b)
        reached = SequenceMatcher(None, b, a).ratio()
        for ratio in (0.6, 0.75, 0.9):
            if reached >= ratio and b:
                q = lexicon.gram_size(ratio)
                common = len(set(lexicon._numbered_grams(a, q)) & set(lexicon._numbered_grams(b, q)))
                assert common >= lexicon.least_grams(ratio, len(a) + len(b), q) >= 1
                assert {g for _, g, _, _, _ in lexicon.gram_index([(a, ratio)], q)} & set(lexicon._numbered_grams(b, q))


def test_grams_and_runs_have_their_lengths(spark):
    """Every gram of three to five characters with its count, every run of one to three words of three letters or more."""
    texts = ["abcabc", "ab", "uno dos de tres cuatro", ""]
    df = spark.createDataFrame([(t,) for t in texts], "norm string")
    grams = {(r["norm"], r["gram"]): r["tf"] for r in lexicon.char_ngrams(df).collect()}
    want: dict = {}
    for t in texts:
        for n in (3, 4, 5):
            for i in range(len(t) - n + 1):
                want[t, t[i : i + n]] = want.get((t, t[i : i + n]), 0) + 1
    assert grams == want
    runs = {r["term"] for r in lexicon.word_runs(df).where("norm like 'uno%'").collect()}
    assert runs == {"tres", "cuatro", "uno dos", "dos tres", "tres cuatro", "uno dos tres", "dos tres cuatro"}


def test_long_texts_are_read_once_where_they_lie(spark):
    rnd = random.Random(4)
    words = ["mordida", "para", "te", "debo", "la", "vida", "sobre", "mesa", "por", "mi", "xfavor", "en"]
    texts = [" ".join(rnd.choice(words) for _ in range(4000)) + end for end in ("", " te debo la", " valida x", "\npara y\nvalida")]
    rows = [*ROWS, ("F", 5, 1.0, "pattern", r"\b(por|para)\b.*\b(firm|valid)\w*")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, norm string")
    hits = lexicon.hits_of(df, lexicon.lexicon_table(spark, rows))
    assert "norm" not in hits.columns
    got = {(r["row"], r["family"], r["term"]) for r in hits.collect()}
    want = {(texts.index(t), family, term) for t, family, _, _, term in brute_hits(texts)} | {(2, "F", rows[-1][4])}
    assert got == want
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") + plan.count("Scan ExistingRDD") <= 3  # texts once, and the two parts of the lexicon


def test_a_pattern_is_tried_after_the_first_word_only():
    assert lexicon.once(r"\b(por|para)\b.*\bfirm\w*").startswith("^(?>")
    assert lexicon.once(r"\b(a b c|b)\b.*x") is None and lexicon.once(r"\b(por)\b.*(x)\1") is None and lexicon.once(r"\b(por)\b.*x|y") is None


def test_runs_are_of_whole_characters(spark):
    text = "a\U0001F600b\U0001F601\U0001F600 c"
    got = spark.createDataFrame([(text,), ("ab",), ("",)], "norm string").select("norm", lexicon._substrings([1, 3]).alias("runs")).collect()
    assert {r["norm"]: r["runs"] for r in got} == {t: [t[i : i + n] for n in (1, 3) for i in range(len(t) - n + 1)] for t in (text, "ab", "")}
