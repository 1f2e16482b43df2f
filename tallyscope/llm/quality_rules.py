"""Operator 5: quality rules with risk-controlled cutoffs. DataFrame functions only.

Fixed base rules come first (BASE_WORDS, BASE_REPEAT_PERCENT). On top, three measures (symbols per word
character, repeated lines, repeated words) are compared with cutoffs that labelled good documents
certify, stratum by stratum: a cutoff may be used only if the exact binomial test rejects "more than
RISK of the good documents of this stratum lie above it". A measure's cutoffs are tested from the
loosest to the strictest until one fails (fixed-sequence testing), and the level DELTA is divided by
the number of sequences (strata times measures, Bonferroni), so with probability 1 - DELTA every
cutoff in use wrongly rejects at most RISK of the good documents. A stratum with too few labels
certifies nothing and loses nothing beyond the base rules.

Defined cases: null text has no words and fails the base rules; a null stratum is a stratum of its own; repeated rows
get equal verdicts; a document labelled twice is good only if all its labels say so; texts of any
length are read whole; an empty table gives an empty result; columns other than doc_id, text, the stratum and the labels are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import SPACES, numbered, without, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
BASE_WORDS = 20
BASE_REPEAT_PERCENT = 30
#: Cutoffs of each measure, loosest first.
CUTOFFS = {
    "symbols": (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03),
    "dup_lines": (0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "repeats": (0.28, 0.25, 0.22, 0.2, 0.17, 0.15, 0.12, 0.1),
}
RISK = 0.01
DELTA = 0.05
#: Up to this many strata their cutoffs are broadcast; beyond it they are joined by shuffle.
BROADCAST_STRATA = 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of `window` words found at least twice.

    Each window is one 64-bit hash of its words' hashes. Only texts with a repeated hash go on to sort
    (hash, place) pairs, keep those equal to a neighbour, and measure the union of their windows.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def union(s: Column) -> Column:
            twin = lambda e, at: F.coalesce(F.get(s, at)["h"] == e["h"], F.lit(False))
            twins = F.filter(s, lambda e, i: twin(e, i + 1) | twin(e, i - 1))
            places = F.array_sort(F.transform(twins, lambda e: e["p"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            step = lambda a, p: F.struct((a["n"] + p + window - F.greatest(p, a["end"])).alias("n"), (p + window).alias("end"))
            return F.aggregate(places, start, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, union)).otherwise(0)

    def windows(h: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(h) - window + 1)
        return F.transform(places, lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(window)]))

    enough = F.size(words) >= window
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(enough, let(hashed, lambda h: let(windows(h), covered))).otherwise(0).cast("long")


def base_features(docs: DataFrame, stratum: str, more: list[str] | None = None) -> DataFrame:
    """The columns in `more`, doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    cut = docs.select(*(more or []), "doc_id", F.col(stratum).alias("stratum"), text.alias("text"), words.alias("words"), lines.alias("lines"))
    counted = cut.select(
        *(more or []),
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def measures() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbols": per("n_symbols", "word_chars"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words")}


def log_tail(n: Column, k: Column, risk: float) -> Column:
    """log P(Binomial(n, risk) <= k), for k < n * risk: k steps at any n."""
    odds = math.log(risk / (1 - risk))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(a["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(a["sum"] - top) + F.exp(term - top))).alias("sum"))

    first = n * F.lit(math.log(1 - risk))
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.struct(first.alias("term"), first.alias("sum")), step, lambda a: a["sum"])


def certified_cutoffs(good: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum and its strictest certified cutoff per measure (null: none) from the features of labelled good documents.

    Counts over all of them, by partial sums: a row per stratum and task is shuffled, however many rows a stratum has.
    """
    counts = [F.count_if(measures()[m] > c).alias(f"{m}_{i}") for m, grid in CUTOFFS.items() for i, c in enumerate(grid)]
    sums = written(good.where(~F.col("base_failed")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts), "holdout")
    sequences = sums.agg((F.count(F.lit(1)) * len(CUTOFFS)).alias("sequences"))
    tests = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(c).alias("cutoff"), F.col(f"{m}_{i}").alias("k")) for m, grid in CUTOFFS.items() for i, c in enumerate(grid)]))
    tested = sums.select("stratum", "n", tests.alias("t")).select("stratum", "n", "t.*")
    # sequences is one row
    tested = tested.join(F.broadcast(sequences)).withColumn("passes", F.when(F.col("k") < F.col("n") * risk, log_tail(F.col("n"), F.col("k"), risk) <= F.log(F.lit(delta) / F.col("sequences"))).otherwise(False))
    # k grows as cutoffs get stricter, so the passing ones are the start of each sequence
    best = [F.min(F.when(F.col("passes") & (F.col("measure") == m), F.col("cutoff"))).alias(f"cut_{m}") for m in CUTOFFS]
    return tested.groupBy("stratum").agg(*best)


def with_cutoffs(rows: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (with features) and `kept`. features: those of all documents; labels: doc_id, quality (1: good)."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    cutoffs = written(certified_cutoffs(features.join(good, "doc_id")), "cutoffs").withColumnRenamed("stratum", "_stratum")
    if cutoffs.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    kept = ~F.col("base_failed")
    for m, value in measures().items():
        kept = kept & ~F.coalesce(value > F.col(f"cut_{m}"), F.lit(False))
    return rows.join(cutoffs, rows["stratum"].eqNullSafe(F.col("_stratum")), "left").withColumn("kept", kept)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts, base_failed and kept for every row of docs."""
    rows = written(base_features(docs, stratum), "features")
    return with_cutoffs(rows, rows, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of docs that pass, with the columns of docs.

    Features are computed once and written as narrow rows; texts are neither written nor shuffled: the rows that fail are
    flagged where they lie.
    """
    rows = numbered(docs)
    asked = rows.select("file", "row", "kept.doc_id", "kept.text", F.col(f"kept.`{stratum}`").alias("stratum"))
    features = written(base_features(asked, "stratum", ["file", "row"]), "features")
    return without(rows, with_cutoffs(features, features, labels).where("not kept").select("file", "row"))


ORACLE_SQL = r"""
with d as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select rid, i, array_to_string(w[i:i+7], ' ') as g from (select rid, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from g) where c >= 2),
rw as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 8)) as p from r) group by rid),
li as (select rid, count(*) as n_lines, count(*) - count(distinct l) as n_dup from (select rid, unnest(string_split(text, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid),
f as (select d.rid, doc_id, lang, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(li.n_lines, 0)::bigint as n_lines,
        coalesce(li.n_dup, 0)::bigint as n_dup_lines, coalesce(rw.n, 0)::bigint as n_repeat_words
      from d left join li using (rid) left join rw using (rid)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, n_symbols / greatest(word_chars, 1) as symbols,
        n_dup_lines / greatest(n_lines, 1) as dup_lines, n_repeat_words / greatest(n_words, 1) as repeats from f),
ok as (select doc_id from labels group by doc_id having min(quality) = 1),
h as (select lang, case m when 0 then symbols when 1 then dup_lines else repeats end as v, m from b join ok using (doc_id), (select unnest([0, 1, 2]) as m) where not base_failed),
cuts as (select 0 as m, unnest([CUT0]) as c union all select 1, unnest([CUT1]) union all select 2, unnest([CUT2])),
k as (select lang, m, c, count(*) as n, count(*) filter (where v > c) as k from h join cuts using (m) group by all),
t as (select k.*, (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(RISK) + (n - i) * ln(1 - RISK))) from (select unnest(range(0, k.k + 1)) as i)) as p,
        (select count(distinct coalesce(lang, '')) + 0 from h) * 3 as sequences from k where k < n * RISK),
cut as (select lang, min(c) filter (where m = 0) as c0, min(c) filter (where m = 1) as c1, min(c) filter (where m = 2) as c2 from t where p <= DELTA / sequences group by lang)
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or coalesce(symbols > c0, false) or coalesce(dup_lines > c1, false) or coalesce(repeats > c2, false)) as kept
from b left join cut on b.lang is not distinct from cut.lang
"""
for _i, _grid in enumerate(CUTOFFS.values()):
    ORACLE_SQL = ORACLE_SQL.replace(f"CUT{_i}", ", ".join(map(str, _grid)))
ORACLE_SQL = ORACLE_SQL.replace("RISK", str(RISK)).replace("DELTA", str(DELTA))
