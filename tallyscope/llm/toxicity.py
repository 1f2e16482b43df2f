"""Operator 9: toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters, digits and signs used as letters, zero-width
characters), then one Aho-Corasick automaton finds all lexicon terms at word starts, exception phrases
included. A hit inside an exception phrase counts nothing; at one word start the heaviest term counts.
The weights are summed and normalised by the number of words, and a logistic curve over both makes the score.

Terms (word beginnings), exception phrases (a term with a neighbour word) and the curve are learned from
labelled rows: at most SAMPLE_ROWS of them, taken by hash of doc_id. Every term that passes the thresholds
is kept; as each is in at least MIN_TOXIC_DOCS documents of the sample, the sample bounds the lexicon that
is broadcast. Only the text is an input of a score.

Defined cases: a null text scores as an empty one; texts are read whole; repeated rows score alike;
a document labelled twice is toxic if any label says so; without labels of both kinds every score is
PRIOR; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyscope.llm.common import unused_name
from tallyscope.llm.sentencepiece_codec import text_slices

#: Labelled rows that the lexicon and the curve are fitted on, at most.
SAMPLE_ROWS = 12_000
#: A term is a word beginning of so many letters.
TERM_LETTERS = range(4, 13)
MIN_TOXIC_DOCS = 4
MIN_WEIGHT = 3.0
MIN_EXCEPTION_DOCS = 3
#: Terms that a task counts before it hands its counts on.
HELD_TERMS = 300_000
THRESHOLD = 0.7
PRIOR = 0.1

#: Characters read as Latin letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "х": "x", "ѡ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS_INSIDE = {"@": "a", "$": "s", "!": "i"}
_INSIDE = re.compile(r"(?<=[a-z0-9])[@$!](?=[a-z0-9])")


def _fold_table() -> dict[int, str | None]:
    fold: dict[int, str | None] = {i: " " for i in range(128) if not chr(i).isalnum()}
    for i in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D6A4)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c)).lower()
        if base.isascii() and base.isalnum():
            fold[i] = "".join(DIGITS.get(c, c) for c in base)
    fold |= {ord(k): v for k, v in LOOK_ALIKES.items()} | {ord(k): v for k, v in DIGITS.items()}
    fold |= dict.fromkeys([*range(0x0300, 0x0370), 0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
    return fold | dict.fromkeys([0x00A0, *range(0x2000, 0x200B), *range(0x2010, 0x2028), 0x2028, 0x2029, 0x3000], " ")


FOLD = _fold_table()


def fold(text: str) -> str:
    """The folded text: words of plain letters with single spaces between, before and after."""
    low = text.lower()
    if "@" in low or "$" in low or "!" in low:
        low = _INSIDE.sub(lambda m: SIGNS_INSIDE[m[0]], low)
    return " " + " ".join(low.translate(FOLD).split()) + " "


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (math.log(PRIOR / (1 - PRIOR)), 0.0, 0.0)


class Scorer:
    """Matches a folded text against terms (' idio') and exception phrases (' no idiot ')."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            self.automaton.add_word(" " + term, (len(term) + 1, weight))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, -1.0))
        self.empty = not (lexicon.weights or lexicon.exceptions)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """Word start -> heaviest weight there, without starts inside exception phrases."""
        found: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        if self.empty:
            return found
        for end, (length, weight) in self.automaton.iter(folded):
            start = end - length + 1
            if weight < 0:
                free.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        if free:
            free.sort()
            following, reach = 0, -1
            for at in sorted(found):
                while following < len(free) and free[following][0] <= at:
                    reach = max(reach, free[following][1])
                    following += 1
                if at < reach:
                    del found[at]
        return found

    def measures(self, folded: str) -> tuple[float, float]:
        """log(1 + sum of weights), and the same for the sum per hundred words."""
        total = sum(self.hits(folded).values())
        words = max(1, folded.count(" ") - 1)
        return math.log1p(total), math.log1p(100.0 * total / words)

    def score(self, text: str | None) -> float:
        x = self.measures(fold(text or ""))
        z = self.lexicon.curve[0] + self.lexicon.curve[1] * x[0] + self.lexicon.curve[2] * x[1]
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 3: rows with 1 are held out from learning."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def training_texts(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, toxic of at most `rows` labelled documents that are not held out.

    A doc_id on several rows gives one training row, the least of its texts, chosen by partial aggregates: so the bound holds whatever an id's rows.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 1))
    picked = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # `rows` short rows at most
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def _counted(texts: DataFrame, terms_of, name: str) -> DataFrame:
    """term, toxic_docs, clean_docs over all training texts; terms_of(text) gives a text's distinct terms."""
    arrow = pa.schema([("term", pa.string()), ("toxic_docs", pa.int64()), ("clean_docs", pa.int64())])

    def batch_of(toxic: Counter, clean: Counter) -> pa.RecordBatch:
        names = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_pydict({"term": names, "toxic_docs": [toxic[t] for t in names], "clean_docs": [clean[t] for t in names]}, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                (toxic if y else clean).update(terms_of(text))
                if len(toxic) + len(clean) > HELD_TERMS:
                    yield batch_of(toxic, clean)
                    toxic, clean = Counter(), Counter()
        yield batch_of(toxic, clean)

    counts = texts.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "term string, toxic_docs long, clean_docs long")
    return counts.groupBy("term").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("clean_docs").alias("clean_docs"))


def word_starts(text: str) -> set[str]:
    return {w[:n] for w in set(fold(text).split()) for n in TERM_LETTERS if n <= len(w)}


def _weight(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def choose_terms(heavy: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Weights of the terms to keep, from term -> (toxic documents, weight).

    A beginning gives way to a longer term that has nearly all its documents; then a longer term stays
    only where it says more than a beginning that is kept.
    """
    longer: dict[str, int] = {}
    for term, (n, _) in heavy.items():
        longer[term[:-1]] = max(longer.get(term[:-1], 0), n)
    weights: dict[str, float] = {}
    for term in sorted(heavy, key=lambda t: (len(t), t)):
        n, weight = heavy[term]
        if longer.get(term, 0) < 0.9 * n and all(weights.get(term[:k], 0.0) < weight - 0.7 for k in range(TERM_LETTERS[0], len(term))):
            weights[term] = weight
    return weights


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Lexicon:
    """A lexicon from labels (doc_id, toxic). Counting is distributed; terms that pass the thresholds, and two numbers per training row, reach the driver."""
    texts = training_texts(docs, labels, rows).persist()
    try:
        n = {bool(r["toxic"]): r["count"] for r in texts.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
        n_toxic, n_clean = n.get(True, 0), n.get(False, 0)
        if not n_toxic or not n_clean:
            return Lexicon({})
        weight = F.log((F.col("toxic_docs") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean_docs") + 0.5) / (n_clean + 1))
        heavy = _counted(texts, word_starts, "terms").where(F.col("toxic_docs") >= MIN_TOXIC_DOCS).withColumn("weight", weight).where(F.col("weight") >= MIN_WEIGHT)
        weights = choose_terms({r["term"]: (r["toxic_docs"], r["weight"]) for r in heavy.collect()})
        plain = Scorer(Lexicon(weights))

        def neighbours(text: str) -> set[str]:
            folded = fold(text)
            out = set()
            for start in plain.hits(folded):
                end = folded.index(" ", start + 1)
                after = folded.find(" ", end + 1)
                before = folded.rfind(" ", 0, start) if start else -1
                out |= {folded[start + 1 : after]} if after > 0 else set()
                out |= {folded[before + 1 : end]} if before >= 0 else set()
            return out

        odd = _counted(texts, neighbours, "phrases").where((F.col("clean_docs") >= MIN_EXCEPTION_DOCS) & (F.col("clean_docs") >= 9 * F.col("toxic_docs")))
        phrases = sorted(r["term"] for r in odd.collect())
        scorer = Scorer(Lexicon(weights, phrases))

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = [scorer.measures(fold(t)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"a": pa.array([v[0] for v in x], pa.float64()), "b": pa.array([v[1] for v in x], pa.float64()), "y": batch.column("toxic")})

        seen = texts.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")).mapInArrow(measured, "a double, b double, y int").collect()
        return Lexicon(weights, phrases, fit_curve(np.array([[r["a"], r["b"]] for r in seen]), np.array([r["y"] for r in seen], dtype=float)))
    finally:
        texts.unpersist()


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton's method; sorted rows make the sums independent of task order."""
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    x, y = np.column_stack([np.ones(len(x)), x])[order], y[order]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), grad)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def add_score(rows: DataFrame, lexicon: Lexicon, text: str = "text", to: str = "score") -> DataFrame:
    """rows and their score in column `to`: one narrow pass with the lexicon broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    schema = StructType([*rows.schema.fields, StructField(to, DoubleType())])
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in text_slices(batches, text):
            scores = pa.array([scorer.score(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=schema.names)

    return rows.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scored = add_score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs below the threshold, with the columns of docs."""
    score = unused_name(docs.columns, "score")
    return add_score(docs, learn(docs, labels), to=score).where(F.col(score) < THRESHOLD).drop(score)
