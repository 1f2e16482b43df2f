"""Operator 2: exact top-k inner products with a vector-approximation file.

Vectors become integers, floor(64 * x). Equal vectors are one entry, with the first k + 1 of its rows. The
file holds, for each entry, the cell it lies in: its largest absolute component m, and per dimension one
of CELLS equal intervals of [-m, m], one byte. A cell bounds the inner product with any query from both sides.

1. Blocks of the file are scanned by blocks of queries, on the codes alone. Entries whose upper bound is
   under a query's (k + 1)-th greatest lower bound drop out, in each block and then over all blocks.
2. The exact vectors of the entries left are read in order of their upper bounds: the first 2 * k of a
   query, then only those whose upper bound reaches the (k + 1)-th score found.
3. Exact scores are sums of integers. Each query row takes the k best rows but itself.

Every query meets every code, exact vectors are joined to the pairs left alone, and groups have a bounded size:
VECTOR_BLOCK entries and QUERY_BLOCK queries. Equal vectors cannot make a group of ties, as they are one entry.

Defined cases: a vector that is null, empty, or holds a null or non-finite component takes no part;
vectors of different lengths do not meet, and one of any length is read whole; rows with equal vec_id
are separate candidates, and only the query's own row is left out; ties go to the smaller vec_id; null
vec_ids are candidates (last in ties) but no queries; components are exact up to the largest double, and
scores beyond 64 bits are cut to them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import Scratch, written

SCALE = 64
CELLS = 256
#: Entries and queries that meet in one task, at most; a small table is cut into blocks of LEAST_BLOCK entries.
VECTOR_BLOCK, QUERY_BLOCK, LEAST_BLOCK = 65_536, 8_192, 8_192
#: Entries and queries multiplied at a time.
VECTOR_TILE, QUERY_TILE = 8_192, 512
#: Bounds are scaled by this power of two, so that no sum of doubles overflows.
DOWN = 2.0**-24
LONG = np.iinfo(np.int64)


def pack(v: list[float]) -> bytes:
    """floor(64 * x) of finite doubles: a letter for the type, and the integers; beyond 2 ** 62, floor(64 * x) / 64 as doubles (d)."""
    x = np.asarray(v, dtype=np.float64)
    if np.abs(x).max() < 2.0**56:
        whole = np.floor(SCALE * x).astype(np.int64)
        size = np.abs(whole).max()
        kind = "h" if size < 2**15 else "i" if size < 2**31 else "q"
        return kind.encode() + whole.astype(kind).tobytes()
    return b"d" + np.where(np.abs(x) < 2.0**56, np.floor(SCALE * np.where(np.abs(x) < 2.0**56, x, 0.0)) / SCALE, x).tobytes()


def unpack(exact: bytes) -> np.ndarray:
    """The integers; Python integers for type d."""
    x = np.frombuffer(exact, dtype=chr(exact[0]), offset=1)
    return np.array([int(Fraction(float(y)) * SCALE) for y in x], dtype=object) if exact[:1] == b"d" else x.astype(np.int64)


def scaled(exact: bytes) -> tuple[float, np.ndarray]:
    """(m, z): the vector divided by SCALE is m * z / DOWN, with z in [-1, 1]."""
    x = np.frombuffer(exact, dtype=chr(exact[0]), offset=1).astype(np.float64)
    m = np.abs(x).max()
    z = x / m if m else x
    return (m if exact[:1] == b"d" else m / SCALE) * DOWN, z


def most(m: np.ndarray | float) -> np.ndarray | float:
    """The bound, for a query of scale m, at which scores are cut to 64 bits; what lies beyond it is a tie."""
    with np.errstate(divide="ignore"):
        return np.float64(2.0**63 * DOWN * DOWN / SCALE**2 * (1 - 1e-9)) / m


def cell_codes(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((z + 1) * (CELLS / 2)), 0, CELLS - 1).astype(np.uint8)


def exact_score(q: np.ndarray, x: np.ndarray) -> int:
    """The integer inner product, cut to 64 bits."""
    if q.dtype != object and x.dtype != object and float(np.abs(q).sum()) * float(np.abs(x).max()) < 2.0**62:
        return int(q @ x)
    return max(LONG.min, min(LONG.max, sum(int(a) * int(b) for a, b in zip(q, x))))


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """uid, id, exact (see pack) of the vectors that take part."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    ok = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = [pack(v) for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_pydict({"uid": batch.column("uid"), "id": batch.column("id"), "exact": pa.array(exact, pa.binary())})

    return written(ok.select(F.monotonically_increasing_id().alias("uid"), "id", "v").mapInArrow(run, "uid long, id long, exact binary"), "vectors")


def approximation_file(entries: DataFrame) -> DataFrame:
    """entry, dim, scale, codes: the cell of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [scaled(e) for e in batch.column("exact").to_pylist()]
            columns = {"entry": batch.column("entry"), "dim": pa.array([len(z) for _, z in cells], pa.int32()), "scale": pa.array([m for m, _ in cells], pa.float64())}
            yield pa.RecordBatch.from_pydict(columns | {"codes": pa.array([cell_codes(z).tobytes() for _, z in cells], pa.binary())})

    return entries.select("entry", "exact").mapInArrow(run, "entry long, dim int, scale double, codes binary")


def scan_block(q: np.ndarray, cut: np.ndarray, codes: np.ndarray, scale: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, places, upper bounds, lower bounds) of the entries that can be among a query's best k in this block.

    q: queries divided by their largest absolute component, with the bounds at which their scores are cut. Single precision is enough, as its error is part of the bounds.
    """
    weight = np.abs(q).sum(axis=1)
    # half a cell, and what single precision can lose over a sum of so many terms
    reach = weight * (1.0 / CELLS * (1 + 1e-6) + 1.2e-7 * (q.shape[1] + 4))
    for q0 in range(0, len(q), QUERY_TILE):
        part, error, end = q[q0 : q0 + QUERY_TILE].astype(np.float32), reach[q0 : q0 + QUERY_TILE], cut[q0 : q0 + QUERY_TILE, None]
        best = np.full((len(part), k), -np.inf)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for v0 in range(0, len(codes), VECTOR_TILE):
            centres = (codes[v0 : v0 + VECTOR_TILE].astype(np.float32) + np.float32(0.5)) * np.float32(2 / CELLS) - np.float32(1)
            m = scale[v0 : v0 + VECTOR_TILE]
            middle, gap = (part @ centres.T).astype(np.float64) * m, np.outer(error, m)
            lower, upper = np.clip(middle - gap, -end, end), np.clip(middle + gap, -end, end)
            both = np.concatenate([best, lower], axis=1)
            best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            at, place = np.nonzero(upper >= best.min(axis=1)[:, None])
            kept.append((at, place + v0, upper[at, place], lower[at, place]))
        at, place, upper, lower = (np.concatenate(c) for c in zip(*kept))
        still = upper >= best.min(axis=1)[at]
        at, place, upper, lower = at[still], place[still], upper[still], lower[still]
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(part) + 1))
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            yield q0 + i, place[order[a:b]], upper[order[a:b]], lower[order[a:b]]


def scan(asked: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """q, entry, upper, lower: the pairs of a query and an entry that the bounds of one block leave."""
    spark = cells.sparkSession
    n, n_asked = cells.count(), asked.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-n // VECTOR_BLOCK), min(tasks, -(-n // LEAST_BLOCK)), 1)
    q_blocks = max(-(-n_asked // QUERY_BLOCK), 1)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = cells.select("dim", deal("entry", blocks).alias("block"), "entry", "scale", "codes").withColumn("q_block", every(q_blocks)).withColumn("exact", F.lit(None).cast("binary"))
    dim = F.length("exact") - 1
    size = F.when(F.substring("exact", 1, 1) == F.lit(b"h"), 2).when(F.substring("exact", 1, 1) == F.lit(b"i"), 4).otherwise(8)
    asking = asked.select((dim / size).cast("int").alias("dim"), deal("entry", q_blocks).alias("q_block"), "entry", "exact").withColumn("block", every(blocks))
    asking = asking.withColumn("scale", F.lit(None).cast("double")).withColumn("codes", F.lit(None).cast("binary"))

    def run(group: pa.Table) -> pa.Table:
        is_query = group.column("exact").is_valid().to_numpy()
        names = group.column("entry").to_numpy()
        out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))]
        if is_query.any() and not is_query.all():
            asks = [scaled(e) for e in group.column("exact").filter(pa.array(is_query)).to_pylist()]
            q, cut = np.stack([z for _, z in asks]), most(np.array([m for m, _ in asks]))
            rows = group.filter(pa.array(~is_query))
            codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in rows.column("codes").to_pylist()])
            asked_names, held_names = names[is_query], names[~is_query]
            for i, place, upper, lower in scan_block(q, cut, codes, rows.column("scale").to_numpy(), k):
                out.append((np.full(len(place), asked_names[i]), held_names[place], upper, lower))
        q_names, entries, upper, lower = (np.concatenate(c) for c in zip(*out))
        return pa.table({"q": q_names, "entry": entries, "upper": upper, "lower": lower})

    columns = ["dim", "block", "q_block", "entry", "scale", "codes", "exact"]
    return held.select(columns).unionByName(asking.select(columns)).groupBy("dim", "block", "q_block").applyInArrow(run, "q long, entry long, upper double, lower double")


def with_scores(pairs: DataFrame, entries: DataFrame, asked: DataFrame) -> DataFrame:
    """q, entry, score and `least`, no more than the score in the scale of the bounds: the exact vectors of pairs are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, least = [], []
            for a, b in zip(batch.column("q_exact").to_pylist(), batch.column("exact").to_pylist()):
                scores.append(exact_score(unpack(a), unpack(b)))
                (m_q, q), (m, z) = scaled(a), scaled(b)
                least.append(float(np.clip(m * ((q @ z) - 1e-12 * len(q) * np.abs(q).sum()), -most(m_q), most(m_q))))
            yield pa.RecordBatch.from_pydict({"q": batch.column("q"), "entry": batch.column("entry"), "score": pa.array(scores, pa.int64()), "least": pa.array(least, pa.float64())})

    exact = entries.select("entry", "exact")
    queries = asked.select(F.col("entry").alias("q"), F.col("exact").alias("q_exact"))
    return pairs.select("q", "entry").join(exact, "entry").join(queries, "q").select("q", "entry", "exact", "q_exact").mapInArrow(run, "q long, entry long, score long, least double")


def reaching(pairs: DataFrame, bound: str, k: int) -> DataFrame:
    """q and the k-th greatest `bound` of each query that has so many."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(bound), "entry"))
    return pairs.select("q", "entry", bound).withColumn("_place", place).where(F.col("_place") == k).select("q", F.col(bound).alias("reached"))


def top_k(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for the queries, rows whose id is divisible by `every`, against all other rows."""
    scratch = Scratch(vectors.sparkSession)
    rows = integer_vectors(vectors, id_col, vector_col)
    order = [F.col("id").asc_nulls_last(), F.col("uid")]
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("exact").orderBy(*order))).where(F.col("place") <= k + 1)
    # lists of k + 1 rows at most
    entries = written(first.groupBy("exact").agg(F.min("uid").alias("entry"), F.collect_list(F.struct("id", "uid")).alias("members")), "entries")
    queries = rows.where(F.col("id").isNotNull() & (F.col("id") % every == 0)).join(entries.select("exact", "entry"), "exact")
    queries = written(queries.select(F.col("entry").alias("q"), F.col("id").alias("query_id"), F.col("uid").alias("q_uid")), "queries")
    asked = scratch.written(entries.select("entry", "exact").join(queries.select(F.col("q").alias("entry")).distinct(), "entry", "left_semi"))
    # with its own row left out, a query needs one entry more
    met = scratch.written(scan(asked, scratch.written(approximation_file(entries)), k + 1))
    left = met.join(reaching(met, "lower", k + 1), "q", "left").where(F.col("reached").isNull() | (F.col("upper") >= F.col("reached"))).drop("reached", "lower")
    left = scratch.written(left.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("upper"), "entry"))))
    early = scratch.written(with_scores(left.where(F.col("place") <= 2 * k), entries, asked))
    late = left.where(F.col("place") > 2 * k).join(reaching(early, "least", k + 1), "q").where(F.col("upper") >= F.col("reached"))
    scored = written(early.unionByName(with_scores(late, entries, asked)).select("q", "entry", "score"), "scored")
    scratch.remove()
    best = lambda q: Window.partitionBy(q).orderBy(F.desc("score"), *order)
    found = scored.join(entries.select("entry", F.explode("members").alias("m")), "entry").select("q", "score", "m.id", "m.uid")
    found = found.withColumn("place", F.row_number().over(best("q"))).where(F.col("place") <= k + 1)
    others = queries.join(found, "q").where(F.col("uid") != F.col("q_uid"))
    ranked = others.withColumn("rank", F.row_number().over(best("q_uid"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


#: The same result from all inner products.
ORACLE_SQL = """
with v as (select row_number() over () as uid, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.uid, q.vec_id as query_id, c.vec_id, c.uid as cuid, list_dot_product(q.v, c.v)::bigint as score
      from v q join v c on len(q.v) = len(c.v) and q.uid <> c.uid where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by uid order by score desc, vec_id nulls last, cuid) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
