"""Operator 6: mix sources to target weights.

Sizes are summed per source; a source's repetition rate is its target over its size; a document is
emitted floor(rate) times, and once more when a hash-seeded draw falls below the fraction.

A row's draw depends on its doc_id alone where no other row has that id. Rows that share an id, or have
none, also draw by their text, and equal rows of these by their number among equals, so they are drawn
independently and reruns still agree.

Defined cases: a null source is a source of its own, last in order; a null or wordless text has size
0 (its copies count as nothing); texts of any length are read whole; an empty table gives an empty mix.
Only doc_id, text and source are read; other columns, whatever their names, pass through
`mix_documents` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import global_rank, numbered, places_among_equals, word_count, written

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
#: Up to this many sources their targets are broadcast; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 50_000
#: 13 hex digits of an MD5 make a draw of 52 bits, exact in a double.
DRAW_DIGITS = 13


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on key and seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**DRAW_DIGITS))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """_source, source_size, target, _rate from (source, size) rows, marked for broadcast if they are few.

    The level (target per unit of weight of the sources below their cap) rises until no source is
    above its cap; each step is one aggregate over the sources that returns a few numbers.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(sums, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", weight.cast("long").alias("weight")), "sources")
    level, capped = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > F.lit(max_rate) * F.col("source_size")
        got = ranked.agg(
            F.count_if(over).alias("n"),
            F.count(F.lit(1)).alias("sources"),
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        if got["n"] == capped or not got["free"]:
            break
        capped, level = got["n"], (got["total"] - max_rate * got["held"]) / got["free"]
    target = F.least(F.lit(level) * F.col("weight"), (F.lit(max_rate) * F.col("source_size")).cast("double"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    targets = ranked.select(F.col("source").alias("_source"), "source_size", target.alias("target"), rate.alias("_rate"))
    return F.broadcast(targets) if got["sources"] <= BROADCAST_SOURCES else targets


def copies(rate: Column, key: Column, seed: str) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(key, seed) < rate - whole, 1).otherwise(0)).cast("long")


def narrow(rows: DataFrame) -> DataFrame:
    """file, row, doc_id, source, digest of the text and size of numbered rows, written."""
    digest = F.md5(F.coalesce(F.col("kept.text"), F.lit("")).cast("binary"))
    return written(rows.select("file", "row", "kept.doc_id", "kept.source", digest.alias("digest"), word_count(F.col("kept.text")).alias("size")), "mix")


def shared_draws(slim: DataFrame) -> DataFrame:
    """file, row and `_more`, what the draw of a row depends on beside its doc_id, of the rows whose doc_id others have too."""
    shared_ids = written(slim.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")), "shared-ids")
    some = slim.join(shared_ids, F.col("doc_id").eqNullSafe(F.col("_id")))
    group = F.xxhash64(F.to_json(F.struct("doc_id", "source", "digest")))  # leaves nulls out, so they differ from values
    return places_among_equals(some, group).join(slim.select("file", "row", "digest"), ["file", "row"]).select("file", "row", F.concat("digest", F.lit("|"), F.col("place").cast("string")).alias("_more"))


def with_copies(rows: DataFrame, slim: DataFrame, doc_id: str, source: str, seed: str) -> DataFrame:
    """rows with source_size, target and copies. Rows with an id of their own meet nothing but the targets of their source."""
    joined = rows.join(shared_draws(slim), ["file", "row"], "left").join(source_targets(slim), F.col(source).eqNullSafe(F.col("_source")))
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce("_more", F.lit("")))
    return joined.withColumn("copies", copies(F.col("_rate"), key, seed))


def plan_mix(docs: DataFrame, seed: str = "mix-1") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken per row of docs."""
    slim = narrow(numbered(docs))
    planned = with_copies(slim, slim, "doc_id", "source", seed)
    return planned.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, seed: str = "mix-1") -> DataFrame:
    """The mix itself: rows of docs, repeated or left out where they lie; sizes and draws are planned on narrow columns."""
    rows = numbered(docs)
    planned = with_copies(rows, narrow(rows), "kept.doc_id", "kept.source", seed)
    return planned.select("kept", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("kept.*")


ORACLE_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(text, '')) as digest,
        count(*) over (partition by doc_id) as sharing, row_number() over (partition by doc_id, source, md5(coalesce(text, ''))) - 1 as place from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rk from d group by source),
w as (select source, source_size, case rk % 3 when 0 then 5 when 1 then 2 else 1 end as weight from s),
r as (select *, 3.0 * source_size / weight as full_at, row_number() over (order by 3.0 * source_size / weight, weight, source nulls last) as k from w),
c as (select *, (sum(source_size) over ())::bigint as total,
        coalesce(sum(source_size) over (order by k rows between unbounded preceding and 1 preceding), 0)::bigint as held,
        (sum(weight) over (order by k rows between current row and unbounded following))::bigint as free from r),
l as (select min(case when (total - 3 * held)::double / free <= full_at then k end) as k from c),
v as (select (c.total - 3 * c.held)::double / c.free as level from c join l using (k)),
t as (select source, source_size, least(level * weight, (3 * source_size)::double) as target from w, v),
j as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
        ('0x' || substr(md5('mix-1' || coalesce(cast(d.doc_id as varchar), '') || case when sharing > 1 then digest || '|' || place else '' end), 1, 13))::bigint::double / 4503599627370496.0 as u
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken from j
"""
