"""Rows of ordered groups of any size: dealt by ranges, so that a group may lie in many partitions, and put together piece by piece.

SHA-256 reads its input from the first byte to the last, so the digest of one group is made by one task; that task gets
the group in pieces of about PIECE_BYTES, merged beforehand where the rows lie, and holds one Arrow batch of them at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tallyscope.llm.common import Scratch

#: Bytes from which a piece of a group is handed on.
PIECE_BYTES = 64_000
#: Bits of `at` that number the rows of a partition.
ROW_BITS = 33


def in_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with `at`, a long that grows in the given order; equal rows lie in any order and in as many partitions as they fill.

    Lazy, and `at` changes with the partitions: write the result before using it twice.
    """
    salt = F.xxhash64(F.monotonically_increasing_id())
    dealt = rows.withColumn("_salt", salt)
    keys = [*order, F.col("_salt")]
    return dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt").withColumn("at", F.monotonically_increasing_id())


def _joined(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    return zip(*[batch.column(n).to_pylist() for n in names])


def digests(rows: DataFrame, keys: list[str], order: list[Column | str], piece: str, separator: bytes, kept: Scratch) -> DataFrame:
    """keys and `digest`, the SHA-256 of each group's pieces (strings) by `order`, joined by the separator.

    Groups that lie within one partition are done there; those that reach its ends, or are long, go on as pieces.
    """
    fields = [rows.schema[k] for k in keys]
    schema = StructType([*fields, StructField("at", LongType()), StructField("piece", BinaryType()), StructField("digest", StringType())])
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    taken = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*keys, piece)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << ROW_BITS
        key, held, size, open_, first = None, [], 0, True, True
        out: list[tuple] = []

        def close(last: bool) -> None:
            nonlocal at
            if open_ or last:
                out.append((*key, at, separator.join(held), None))
                at += 1
            else:
                out.append((*key, None, None, hashlib.sha256(separator.join(held)).hexdigest()))

        for batch in batches:
            for *k, text in _joined(batch, [*keys, piece]):
                if k != key:
                    if key is not None:
                        close(False)
                        first = False
                    key, held, size, open_ = k, [], 0, first
                elif size > PIECE_BYTES:
                    close(True)
                    held, size, open_ = [], 0, True
                held.append(text.encode())
                size += len(text) + 1
            yield _rows(out, schema)
            out = []
        if key is not None:
            close(True)
        yield _rows(out, schema)

    merged = kept.written(taken.mapInArrow(merge, schema))
    done = merged.where("digest is not null").select(*keys, "digest")
    return done.unionByName(piece_digests(merged.where("digest is null"), keys, separator))


def _rows(out: list[tuple], schema: StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    columns = list(zip(*out)) if out else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def piece_digests(pieces: DataFrame, keys: list[str], separator: bytes) -> DataFrame:
    """keys and `digest` from pieces (keys, at, piece): each group's pieces pass through one hash, in order; null pieces are left out."""
    schema = StructType([*[pieces.schema[k] for k in keys], StructField("digest", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hashed, begun = None, None, False
        for batch in batches:
            out = []
            for *k, piece in _joined(batch, [*keys, "piece"]):
                if k != key:
                    if key is not None:
                        out.append((*key, hashed.hexdigest()))
                    key, hashed, begun = k, hashlib.sha256(), False
                if piece is not None:
                    hashed.update(separator + piece if begun else piece)
                    begun = True
            yield _rows(out, schema)
        if key is not None:
            yield _rows([(*key, hashed.hexdigest())], schema)

    dealt = pieces.select(*keys, "at", "piece").repartition(*keys).sortWithinPartitions(*keys, "at")
    return dealt.mapInArrow(run, schema)
