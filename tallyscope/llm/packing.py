"""Operator 10: pack token ids into fixed rows.

Documents are split losslessly at the row width, and the segments are placed by best-fit decreasing:
a segment tree over free capacities finds the fullest open row that still takes a segment. A pool of
bounded size is packed at a time within a Spark partition, so nothing is shuffled and a task that runs
again writes the same rows.

A packed row: `ids` (int32 little-endian, exactly `width` of them, padded), `n_tokens` used,
`cu_seqlens` (0 and the cumulative segment lengths), `position_ids` (int32, from 0 in each segment,
0 in the padding), and the documents and chunk numbers of its segments, in order.

Defined cases: null and empty texts have no tokens and thus no segment; a text of any length is encoded
whole, and one longer than a row becomes several chunks; repeated rows are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.sentencepiece_codec import MODEL, load_pieces, shared_codec, text_slices

WIDTH = 2048
#: Tokens held by a task before a pool is packed: 8 MB of ids.
POOL_TOKENS = 2_000_000
PAD = 0
SCHEMA = "pool string, row int, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, chunks array<int>"


class FreeRows:
    """Open rows by free capacity, with a segment tree that finds the least capacity of at least n."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def _change(self, capacity: int, by: int) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, row: int, capacity: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        self._change(capacity, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        """(row, its capacity) of the least capacity >= n; the row is no longer open."""
        at = self.leaves + n
        if not self.count[at]:
            while at > 1 and not (at % 2 == 0 and self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._change(capacity, -1)
        return self.rows[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of segment numbers; ties go by segment number."""
    rows: list[list[int]] = []
    free = FreeRows(width)
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[i]
        got = free.take(n)
        if got is None:
            rows.append([i])
            row, capacity = len(rows) - 1, width
        else:
            row, capacity = got
            rows[row].append(i)
        if capacity > n:
            free.put(row, capacity - n)
    return rows


def pack_pool(pool: str, segments: list[tuple[int | None, int, np.ndarray]], width: int, pad: int) -> list[dict]:
    """Packed rows of (doc_id, chunk, ids) segments."""
    out = []
    for k, row in enumerate(best_fit_decreasing([len(s[2]) for s in segments], width)):
        parts = [segments[i] for i in row]
        ids = np.full(width, pad, dtype=np.int32)
        positions = np.zeros(width, dtype=np.int32)
        ends = np.cumsum([0] + [len(p[2]) for p in parts])
        for (_, _, tokens), start in zip(parts, ends):
            ids[start : start + len(tokens)] = tokens
            positions[start : start + len(tokens)] = np.arange(len(tokens), dtype=np.int32)
        out.append({"pool": pool, "row": k, "n_tokens": int(ends[-1]), "n_segments": len(parts), "ids": ids.tobytes(), "cu_seqlens": ends.tolist(), "position_ids": positions.tobytes(), "doc_ids": [p[0] for p in parts], "chunks": [p[1] for p in parts]})
    return out


ARROW = pa.schema([("pool", pa.string()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("chunks", pa.list_(pa.int32()))])


def pack_stream(tokens: Iterator[tuple[int, int | None, np.ndarray]], width: int, pad: int, pool_tokens: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of (partition, doc_id, ids), pool by pool."""
    segments: list[tuple[int | None, int, np.ndarray]] = []
    held, pools, part = 0, 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows = pack_pool(f"{part}-{pools}", segments, width, pad)
        for at in range(0, len(rows), 256):
            yield pa.RecordBatch.from_pylist(rows[at : at + 256], schema=ARROW)

    for part, doc_id, ids in tokens:
        for chunk, at in enumerate(range(0, len(ids), width)):
            segments.append((doc_id, chunk, ids[at : at + width]))
            held += len(segments[-1][2])
            if held >= pool_tokens:
                yield from flush()
                segments, held, pools = [], 0, pools + 1
    if segments:
        yield from flush()


def pack_documents(docs: DataFrame, model: str = MODEL, width: int = WIDTH, pad: int = PAD, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """Encode the texts of docs (operator 3) and pack them."""
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(pieces.value)

        def tokens() -> Iterator[tuple[int, int | None, np.ndarray]]:
            for batch in text_slices(batches):
                for part, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_part", "doc_id", "_text"))):
                    if text:
                        yield part, doc_id, np.frombuffer(codec.encode(text), dtype=np.int32)

        yield from pack_stream(tokens(), width, pad, pool_tokens)

    return docs.select("doc_id", docs["text"].alias("_text"), F.spark_partition_id().alias("_part")).mapInArrow(run, SCHEMA)


def pack_tokens(encoded: DataFrame, ids: str = "token_ids", width: int = WIDTH, pad: int = PAD, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """Pack a table that already has doc_id and an id list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tokens() -> Iterator[tuple[int, int | None, np.ndarray]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    got = batch.column("_ids")[i]
                    if got.is_valid and len(got):
                        yield batch.column("_part")[i].as_py(), batch.column("doc_id")[i].as_py(), got.values.to_numpy(zero_copy_only=False).astype(np.int32)

        yield from pack_stream(tokens(), width, pad, pool_tokens)

    return encoded.select("doc_id", encoded[ids].alias("_ids"), F.spark_partition_id().alias("_part")).mapInArrow(run, SCHEMA)
