"""The document by shingle incidence of operator 4, dealt in blocks of columns.

Tasks collect the sets of many texts in a buffer of bounded size, sort its entries by shingle and cut
them into column blocks: ranges of shingle hashes, as many as the size of the table asks for. What is
shuffled is a packed piece of a buffer per block: four bytes a shingle (differences of sorted hashes)
and two bytes for the row within the buffer. A task then holds all entries of its block, so it knows
how many rows have each shingle; shingles of a single row drop out, and what remains goes back to rows.

Shingles in more than 1 / HOT_SHARE of the rows never enter a block. They are counted beforehand by
partial sums in every task, their number is bounded by HOT_SHARE times the mean size of a set, and
their entries stay with their row. So a block is bounded whatever a single shingle's frequency.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.sentencepiece_codec import text_slices
from tallyscope.llm.shingles import mix, set_key, shingle_sets

SHINGLE_WORDS = 5
PERCENT = 75
#: Bits of a shingle's hash. Above them is the logarithm of the number of rows that have it, so the order of these longs is rarest first.
HASH_BITS = 48
ROW_BITS = 16
#: Entries and rows of a buffer, and entries of a block.
BUFFER_ENTRIES, BUFFER_ROWS = 1_000_000, 1 << ROW_BITS
BLOCK_ENTRIES = 1_000_000
#: A shingle in more than 1 / HOT_SHARE of the rows is kept out of the blocks; at most HOT_LIMIT are, the most frequent ones.
HOT_SHARE = 1000
HOT_LIMIT = 100_000
#: A task reports a shingle as frequent if at least so many rows of a buffer have it.
HOT_LEAST = 8
#: Set hashes that a task remembers so as to emit equal sets once.
REMEMBERED = 200_000
#: Bits of a set's parity map.
PARITY_BITS = 512


def parity_map(shingles: np.ndarray) -> list[int]:
    """PARITY_BITS bits, each the parity of the shingles that hash to it, as longs: two maps differ in at most as many bits as the sets in shingles."""
    places = (mix(shingles.view(np.uint64)) % np.uint64(PARITY_BITS)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=PARITY_BITS) & 1).astype(np.uint8)).view(np.int64).tolist()


def class_of(counts: np.ndarray) -> np.ndarray:
    """The whole part of the logarithm of positive counts."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1] - 1, 31).astype(np.int64)


class Buffer:
    """Sets of a task, each node once while it is remembered."""

    def __init__(self):
        self.remembered: set[int] = set()
        self.clear()

    def clear(self) -> None:
        self.nodes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.entries = 0

    def add(self, node: int | None, shingles: np.ndarray) -> bool:
        """Take a set; true if the buffer is full."""
        if node is None or node in self.remembered:
            return False
        if len(self.remembered) >= REMEMBERED:
            self.remembered.clear()
        self.remembered.add(node)
        self.nodes.append(node)
        self.sets.append(shingles)
        self.entries += len(shingles)
        return self.entries >= BUFFER_ENTRIES or len(self.nodes) >= BUFFER_ROWS

    def sizes(self) -> np.ndarray:
        return np.array([len(s) for s in self.sets], dtype=np.int64)

    def sorted_entries(self) -> np.ndarray:
        """hash << ROW_BITS | row within the buffer, sorted."""
        rows = np.repeat(np.arange(len(self.sets), dtype=np.uint64), self.sizes())
        entries = np.concatenate(self.sets).view(np.uint64) >> np.uint64(64 - HASH_BITS) << np.uint64(ROW_BITS) | rows
        entries.sort()
        return entries


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, dtype=np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def read_sets(docs: DataFrame, more: list[str]) -> DataFrame:
    """doc_id, node (null: no shingles), n_shingles and the parity map per row, and its long columns `more`.

    Rows with n_shingles = -1 are a task's reports of frequent shingles: their hashes and counts.
    """
    schema = "".join(f"{c} long, " for c in more) + "doc_id long, node long, n_shingles long, parity array<long>, hot array<long>, hot_rows array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = Buffer()

        def report() -> pa.RecordBatch:
            hashes = buffer.sorted_entries() >> np.uint64(ROW_BITS)
            starts, counts = runs(hashes)
            often = counts >= max(HOT_LEAST, len(buffer.nodes) / HOT_SHARE)
            found, counts = hashes[starts[often]].astype(np.int64), counts[often]
            buffer.clear()
            none = {c: pa.array([None], pa.int64()) for c in [*more, "doc_id", "node"]}
            lists = {"hot": pa.array([found], pa.list_(pa.int64())), "hot_rows": pa.array([counts], pa.list_(pa.int64()))}
            return pa.RecordBatch.from_pydict(none | {"n_shingles": pa.array([-1], pa.int64()), "parity": pa.array([None], pa.list_(pa.int64()))} | lists)

        for batch in text_slices(batches):
            sets = shingle_sets(batch.column("_text").to_pylist(), SHINGLE_WORDS)
            nodes = [set_key(s) for s in sets]
            empty = pa.nulls(len(sets), pa.list_(pa.int64()))
            columns = {c: batch.column(c) for c in [*more, "doc_id"]} | {"node": pa.array(nodes, pa.int64()), "n_shingles": pa.array([len(s) for s in sets], pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | {"parity": pa.array([parity_map(s) for s in sets], pa.list_(pa.int64())), "hot": empty, "hot_rows": empty})
            for node, s in zip(nodes, sets):
                if buffer.add(node, s):
                    yield report()
        if buffer.nodes:
            yield report()

    return docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")).mapInArrow(run, schema)


def hot_shingles(sets: DataFrame, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the frequent shingles, and their packed form: HOT_LIMIT at most reach the driver."""
    reports = sets.where("n_shingles < 0").select(F.explode(F.arrays_zip("hot", "hot_rows")).alias("e"))
    counts = reports.groupBy(F.col("e.hot").alias("h")).agg(F.sum("e.hot_rows").alias("c")).where(F.col("c") * HOT_SHARE >= n_rows)
    got = counts.orderBy(F.desc("c"), "h").limit(HOT_LIMIT).collect()
    hashes, counted = np.array([r["h"] for r in got], dtype=np.int64), np.array([r["c"] for r in got], dtype=np.int64)
    order = np.argsort(hashes)
    hashes, counted = hashes[order], counted[order]
    return hashes, class_of(counted) << HASH_BITS | hashes


PIECES = "block long, buffer long, base long, hashes binary, rows binary, nodes binary, sizes binary, hot binary, hot_rows binary"
SHARED = "buffer long, rows binary, shingles binary, nodes binary, sizes binary"
ROWS = "node long, n long, shingles array<long>"


def arrow_of(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c, kinds[kind]) for c, kind in (f.split() for f in schema.split(", "))])


def pieces(docs: DataFrame, blocks: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Buffers cut into blocks of columns (see PIECES). One more piece of each buffer names its rows and holds their frequent shingles."""
    step = np.uint64((1 << HASH_BITS) // blocks)
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    arrow = arrow_of(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, packed = shared.value
        buffer = Buffer()
        part, turn = TaskContext.get().partitionId(), 0

        def cut() -> pa.RecordBatch:
            name = part << 20 | turn
            entries = buffer.sorted_entries()
            h = entries >> np.uint64(ROW_BITS)
            often = np.zeros(len(h), dtype=bool)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, h.view(np.int64)), len(hashes) - 1)
                often = hashes[at] == h.view(np.int64)
            mask = np.uint64(BUFFER_ROWS - 1)
            names = {"block": -1 - (part + turn) % blocks, "buffer": name, "nodes": np.array(buffer.nodes, dtype=np.int64).tobytes(), "sizes": buffer.sizes().astype(np.int32).tobytes()}
            if often.any():
                names |= {"hot": packed[at[often]].tobytes(), "hot_rows": (entries[often] & mask).astype(np.uint16).tobytes()}
            rows = [names]
            h, within = h[~often], (entries[~often] & mask).astype(np.uint16)
            block = np.minimum(h // step, np.uint64(blocks - 1))
            starts, lengths = runs(block)
            for start, length in zip(starts.tolist(), lengths.tolist()):
                piece = h[start : start + length]
                steps = np.diff(piece, prepend=piece[:1])
                wide = steps.max() >> np.uint64(32)
                rows.append({"block": int(block[start]), "buffer": name, "base": int(piece[0]), "hashes": steps.astype(np.uint64 if wide else np.uint32).tobytes(), "rows": within[start : start + length].tobytes()})
            buffer.clear()
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        for batch in text_slices(batches):
            for s in shingle_sets(batch.column("_text").to_pylist(), SHINGLE_WORDS):
                if buffer.add(set_key(s), s):
                    yield cut()
                    turn += 1
        if buffer.nodes:
            yield cut()

    return docs.select(F.col("text").alias("_text")).mapInArrow(run, PIECES)


def shared_of_block(group: pa.Table) -> pa.Table:
    """The entries of a block whose shingles several rows have, packed by buffer; pieces that name rows are handed on."""
    hashes, within, owners, out = [], [], [], []
    for p in group.to_pylist():
        if p["nodes"] is not None:
            out.append({"buffer": p["buffer"], "rows": p["hot_rows"], "shingles": p["hot"], "nodes": p["nodes"], "sizes": p["sizes"]})
            continue
        rows = np.frombuffer(p["rows"], dtype=np.uint16)
        steps = np.frombuffer(p["hashes"], dtype=np.uint32 if len(p["hashes"]) == 2 * len(p["rows"]) else np.uint64)
        hashes.append(np.cumsum(steps, dtype=np.int64) + p["base"])
        within.append(rows)
        owners.append((p["buffer"], len(rows)))
    if hashes:
        h = np.concatenate(hashes)
        order = np.argsort(h)
        starts, counts = runs(h[order])
        packed = np.empty(len(h), dtype=np.int64)
        packed[order] = np.repeat(np.where(counts > 1, class_of(counts) << HASH_BITS, -1), counts)
        at = 0
        for (buffer, length), rows in zip(owners, within):
            classes = packed[at : at + length]
            several = classes >= 0
            if several.any():
                out.append({"buffer": buffer, "rows": rows[several].tobytes(), "shingles": (classes | h[at : at + length])[several].tobytes()})
            at += length
    return pa.Table.from_pylist(out, schema=arrow_of(SHARED))


def rows_of_buffer(group: pa.Table) -> pa.Table:
    """node, n and the shared shingles, rarest first, of the rows of a buffer that share at least least_shared of theirs."""
    found = group.to_pylist()
    rows = np.frombuffer(b"".join(p["rows"] for p in found if p["rows"]), dtype=np.uint16).astype(np.int64)
    shingles = np.frombuffer(b"".join(p["shingles"] for p in found if p["shingles"]), dtype=np.int64)
    named = next(p for p in found if p["nodes"] is not None)
    nodes, sizes = np.frombuffer(named["nodes"], dtype=np.int64), np.frombuffer(named["sizes"], dtype=np.int32).astype(np.int64)
    enough = np.bincount(rows, minlength=len(nodes)) >= least_shared(sizes)
    kept = enough[rows]
    rows, shingles = rows[kept], shingles[kept]
    order = np.lexsort((shingles, rows))
    rows, shingles = rows[order], shingles[order]
    starts, _ = runs(rows)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)).astype(np.int32)), pa.array(shingles))
    return pa.table({"node": nodes[rows[starts]], "n": sizes[rows[starts]], "shingles": lists})


def least_shared(n: Column | np.ndarray) -> Column | np.ndarray:
    """ceil(0.75 n): shingles that a set of n must share with any partner."""
    return (PERCENT * n + 99) // 100 if isinstance(n, np.ndarray) else F.floor((PERCENT * n + 99) / 100).cast("long")


def shared_rows(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """node, n, shingles: sets of docs that share enough to link, with the shingles that others have too, rarest first.

    sets: read_sets of docs, written. Equal sets of different tasks are rows of their own.
    """
    total = sets.where("n_shingles > 0").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("entries")).first()
    blocks = -(-total["entries"] // BLOCK_ENTRIES) or 1
    dealt = pieces(docs, blocks, hot_shingles(sets, total["rows"]))
    return dealt.groupBy("block").applyInArrow(shared_of_block, SHARED).groupBy("buffer").applyInArrow(rows_of_buffer, ROWS)
