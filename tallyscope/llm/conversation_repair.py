"""Operator 11: repair of the structure of conversations at least cost, by Four-Russians block tables.

The initials of the roles of a repaired conversation read (s?(ua)+)? ; rows are kept, given another role or deleted, and empty turns are
inserted. Going through the rows from the last to the first, the costs to the end from the four states of that pattern
form a vector; without its least component it is one of a few dozen. For every vector and every block of BLOCK symbols (a symbol is
what the edits of a row depend on) the vector before the block is tabled once, so the pass backward is a lookup per block. The pass forward
expands each block backward into the vectors between its rows and takes, row by row, the ASCII-least edit that is still on
a cheapest path; expanded blocks are kept as well.

The vectors' and states' maps of neighbouring stretches compose. So a conversation that fills many partitions is cut into
segments of at most 4,096 rows; their maps are composed level by level (SHIFTS), and go down again as the
vector after and the state before each segment. Texts move once, to be hashed in order; everything else is done on narrow rows.

Defined cases: a null role or text is one space, as is a null conv_id or turn where rows are drawn for damage; rows without a
conv_id are one conversation; rows of equal turn are ordered by role and text (its first characters, then a hash of all), so repeated rows lie side by
side; a row of a role with another initial cannot be kept; empty and very long texts and roles are read whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import SPACES, Scratch, numbered, without, written
from tallyscope.llm.ordered import digests, in_order
from tallyscope.llm.prefix_trie import CRC_TABLE_SQL, EMPTY, crc32_sql, turn_key, turn_order

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of (s?(ua)+)? : 0 nothing yet (accepted), 1 after s, 2 after u, 3 after a (accepted). What u or a, whichever fits, leads to:
FOLLOWING, FITTING = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: A row's symbol: 0 where it must go, else 1 + 2 * (place of its role's initial in INITIALS, 3 for others) + truncated.
INITIALS, SYMBOLS, BLOCK = "sua", 9, 4
#: Rows are gathered by so many low bits of their place: segments, then what is composed on each level.
SHIFTS = (12, 24, 40)
KEYS = ["c", "unnamed"]


def _kept_state(state: int, initial: int) -> int | None:
    """State after a row of that initial is kept."""
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return 2 if state != 2 else None
    return 3 if initial == 2 and state == 2 else None


def _moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) of the edits that use up a row, in ASCII order of the edits."""
    out = [("D", DELETE, state)]
    if symbol:
        more = TRUNCATED * ((symbol - 1) % 2)
        kept = _kept_state(state, (symbol - 1) // 2)
        if kept is not None:
            out.append(("K", more, kept))
        out.append(("R", REROLE + more, FOLLOWING[state]))
    return out


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in range(3):
        costs = [min(costs[q], INSERT + costs[FOLLOWING[q]]) for q in range(4)]
    return tuple(costs)


def _before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    return _with_inserts([min(cost + after[to] for _, cost, to in _moves(symbol, q)) for q in range(4)])


@cache
def vectors() -> tuple[tuple[tuple[int, ...], ...], np.ndarray, np.ndarray]:
    """All cost vectors less their least component (the first is that at the end), the vector before each symbol, and its least component."""
    found = [_with_inserts([0, 99, 99, 0])]
    number = {found[0]: 0}
    step, least = [], []
    for v in found:
        row, low = [], []
        for x in range(SYMBOLS):
            b = _before(v, x)
            b, m = tuple(y - min(b) for y in b), min(b)
            if b not in number:
                number[b] = len(found)
                found.append(b)
            row.append(number[b])
            low.append(m)
        step.append(row)
        least.append(low)
    return tuple(found), np.array(step, dtype=np.int16), np.array(least, dtype=np.int16)


def trace_row(after: int, symbol: int, state: int) -> tuple[str, int]:
    """Edits at one row, inserts before it included, and the state after it: the ASCII-least of the cheapest."""
    found, step, least = vectors()
    before, last, low = found[step[after, symbol]], found[after], int(least[after, symbol])
    edits = ""
    while True:
        moves = _moves(symbol, state)
        # D < I < K < R
        for edit, cost, to in (moves[0], ("I", INSERT, FOLLOWING[state]), *moves[1:]):
            if before[state] == cost + (before[to] if edit == "I" else last[to] - low):
                break
        edits, state = edits + edit, to
        if edit != "I":
            return edits, state


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For every block (its first symbol counts most) and vector after it: the vector before it; and the state after it by the state before it."""
    found, step, _ = vectors()
    moved = np.array([[[trace_row(v, x, q)[1] for q in range(4)] for v in range(len(found))] for x in range(SYMBOLS)], dtype=np.int8)
    before, states = step.T.copy(), moved
    for _ in range(BLOCK - 1):
        # a symbol in front of every shorter block
        before, states = (
            np.concatenate([step.T[x][before] for x in range(SYMBOLS)]),
            np.concatenate([np.take_along_axis(states, moved[x][before].astype(np.intp), axis=2) for x in range(SYMBOLS)]),
        )
    return before, states


@lru_cache(maxsize=200_000)
def expand(block: tuple[int, ...], after: int, state: int) -> tuple[tuple[tuple[str, int, int], ...], int]:
    """(edits, state before, state after) of each row of a block, and the state after it: its vectors are found backward, its edits forward."""
    step = vectors()[1]
    ends = [after]
    for x in reversed(block[1:]):
        ends.append(int(step[ends[-1], x]))
    out = []
    for x, v in zip(block, reversed(ends)):
        edits, to = trace_row(v, x, state)
        out.append((edits, state, to))
        state = to
    return tuple(out), state


def _code(block: tuple[int, ...]) -> int:
    code = 0
    for x in block:
        code = code * SYMBOLS + x
    return code


def cheapest_edits(symbols: list[int], after: int = 0, state: int = 0) -> tuple[list[tuple[str, int, int]], int]:
    """(edits, state before, state after) of every row of a stretch, given the vector after it and the state before it; and the state after it."""
    first = len(symbols) % BLOCK
    blocks = [tuple(symbols[:first])] * bool(first) + [tuple(symbols[i : i + BLOCK]) for i in range(first, len(symbols), BLOCK)]
    before, _ = tables()
    ends = [after]
    for block in reversed(blocks[1:]):
        ends.append(int(before[_code(block), ends[-1]]))
    out: list[tuple[str, int, int]] = []
    for block, v in zip(blocks, reversed(ends)):
        rows, state = expand(block, v, state)
        out += rows
    return out, state


def identity() -> tuple[np.ndarray, np.ndarray]:
    n = len(vectors()[0])
    return np.arange(n, dtype=np.int16), np.tile(np.arange(4, dtype=np.int8), (n, 1))


def compose(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Maps of one stretch followed by another: vector before by vector after, and state after by (vector after, state before)."""
    (f, s), (g, t) = first, second
    return f[g], np.take_along_axis(t, s[g].astype(np.intp), axis=1)


def maps_of(symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    before, states = tables()
    _, step, _ = vectors()
    first = len(symbols) % BLOCK
    out = identity()
    for x in symbols[:first]:
        out = compose(out, (step[:, x], np.array([[trace_row(v, x, q)[1] for q in range(4)] for v in range(len(step))], dtype=np.int8)))
    for i in range(first, len(symbols), BLOCK):
        code = _code(tuple(symbols[i : i + BLOCK]))
        out = compose(out, (before[code], states[code]))
    return out


def _packed(maps: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, bytes]:
    return maps[0].astype(np.int16).tobytes(), maps[1].astype(np.int8).tobytes()


def _unpacked(f: bytes, s: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(f, dtype=np.int16), np.frombuffer(s, dtype=np.int8).reshape(-1, 4)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that the query's contract draws by conv_id and turn; other columns stay."""
    string = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(string("conv_id"), F.lit(":"), string("turn")).cast("binary")) % 20
    out = rows.withColumns({"role": string("role"), "text": string("text"), "_draw": draw}).where("_draw <> 0")
    text = F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_draw") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.withColumns({"text": text, "role": role, "_copy": F.explode(copies)}).drop("_draw")


def _named(rows: DataFrame) -> list[Column]:
    return [F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("unnamed")]


def _segment(shift: int) -> Column:
    return F.shiftright("at", shift)


def judged(rows: DataFrame, kept: Scratch) -> DataFrame:
    """Narrow rows in order: c, unnamed (a row without conv_id), at, turn, role, text (its first characters), key, file, row, fault, symbol."""
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    some = rows.select(*_named(rows), "turn", "role", F.substring("text", 1, 32).alias("text"), turn_key(F.col("role"), F.col("text")).alias("key"), "file", "row", last.alias("last"))
    placed = kept.written(in_order(some, [F.col("c"), F.col("unnamed"), *turn_order()]))
    # rows that repeat an earlier one; the first of each is found by partial aggregates, and left out by its place
    firsts = placed.groupBy(*KEYS, "key").agg(F.min("at").alias("at"))
    seen = placed.select("at").join(firsts.select("at"), "at", "left_anti").withColumn("seen", F.lit(True))
    fault = F.when(F.col("last") == "", "blank").when(F.col("seen"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    place = F.position(F.substring("role", 1, 1), F.lit(INITIALS)) - 1
    initial = F.when((F.length("role") > 0) & (place >= 0), place).otherwise(3)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(1 + 2 * initial + F.coalesce((F.col("fault") == "truncated").cast("int"), F.lit(0)))
    return kept.written(placed.join(seen, "at", "left").withColumn("fault", fault).withColumn("symbol", symbol.cast("int")).drop("seen", "last"))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of rows of equal keys; a run is held whole, so it must be bounded."""
    rest = None
    for batch in batches:
        rows = batch.to_pandas()
        if rest is not None:
            rows = pd.concat([rest, rows], ignore_index=True)
        if not len(rows):
            continue
        new = np.flatnonzero((rows[keys] != rows[keys].shift()).any(axis=1).to_numpy())
        for a, b in zip(new, new[1:]):
            yield tuple(rows[keys].iloc[a]), rows.iloc[a:b]
        rest = rows.iloc[new[-1] :]
    if rest is not None:
        yield tuple(rest[keys].iloc[0]), rest


def bounds_of_segments(rows: DataFrame, kept: Scratch) -> DataFrame:
    """c, unnamed, seg, after (vector), state: what lies after and before each segment of a conversation that has several."""
    segments = rows.groupBy(*KEYS, _segment(SHIFTS[0]).alias("seg")).agg(F.count(F.lit(1)).alias("n"))
    several = segments.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEYS)
    named = segments.join(several, KEYS, "left_semi").drop("n")
    cut = rows.select(*KEYS, "at", "symbol", _segment(SHIFTS[0]).alias("seg")).join(named, [*KEYS, "seg"], "left_semi")
    kinds = "c long, unnamed boolean, seg long"

    def first_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c, unnamed, seg), run in _runs(batches, [*KEYS, "seg"]):
            f, s = _packed(maps_of(run["symbol"].tolist()))
            yield pa.RecordBatch.from_pydict({"c": pa.array([c], pa.int64()), "unnamed": pa.array([bool(unnamed)]), "seg": pa.array([seg], pa.int64()), "f": pa.array([f]), "s": pa.array([s])})

    def composed(group: pd.DataFrame) -> pd.DataFrame:
        out = identity()
        for f, s in group.sort_values("seg")[["f", "s"]].itertuples(index=False):
            out = compose(out, _unpacked(f, s))
        f, s = _packed(out)
        return pd.DataFrame({"c": group["c"].iloc[:1], "unnamed": group["unnamed"].iloc[:1], "seg": group["up"].iloc[:1], "f": [f], "s": [s]})

    def handed_down(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seg")
        maps = [_unpacked(f, s) for f, s in group[["f", "s"]].itertuples(index=False)]
        after = [int(group["after"].iloc[0])]
        for f, _ in reversed(maps[1:]):
            after.append(int(f[after[-1]]))
        after.reverse()
        state = [int(group["state"].iloc[0])]
        for (_, s), v in zip(maps, after[:-1]):
            state.append(int(s[v, state[-1]]))
        return group[[*KEYS, "seg"]].assign(after=after, state=state)

    ordered_rows = cut.repartition(*KEYS, "seg").sortWithinPartitions(*KEYS, "at")
    levels = [kept.written(ordered_rows.mapInArrow(first_maps, f"{kinds}, f binary, s binary"))]
    ups = [F.shiftright("seg", b - a) for a, b in zip(SHIFTS, SHIFTS[1:])]
    for up in ups:
        levels.append(kept.written(levels[-1].withColumn("up", up).groupBy(*KEYS, "up").applyInPandas(composed, f"{kinds}, f binary, s binary")))
    bounds = None
    for level, up in zip(reversed(levels), [F.lit(0).cast("long"), *reversed(ups)]):
        known = level.withColumn("up", up)
        if bounds is None:
            known = known.withColumns({"after": F.lit(0), "state": F.lit(0)})
        else:
            known = known.join(bounds.withColumnRenamed("seg", "up"), [*KEYS, "up"])
        bounds = kept.written(known.groupBy(*KEYS, "up").applyInPandas(handed_down, f"{kinds}, after int, state int"))
    return bounds


def repairs(rows: DataFrame, kept: Scratch) -> DataFrame:
    """c, unnamed, at, edits, lead (what is put before the row's text, its new role included), cost and tail (turns after the last row)."""
    several = bounds_of_segments(rows, kept)
    last = rows.groupBy(*KEYS).agg(F.max("at").alias("at")).select("at", F.lit(True).alias("ends"))
    seg = _segment(SHIFTS[0]).alias("seg")
    known = rows.select("at", *KEYS, "symbol", "role").join(last, "at", "left").select("*", seg).join(several, [*KEYS, "seg"], "left")
    ordered_rows = known.repartition(*KEYS, "seg").sortWithinPartitions(*KEYS, "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (c, unnamed, _), part in _runs(batches, [*KEYS, "seg"]):
            symbols, roles, ats = part["symbol"].tolist(), part["role"].tolist(), part["at"].tolist()
            after, state = part["after"].iloc[0], part["state"].iloc[0]
            edits, state = cheapest_edits(symbols, 0 if pd.isna(after) else int(after), 0 if pd.isna(state) else int(state))
            ends = part["ends"].iloc[-1]
            for i, (e, q, _) in enumerate(edits):
                lead = ""
                for sign in e:
                    if sign == "D":
                        continue
                    lead += ("\n" if q else "") + (roles[i] if sign == "K" else FITTING[q]) + ":"
                    q = _kept_state(q, (symbols[i] - 1) // 2) if sign == "K" else FOLLOWING[q]
                truncated = symbols[i] > 0 and (symbols[i] - 1) % 2
                cost = sum({"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[sign] for sign in e) + (TRUNCATED if truncated and e[-1] != "D" else 0)
                tail = None
                if i + 1 == len(edits) and ends is not None and not pd.isna(ends):
                    while state in (1, 2):
                        tail = (tail or "") + f"\n{FITTING[state]}:"
                        e, cost, state = e + "I", cost + INSERT, FOLLOWING[state]
                out.append((c, bool(unnamed), ats[i], e, lead or None, cost, tail))
            if len(out) > 10_000:
                yield _edit_rows(out)
                out = []
        yield _edit_rows(out)

    return kept.written(ordered_rows.mapInArrow(run, "c long, unnamed boolean, at long, edits string, lead string, cost long, tail string"))


def _edit_rows(out: list[tuple]) -> pa.RecordBatch:
    names = ["c", "unnamed", "at", "edits", "lead", "cost", "tail"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    columns = list(zip(*out)) if out else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=names)


def faults(rows: DataFrame) -> DataFrame:
    """c, unnamed, gaps, blank, duplicate, truncated, illegal."""
    of = lambda kind: F.sum((F.coalesce(F.col("fault"), F.lit("")) == kind).cast("long")).alias(kind)
    kinds = ("blank", "duplicate", "truncated")
    turns = rows.groupBy(*KEYS, "turn").agg(*[of(k) for k in kinds])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counted = turns.groupBy(*KEYS).agg(gaps.alias("gaps"), *[F.sum(k).alias(k) for k in kinds])
    # neighbours within segments, then between the ends of segments
    initial = F.substring("role", 1, 1).alias("initial")
    some = rows.select(*KEYS, "at", _segment(SHIFTS[0]).alias("seg"), initial)
    bad = lambda a, b: (~F.concat(a, b).isin("su", "ua", "au")).cast("long")
    inside = F.lag("initial").over(Window.partitionBy(*KEYS, "seg").orderBy("at"))
    segments = some.withColumn("bad", F.coalesce(bad(inside, F.col("initial")), F.lit(0))).groupBy(*KEYS, "seg").agg(F.sum("bad").alias("bad"), F.min_by("initial", "at").alias("head"), F.max_by("initial", "at").alias("foot"))
    between = F.lag("foot").over(Window.partitionBy(*KEYS).orderBy("seg"))
    illegal = segments.withColumn("bad", F.col("bad") + F.coalesce(bad(between, F.col("head")), F.lit(0))).groupBy(*KEYS).agg(F.sum("bad").alias("illegal"))
    return counted.join(illegal, KEYS)


def repair(rows: DataFrame, damage: bool = True) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation, after the contract's damage if asked for."""
    kept = Scratch(rows.sparkSession)
    some = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    lying = numbered(some)
    spread = damaged if damage else lambda df: df.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")}).withColumn("_copy", F.lit(0))
    judged_rows = judged(spread(lying.select("kept.*", "file", "row")), kept)
    done = repairs(judged_rows, kept)
    # texts of rows that stay, each beside what is put before it: pieces in the order of the rows
    place = judged_rows.select("at", "turn", "role", "text", "key", "file", "row")
    acted = done.where("lead is not null or tail is not null").join(place, "at")
    stays = done.where(~F.endswith(F.rtrim("edits", F.lit("I")), F.lit("D"))).select("at").join(place.select("at", "file", "row"), "at")
    gone = lying.select("file", "row").join(stays, ["file", "row"], "left_anti")
    kept_rows = spread(_with_place(without(lying.select(F.struct("kept", "file", "row").alias("kept"), "file", "row"), gone))).where("_copy = 0")
    texts = kept_rows.select(*_named(kept_rows), "turn", "role", F.substring("text", 1, 32).alias("t"), turn_key(F.col("role"), F.col("text")).alias("key"), F.lit(1).alias("tag"), F.col("text").alias("piece"))
    signs = lambda what, tag: acted.where(f"{what} is not null").select(*KEYS, "turn", "role", F.col("text").alias("t"), "key", F.lit(tag).alias("tag"), F.col(what).alias("piece"))
    pieces = texts.unionByName(signs("lead", 0)).unionByName(signs("tail", 2))
    hashed = digests(pieces, KEYS, [F.col("turn").asc_nulls_first(), F.substring("role", 1, 32), "t", "key", "tag"], "piece", b"", kept)
    in_segments = done.groupBy(*KEYS, _segment(SHIFTS[0]).alias("seg")).agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "edits"))), lambda e: e["edits"]), "").alias("edits"))
    audits = in_segments.groupBy(*KEYS).agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "edits"))), lambda e: e["edits"]), "").alias("audit"))
    every = some.select(*_named(some)).distinct()
    out = every.join(faults(judged_rows), KEYS, "left").join(audits, KEYS, "left").join(hashed, KEYS, "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    result = written(out.select(F.when(~F.col("unnamed"), F.col("c")).alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(EMPTY)).alias("repaired_sha256")), "repaired")
    kept.remove()
    return result


def _with_place(rows: DataFrame) -> DataFrame:
    return rows.select("kept.*", "file", "row")


_ROLE = "CASE q WHEN 2 THEN 'assistant' ELSE 'user' END"
_NEXT = "CASE q WHEN 2 THEN 3 ELSE 2 END"
_ITEM = "CASE WHEN q = 0 THEN '' ELSE chr(10) END"


def _inserted(source: str) -> str:
    """States reached from those of `source` (c, i, q, best) by up to three inserts, the best of each."""
    parts = [f"SELECT c, i, q, best FROM {source}"]
    for _ in range(3):
        parts.append(f"SELECT c, i, {_NEXT} AS q, {{'cost': best.cost + {INSERT}, 'audit': best.audit || 'I', 'text': best.text || {_ITEM} || {_ROLE} || ':'}} AS best FROM ({parts[-1]})")
    return f"SELECT c, i, q, min(best) AS best FROM ({' UNION ALL '.join(parts)}) GROUP BY c, i, q"


ORACLE_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
drawn AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc),
damaged AS (SELECT c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn WHERE k <> 0),
placed AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, left(role, 32), left(text, 32), md5(length(role) || ':' || role || text), copy) AS i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM placed),
r AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS pair FROM seen),
counted AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY c),
s(c, i, q, best) AS (
  SELECT c, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': '', 'text': ''}} FROM counted
  UNION ALL
  (SELECT c, i, q, min(best) AS best FROM (
    WITH b AS ({_inserted("s")}),
      m AS (SELECT b.c, b.q, b.best, r.i, r.role, r.text, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS more, left(role, 1) AS x FROM b JOIN r ON r.c = b.c AND r.i = b.i + 1)
    SELECT c, i, q, {{'cost': best.cost + {DELETE}, 'audit': best.audit || 'D', 'text': best.text}} AS best FROM m
    UNION ALL SELECT c, i, CASE x WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, {{'cost': best.cost + more, 'audit': best.audit || 'K', 'text': best.text || {_ITEM} || role || ':' || m.text}} FROM m WHERE NOT must AND ((x = 's' AND q = 0) OR (x = 'u' AND q <> 2) OR (x = 'a' AND q = 2))
    UNION ALL SELECT c, i, {_NEXT}, {{'cost': best.cost + {REROLE} + more, 'audit': best.audit || 'R', 'text': best.text || {_ITEM} || {_ROLE} || ':' || m.text}} FROM m WHERE NOT must)
   GROUP BY c, i, q)
),
finished AS (SELECT c, min(best) AS best FROM ({_inserted("(SELECT s.* FROM s JOIN counted USING (c) WHERE i = n)")}) WHERE q IN (0, 3) GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM drawn) LEFT JOIN counted USING (c) LEFT JOIN finished USING (c)
"""
