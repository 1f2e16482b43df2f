"""Operator 11 against a plain program over all paths, and against its SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tallyscope.llm import conversation_repair as repair
from tallyscope.llm.common import table

NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(symbols):
    """(cost, audit) by keeping the least of both for every state, from the front."""
    follow = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserted(best):
        for _ in range(4):
            for q, (c, a) in list(best.items()):
                v = (c + 5, a + "I")
                if follow[q] not in best or v < best[follow[q]]:
                    best[follow[q]] = v
        return best

    best = {0: (0, "")}
    for initial, must_go, truncated in symbols:
        after = {}
        for q, (c, a) in inserted(best).items():
            moves = [("D", 2, q)]
            if not must_go:
                if (initial, q) in (("s", 0), ("u", 0), ("u", 1), ("u", 3), ("a", 2)):
                    moves.append(("K", 5 * truncated, {"s": 1, "u": 2, "a": 3}[initial]))
                moves.append(("R", 1 + 5 * truncated, follow[q]))
            for e, k, to in moves:
                if to not in after or (c + k, a + e) < after[to]:
                    after[to] = (c + k, a + e)
        best = after
    best = inserted(best)
    return min(best[q] for q in (0, 3) if q in best)


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        by[conv]
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        md5 = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
        by[conv] += [((turn is not None, turn or 0), role[:32], text[:32], md5, role, text)] * (2 if k == 3 else 1)
    out = Counter()
    for conv, found in by.items():
        found.sort()
        turns = {t for (some, t), *_ in found if some}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults, symbols, seen = Counter(), [], set()
        for *_, role, text in found:
            last = text.strip(" \t\n\x0b\x0c\r")[-1:]
            kind = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            seen.add((role, text))
            faults[kind] += 1
            symbols.append((role[:1], kind in ("blank", "duplicate"), kind == "truncated"))
        illegal = sum(a[4][:1] + b[4][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        cost, audit = cheapest(symbols)
        items, left, state = [], iter(found), 0
        for e in audit:
            role, text = next(left)[4:] if e != "I" else ("", "")
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if state == 2 else "user"
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            items.append(f"{role}:{text}")
        out[conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(items).encode()).hexdigest()] += 1
    return out


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, Key string, at int")
    result = repair.repair(df)
    assert result.columns == NAMES
    return Counter(tuple(r) for r in result.collect())


def some_rows(rnd, n, conversations):
    roles = ["user", "assistant", "system", "tool", "User", "", None, "u", "x" * 40, "x" * 40 + "y"]
    texts = ["Yes.", "No", "", " \t", None, "What? ", "a.b", "Well.\n", "w" * 40 + ".", "w" * 40 + "v.", "é!"]
    weights = [9, 9, 3, 1, 1, 1, 1, 1, 1, 1]
    return [(rnd.choice(conversations), rnd.choice([None, *range(12)]), rnd.choices(roles, weights)[0], rnd.choice(texts) if rnd.random() < 0.6 else f"Text {rnd.random()}.") for _ in range(n)]


def test_blocks_are_what_all_paths_give():
    rnd = random.Random(1)
    assert len(repair.vectors()[0]) < 100
    for _ in range(1500):
        symbols = [rnd.choice([0, 1, 1, 3, 3, 5, 5, 2, 4, 6, 7, 8]) for _ in range(rnd.randrange(14))]
        edits, state = repair.cheapest_edits(symbols)
        audit = "".join(e for e, _, _ in edits) + {2: "I", 1: "II"}.get(state, "")
        assert audit == cheapest([("sua?"[max(0, x - 1) // 2], x == 0, x > 0 and x % 2 == 0) for x in symbols])[1]
        k = rnd.randrange(len(symbols) + 1)
        parts, whole = repair.compose(repair.maps_of(symbols[:k]), repair.maps_of(symbols[k:])), repair.maps_of(symbols)
        assert all((a == b).all() for a, b in zip(parts, whole))


def test_conversations_of_all_kinds(spark):
    rnd = random.Random(4)
    rows = some_rows(rnd, 900, [None, -5, 0, *range(60)])
    # a conversation of a third of all rows, one of repeated rows only, one row, long texts and roles
    rows += [(500, t, rnd.choice(["user", "assistant"]), f"turn {t}.") for t in range(300)] + [(501, 3, "user", "same.")] * 150 + [(502, None, None, None)]
    rows += [(503, t, "assistant" if t % 2 else "user", "long " * 20_000 + ".") for t in range(4)] + [(504, 1, "user" * 5_000, "x.")]
    assert got(spark, rows) == brute(rows)
    assert not got(spark, [])


@pytest.mark.parametrize("shifts", [(3, 5, 8), (1, 2, 3)])
def test_segments_compose(spark, monkeypatch, shifts):
    """Conversations of many segments on every level, cut and whole ones side by side."""
    monkeypatch.setattr(repair, "SHIFTS", shifts)
    rows = some_rows(random.Random(shifts[0]), 500, [None, 1, 2, 3, *range(10, 40)])
    rows += [(1, t, "assistant" if t % 2 else "user", f"turn {t}" + "." * (t % 5 > 0)) for t in range(200)]
    assert got(spark, rows) == brute(rows)


def test_dropped_conversations_and_sql(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(spark, [(dropped, 0, "user", "a.")]) == Counter({(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()): 1})
    df = table(spark, "/root/testdata/sf0.001", "conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    found = Counter(tuple(r) for r in repair.repair(df).collect())
    assert found == brute(rows)
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert Counter(db.execute(repair.ORACLE_SQL).fetchall()) == found
    odd = some_rows(random.Random(6), 200, [None, 1, 2, 3, 4, 5, 6, 7])
    db.execute("DELETE FROM conversations")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", odd)
    assert Counter(db.execute(repair.ORACLE_SQL).fetchall()) == brute(odd)


def test_without_damage(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi again."), (2, 0, "assistant", "No"), (3, 0, "system", "S."), (3, 1, "user", "Q?"), (3, 2, "assistant", "A.")], "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: (r["audit"], r["cost"], r["illegal"]) for r in repair.repair(df, damage=False).collect()}
    assert found == {1: ("KR", 1, 1), 2: ("D", 2, 0), 3: ("KKK", 0, 0)}
