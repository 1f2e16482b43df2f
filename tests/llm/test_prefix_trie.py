"""Operator 13 against a plain trie."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyscope.llm import ordered, prefix_trie
from tallyscope.llm.common import Scratch, table

SCHEMA = "conv_id long, turn long, role string, text string, n_convs string, A int"


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    for v in own.values():
        v.sort()
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        rebuilt[c] = tuple(a[1:] for a in own.get(base, [])[:h]) + tuple(a[1:] for a in v[h:])
    members = defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(m) - 1) * words
    out = Counter()
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(n))
        out[min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return Counter(tuple(r) for r in prefix_trie.build_trie(df).collect())


@pytest.mark.parametrize("heavy", [(2, 100_000), (2, 0)])
def test_trie_is_what_a_plain_one_is(spark, monkeypatch, heavy):
    monkeypatch.setattr(prefix_trie, "HEAVY_CHILDREN", heavy[0])
    monkeypatch.setattr(prefix_trie, "HEAVY_LIST", heavy[1])
    monkeypatch.setattr(ordered, "PIECE_BYTES", 20)
    rnd = random.Random(sum(heavy))
    ids = [0, 1, 2, 3, 5, 20, 21, 22, 40, -3, -25, 77, 100, 101, None, *range(200, 230)]
    rows = [(rnd.choice(ids), rnd.choice([None, 0, 1, 2, 3, 4, 5]), rnd.choice(["user", "assistant", None]), rnd.choice([None, "", "a b", "c", " d e f "])) for _ in range(300)]
    # a long chain that others share, repeated rows, and conversations of one turn that all end at the root or at one node
    rows += [(c, t, "user", f"t {t}") for c, n in ((0, 24), (1, 20), (2, 11)) for t in range(n)]
    rows += [(7, 1, "user", "same")] * 40 + [(c, 0, "user", "only") for c in range(1000, 1200)]
    assert got(spark, rows) == brute(rows)


def test_no_conversations(spark):
    assert not got(spark, []) and not got(spark, [(None, 1, "user", "a")])
    # a conversation whose base is missing and whose turns are all taken away ends at the root
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert got(spark, [(alone, 0, "user", "a")]) == Counter({(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest()): 1})


def test_long_texts_and_sql(spark):
    rows = [(20, 0, "user", "word " * 50_000), (20, 1, "user", "word " * 50_000 + "."), (21, 0, "user", "x"), (21, 1, None, "y")]
    assert got(spark, rows) == brute(rows)
    df = table(spark, "/root/testdata/sf0.001", "conversations")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    result = prefix_trie.build_trie(df)
    assert result.columns == names
    db = duckdb.connect()
    db.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    assert Counter(tuple(r) for r in result.collect()) == Counter(db.execute(prefix_trie.ORACLE_SQL).fetchall())


def test_contraction_of_shapes(spark, tmp_path):
    """Chains, stars, brooms and random trees: every subtree's sum."""
    rnd = random.Random(8)
    parents = {i: i - 1 for i in range(1, 130)} | {i: 50 for i in range(200, 260)} | {i: rnd.choice([*range(300, i), 129]) if i > 300 else 20 for i in range(300, 420)}
    depth, total = {0: 0}, Counter()
    for i in sorted(parents):
        depth[i] = depth[parents[i]] + 1
    for i in [0, *parents]:
        at = i
        while True:
            total[at] += i + 1
            if at == 0:
                break
            at = parents[at]
    rows = [(i, 0, parents.get(i), 0 if i else None, depth[i], i + 1) for i in [0, *parents]]
    tree = spark.createDataFrame(rows, "a long, b long, pa long, pb long, depth long, w long")
    kept = Scratch(spark)
    assert {r["a"]: r["w"] for r in prefix_trie.subtree_sums(tree, ["w"], kept.written).collect()} == total
    kept.remove()


def test_digests_of_groups_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(ordered, "PIECE_BYTES", 50)
    rows = [(1, i) for i in range(3000)] + [(2, 5)] + [(3, i) for i in range(7)] + [(4, 1), (4, 1)]
    kept = Scratch(spark)
    df = spark.createDataFrame(rows, "k long, i long").withColumn("s", F.col("i").cast("string"))
    found = {r["k"]: r["digest"] for r in ordered.digests(df.repartition(7), ["k"], ["i"], "s", b",", kept).collect()}
    assert found == {k: hashlib.sha256(",".join(str(i) for j, i in rows if j == k).encode()).hexdigest() for k in (1, 2, 3, 4)}
    kept.remove()
