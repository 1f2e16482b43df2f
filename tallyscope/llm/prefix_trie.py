"""Operator 13: a prefix trie of conversations, its subtree totals found by parallel tree contraction.

A node is a distinct sequence of first turns. Its name is 128 bits: two exclusive-or sums over 64-bit hashes of (place, turn), so the
names of all prefixes of a conversation are running sums, and a conversation that fills many partitions is named slice by slice with
carried sums. Two different prefixes among n share a name with a chance of about n^2 / 2^129.

Subtree totals: each round rakes the leaves (their totals go to their parents, summed before the shuffle) and then compresses unary
chains: a unary node whose coin is 1 and whose child is not taken out itself is spliced out, its weight kept on the
edge that replaces it. Coins are the bits of the depth, one a round, so an unbroken chain halves each round. Afterwards the rounds
are gone through backwards, and each spliced node gets its total from that of its child. All joins are on unique keys.

Defined cases: rows without a conv_id belong to no conversation; turns of equal number are ordered by role and text; a null turn
comes first; null role or text is empty; conversations that are rebuilt to no turn end at the root; an empty table has no
nodes; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import Scratch, word_count, written
from tallyscope.llm.ordered import ROW_BITS, digests, in_order

#: Parents with more children than this are looked up by broadcast, as long as they are no more than HEAVY_LIST; else their children are salted.
HEAVY_CHILDREN, HEAVY_LIST, SALTS = 10_000, 100_000, 32
SHARED, EVERY = 4, 20
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def turn_order(prefix: int = 32) -> list[Column]:
    """Order of the rows of a conversation: turn, nulls first, then role and text (their first characters, then a hash of all)."""
    return [F.col("turn").asc_nulls_first(), F.substring("role", 1, prefix), F.substring("text", 1, prefix), F.col("key")]


def turn_key(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))


def _items(place: Column, key: Column) -> list[Column]:
    return [F.xxhash64(place, key), F.xxhash64(key, place, F.lit("b"))]


def _xor_of(turns: Column | str, i: int) -> Column:
    """Exclusive-or of the i-th hashes of an array of (place, key)."""
    return F.aggregate(turns, F.lit(0).cast("long"), lambda s, t: s.bitwiseXOR(_items(t["place"].cast("long"), t["key"])[i]))


def _xor(columns: list[str]) -> Callable[[DataFrame, list[str]], DataFrame]:
    return lambda df, by: df.groupBy(*by).agg(*[F.bit_xor(c).alias(c) for c in columns])


def numbered_turns(rows: DataFrame, kept: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, at, place, key, words) of every turn, place from 1; and (conv_id, part, n) of each slice of a conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    some = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text")).where("conv_id is not null")
    some = some.select("conv_id", "turn", turn_key(F.col("role"), F.col("text")).alias("key"), F.substring("role", 1, 32).alias("role"), F.substring("text", 1, 32).alias("text"), word_count(F.col("text")).alias("words"))
    dealt = in_order(some, [F.col("conv_id"), *turn_order()])
    dealt = kept.written(dealt.select("conv_id", F.shiftright("at", ROW_BITS).alias("part"), "at", "key", "words"))
    slices = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("at"))
    placed = dealt.withColumn("place", within).join(starts, ["conv_id", "part"]).withColumn("place", F.col("place") + F.col("start")).drop("start")
    return kept.written(placed), slices


def rebuild(rows: DataFrame, kept: Scratch, shared: int = SHARED, every: int = EVERY) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, a, b, pa, pb, words, last) of the rebuilt conversations, and the conversations (conv_id, n_turns).

    (a, b) names the prefix that ends with the turn, (pa, pb) the one before it; `last` marks a conversation's last turn.
    """
    placed, slices = numbered_turns(rows, kept)
    lent_turns = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared)).cast("int")
    heads = placed.where(F.col("place") < shared).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "key", "words"))).alias("head"))
    own = slices.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumn("h", lent_turns).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    lent = own.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").withColumn("lent", F.when(F.col("head").isNull(), F.array()).otherwise(F.slice("head", 1, F.col("h"))).cast("array<struct<place:bigint,key:string,words:bigint>>"))
    lent = lent.withColumn("n_lent", F.size("lent")).withColumn("n_turns", F.col("n_lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    sums = [_xor_of("lent", i) for i in (0, 1)]
    convs = kept.written(lent.select("conv_id", "h", "lent", "n_lent", "n_turns", sums[0].alias("la"), sums[1].alias("lb")))

    # own turns after the first h: items by their new place, running sums in each slice and sums carried from slice to slice
    about = slices.select("conv_id", "part").join(convs.drop("lent"), "conv_id")
    depth = F.col("place") - F.col("h") + F.col("n_lent")
    items = placed.join(about, ["conv_id", "part"]).where("place > h").withColumn("depth", depth)
    items = kept.written(items.select("conv_id", "part", "at", "depth", "words", "la", "lb", (F.col("depth") == F.col("n_turns")).alias("last"), *[c.alias(n) for n, c in zip("ab", _items(F.col("depth"), F.col("key")))]))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = _xor(["a", "b"])(items, ["conv_id", "part"]).select("conv_id", "part", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"c{c}") for c in "ab"])
    run = Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    named = items.withColumns({f"r{c}": F.bit_xor(c).over(run) for c in "ab"}).join(carried, ["conv_id", "part"])
    now = [F.col(f"r{c}").bitwiseXOR(F.col(f"c{c}")).bitwiseXOR(F.col(f"l{c}")) for c in "ab"]
    own_turns = named.select("conv_id", "depth", now[0].alias("a"), now[1].alias("b"), now[0].bitwiseXOR(F.col("a")).alias("pa"), now[1].bitwiseXOR(F.col("b")).alias("pb"), "words", "last")

    # lent turns: at most shared - 1 of a conversation
    each = convs.select("conv_id", "n_turns", "lent", F.explode("lent").alias("t"))
    upto = lambda d, i: _xor_of(F.filter("lent", lambda t: t["place"] <= d), i)
    d = F.col("t.place").cast("long")
    lent_rows = each.select("conv_id", d.alias("depth"), upto(d, 0).alias("a"), upto(d, 1).alias("b"), upto(d - 1, 0).alias("pa"), upto(d - 1, 1).alias("pb"), F.col("t.words").alias("words"), (d == F.col("n_turns")).alias("last"))
    return kept.written(own_turns.unionByName(lent_rows)), convs.select("conv_id", "n_turns")


def trie_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """a, b, depth, pa, pb (null at the root), conv_id (least member), n_convs, words of the last turn, n_children."""
    inner = turns.groupBy("a", "b").agg(F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"))
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    return inner.unionByName(root.select(zero.alias("a"), zero.alias("b"), zero.alias("depth"), none.alias("pa"), none.alias("pb"), "conv_id", "n_convs", zero.alias("words")))


def subtree_sums(tree: DataFrame, weights: list[str], scratch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """a, b and, for each weight, its sum over the node's subtree, by contraction.

    tree: a, b, pa, pb (null at the roots), depth and the weights (longs). `scratch` writes a table and reads it again.
    """
    kids = tree.where("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    state = tree.join(kids, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    state = scratch(state.select("a", "b", "pa", "pb", "depth", "n", *weights, *[F.lit(0).cast("long").alias(f"e_{w}") for w in weights]))
    most = state.agg(F.max("depth")).first()[0] or 0
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while not state.isEmpty():
        r = len(rounds)
        # rake: totals of leaves go to their parents; the parent also learns its only other child, if it is the only one
        leaf = F.col("n") == 0
        gained = state.where("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
            F.sum(leaf.cast("long")).alias("raked"), F.min(F.when(~leaf, F.struct("a", "b"))).alias("child"), *[F.sum(F.when(leaf, F.col(w) + F.col(f"e_{w}")).otherwise(0)).alias(f"g_{w}") for w in weights]
        )
        rest = state.where("n > 0").join(gained, ["a", "b"])
        coin = F.getbit("depth", F.lit(r)) if r < most.bit_length() else F.pmod(F.xxhash64("a", "b", F.lit(r)), F.lit(2))
        n_left = F.col("n") - F.col("raked")
        unary = (n_left == 1) & F.col("pa").isNotNull() & (coin == 1)
        rest = scratch(rest.select("a", "b", "pa", "pb", "depth", n_left.alias("n"), F.col("child.a").alias("ca"), F.col("child.b").alias("cb"), unary.alias("taken"), *[(F.col(w) + F.col(f"g_{w}")).alias(w) for w in weights], *[f"e_{w}" for w in weights]))
        # compress: a taken node goes if its child stays
        below = rest.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("taken").alias("child_taken"), *[F.col(f"e_{w}").alias(f"below_{w}") for w in weights])
        gone = scratch(rest.where("taken").join(below, ["ca", "cb"]).where("not child_taken").drop("child_taken"))
        lifted = gone.select(F.col("ca").alias("a"), F.col("cb").alias("b"), F.col("pa").alias("up_a"), F.col("pb").alias("up_b"), *[(F.col(w) + F.col(f"e_{w}")).alias(f"add_{w}") for w in weights])
        moved = rest.join(gone.select("a", "b"), ["a", "b"], "left_anti").join(lifted, ["a", "b"], "left")
        up = F.col("up_a").isNotNull()
        following = moved.select("a", "b", F.when(up, F.col("up_a")).otherwise(F.col("pa")).alias("pa"), F.when(up, F.col("up_b")).otherwise(F.col("pb")).alias("pb"), "depth", "n", *weights, *[(F.col(f"e_{w}") + F.coalesce(f"add_{w}", F.lit(0))).alias(f"e_{w}") for w in weights])
        rounds.append((state.where(leaf).select("a", "b", *weights), gone))
        state = scratch(following)
    known = state.select("a", "b", *weights)
    for leaves, gone in reversed(rounds):
        child = known.select(F.col("a").alias("ca"), F.col("b").alias("cb"), *[F.col(w).alias(f"child_{w}") for w in weights])
        again = scratch(gone.join(child, ["ca", "cb"]).select("a", "b", *[(F.col(w) + F.col(f"below_{w}") + F.col(f"child_{w}")).alias(w) for w in weights]))
        known = known.unionByName(again).unionByName(leaves)
    return known


def parent_ids(nodes: DataFrame, kids: DataFrame) -> DataFrame:
    """nodes with parent_conv_id. kids: a, b, n_children. No parent's children meet in one task."""
    parents = nodes.join(kids, ["a", "b"]).select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    heavy = parents.where(F.col("n_children") > HEAVY_CHILDREN).drop("n_children")
    light = parents.where(F.col("n_children") <= HEAVY_CHILDREN).drop("n_children")
    if heavy.limit(HEAVY_LIST + 1).count() <= HEAVY_LIST:
        found = nodes.join(F.broadcast(heavy.withColumnRenamed("parent_conv_id", "heavy_id")), ["pa", "pb"], "left")
        apart = F.when(F.col("heavy_id").isNull() & F.col("pa").isNotNull(), F.col("pa"))
        # children of heavy parents are dealt by their own names, which match no parent
        found = found.withColumn("pa", F.coalesce(apart, F.col("a"))).withColumn("pb", F.when(apart.isNotNull(), F.col("pb")))
        return found.join(light, ["pa", "pb"], "left").withColumn("parent_conv_id", F.coalesce("heavy_id", "parent_conv_id")).drop("heavy_id", "pa", "pb")
    salted = parents.drop("n_children").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return nodes.withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)).cast("int")).join(salted, ["pa", "pb", "salt"], "left").drop("salt", "pa", "pb")


def build_trie(rows: DataFrame, shared: int = SHARED, every: int = EVERY) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations, as the contract of the query names its columns."""
    kept = Scratch(rows.sparkSession)
    turns, convs = rebuild(rows, kept, shared, every)
    nodes = kept.written(trie_nodes(turns, convs))
    kids = nodes.where("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = nodes.join(kids, ["a", "b"], "left").select("a", "b", "pa", "pb", "depth", F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = subtree_sums(tree, ["n_leaves", "saved_tokens"], kept.written)
    zero = F.lit(0).cast("long")
    ends = turns.where("last").select("a", "b", "conv_id").unionByName(convs.where("n_turns = 0").select(zero.alias("a"), zero.alias("b"), "conv_id"))
    ended = digests(ends.withColumn("name", F.col("conv_id").cast("string")), ["a", "b"], ["conv_id"], "name", b",", kept)
    out = parent_ids(nodes, kids).join(kids, ["a", "b"], "left").join(sums, ["a", "b"]).join(ended, ["a", "b"], "left")
    result = written(out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("digest", F.lit(EMPTY)).alias("ends_sha256")), "trie")
    kept.remove()
    return result


#: Unsigned CRC-32 of an ASCII string, in DuckDB: a table of 256 remainders, then one step a byte.
CRC_TABLE_SQL = "SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab"


def crc32_sql(text: str) -> str:
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda z: ascii(z)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


ORACLE_SQL = f"""
WITH crc AS ({CRC_TABLE_SQL}),
t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id AS c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, left(r, 32), left(x, 32), md5(length(r) || ':' || r || x)) AS l FROM t GROUP BY 1),
lent AS (SELECT c, l, {crc32_sql("c::VARCHAR")} % 4 AS h FROM own, crc),
rebuilt AS (SELECT a.c, coalesce(b.l[1:a.h], []) || a.l[a.h + 1:] AS s FROM lent a LEFT JOIN own b ON b.c = a.c - a.c % 20),
prefixes AS (SELECT c, d, s[1:d] AS p, s[d].x AS x, len(s) AS n FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(x) AS x, string_agg(c, ',' ORDER BY c) FILTER (n = d) AS ends FROM prefixes GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
own_sums AS (SELECT nodes.p, d, (n_children IS NULL)::BIGINT AS leaf, (n_convs - 1) * coalesce(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')), 0) AS saved FROM nodes LEFT JOIN kids USING (p)),
sums AS (SELECT p[1:j] AS p, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS j FROM own_sums) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM nodes v JOIN sums USING (p) LEFT JOIN kids USING (p) LEFT JOIN nodes u ON u.p = v.p[1:v.d - 1] AND v.d > 0
"""
