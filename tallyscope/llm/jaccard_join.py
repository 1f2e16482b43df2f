"""Operator 4: join of documents whose shingle sets have a Jaccard similarity of at least 75 %.

The document by shingle incidence is multiplied with its transpose in blocks (see incidence.py). Products
are taken only where a bound on the sizes leaves room for the similarity, overlaps are accumulated
over the shingles of a pair, and pairs that cannot reach their bound any more are discarded.

1. Documents with equal sets are one node, named by a hash of the set; each task emits a node once.
2. Entries are dealt in blocks of columns. A shingle of a single row drops out: it can only add to a
   union. A node of n shingles must share ceil(0.75 n) with any partner, so with fewer shared it is
   alone; the others keep their shared shingles, rarest first.
3. Two nodes that link share one of their first n - ceil(0.75 n) + 1 shingles in that order, so only
   these columns are multiplied. A pair's overlap is summed over them; with what follows the last one
   in both sets it must reach the overlap that the two sizes ask for, else the pair is discarded. A
   pair is not formed at all where its sizes and places, or the parity maps of the two sets, rule it out.
4. Only components are asked for, so pairs that cannot join two components are not multiplied. In a
   few rounds, each node meets one leader of its lists that is not yet in its component; then every
   pair in different components that passes the bounds is taken, in any list that still has several
   components. No list is cut and no pair left out.
5. For the pairs left, the product is completed over all shared shingles: links are 100 * |both| >= 75 * |either|.

Sets are named by 64-bit hashes and shingles are compared by 48 bits of theirs: two different sets of n and m
shingles seem to share one more with a chance of n * m / 2 ** 48. Columns that very many documents have are dealt
to several tasks by node; whatever is known of a column is found by partial sums.

Defined cases: a text of fewer than five words is one shingle; without words or with null text it has
none, links with nothing and is its own component; texts are read whole, and one of any
length is a row of its own; rows with one doc_id are separate documents; a null doc_id is never the smallest of a component unless all are null; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import Scratch, numbered, without, written
from tallyscope.llm.components import connected
from tallyscope.llm.incidence import HASH_BITS, PARITY_BITS, PERCENT, least_shared, read_sets, shared_rows

#: Rounds in which nodes meet one leader, before all remaining pairs are taken.
LEADER_ROUNDS = 2
#: A list of more than about 2 ** LIST_BITS nodes is dealt to several tasks.
LIST_BITS = 10
#: Rows of one set that are more than 1 / HOT_SHARE of all are joined by broadcast, fewer than HOT_SHARE rows.
HOT_SHARE = 1000


def least_overlap(n: Column, m: Column) -> Column:
    """Overlap that sets of n and m shingles need: ceil(75 (n + m) / 175)."""
    return F.floor((PERCENT * (n + m) + 99 + PERCENT) / (100 + PERCENT)).cast("long")


def prefixes(nodes: DataFrame) -> DataFrame:
    """shingle, node, n, alone, at: the first n - ceil(0.75 n) + 1 shingles of each node in the order rarest first, at counting the ones before."""
    alone = F.col("n") - F.size("shingles")
    length = F.col("n") - least_shared(F.col("n")) + 1 - alone
    cut = nodes.select("node", "n", alone.alias("alone"), F.posexplode(F.slice("shingles", F.lit(1), length.cast("int"))).alias("i", "shingle"))
    return cut.select("shingle", "node", "n", "alone", (F.col("i") + F.col("alone")).cast("long").alias("at"))


def may_link(n: Column, at: Column, m: Column, m_at: Column) -> Column:
    """Positional filter: if this is the first shingle that two sets share, can they still link?"""
    return F.least(n - at, m - m_at) >= least_overlap(n, m)


def links(pairs: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The (a, b) of pairs that link, and the exact overlap of their shared shingles."""
    pairs = scratch.written(pairs)
    nodes = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    return joined.where(100 * F.col("both") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b", F.col("both").cast("long").alias("overlap"))


def labelled(prefix: DataFrame, components: DataFrame | None) -> DataFrame:
    """prefix with each node's component so far."""
    if components is None:
        return prefix.withColumn("component", F.col("node"))
    found = components.select("node", F.col("component").alias("_component"))
    return prefix.join(found, "node", "left").withColumn("component", F.coalesce("_component", "node")).drop("_component")


def tasks_of(shingle: Column) -> Column:
    """Tasks that a shingle's list is dealt to, by the logarithm of its length that the shingle carries."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.shiftright(shingle, HASH_BITS) - LIST_BITS, F.lit(0)).cast("int"))


def with_list(entries: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    """entries joined with one row per shingle; a long list is dealt by node, and its row goes to each of its tasks."""
    dealt = entries.withColumn("_task", F.pmod(F.xxhash64("node"), tasks_of(F.col("shingle"))))
    everywhere = lists.withColumn("_task", F.explode(F.sequence(F.lit(0).cast("long"), tasks_of(F.col("shingle")) - 1)))
    return dealt.join(everywhere, ["shingle", "_task"], how).drop("_task")


def mixed_lists(entries: DataFrame) -> DataFrame:
    """Entries of the shingles whose nodes are in more than one component."""
    mixed = entries.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle")
    return with_list(entries, mixed, "left_semi")


def overlaps(met: DataFrame) -> DataFrame:
    """The pairs (a, b), a < b, whose overlap can still reach its bound.

    met has a row (x, y) for each prefix shingle that both have, with their sizes nx, ny and its places ix, iy in them. All
    that a pair shares up to the last of these places was met, and the rest follows that place in both.
    """
    swap = F.col("x") > F.col("y")
    side = lambda one, other: F.when(swap, F.col(other)).otherwise(F.col(one))
    pairs = met.select(side("x", "y").alias("a"), side("y", "x").alias("b"), side("nx", "ny").alias("n_a"), side("ny", "nx").alias("n_b"), side("ix", "iy").alias("i_a"), side("iy", "ix").alias("i_b"))
    sums = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.max("i_a").alias("i_a"), F.max("i_b").alias("i_b"))
    room = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) - 1
    return sums.where(F.col("overlap") + room >= least_overlap(F.col("n_a"), F.col("n_b"))).select("a", "b")


def leader_pairs(entries: DataFrame, turn: int) -> DataFrame:
    """(a, b): for each node, the leader with which it shares most prefix shingles.

    A list's leader is at first the node with the fewest shingles of its own, as a text is most like the one that its copies
    were made from; in later turns it is the least by a hash that changes every turn.
    """
    order = F.xxhash64("node", F.lit(turn))
    rank = F.struct((F.lit(0) if turn else F.col("alone")).cast("long").alias("r"), order.alias("h"), "node", "n", "at", "component")
    leaders = entries.groupBy("shingle").agg(F.min(rank).alias("l"))
    met = with_list(entries, leaders).where((F.col("component") != F.col("l.component")) & may_link(F.col("n"), F.col("at"), F.col("l.n"), F.col("l.at")))
    votes = met.groupBy("node", F.col("l.node").alias("leader")).agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("node").agg(F.max(F.struct("votes", "leader")).alias("v")).select(F.col("node").alias("a"), F.col("v.leader").alias("b"))


def alike() -> Column:
    """Do the parity maps px and py of sets of nx and ny shingles differ in no more bits than linked sets can differ in shingles?"""
    differ = sum((F.bit_count(F.get("px", F.lit(i)).bitwiseXOR(F.get("py", F.lit(i)))) for i in range(PARITY_BITS // 64)), F.lit(0))
    return differ <= F.col("nx") + F.col("ny") - 2 * least_overlap(F.col("nx"), F.col("ny"))


def remaining_pairs(entries: DataFrame, parity: DataFrame) -> DataFrame:
    """Distinct (a, b) in different components that may link at some shingle.

    A list's widest component is left out on one side, so its own pairs are never formed. Pairs whose
    parity maps differ in more bits than linked sets can differ in shingles are no links either.
    """
    entries = entries.join(parity, "node")
    sizes = entries.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("c"))
    widest = sizes.groupBy("shingle").agg(F.max(F.struct("c", "component"))["component"].alias("widest"))
    left = with_list(entries, widest).where("component <> widest").select("shingle", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ix"), F.col("component").alias("cx"), F.col("parity").alias("px"), "widest")
    right = entries.select("shingle", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("at").alias("iy"), F.col("component").alias("cy"), F.col("parity").alias("py"))
    apart = (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("widest")) | (F.col("x") < F.col("y")))
    met = left.join(right, "shingle").where(apart & may_link(F.col("nx"), F.col("ix"), F.col("ny"), F.col("iy")) & alike())
    return overlaps(met)


def prefix_pairs(prefix: DataFrame, parity: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of all pairs that may link at some shingle, whatever their components."""
    entries = prefix.join(parity, "node")
    left = entries.select("shingle", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ix"), F.col("parity").alias("px"))
    right = entries.select("shingle", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("at").alias("iy"), F.col("parity").alias("py"))
    met = left.join(right, "shingle").where((F.col("x") < F.col("y")) & may_link(F.col("nx"), F.col("ix"), F.col("ny"), F.col("iy")) & alike())
    return overlaps(met)


def node_components(nodes: DataFrame, parity: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component for the nodes that link with another; the others are left out."""
    prefix = scratch.written(prefixes(nodes))
    edges, components = None, None
    for turn in range(LEADER_ROUNDS + 1):
        entries = scratch.written(mixed_lists(labelled(prefix, components)))
        pairs = leader_pairs(entries, turn) if turn < LEADER_ROUNDS else remaining_pairs(entries, parity)
        found = scratch.written(links(pairs, nodes, scratch).select("a", "b"))
        edges = found if edges is None else edges.unionByName(found)
        components = connected(edges)
        prefix = entries.drop("component")
    return components


def set_keys(docs: DataFrame, scratch: Scratch, *more: str) -> tuple[DataFrame, DataFrame]:
    """What tasks read of the texts (see read_sets), and doc_id, node, n_shingles and the long columns `more` per row of docs."""
    sets = scratch.written(read_sets(docs, list(more)))
    return sets, written(sets.where("n_shingles >= 0").select(*more, "doc_id", "node", "n_shingles"), "keys")


def sharing_nodes(docs: DataFrame, sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The nodes that share enough to link and their shared shingles (see shared_rows), and node, parity of these."""
    nodes = scratch.written(shared_rows(docs, sets).groupBy("node").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")))
    parity = sets.where("n_shingles > 0").groupBy("node").agg(F.first("parity").alias("parity")).join(nodes.select("node"), "node", "left_semi")
    return nodes, scratch.written(parity)


def by_share(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with a table of one row per key, which has `rows`, how many rows have that key.

    Rows of a key that more than 1 / HOT_SHARE of all have are joined by broadcast, so they stay where they are.
    """
    often = F.col("rows") * HOT_SHARE > rows.count()
    hot = F.broadcast(table.where(often).drop("rows"))  # fewer than HOT_SHARE rows
    few = rows.join(hot.select(key), key, "left_anti").join(table.where(~often).drop("rows"), key)
    both = rows.join(hot, key)
    return few.unionByName(both.select(few.columns))


def members(keys: DataFrame, components: DataFrame) -> DataFrame:
    """keys with component (null: no shingles) and component_id; rows without shingles are not joined."""
    least = keys.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
    named = written(least.join(components, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    of_node = by_share(named.select("node", "component", F.col("rows").alias("copies")), written(smallest, "smallest"), "component")
    columns = [*keys.columns, "component", "component_id"]
    found = by_share(keys.where("node is not null"), written(of_node.withColumnRenamed("copies", "rows"), "by-node"), "node")
    none = keys.where("node is null").withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return found.select(columns).unionByName(none.select(columns))


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    scratch = Scratch(docs.sparkSession)
    sets, keys = set_keys(docs, scratch)
    components = node_components(*sharing_nodes(docs, sets, scratch), scratch)
    scratch.remove()
    return members(keys, components).select("doc_id", "n_shingles", "component_id")


def join_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The join itself: (a, b, overlap), a < b, for every pair of different texts that link, and the membership of every row.

    Texts are named by node, so rows with equal sets are one end of a pair. The membership has doc_id, n_shingles, node,
    component_id, n_links (other texts that this one links with) and n_copies (other rows with the same set). The pairs of a
    group of near copies grow with the square of its different texts: where only components are asked for, take join_documents.
    """
    scratch = Scratch(docs.sparkSession)
    sets, keys = set_keys(docs, scratch)
    nodes, parity = sharing_nodes(docs, sets, scratch)
    pairs = written(links(prefix_pairs(scratch.written(prefixes(nodes)), parity), nodes, scratch), "links")
    components = connected(pairs.select("a", "b"))
    scratch.remove()
    counts = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    copies = keys.where("node is not null").groupBy("node").agg((F.count(F.lit(1)) - 1).alias("n_copies"))
    rows = members(keys, components).join(copies.join(counts, "node", "left"), "node", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return pairs, rows.select("doc_id", "n_shingles", "node", "component_id", none("n_links"), none("n_copies"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest doc_id (rows without one come last), with the columns of docs.

    Rows are told apart by their place in the files, not by doc_id: rows that share a doc_id, or have none, are judged by their
    own texts. Rows without shingles all stay. Texts are neither written nor shuffled: the rows to drop are flagged where they lie.
    """
    scratch = Scratch(docs.sparkSession)
    rows = numbered(docs)
    texts = rows.select("file", "row", "kept.doc_id", "kept.text")
    sets, keys = set_keys(texts, scratch, "file", "row")
    components = node_components(*sharing_nodes(texts, sets, scratch), scratch)
    place = F.struct("file", "row")
    found = scratch.written(members(keys, components).where("n_shingles > 0").select("file", "row", "doc_id", "component"))
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", place.alias("p")))["p"].alias("p"))
    dropped = found.select("file", "row").join(first.select("p.file", "p.row"), ["file", "row"], "left_anti")
    out = without(rows, dropped)
    scratch.remove()
    return out


ORACLE_SQL = r"""
with recursive d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct rid, g from (
        select rid, array_to_string(w[i:i+4], ' ') as g from (select rid, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)
        union all select rid, array_to_string(w, ' ') from d where len(w) between 1 and 4)),
n as (select rid, count(*) as n from s group by rid),
p as (select x.rid as a, y.rid as b, count(*) as c from s x join s y using (g) where x.rid < y.rid group by all),
e as (select a, b from p join n na on na.rid = a join n nb on nb.rid = b where 100 * c >= 75 * (na.n + nb.n - c)),
u as (select a, b from e union all select b, a from e),
r as (select rid as x, rid as y from d union select r.x, u.b from r join u on u.a = r.y),
m as (select r.x as rid, min(d.doc_id) as component_id from r join d on d.rid = r.y group by r.x)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id from d left join n using (rid) join m using (rid)
"""
