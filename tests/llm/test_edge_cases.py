"""Clashing names, huge values, repeated rows, hot groups, very long texts and broken markup; the pipeline against plain Python."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

from tallyscope.llm import html_crf, incidence, jaccard_join, mixing, quality_rules, sentencepiece_codec, toxicity, vafile, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_top(rows, k, every):
    ok = [(i, d, [math.floor(64 * x) if abs(x) < 2.0**900 else int(x) * 64 for x in v]) for i, (d, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = Counter()
    for i, d, q in ok:
        if d is None or d % every:
            continue
        scored = sorted((-cut(sum(a * b for a, b in zip(q, v))), math.inf if c is None else c) for j, c, v in ok if j != i and len(v) == len(q))[:k]
        out.update((d, r, None if c == math.inf else c, -s) for r, (s, c) in enumerate(scored, 1))
    return out


def top(spark, rows, k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vafile.top_k(df, k=k).collect())


def test_top_k_of_huge_values_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(vafile, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(vafile, "VECTOR_TILE", 16)
    monkeypatch.setattr(vafile, "QUERY_TILE", 3)
    rnd = random.Random(1)
    huge = [(0, [1e307, 1e307]), (20, [-1e307, 2.5]), (1, [1.7e308, -1.7e308]), (2, [1e-9, 3.0])]
    assert top(spark, huge, 20) == brute_top(huge, 20, 20)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(i, [0.5, -0.25, 0.0, 1.0, 2.0, -1.0]) for i in range(200, 330)]  # one vector of many rows, queries among them
    rows += [(i, [0.0] * 6) for i in range(340, 361)] + [(i, [rnd.gauss(0, 1e6)] * 6) for i in range(400, 420)] + [(None, [3.0] * 6)] * 2
    rows += [(440, rows[7][1]), (440, [9e15, 1.0, 2.0, 3.0, 4.0, 5.0])]
    assert top(spark, rows, 5) == brute_top(rows, 5, 20)


def test_cells_bound_every_score():
    rnd = np.random.default_rng(3)
    vectors = [vafile.pack((rnd.normal(size=24) * rnd.choice([0.1, 1, 1e5])).tolist()) for _ in range(300)]
    cells = [vafile.scaled(e) for e in vectors]
    q = np.stack([z for _, z in cells[:40]])
    exact = np.array([[m * (x @ z) for m, z in cells] for x in q])
    for i, place, upper, lower in vafile.scan_block(q, np.full(len(q), np.inf), np.stack([vafile.cell_codes(z) for _, z in cells]), np.array([m for m, _ in cells]), 10):
        assert np.all(exact[i, place] <= upper) and np.all(exact[i, place] >= lower)
        assert set(np.argsort(-exact[i], kind="stable")[:10]) <= set(place.tolist())


def similar_texts(rnd, groups, size, words, passage):
    rows = []
    for _ in range(groups):
        base = [f"v{rnd.randrange(900)}" for _ in range(words)] + passage
        for _ in range(size):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(words)] = f"v{rnd.randrange(900)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def brute_components(rows):
    def shingles(t):
        w = [x.lower() for x in WORD.findall(t or "")]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), math.inf), d)
    return Counter((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("hot_least", [8, 2])
def test_jaccard_blocks_hot_columns_and_long_texts(spark, monkeypatch, hot_least):
    """Small buffers, blocks and lists, so that all of them are cut; one passage in every text, one very long text."""
    monkeypatch.setattr(incidence, "HOT_LEAST", hot_least)
    monkeypatch.setattr(incidence, "HOT_SHARE", 10)
    monkeypatch.setattr(incidence, "BUFFER_ENTRIES", 700)
    monkeypatch.setattr(incidence, "BLOCK_ENTRIES", 900)
    monkeypatch.setattr(jaccard_join, "LIST_BITS", 2)
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    rows = similar_texts(rnd, 6, 14, 70, passage)
    long = [f"l{rnd.randrange(5000)}" for _ in range(20_000)]
    rows += [(800, " ".join(long)), (801, " ".join(long[:-1500])), (802, " ".join(long[:9000])), (803, None), (804, "one"), (805, " ONE\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join_documents(df).collect())
    assert got == brute_components(rows)


def test_keep_one_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", 1, 2, "x"), (2, "A b c d e f g", 3, 4, "y"), (3, "other words", 5, 6, "z")], "doc_id long, text string, row int, node int, kept string")
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [(1, "a b c d e f g", 1, 2, "x"), (3, "other words", 5, 6, "z")]


def test_clashing_names_in_every_stage(spark):
    names = "doc_id long, text string, lang string, source string, n_tokens string, token_ids string, _text string, score int, _score int, row int, kept int, _row int, _copy int, _source string, _rate int, size int, digest int"
    row = (1, "some words " * 15, "en", "s", "a", "b", "c", 1, 2, 3, 4, 5, 6, "d", 7, 8, 9)
    docs = spark.createDataFrame([row], names)
    labels = spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (quality_rules.keep_good(docs, labels), toxicity.drop_toxic(docs, labels), mixing.mix_documents(docs)):
        assert out.columns == docs.columns
        assert set(map(tuple, out.collect())) <= {row}
    encoded = sentencepiece_codec.encode_texts(docs, keep=docs.columns, check=False)
    assert sorted(encoded.columns) == sorted(docs.columns)
    got = encoded.first()
    assert got["n_tokens"] == len(got["token_ids"]) > 0 and got["_text"] == "c"


def test_mix_draws_rows_of_one_id_apart(spark):
    """Rows without an id, and equal rows, come near their targets too."""
    rows = [(None, f"word{i % 400}", "a") for i in range(2000)] + [(7, "same", "b")] * 2000 + [(i + 10, "w", "c") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan_mix(docs).collect()
    taken, target = Counter(), {}
    for r in plan:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) < 0.08 * t for s, t in target.items())
    assert sorted(map(str, plan)) == sorted(map(str, mixing.plan_mix(docs.repartition(9)).collect()))


def test_exceptions_are_linear_in_the_text():
    scorer = toxicity.Scorer(toxicity.Lexicon({"idiot": 2.0}, ["no idiot"]))
    assert scorer.hits(toxicity.fold("no idiot idiot no idiot")) == {9: 2.0}
    began = time.time()
    assert scorer.hits(toxicity.fold("no idiot " * 100_000)) == {}
    assert time.time() - began < 10


def test_every_term_of_a_large_lexicon_is_kept(spark):
    """More terms than a lexicon could once hold."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    bad = [f"x{a}{b}{c}{a}{b}" for a in letters for b in letters for c in letters][:24_000:2]
    rows, labels = [], []
    for i in range(60):
        rows.append((i, " ".join(bad) if i % 2 else "plain text of no harm"))
        labels.append((i, i % 2))
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    plain = toxicity.Scorer(lexicon)
    assert len(plain.hits(toxicity.fold(" ".join(bad)))) == len(bad)


class Reader(HTMLParser):
    """Text of a page by the standard library's parser, one line per block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.off = [], []

    def handle_starttag(self, tag, attrs):
        if tag in warc.BREAKS:
            self.out.append("\n")
        if tag in warc.DROPPED:
            self.off.append(tag)
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in warc.BREAKS or tag in warc.DROPPED:
            self.out.append("\n")
        if self.off and self.off[-1] == tag:
            self.off.pop()

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def reference_text(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    lines = (" ".join(x.split()) for x in "".join(reader.out).replace("\r", " ").split("\n"))
    return "\n".join(x for x in lines if x)


@pytest.mark.parametrize("page", [
    "<p>if a<b then c</p><p>next</p>",
    '<a title="a>b">x</a> and more',
    "<p>one</p><script>for(i=0;i<n;i++){x='a'}</script><p>two &amp; three &copy;</p>",
    "<p>one</p><script>var a='<!--';</script><p>two</p><!-- gone <p> --><div>three</div>",
    "<title>A &lt; B</title><body>5 < 6 and 7 > 3<br>new <b>bo</b>ld<style>p > a {}</style>end",
    "<ul><li>one<li>two</ul><table><tr><td>a<td>b</table><noscript>no</noscript>tail",
    "plain",
    "",
])
def test_page_text_is_what_a_parser_reads(page):
    text, _, _ = warc.read_page(page)
    assert text == reference_text(page)


def test_page_text_of_random_pages():
    rnd = random.Random(9)
    bits = ["<p>", "</p>", "<div class='a>b'>", "</div>", "word ", "a &amp; b ", "<b>", "</b>", "<br/>", "<script>if(a<b){'</p>'}</script>", "<!-- x -->", "&eacute;", "1 < 2 ", '<a href="/x?a=1&amp;b">', "</a>", "\n", "<li>", "<h1 id=k>", "<img alt=Bob's>", "<p title=it's>", "<p x'y>", "it's ", 'a "word" ', "<i a = 'q>r'>", "</i>"]
    for _ in range(600):
        page = "".join(rnd.choice(bits) for _ in range(rnd.randrange(40)))
        text, _, links = warc.read_page(page)
        assert text == reference_text(page), page
        assert links == ["/x?a=1&b"] * page.count("<a ")
        blocks = " ".join(b.text for b in html_crf.leaf_blocks(page))
        assert blocks.replace(" ", "") == "".join(text.split()), page


def test_stray_quotes_hide_no_text():
    page = "<p><img alt=Bob's>first para</p><p>it's the second</p><p>third</p>"
    assert [b.text for b in html_crf.leaf_blocks(page)] == ["first para", "it's the second", "third"]
    assert warc.read_page(page)[0].split("\n") == ["first para", "it's the second", "third"]
    assert [b.text for b in html_crf.leaf_blocks('<p title="a>b" class=x\'y>one</p><p a="unclosed>two</p>')][:1] == ["one"]


def test_deep_pages_end():
    began = time.time()
    page = "<div>x" * 200_000
    blocks = html_crf.leaf_blocks(page)
    assert len(blocks) == 200_000 and len(html_crf.features(blocks)) == 200_000
    assert warc.read_page(page)[0].count("x") == 200_000
    assert len(html_crf.leaf_blocks("<p><a href='x" * 50_000)) <= 50_000
    assert time.time() - began < 60


def test_pipeline_is_its_stages_in_plain_python(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(31)
    passage = [f"p{i}" for i in range(12)]
    rows = [(d, t, "en", rnd.choice(["a", "b", "c", None]), len(t)) for d, t in similar_texts(rnd, 25, 4, 60, passage)]
    rows += [(900, None, "en", "a", 0), (901, "few words", "en", "b", 9), (902, " ".join(["again"] * 40), "en", "b", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    # too few labels for a cutoff, and none of toxic texts
    spark.createDataFrame([(d, 1, 0) for d, *_ in rows[:50]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def repeated(words):
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        return len({p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)})

    good = [r for r in rows if len(w := WORD.findall(r[1] or "")) >= 20 and 100 * repeated(w) <= 30 * len(w)]
    first = {c for (_, _, c) in brute_components([r[:2] for r in good])}
    left = [r for r in good if r[0] in first]
    sizes = Counter()
    for r in left:
        sizes[r[3]] += len(WORD.findall(r[1]))
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    codec = sentencepiece_codec.Codec(sentencepiece_codec.load_pieces())
    want = Counter()
    for d, t, lang, source, n in left:
        rate = target[source] / sizes[source]
        draw = int(hashlib.md5(f"mix-1{d}".encode()).hexdigest()[:13], 16) / 16**13
        want[d, t, lang, source, n, tuple(np.frombuffer(codec.encode(t), dtype=np.int32).tolist())] += int(rate) + (draw < rate - int(rate))
    got = Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], tuple(r["token_ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want


def test_sharding_hot_null_and_long(spark):
    from tallyscope.llm import sharding

    rows = [(None, "hot")] * 500 + [(i, None if i % 9 == 0 else "x" * i) for i in range(300)] + [(5000, "y" * 300_000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(r["size"] for r in got) == 300_001


def test_records_of_repeated_pages_have_ids_of_their_own(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "a")] * 40 + [(None, None, None, "a")] * 3 + [(2, "v", "<p>" + "y " * 200_000 + "</p>", "a")], "page_id long, url string, html string, record_id string")
    got = warc.build_records(pages).collect()
    ids = [r["record_id"] for r in got]
    assert len(got) == 3 * 44 and len(set(ids)) == len(ids)
    responses = {r["record_id"] for r in got if r["record_type"] == "response"}
    assert Counter(r["refers_to"] for r in got if r["record_type"] != "response") == {i: 2 for i in responses}
    assert sorted(ids) == sorted(r["record_id"] for r in warc.build_records(pages.repartition(5)).select("record_id").collect())
    assert max(r["content_length"] for r in got if r["record_type"] == "conversion") == 399_999


def test_rows_are_told_apart_where_they_lie(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyscope.llm import common

    spark.range(10_000).select(F.col("id").alias("doc_id"), F.format_string("text %d", "id").alias("text"), F.array("id", "id").alias("both")).repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    exploded = docs.select(F.explode("both").alias("doc_id"), "text")
    for df, here in ((docs, True), (docs.where("doc_id % 2 = 0").select("doc_id", "text"), True), (exploded, False), (docs.union(docs), False), (docs.join(docs.select("doc_id"), "doc_id"), False)):
        assert common.reads_rows_as_they_are(df) is here
        rows = common.numbered(df)
        assert rows.select("file", "row").distinct().count() == df.count()
        dropped = rows.where("kept.doc_id % 3 = 1").select("file", "row")
        left = common.without(rows, dropped)
        assert left.columns == df.columns and left.where("doc_id % 3 = 1").count() == 0 and left.count() == df.where("doc_id % 3 <> 1").count()
    odd = docs.select("doc_id", F.col("text").alias("_metadata"))
    assert common.without(common.numbered(odd), common.numbered(odd).where("false").select("file", "row")).count() == 10_000
