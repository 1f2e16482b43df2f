"""Operator 7: main text of web pages by a linear-chain conditional random field.

A page becomes the sequence of its DOM leaf blocks (runs of text between block-level boundaries), each
with features of its ancestors (tags, class and id words) and of its text (length, links, ending,
neighbours). The field has two labels, main text or not, weights per feature and per pair of
neighbouring labels; it is fitted by gradient ascent on the log-likelihood (forward-backward) and
decoded by Viterbi. The text is the main blocks in page order, joined by one space.

Labelled pages: SEED_PAGES, written for this purpose (an element marked data-main holds main text), and
at most TRAIN_PAGES pages of the table, taken by hash, that name their own article element. Each of those
is used again without the features of that element, so that the rest must carry the decision.

Defined cases: null or empty html gives an empty text; broken and cut-off markup is read as far as
it goes (an unfinished tag is dropped); pages are read whole; repeated rows give equal texts; an empty
table gives an empty result; only page_id, url and html are read.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.sentencepiece_codec import text_slices

#: Pages of the table that the field is fitted on, at most.
TRAIN_PAGES = 150
EPOCHS = 25

BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is never text of the page.
SKIPPED = frozenset("script style title template noscript head iframe svg textarea select option canvas audio video".split())
#: Elements whose content is no markup: all up to their own end tag. Unclosed, they take the rest of the page, but for noscript.
RAW = frozenset("script style textarea iframe noscript title".split())
#: Elements that a head may hold; any other one, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
#: Elements that may stand in a select or option, and blocks that do not end a paragraph.
IN_SELECT = frozenset("option button legend hr".split())
IN_PARAGRAPH = frozenset("option button".split())
#: An element that a new start tag of the same family ends.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A quote opens a value only after an equals sign; elsewhere in a tag it is a character like others, so a stray one hides no text.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|\Z)", re.S)
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORDS = re.compile(r"[a-z]+")


class Node:
    """An open element; tags, names and main are those of all elements around it too, shared where it adds none."""

    __slots__ = ("tag", "tags", "names", "main")

    def __init__(self, tag: str, words: tuple[str, ...], main: bool, up: Node | None):
        tags, names, around = (up.tags, up.names, up.main) if up else (frozenset(), frozenset(), False)
        self.tag = tag
        self.tags = tags if tag in tags else tags | {tag}
        self.names = names if names.issuperset(words) else names.union(words)
        self.main = main or around


@dataclass
class Block:
    text: str
    inner: Node | None  # the innermost element
    link_chars: int
    size: int


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    return tuple(w for m in _NAMES.finditer(attributes) for w in _WORDS.findall(next(x for x in m.groups() if x is not None).lower()))


def leaf_blocks(html: str) -> list[Block]:
    """The leaf blocks of a page, in order: one pass, whatever the depth, as open elements are counted by tag."""
    out: list[Block] = []
    stack: list[Node] = []
    opened: Counter[str] = Counter()
    n_hidden = 0
    texts: list[str] = []
    inner: Node | None = None
    links = 0

    def pop() -> str:
        nonlocal n_hidden
        tag = stack.pop().tag
        opened[tag] -= 1
        n_hidden -= tag in SKIPPED
        return tag

    def hidden() -> bool:
        return n_hidden > 0

    def close(tag: str) -> None:
        while pop() != tag:
            pass

    def flush() -> None:
        nonlocal texts, links
        if texts:
            text = " ".join(html_lib.unescape("".join(texts)).split())
            if text:
                out.append(Block(text, inner, links, len(text)))
        texts, links = [], 0

    def add(raw: str) -> None:
        nonlocal inner, links
        if raw.strip() and stack and stack[-1].tag == "head":
            pop()
        if raw and (texts or not raw.isspace()) and not hidden():
            if not texts:
                inner = stack[-1] if stack else None
            texts.append(raw)
            if opened["a"]:
                links += len(raw)

    at = 0
    while m := TOKEN.search(html, at):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        closing, tag, attributes = m[1], m[2], m[3]
        tag = (tag or "").lower()
        if not tag:
            continue
        if tag in BLOCKS or tag == "head":
            flush()
        if closing:
            if opened[tag]:
                close(tag)
            continue
        if stack and stack[-1].tag == "head" and tag not in IN_HEAD:
            pop()
        if tag in BLOCKS and (opened["select"] or opened["option"]) and tag not in IN_SELECT:
            # a block that a select cannot hold: it was never closed
            close("select" if opened["select"] else "option")
        if tag in BLOCKS and opened["svg"] and not opened["foreignobject"]:
            close("svg")
        if tag in SKIPPED or tag in RAW and hidden():
            if tag not in ("option", "head"):
                flush()
            if attributes.rstrip().endswith("/"):
                continue
            if tag in RAW:
                end = RAW_ENDS[tag].search(html, at)
                if end or tag != "noscript":
                    at = end.start() if end else len(html)
                    continue
                tag = "noscript-unclosed"
        if tag in VOID:
            continue
        if tag in BLOCKS and tag not in IN_PARAGRAPH and opened["p"] and not hidden():
            close("p")
        ends = ENDS.get(tag)
        while ends and stack and stack[-1].tag in ends:
            pop()
        stack.append(Node(tag, _names(attributes), "data-main" in attributes, stack[-1] if stack else None))
        opened[tag] += 1
        n_hidden += tag in SKIPPED
    if at < len(html):
        add(html[at:])
    flush()
    return out


OWN_TAGS = frozenset({"article", "main"})


def features(blocks: list[Block], hide_own: bool = False) -> list[list[str]]:
    """Feature names of each block; hide_own leaves out what names the article element."""
    out = []
    n = len(blocks)
    for i, b in enumerate(blocks):
        f = ["bias"]
        tags = b.inner.tags if b.inner else frozenset()
        f += [f"in:{t}" for t in tags if t not in ("html", "body") and not (hide_own and t in OWN_TAGS)]
        parent = b.inner.tag if b.inner else ""
        f.append("parent:" + ("" if hide_own and parent in OWN_TAGS else parent))
        f += [f"name:{w}" for w in (b.inner.names if b.inner else ())]
        size = b.size
        f.append(f"size:{min(9, int(math.log2(size + 1)))}")
        f.append(f"links:{int(3.999 * min(1.0, b.link_chars / size))}")
        if b.text[-1] in ".!?…»\"”":
            f.append("ends")
        if "©" in b.text or "(c)" in b.text[:20].lower():
            f.append("copyright")
        if i == 0:
            f.append("first")
        if i == n - 1:
            f.append("last")
        longest = max(blocks[i - 1].size if i else 0, blocks[i + 1].size if i + 1 < n else 0)
        f.append(f"near:{min(9, int(math.log2(longest + 1)))}")
        out.append(f)
    return out


@dataclass
class Field:
    """weights: score of label 1 over label 0 by feature; turns[a][b]: score of label b after label a."""

    weights: dict[str, float] = field(default_factory=dict)
    turns: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])

    def unary(self, names: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in row) for row in names]

    def decode(self, names: list[list[str]]) -> list[int]:
        """The best labels (Viterbi); ties go to main text."""
        if not names:
            return []
        (t00, t01), (t10, t11) = self.turns
        back: list[tuple[int, int]] = []
        scores = self.unary(names)
        zero, one = 0.0, scores[0]
        for s in scores[1:]:
            from0, from1 = (1, one + t10) if one + t10 >= zero + t00 else (0, zero + t00), (1, one + t11) if one + t11 >= zero + t01 else (0, zero + t01)
            back.append((from0[0], from1[0]))
            zero, one = from0[1], from1[1] + s
        label = int(one >= zero)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]

    def marginals(self, names: list[list[str]]) -> tuple[list[float], list[list[float]], float]:
        """P(label 1) per block, expected label turns, and the log of the partition sum."""
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        t = self.turns
        s = self.unary(names)
        n = len(s)
        ahead = [(0.0, s[0])]
        for i in range(1, n):
            z, o = ahead[-1]
            ahead.append((add(z + t[0][0], o + t[1][0]), add(z + t[0][1], o + t[1][1]) + s[i]))
        behind = [(0.0, 0.0)] * n
        for i in range(n - 2, -1, -1):
            z, o = behind[i + 1]
            behind[i] = (add(t[0][0] + z, t[0][1] + s[i + 1] + o), add(t[1][0] + z, t[1][1] + s[i + 1] + o))
        total = add(*ahead[-1])
        p = [math.exp(ahead[i][1] + behind[i][1] - total) for i in range(n)]
        turns = [[0.0, 0.0], [0.0, 0.0]]
        for i in range(1, n):
            for a in (0, 1):
                for b in (0, 1):
                    turns[a][b] += math.exp(ahead[i - 1][a] + t[a][b] + (s[i] if b else 0.0) + behind[i][b] - total)
        return p, turns, total


def fit(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Adagrad on the penalised log-likelihood, page by page in the given order."""
    model = Field()
    w, seen = defaultdict(float), defaultdict(float)
    turns_seen = [[1e-6, 1e-6], [1e-6, 1e-6]]
    model.weights = w
    for _ in range(epochs):
        for names, labels in pages:
            if not names:
                continue
            p, turns, _ = model.marginals(names)
            grad: dict[str, float] = defaultdict(float)
            for row, label, q in zip(names, labels, p):
                for f in row:
                    grad[f] += label - q
            for f, g in grad.items():
                g -= decay * w[f]
                seen[f] += g * g
                w[f] += rate * g / math.sqrt(seen[f] + 1e-9)
            for a, b in zip(labels, labels[1:]):
                turns[a][b] -= 1.0
            for a in (0, 1):
                for b in (0, 1):
                    g = -turns[a][b] - decay * model.turns[a][b]
                    turns_seen[a][b] += g * g
                    model.turns[a][b] += rate * g / math.sqrt(turns_seen[a][b])
    model.weights = {f: v for f, v in w.items() if v}
    return model


#: Pages labelled by hand: main text is what a data-main element holds.
SEED_PAGES = (
    '<html><body><div id="cookie-notice"><p>We use cookies to improve this site.</p><button>Accept</button></div><header><h2>The Daily Page</h2><p>News since 1901</p></header><nav><a href="/">Home</a> <a href="/a">World</a></nav><main><div data-main><h1>River rises after storm</h1><p>The river rose by two metres during the night, officials said on Monday.</p><p>Schools stay closed.</p></div><div class="related"><h3>Related stories</h3><ul><li><a href="/1">Storm damages bridge in the north</a></li></ul></div></main><aside class="sidebar"><h4>Most read</h4><p>Ten things to know about winter tyres before you buy them this year.</p></aside><footer><p>© 2020 The Daily Page. All rights reserved.</p></footer></body></html>',
    '<html><body><div class="header"><span>My Blog</span></div><div class="menu"><ul><li><a href="#">About</a></li><li><a href="#">Contact</a></li></ul></div><div class="post-content" data-main><h1>How to bake bread</h1><p>Mix the flour and the water. Wait for an hour, then knead the dough for ten minutes.</p><ul><li>Flour, 500 grams</li><li>Water, 350 grams</li></ul><blockquote>Good bread takes time.</blockquote></div><div id="comments"><h3>2 comments</h3><div class="comment"><p>I tried this and it worked very well, thank you for the recipe!</p></div><div class="comment"><p>Mine was too dry. Should I add more water the next time I bake it?</p></div><form><label>Your comment</label><input name="c"><p>Please be polite when you write.</p></form></div><div class="footer">Powered by nothing. Privacy policy.</div></body></html>',
    '<html><body><div class="ad banner">Buy two shoes and get a third one free, only this week!</div><div class="content"><div class="article-body" data-main><h2>Council votes on budget</h2><p>The council voted 7 to 4 for the new budget after a long debate on Tuesday evening.</p><p>It takes effect in May.</p></div><div class="advert"><p>Sponsored: the best loans for your new car, without any hidden fees.</p></div><div class="article-body" data-main><p>Opponents said that they would appeal against the decision in court.</p></div></div><div class="newsletter signup"><form><p>Subscribe to our newsletter and never miss a story.</p></form></div><div id="footer"><p>Imprint. Contact. Terms of use.</p></div></body></html>',
    '<html><body><nav class="breadcrumb"><a href="/">Start</a> <a href="/x">Science</a></nav><section class="entry" data-main><h1>Old bones found in cave</h1><p>Researchers dug for three summers.<br>Then they found the bones of a bear.</p><table><tr><td>Age</td><td>12,000 years</td></tr></table><h2>What comes next</h2><p>More digging.</p></section><section class="share social"><p>Share this on your favourite network now.</p></section><section class="comments" id="disqus"><p>Great find, congratulations to the whole team from all of us here.</p></section><footer>© Museum · all rights reserved</footer></body></html>',
    '<html><body><header class="site-header"><div class="notice alert"><p>Our shop is closed on Friday. Orders will be sent on Monday.</p></div><ul class="nav"><li><a href="/s">Shop</a></li></ul></header><article data-main><header><h1>Letter from the editor</h1></header><p>Dear readers, this issue is about the sea, its people and its future.</p><p>We hope you like it.</p></article><aside><p>About the author: writes about boats and lives near the coast with two dogs.</p></aside><div class="promo ad"><p>Win a trip to the sea with our new quiz.</p></div><footer><p>© Sea Magazine</p></footer></body></html>',
    '<html><body><div role="banner"><p>Town News</p></div><div role="navigation"><ul><li><a href="/">Home</a></li><li><a href="/b">Sport</a></li></ul></div><div role="main"><div data-main><h1>Match ends in a draw</h1><p>Both teams scored late in a wild second half that nobody expected.</p><p>The fans sang until midnight.</p></div><div class="user-comments"><ol><li><p>What a game, I was there with my kids and we loved every minute.</p></li></ol></div></div><div role="complementary"><p>Weather: rain in the morning, later dry with some sun.</p></div><div role="contentinfo"><p>© Town News, contact us</p></div></body></html>',
    '<html><body><article><div data-main><h1>Ein kurzer Bericht</h1><p>Der Zug kam am Morgen mit zwei Stunden Verspätung an.</p><p>Niemand wusste warum.</p></div><div class="ad"><p>Jetzt kaufen und bis zum Sommer sparen, nur in dieser Woche!</p></div><div data-main><p>Am Abend fuhr er wieder ab.</p></div><nav><a href="/2">Weiter</a></nav><form><p>Bitte melden Sie sich an, um zu schreiben.</p></form><section class="comments"><h2>Kommentare</h2><p>Das passiert hier leider jede Woche, man gewöhnt sich daran.</p></section></article><aside class="sidebar"><p>Lesen Sie auch unseren Bericht über alte Bahnhöfe im Norden.</p></aside></body></html>',
    '<html><body><div class="top-menu"><a href="/">Accueil</a> <a href="/n">Nouvelles</a></div><div class="cookie banner"><p>Ce site utilise des cookies pour mesurer son audience.</p></div><div id="main-text" data-main><h1>La foire ouvre ses portes</h1><p>La foire a ouvert samedi devant une foule de visiteurs venus de toute la région.</p><p>Elle dure dix jours.</p></div><div class="sidebar widget"><h3>Archives</h3><p>Retrouvez ici tous nos articles des années passées, mois par mois.</p></div><div class="site-footer"><p>Mentions légales · Tous droits réservés</p></div></body></html>',
)


def labelled(html: str, main: str = "mark") -> tuple[list[Block], list[int]]:
    """Blocks and labels of a page by its data-main marks, or ("own") by its own article element."""
    blocks = leaf_blocks(html)
    if main == "mark":
        return blocks, [int(b.inner is not None and b.inner.main) for b in blocks]
    away = {"nav", "aside", "footer", "form", "header"}
    unwanted = {"comment", "comments", "ad", "ads"}
    own = lambda n: n is not None and not n.tags.isdisjoint(OWN_TAGS) and n.tags.isdisjoint(away) and n.names.isdisjoint(unwanted)
    return blocks, [int(own(b.inner)) for b in blocks]


def train(pages: DataFrame, limit: int = TRAIN_PAGES) -> Field:
    """A field from SEED_PAGES and at most `limit` pages of the table that have one article element."""
    named = pages.where(F.col("html").contains("<article") | F.col("html").contains("<main")).select("html", F.xxhash64("html").alias("h"))
    # hashes alone are ordered; only the pages chosen, equal ones once, reach the driver
    last = named.select("h").distinct().orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    taken = named.where(F.col("h") <= last).groupBy("h").agg(F.first("html").alias("html")).orderBy("h").collect() if last is not None else []
    seeds = [(features(b), y) for b, y in map(labelled, SEED_PAGES)] + [(features(b, True), y) for b, y in map(labelled, SEED_PAGES)]
    own = [labelled(r["html"], "own") for r in taken]
    rows = [(features(b), y) for b, y in own] + [(features(b, True), y) for b, y in own]
    repeats = max(1, len(rows) // (2 * len(seeds)))
    return fit(rows + seeds * repeats)


def main_text(html: str | None, model: Field) -> str:
    blocks = leaf_blocks(html or "")
    return " ".join(b.text for b, keep in zip(blocks, model.decode(features(blocks))) if keep)


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars per row of pages: one narrow pass with the field broadcast."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field_ = shared.value
        for batch in text_slices(batches, "html"):
            texts = [main_text(h, field_) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
