"""Operator 12: byte-level BPE encoding and decoding by DuckDB recursive queries, one database in each task.

A text is cut into words by the vocabulary's pattern. Rows (word, position, token), one for each byte at first, join the
table of merges; a recursive query contracts each word's leftmost pair of least rank until no word has a pair left. A
word that is a token as it stands is that token, as in the tiktoken library. Decoding joins ids with the vocabulary and
aggregates the bytes in order.

Words of up to SHORT bytes contract one pair a round; the rounds' rows are small and many words share a round. Longer
words are first cut between bytes that no token holds side by side, which no merge crosses. Then every occurrence of the least pair
is contracted in one round, from the left up to the first that makes a pair of lower rank, which is what one at a time does; their rows
are replaced by key, so the memory is that of the word.

Words and space-separated parts of texts seen before come from bounded tables in the Python worker, so DuckDB meets a word of the
corpus about once in each worker. Nothing is trained; ranks and pattern are read on the driver and broadcast (a
vocabulary of a few hundred thousand short tokens at most).

Defined cases: null text counts as empty and has no tokens; texts of any length are read whole; a string of a special token is
ordinary text; repeated rows repeat; an empty table gives an empty result; only the columns to keep and the text are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tallyscope.llm.common import unused_name
from tallyscope.llm.sentencepiece_codec import id_lists, text_slices

#: Bytes up to which a word contracts one pair a round.
SHORT = 48
#: Bytes of words that one query takes (a longer word is one query), and rows that one decoding query takes.
QUERY_BYTES, QUERY_ROWS = 400_000, 1_000_000
#: Entries of each of the two tables of words and of parts seen, and the longest (in characters) that stay; some 300 MB of a worker in all.
WORDS, PARTS = (400_000, 32), (250_000, 40)
#: White space before or after a space: there a space need not begin a word.
_DOUBTFUL = re.compile(r"\s | \s|^ | $")
#: Places in a query's words fit into 30 bits beside the rank.
_PLACES = 1 << 30

_SHORT_WORDS = f"""
WITH RECURSIVE s(w, g, t, live) AS (
  SELECT w, g, t, true FROM start
  UNION ALL
  (WITH a AS (SELECT w, g, t, lead(t) OVER o AS t2, lead(w) OVER o AS w2, lag(g) OVER o AS g0 FROM s WHERE live WINDOW o AS (ORDER BY g)),
    best AS (SELECT a.w, min(m::BIGINT * {_PLACES} + g) AS b FROM a JOIN merges ON pair = t::BIGINT * {_PLACES} + t2 WHERE w = w2 GROUP BY a.w)
   SELECT a.w, g, CASE WHEN g = b % {_PLACES} THEN (b // {_PLACES})::INT ELSE t END, b IS NOT NULL
   FROM a LEFT JOIN best USING (w) WHERE b IS NULL OR g0 IS NULL OR g0 <> b % {_PLACES})
)
SELECT w, t FROM s WHERE NOT live ORDER BY g
"""

# i numbers the tokens of a word, hit marks its least pair, go the hits that are contracted if none stops them (the 1st, 3rd, ... of
# adjoining ones), stop those whose contraction makes a pair of lower rank; the pair after the stop waits for the next round.
_LONG_WORDS = f"""
WITH RECURSIVE s(w, g, t, k) USING KEY (w, g) AS (
  SELECT w, g, t, 0 FROM start
  UNION
  (WITH a AS (SELECT w, g, t, k, lead(t) OVER o AS t2, lead(t, 2) OVER o AS t3, lag(t) OVER o AS t0, row_number() OVER o AS i FROM s WHERE t >= 0 WINDOW o AS (PARTITION BY w ORDER BY g)),
    ranked AS (SELECT a.*, m, min(m) OVER (PARTITION BY w) AS best FROM a LEFT JOIN merges ON pair = t::BIGINT * {_PLACES} + t2),
    hits AS (SELECT *, coalesce(m = best, false) AS hit FROM ranked WHERE best IS NOT NULL),
    runs AS (SELECT *, hit AND (i - coalesce(max(CASE WHEN NOT hit THEN i END) OVER o, 0)) % 2 = 1 AS go FROM hits WINDOW o AS (PARTITION BY w ORDER BY g ROWS UNBOUNDED PRECEDING)),
    chosen AS (SELECT *, coalesce(lag(go, 1) OVER o, false) AS gone, coalesce(lag(go, 2) OVER o, false) AS merged_before FROM runs WINDOW o AS (PARTITION BY w ORDER BY g)),
    stops AS (SELECT c.w, min(c.g) AS stop FROM chosen c
      LEFT JOIN merges x ON x.pair = (CASE WHEN c.merged_before THEN c.best ELSE c.t0 END)::BIGINT * {_PLACES} + c.best
      LEFT JOIN merges y ON y.pair = c.best::BIGINT * {_PLACES} + c.t3
      WHERE c.go AND least(x.m, y.m) < c.best GROUP BY c.w),
    halted AS (SELECT c.*, c.go AND (stop IS NULL OR g <= stop) AS done, c.gone AND (stop IS NULL OR coalesce(lag(g) OVER (PARTITION BY c.w ORDER BY g), -1) <= stop) AS away FROM chosen c LEFT JOIN stops USING (w))
   SELECT w, g, CASE WHEN done THEN best WHEN away THEN -1 ELSE t END, k + 1 FROM halted)
)
SELECT w, t FROM s WHERE t >= 0 ORDER BY w, g
"""

_DECODE = "SELECT w, string_agg(piece, '' ORDER BY g) AS text FROM coded JOIN vocabulary USING (t) GROUP BY w"


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """Token -> rank from a tiktoken file; by default the multilingual one of the public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def load_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _batches(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of consecutive entries whose sizes add up to at most `most`, or of one entry."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield slice(at, len(sizes))


class Seen:
    """What strings were coded to, in two tables of bounded size: when the newer is full it becomes the older, so strings that come again stay."""

    def __init__(self, size: int, longest: int):
        self.size, self.longest = size, longest
        self.ids: dict[str, bytes] = {}
        self.back: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def missing(self, strings: set[str]) -> set[str]:
        new = strings - self.ids.keys()
        ids, back = self.older
        again = new & ids.keys()
        self.ids.update((x, ids[x]) for x in again)
        self.back.update((x, back[x]) for x in again)
        return new - again

    def shrink(self, new: Iterable[str]) -> None:
        for x in new:
            if len(x) > self.longest:
                del self.ids[x], self.back[x]
        if len(self.ids) > self.size:
            self.older, self.ids, self.back = (self.ids, self.back), {}, {}


class ByteCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: str = "500MB"):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.packed = {token: np.uint32(rank).tobytes() for token, rank in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        merges = [(ranks[b[:i]], ranks[b[i:]], rank) for b, rank in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        self.joined = {b[i : i + 2] for b in ranks for i in range(len(b) - 1)}
        left, right, made = (np.array(x, dtype=np.int64) for x in zip(*merges))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        self._table("merges", pa.table({"pair": left * _PLACES + right, "m": made.astype(np.int32)}))
        # a byte is a character of the same number, so that bytes can be aggregated as text
        self._table("vocabulary", pa.table({"t": np.array(list(ranks.values()), dtype=np.int32), "piece": [b.decode("latin-1") for b in ranks]}))
        self.parts, self.words = Seen(*PARTS), Seen(*WORDS)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("_rows", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM _rows")
        self.db.unregister("_rows")

    def _contract(self, words: list[bytes], query: str) -> list[bytes]:
        """Packed ids of each word."""
        lengths = np.array([len(w) for w in words])
        tokens = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        self.db.register("start", pa.table({"w": owner, "g": np.arange(len(tokens), dtype=np.int32), "t": tokens}))
        found = self.db.execute(query).fetchnumpy()
        ends = np.searchsorted(found["w"], np.arange(1, len(words) + 1)) * 4
        ids = found["t"].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]

    def _cuts(self, word: bytes) -> list[bytes]:
        """A long word cut where no token holds both neighbours."""
        joined = self.joined
        at = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joined), len(word)]
        return [word[a:b] for a, b in zip(at, at[1:])]

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Packed ids (little-endian unsigned 32-bit) of each word."""
        out = {w: self.packed[w] for w in words if w in self.packed}
        rest = [w for w in words if w not in out]
        cuts = {w: self._cuts(w) for w in rest if len(w) > SHORT}
        pieces = sorted({p for w in rest for p in cuts.get(w, [w])}, key=len)
        short = sum(len(p) <= SHORT for p in pieces)
        ids = {}
        for some, query in ((pieces[:short], _SHORT_WORDS), (pieces[short:], _LONG_WORDS)):
            for part in _batches([len(p) for p in some], QUERY_BYTES):
                ids.update(zip(some[part], self._contract(some[part], query)))
        for w in rest:
            out[w] = b"".join([ids[p] for p in cuts[w]]) if w in cuts else ids[w]
        return out

    def decode_many(self, packed: list[bytes]) -> list[bytes]:
        """Bytes of each list of packed ids."""
        out: list[bytes] = []
        for part in _batches([len(p) // 4 for p in packed], QUERY_ROWS):
            some = packed[part]
            owner = np.repeat(np.arange(len(some), dtype=np.int32), [len(p) // 4 for p in some])
            tokens = np.frombuffer(b"".join(some), dtype="<u4").astype(np.int32)
            if len(tokens) and not (tokens < len(self.ranks)).all():
                raise ValueError("an id that the vocabulary does not have")
            self.db.register("coded", pa.table({"w": owner, "g": np.arange(len(tokens), dtype=np.int32), "t": tokens}))
            texts = dict(self.db.execute(_DECODE).fetchall())
            out += [texts.get(i, "").encode("latin-1") for i in range(len(some))]
        return out

    def _parts(self, text: str) -> list[str]:
        """A text cut before spaces that surely begin a word: those with no white space beside them."""
        cuts = text.split(" ")
        parts = [cuts[0], *[" " + c for c in cuts[1:]]]
        if not _DOUBTFUL.search(text):
            return parts
        out = [parts[0]]
        for before, part in zip(parts, parts[1:]):
            if len(part) == 1 or part[1].isspace() or before == " " or not before or before[-1].isspace():
                out[-1] += part
            else:
                out.append(part)
        return out

    def _learn(self, parts: set[str]) -> None:
        """Put parts of texts into the table."""
        cut = {p: self.pattern.findall(p) for p in parts}
        new = list(self.words.missing(set(chain.from_iterable(cut.values()))))
        as_bytes = [w.encode() for w in new]
        coded = self.encode_words(as_bytes)
        packed = [coded[b] for b in as_bytes]
        ids, back = self.words.ids, self.words.back
        ids.update(zip(new, packed))
        back.update(zip(new, self.decode_many(packed)))
        self.parts.ids.update((p, b"".join([ids[w] for w in ws])) for p, ws in cut.items())
        self.parts.back.update((p, b"".join([back[w] for w in ws])) for p, ws in cut.items())
        self.words.shrink(new)

    def code(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(packed ids, bytes that these ids decode to) of each text."""
        split = [self._parts(t) if t else [] for t in texts]
        new = self.parts.missing(set(chain.from_iterable(split)))
        self._learn(new)
        ids, back = self.parts.ids.__getitem__, self.parts.back.__getitem__
        out = [(b"".join(map(ids, parts)), b"".join(map(back, parts))) for parts in split]
        self.parts.shrink(new)
        return out


_codecs: dict[int, ByteCodec] = {}


def shared_codec(ranks: dict[bytes, int], pattern: str) -> ByteCodec:
    """One codec per vocabulary and Python worker: later tasks of a worker find its database and tables."""
    key = hash((pattern, len(ranks), tuple(list(ranks.items())[:: max(1, len(ranks) // 999)])))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = ByteCodec(ranks, pattern)
    return _codecs[key]


def _vocabulary(df: DataFrame, path: str | None):
    return df.sparkSession.sparkContext.broadcast((load_ranks(path), load_pattern()))


def encode_texts(docs: DataFrame, keep: list[str] | None = None, path: str | None = None, packed: bool = False) -> DataFrame:
    """`keep` (default doc_id), n_tokens and token_ids; with `packed`, token_ids are bytes (little-endian unsigned 32-bit
    integers) and `decoded` has the bytes that the ids decode to. A column to keep that has one of these names gives way to it.
    """
    kind = BinaryType() if packed else ArrayType(IntegerType())
    made = [StructField("n_tokens", LongType()), StructField("token_ids", kind)] + ([StructField("decoded", BinaryType())] if packed else [])
    keep = [c for c in (["doc_id"] if keep is None else keep) if c.lower() not in {f.name for f in made}]
    own = unused_name(keep, "_text")
    taken = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(own))
    schema = StructType([*taken.schema.fields[:-1], *made])
    vocabulary = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(*vocabulary.value)
        for batch in text_slices(batches, own, 2_000_000):
            coded = codec.code(batch.column(own).to_pylist())
            ids = [c[0] for c in coded]
            columns = [*batch.columns[:-1], pa.array([len(i) // 4 for i in ids], pa.int64())]
            columns += [pa.array(ids, pa.binary()), pa.array([c[1] for c in coded], pa.binary())] if packed else [id_lists(ids)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return taken.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, ids: str = "token_ids", to: str = "text", path: str | None = None) -> DataFrame:
    """Add the text of a column of id lists (an array); null stays null, bytes that are no UTF-8 become U+FFFD.

    An id that the vocabulary does not have fails the job.
    """
    vocabulary = _vocabulary(encoded, path)
    names = [c for c in encoded.columns if c != to]
    schema = StructType([*encoded.select(*[F.col(f"`{c}`") for c in names]).schema.fields]).add(to, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(*vocabulary.value)
        for batch in batches:
            lists = batch.column(names.index(ids)).to_pylist()
            texts = codec.decode_many([b"" if i is None else np.array(i, dtype="<u4").tobytes() for i in lists])
            texts = [None if i is None else t.decode("utf-8", "replace") for i, t in zip(lists, texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the packed ids and of the decoded bytes."""
    coded = encode_texts(docs, path=path, packed=True)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
