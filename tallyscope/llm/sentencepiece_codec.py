"""Operator 3: SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at each position its output links list
every piece that ends there, and each relaxes the best score at that position (Viterbi over the sum of
piece scores). A character that no piece covers falls back to its UTF-8 bytes. Equal scores keep the
longer last piece. Vocabulary and scores come from a public model file; nothing is trained.

Spaces become U+2581 and one is put in front, as the model asks; decoding takes it away again, so
decode(encode(x)) == x for every text (a literal U+2581 is encoded as bytes).

Pieces that hold U+2581 hold it only in front, so a text can be cut before each run of spaces and the
cuts encoded alone: their best scores add up. Cuts seen before come from a bounded table. A model
with pieces across words is read whole.

Defined cases: null text gives null ids; empty text gives none; texts of any length are read whole;
repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from tallyscope.llm.common import unused_name

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Entries of each of the two tables of cuts seen before, and the longest cut they keep. When the newer is full it
#: becomes the older, so cuts that come again stay. Both together take about 200 MB of a worker.
TABLE_SIZE, TABLE_LENGTH = 500_000, 48
#: Bytes of text encoded at a time.
SLICE_BYTES = 1_000_000
#: A piece counts as beaten by a sum that is better by more than this, far above what rounding of sums can turn.
MARGIN = 1e-3
_CUTS = re.compile(" *[^ ]+| +")
_NEVER = float("-inf")


def _cuts(part: str) -> list[str]:
    """A part before each run of spaces; words with one space in front need no pattern."""
    if part[:1] == " " and part[-1] != " " and "  " not in part:
        return [" " + w for w in part[1:].split(" ")]
    return _CUTS.findall(part)


def load_pieces(model: str = MODEL) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind: normal, byte or control."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    kind = lambda i: "byte" if sp.is_byte(i) else "control" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


class Codec:
    def __init__(self, pieces: list[tuple[str, float, str]]):
        normal = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind == "normal" and p]
        self._read(normal)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces; texts could not be restored")
        self.fallback_score = min(s for _, s, _ in normal) - 10.0
        self._read([(p, s, i) for p, s, i in normal if not self._beaten(p, s)])
        self.by_words = not any(MARK in p.lstrip(MARK) for p, _, _ in normal)
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.restored = [bytes([int(p[3:5], 16)]) if kind == "byte" else p.replace(MARK, " ").encode() if kind == "normal" else b"" for p, _, kind in pieces]

    def _read(self, normal: list[tuple[str, float, int]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for p, s, i in normal:
            self.automaton.add_word(p, (len(p), s, i))
        self.automaton.make_automaton()

    def _beaten(self, piece: str, score: float) -> bool:
        """Whether shorter pieces spell a piece with a better sum: then it is on no best path, wherever it stands."""
        n = len(piece)
        best = [0.0] + [_NEVER] * n
        for end, (length, s, _) in self.automaton.iter(piece):
            if length < n and best[end + 1 - length] + s > best[end + 1]:
                best[end + 1] = best[end + 1 - length] + s
        return best[n] > score + MARGIN

    def viterbi(self, marked: str) -> list[int]:
        """Ids of the best path through a text whose spaces are marks."""
        n = len(marked)
        best = [_NEVER] * n + [0.0]  # by the position of the last character; -1, before the first, is the last entry
        last: list = [None] * n  # the (length, score, id) that ends at each position on its best path
        for end, piece in self.automaton.iter(marked):
            length, score, _ = piece
            got = best[end - length] + score
            if got > best[end]:
                best[end] = got
                last[end] = piece
        if _NEVER in best:
            last = self._with_fallback(marked)[1][1:]
        ids: list[int] = []
        at = n - 1
        while at >= 0:
            piece = last[at]
            if piece is None:
                ids.extend(self.byte_ids[b] for b in reversed(marked[at].encode()))
                at -= 1
            else:
                ids.append(piece[2])
                at -= piece[0]
        ids.reverse()
        return ids

    def _with_fallback(self, marked: str) -> tuple[list[float], list]:
        """The same pass, with an arc over its bytes into every position that no piece reaches."""
        n = len(marked)
        best, last = [0.0] + [_NEVER] * n, [None] * (n + 1)
        done = 0  # positions up to here are settled
        for end, piece in self.automaton.iter(marked):
            while done < end:
                done += 1
                if best[done] == _NEVER:
                    best[done] = best[done - 1] + self.fallback_score
            at = end + 1
            got = best[at - piece[0]] + piece[1]
            if got > best[at]:
                best[at], last[at] = got, piece
        while done < n:
            done += 1
            if best[done] == _NEVER:
                best[done] = best[done - 1] + self.fallback_score
        return best, last

    def _cut(self, cut: str) -> bytes:
        out = self.older.get(cut)
        if out is None:
            out = array("i", self.viterbi(cut.replace(" ", MARK))).tobytes()
        if len(cut) <= TABLE_LENGTH:
            if len(self.table) >= TABLE_SIZE:
                self.older = self.table.copy()
                self.table.clear()
            self.table[cut] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian int32."""
        if not text:
            return b""
        parts = (" " + text).split(MARK)
        literal = np.array([self.byte_ids[b] for b in MARK.encode()], dtype=np.int32).tobytes()
        get, cut = self.table.get, self._cut
        out = []
        for part in parts:
            if self.by_words:
                out.append(b"".join([get(c) or cut(c) for c in _cuts(part)]))
            else:
                out.append(np.array(self.viterbi(part.replace(" ", MARK)), dtype=np.int32).tobytes())
        return literal.join(out)

    def decode(self, ids: list[int]) -> str:
        restored = self.restored
        return b"".join([restored[i] for i in ids]).decode("utf-8", "replace")[1:]


_codecs: dict[int, Codec] = {}


def shared_codec(pieces: list[tuple[str, float, str]]) -> Codec:
    """One codec per vocabulary and Python worker: later tasks of a worker find its automaton and tables."""
    key = hash(tuple(pieces))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(pieces)
    return _codecs[key]


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "_text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `size` bytes of the text column, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def id_lists(encoded: list[bytes | None]) -> pa.Array:
    """list<int32> from packed ids; None stays null."""
    counts = [0 if e is None else len(e) // 4 for e in encoded]
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(e for e in encoded if e), dtype=np.int32))
    mask = pa.array([e is None for e in encoded])
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def encode_texts(docs: DataFrame, model: str = MODEL, keep: list[str] | None = None, check: bool = True) -> DataFrame:
    """`keep` (default doc_id), n_tokens, token_ids and, with `check`, decoded_crc32 (of the decoded text) and round_trip.

    A column to keep that has the name of one of these gives way to it. The pieces are read once and broadcast: a vocabulary
    of a few hundred thousand short strings at most.
    """
    import zlib

    made = [StructField("n_tokens", LongType()), StructField("token_ids", ArrayType(IntegerType()))]
    made += [StructField("decoded_crc32", LongType()), StructField("round_trip", BooleanType())] if check else []
    keep = [c for c in (["doc_id"] if keep is None else keep) if c.lower() not in {f.name for f in made}]
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(model))
    own = unused_name(keep, "_text")
    taken = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(own))
    schema = StructType([*taken.schema.fields[:-1], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(pieces.value)
        for batch in text_slices(batches, own):
            texts = batch.column(own).to_pylist()
            encoded = [None if t is None else codec.encode(t) for t in texts]
            columns = [*batch.columns[:-1], pa.array([None if e is None else len(e) // 4 for e in encoded], pa.int64()), id_lists(encoded)]
            if check:
                decoded = [None if e is None else codec.decode(np.frombuffer(e, dtype=np.int32).tolist()) for e in encoded]
                columns.append(pa.array([None if d is None else zlib.crc32(d.encode()) for d in decoded], pa.int64()))
                columns.append(pa.array([None if t is None else d == t for d, t in zip(decoded, texts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return taken.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, ids: str = "token_ids", to: str = "text", model: str = MODEL) -> DataFrame:
    """Add the text of an id list; null stays null."""
    pieces = encoded.sparkSession.sparkContext.broadcast(load_pieces(model))
    names = [c for c in encoded.columns if c != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(pieces.value)
        for batch in batches:
            texts = [None if i is None else codec.decode(i) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in names} | {to: pa.array(texts, pa.string())})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*names).schema) + f", `{to}` string"
    return encoded.select(*names).mapInArrow(run, fields)
