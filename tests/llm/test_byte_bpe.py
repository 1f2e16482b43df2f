"""Operator 12 against the tiktoken library, and round trips."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken

from tallyscope.llm import byte_bpe
from tallyscope.llm.common import table


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=byte_bpe.load_pattern(), mergeable_ranks=byte_bpe.load_ranks(), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.ByteCodec(byte_bpe.load_ranks(), byte_bpe.load_pattern())


def same(codec, library, texts):
    for text, (ids, back) in zip(texts, codec.code(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode_ordinary(text), text[:80]
        assert back == text.encode()


def test_every_kind_of_character(codec, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 97 == 0)]
    same(codec, library, [f"a{chr(c)}b {chr(c)} c{chr(c)} {chr(c)}d{chr(c)}{chr(c)}" for c in points] + [chr(c) for c in points])


def test_white_space_and_long_words(codec, library):
    rnd = random.Random(5)
    for signs in (" \n\t aA\u00e9's1-.   ", "ab ", "\u3000 \x1c\x85x", "\u00e9e\u0301 \U0001f600"):
        same(codec, library, ["".join(rnd.choice(signs) for _ in range(rnd.randrange(80))) for _ in range(300)])
    words = ["a" * 30_000, "ab" * 4_000, "abcdefghij" * 300, "the" * 3_000, "-" * 5_000, " " * 5_000 + "x"]
    same(codec, library, [*words, *["".join(rnd.choice("etaoins") for _ in range(n)) for n in (47, 48, 49, 400, 5_000)]])
    same(codec, library, ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))])
    same(codec, library, ["<|endoftext|> is no special token", ""])


def test_ranks_in_any_order(library):
    """Made-up ranks, where a merged pair may rank below its parts: rounds of many contractions equal one at a time."""
    rnd = random.Random(9)
    for _ in range(25):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 300:
            tokens.add(bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(2, 6))))
        order = sorted(tokens)
        rnd.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        own = byte_bpe.ByteCodec(ranks, byte_bpe.load_pattern())
        other = tiktoken.Encoding("made", pat_str=byte_bpe.load_pattern(), mergeable_ranks=ranks, special_tokens={})
        same(own, other, ["".join(rnd.choice("abc") for _ in range(n)) for n in (3, 10, 40, 60, 90, 200, 700)])


def test_tables_of_words_seen_are_bounded(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "WORDS", (50, 8))
    monkeypatch.setattr(byte_bpe, "PARTS", (30, 8))
    own, rnd = byte_bpe.ByteCodec(byte_bpe.load_ranks(), byte_bpe.load_pattern()), random.Random(2)
    for _ in range(20):
        same(own, library, [" ".join(rnd.choice(["one", "two,", "three", "unheard-of", "x" * rnd.randrange(1, 12)]) for _ in range(20)) for _ in range(10)])
        assert len(own.parts.ids) <= 30 and len(own.words.ids) <= 50 and max(map(len, own.parts.ids), default=0) <= 8


def test_query(spark, library):
    rows = [(1, "A b"), (1, "A b"), (None, "it's\n\n  so"), (2, None), (3, ""), (4, "word " * 20_000), (5, "\u00e9t\u00e9" * 9_000)]
    df = spark.createDataFrame([(i, t, "z", 7) for i, t in rows], "doc_id long, text string, n_tokens string, Token_Ids int")
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in byte_bpe.digest_documents(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert byte_bpe.digest_documents(df.limit(0)).count() == 0
    lists = byte_bpe.encode_texts(df, keep=["doc_id", "text"])
    back = byte_bpe.decode_ids(lists, to="back").collect()
    assert all(r["back"] == (r["text"] or "") and r["n_tokens"] == len(r["token_ids"]) for r in back)
    odd = spark.createDataFrame([(None,), ([],), ([library.encode_single_token(b"\xc3")],)], "token_ids array<int>")
    assert [r["text"] for r in byte_bpe.decode_ids(odd).collect()] == [None, "", "\ufffd"]
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in byte_bpe.encode_texts(docs).collect():
        assert r["token_ids"] == library.encode_ordinary(texts[r["doc_id"]] or "")
