"""Byte-pair encoding against the public library, and exact round trips."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from grainmill.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_the_hash_is_perfect_and_minimal(codec):
    assert sorted(codec.whole.slots) == list(range(len(codec.tokens)))
    assert all(codec.whole.index(t) == i for i, t in enumerate(codec.tokens))
    small = bpe.PerfectHash([b"a", b"b", b"c"])
    assert sorted(small.index(k) for k in (b"a", b"b", b"c")) == [0, 1, 2]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    codec = bpe.codec(PATH, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    assert codec.encode(text) == library.encode_ordinary(text)
    assert codec.decode_packed(codec.encode_packed(text)).decode() == text


def test_every_character(codec, library):
    text = "".join(f"a{chr(c)} b" for c in range(0x3000) if not 0xD800 <= c < 0xE000)
    assert codec.encode(text) == library.encode_ordinary(text)


def test_long_pretokens(codec, library):
    for text in ("ab" * 30_000, " " * 20_000 + "x", "é" * 5_000, "!?" * 4_000 + "\n" * 3_000):
        assert codec.encode(text) == library.encode_ordinary(text)


def test_special_strings_are_ordinary(codec):
    assert 50256 not in codec.encode("<|endoftext|>")


def test_memory_is_bounded(codec):
    small = bpe.Codec(PATH, PATTERN, remember=10)
    texts = [f"word{k} wörd{k}" for k in range(200)]
    assert [small.encode(t) for t in texts] == [codec.encode(t) for t in texts]
    assert len(small.young) <= 10 and len(small.old) <= 10


def test_frames(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world's\n\n end", "x"), (3, "Hello  world's\n\n end", "x"), (None, "été " * 9_000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert [bytes(r.decoded).decode() for r in out] == [t or "" for _, t, _ in rows]
    assert [r.n_tokens for r in out] == [len(library.encode_ordinary(t or "")) for _, t, _ in rows]
    once = bpe.encode(docs, PATH, PATTERN, decoded="back").collect()
    assert [(r.ids, r.back) for r in once] == [(r.ids, r.decoded) for r in out]
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0


def test_texts_longer_than_a_part(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "PART", 50)
    texts = [None, "short one", "", "Wörter, words and  more\n\n" * 30, "x" * 49, "é" * 51, "tail"]
    packed = list(codec.encode_all(texts))
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [library.encode_ordinary(t or "") for t in texts]
    assert [x.decode() for x in codec.decode_all(packed)] == [t or "" for t in texts]


def test_unknown_ids(codec):
    for bad in (50_256, 2**32 - 1):
        with pytest.raises(KeyError):
            codec.decode_packed(np.array([1, bad], "<u4").tobytes())
