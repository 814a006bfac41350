"""Encoding against the tiktoken library, decoding by round trip."""

import base64
import random
from array import array

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from turnwise.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("reference", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


CODEC = bpe.Codec.load(PATH)


def ids(text):
    return list(array("I", CODEC.encode(text)))


def test_pattern_is_that_of_the_vocabulary():
    assert bpe.PATTERN == public_tokenizers.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_equals_library(text):
    own = tiktoken_encoding()
    assert ids(text) == own.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode("utf-8")


_kept = []


def tiktoken_encoding():
    if not _kept:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
        _kept.append(tiktoken.Encoding("kept", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return _kept[0]


@pytest.mark.parametrize("text", ["", " ", "  a", "a" * 5000, "ab" * 4000, "\n\n \t x", "<|endoftext|>", "don't we'll 'S", "\x1c\x1d\x85", "naïve Übung 漢字 🙂🙂 ١٢٣ Ⅷ"])
def test_special_texts(reference, text):
    assert ids(text) == reference.encode_ordinary(text)


def test_one_long_pretoken(reference):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdethin") for _ in range(200_000))
    got = CODEC.encode(text)
    assert CODEC.decode(got) == text.encode()
    assert ids(text[:20_000]) == reference.encode_ordinary(text[:20_000])


def test_generations_of_kept_pretokens(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    own = bpe.Codec.load(PATH)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(40)) for _ in range(20)]
    for text in texts:
        assert list(array("I", own.encode_all([text, texts[0]])[0])) == reference.encode_ordinary(text)


def test_lower_rank_that_comes_up_later_goes_first():
    # (a, bc) has a lower rank than (b, c): once bc exists, abc must be merged before the next bc.
    ranks = {bytes([i]): 1000 + i for i in range(256)} | {b"bc": 5, b"abc": 2, b"bcb": 3}
    own = bpe.Codec(ranks)
    assert own.merge([b"abcbc"])[0] == [2, 5]


def test_operator(spark, docs, reference):
    rows = [(1, "Hello there"), (2, None), (3, ""), (1, "Hello there"), (None, "x" * 300_000), (5, "é🙂 \n")]
    got = bpe.encoded(docs(rows, extra=True), PATH).collect()
    assert sorted((str(r.doc_id), list(array("I", bytes(r.ids))), bytes(r.decoded)) for r in got) == sorted(
        (str(i), reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows
    )
    assert bpe.encoded(docs([]), PATH).count() == 0
