"""Byte-level BPE against tiktoken, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rivulet.llm.bpe import VOCABULARY, bpe_decode, bpe_round_trip, encoder
from rivulet.llm.tokenizers import Memo, load_ranks, vocabulary_path


@pytest.fixture(scope="module")
def own():
    return encoder(vocabulary_path(VOCABULARY))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(vocabulary_path(VOCABULARY)), special_tokens={})


def ids(own, text):
    return list(memoryview(own.encode(text)).cast("I"))


ODD = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "!", "…", "日本", "\x1c", " ", "'s", "\U0001f600", "----", "\r\n", " \n ", "\u0000", "<|endoftext|>"]


def test_random_mixtures_match_the_library(own, library):
    rnd = random.Random(3)
    for _ in range(20_000):
        text = "".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 12)))
        assert ids(own, text) == library.encode_ordinary(text), repr(text)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60))
def test_any_text_matches_and_comes_back(own, library, text):
    assert ids(own, text) == library.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_long_runs_stay_linear(own, library):
    for text in ("a" * 20_000, "ab" * 5_000, " " * 5_000 + "x", "the" * 4_000):
        assert ids(own, text) == library.encode_ordinary(text)


def test_memo_forgets_but_stays_right():
    memo = Memo(lambda x: x * 2, 4)
    assert [memo[i % 7] for i in range(50)] == [i % 7 * 2 for i in range(50)]
    assert len(memo) <= 4 and len(memo.older) <= 4


def test_table_with_nulls_repeats_and_clashing_columns(spark, library):
    long = "Wörter und words " * 30_000
    rows = [(1, "a b", 1, "x"), (1, "a b", 2, "x"), (2, None, None, None), (None, "", 3, ""), (3, long, 4, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, decoded string")
    got = sorted(bpe_round_trip(df).collect(), key=str)
    assert len(got) == 5
    for r in got:
        text = {1: "a b", 3: long}.get(r.doc_id, "")
        assert list(memoryview(bytes(r.token_ids)).cast("I")) == library.encode_ordinary(text)
        assert r.n_tokens == len(r.token_ids) // 4 and bytes(r.decoded) == text.encode()
    back = bpe_decode(bpe_round_trip(df, decode=False))
    assert sorted(hashlib.md5(r.decoded).hexdigest() for r in back.collect()) == sorted(hashlib.md5(bytes(r.decoded)).hexdigest() for r in got)
    assert bpe_round_trip(df.limit(0)).collect() == []
