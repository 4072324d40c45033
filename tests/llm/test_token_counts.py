"""Token counts against the library, and the cache's behaviour."""

import random

import pytest
from tokenizers import Tokenizer

from rivulet.llm import token_counts as tc
from rivulet.llm.storage import fresh_path
from rivulet.llm.tokenizers import vocabulary_path

ODD = ["a", "the", "ing", " ", "  ", "\n", "é", "1", "!", "日本", "\x1c", "'s", "----", " \n ", "<|endoftext|>", "<|endoft", " <|endoftext|> "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path(tc.VOCABULARY))


def test_pieces_add_up_to_the_library_count(library):
    own, rnd = tc.counter(vocabulary_path(tc.VOCABULARY)), random.Random(5)
    assert own.by_piece
    for _ in range(10_000):
        text = "".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 12)))
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_encode_whole_texts(name):
    own = tc.counter(vocabulary_path(name))
    assert own.count("") == 0 and 0 < own.count("Hello  World <s>") < 12


def test_rows_nulls_copies_and_long_texts(spark, library):
    long = "mot " * 100_000
    rows = [(1, "a b", 7), (2, "a b", 7), (2, "a b", 8), (3, None, 1), (4, "", 1), (None, "ü", None), (5, long, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    assert sorted(map(tuple, tc.token_counts(df).collect()), key=str) == sorted(want, key=str)
    assert tc.token_counts(df.limit(0)).collect() == []


def test_a_cache_is_used_and_extended(spark, monkeypatch):
    path = fresh_path(spark, "cache")
    one = spark.createDataFrame([(1, "alpha"), (2, "beta")], "doc_id bigint, text string")
    two = spark.createDataFrame([(3, "alpha"), (4, "gamma")], "doc_id bigint, text string")
    tc.token_counts(one, cache_path=path).collect()
    seen = []
    real = tc.count_texts
    monkeypatch.setattr(tc, "count_texts", lambda texts, *a: seen.extend(r.text for r in texts.collect()) or real(texts, *a))
    got = {r.doc_id for r in tc.token_counts(two, cache_path=path).collect()}
    assert seen == ["gamma"] and got == {3, 4}
    version = tc.tokenizer_version(vocabulary_path(tc.VOCABULARY))
    assert tc.CountCache(spark, path).read(version).count() == 3
    assert tc.CountCache(spark, path).read("another version").count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_texts_that_normalise_alike_are_encoded_once(spark, monkeypatch, name):
    own = tc.counter(vocabulary_path(name))
    rows = [(i, t) for i, t in enumerate(["Cafe\u0301 x", "Caf\u00e9 x", "two", "two <s>", "two </s> \uff1cs\uff1e", None, ""])]
    seen, real = [], tc.count_texts
    monkeypatch.setattr(tc, "count_texts", lambda texts, *a: seen.append(texts.count()) or real(texts, *a))
    got = tc.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), vocabulary=name).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: own.count(t or "") for i, t in rows}
    assert seen == [len({own.normalised(t or "") if own.normalises else t or "" for _, t in rows})]
