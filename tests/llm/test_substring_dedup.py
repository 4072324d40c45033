"""Substring dedup against a brute-force search of word windows."""

import random
import re

import pytest

from rivulet.llm import blobs, substring_dedup
from rivulet.llm.substring_dedup import COVER, PERIOD, drop_repeated_windows


def brute(rows, size=20):
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w, gone = re.findall(r"[^\x20\x09-\x0D]+", text or ""), set()
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in seen:
                gone |= set(range(i, i + size))
            seen.add(key)
        out[d] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def corpus(rnd):
    word = lambda: rnd.choice(["a", "bé", "C", "d", "日", "e.", "f"]) + str(rnd.randint(0, 40))
    shared = [[word() for _ in range(n)] for n in (19, 20, 21, 27, 60)]
    docs = []
    for d in range(120):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            parts += rnd.choice(shared) if rnd.random() < 0.5 else [word() for _ in range(rnd.randint(0, 30))]
        docs.append((d, "".join(x + rnd.choice([" ", "\n", "  "]) for x in parts)))
    docs += [(200, None), (201, ""), (202, "x " * 500), (203, "x " * 30), (204, "p q " * 40), (205, " ".join(f"w{i % 23}" for i in range(60_000)))]
    docs += [(300 + k, docs[7][1]) for k in range(40)]
    return docs


def test_cover_meets_at_every_distance():
    for distance in range(PERIOD):
        assert any((a - b) % PERIOD == distance for a in COVER for b in COVER)


def test_matches_brute_force_whatever_the_flush(spark, monkeypatch):
    docs = corpus(random.Random(2))
    want = brute(docs)
    for flush in (1 << 21, 300):
        monkeypatch.setattr(blobs, "FLUSH", flush)
        rows = drop_repeated_windows(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows} == want
        for r in rows:
            assert r.n_removed == sum(s.last - s.first for s in r.spans)


def test_missing_and_repeated_ids_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(25))
    other = " ".join(f"v{i}" for i in range(25))
    rows = [(None, long, 1), (5, long, 2), (5, long, 2), (5, other, 3), (6, other, 4)]
    got = drop_repeated_windows(spark.createDataFrame(rows, "doc_id bigint, text string, marks int")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("5", 0), ("5", 0), ("5", 0), ("6", 25), ("None", 25)]
    assert drop_repeated_windows(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_anchor_records_only_at_cover_positions(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "id bigint, text string").selectExpr("*", "false AS missing")
    rows = substring_dedup.find_anchors(df, 4).collect()
    *_, p = blobs.unpack([bytes(r.blob) for r in rows if not r.marks], ["<u4", "<u1", "<i8", "<u4"])
    assert sorted(p) == [i for i in range(33) if i % PERIOD in COVER]


def twins(size):
    """Two different words that polynomial hashes modulo 2**64 cannot tell apart."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_of_a_fixed_pattern_do_not_collide(spark, size):
    words = [f"w{i}" for i in range(19)]
    docs = [(k, " ".join([*words, t])) for k, t in enumerate(twins(size))]
    assert [r.n_removed for r in drop_repeated_windows(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()] == [0, 0]


def test_the_largest_id_is_not_the_missing_one(spark):
    last, text = (1 << 63) - 1, " ".join(f"w{i}" for i in range(25))
    rows = drop_repeated_windows(spark.createDataFrame([(last, text), (None, text)], "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.n_removed) for r in rows} == {(last, 0), (None, 25)}
