"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from rivulet.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TYPES = "doc_id bigint, text string, weight string, id bigint"


def features(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, items, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    def slots(text):
        return [zlib.crc32(f.encode()) % buckets for f in features(text, longest)[1]]

    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, text in docs:
        np.add.at(s, slots(text), 1)
    for text in items:
        np.add.at(t, slots(text), 1)
    ratio = (t + 1.0) * (s.sum() + float(buckets)) / ((s + 1.0) * (t.sum() + float(buckets)))
    gain = [math.floor(1000 * math.log(r)) for r in ratio.tolist()]
    rows = []
    for i, text in docs:
        own = slots(text)
        weight, score = sum(gain[k] for k in own), None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(own), weight, score, None, features(text, 1)[0]])
    able = sorted((r for r in rows if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def sample(seed=5):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "ü", "日本", "x9", "über", "q" * 70, "a.b", "-", "don't"]
    docs = [(i, " ".join(rnd.choice(words[: rnd.randint(2, 11)]) for _ in range(rnd.randint(0, 90)))) for i in range(200)]
    docs += [(500, None), (501, ""), (502, " ...\n"), (503, "long text of Words " * 3000), (504, "w" * 9000), (505, "ß" * 50 + " end " * 40)]
    return docs, [" ".join(rnd.choice(words) for _ in range(30)) for _ in range(20)] + [None, ""]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def run(spark, docs, items, **how):
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], TYPES).repartition(3)
    target = spark.createDataFrame([(t,) for t in items], "text string")
    return order(map(tuple, importance.importance_weights(df, target, **how).collect()))


@pytest.mark.parametrize("how", [{}, {"longest": 3, "buckets": 97, "percent": 33, "least_words": 5, "seed": 7}, {"longest": 2, "chunk": 40}, {"chunk": 1}])
def test_equals_plain_version(spark, how):
    docs, items = sample()
    docs += [(None, "no id " * 30), (3, docs[3][1])]  # a row again
    plain = {k: v for k, v in how.items() if k in ("longest", "buckets", "percent", "seed")}
    want = brute(docs, items, least=how.get("least_words", 20), **plain)
    assert run(spark, docs, items, **how) == order(want)


def test_repeated_long_rows_are_each_weighed(spark):
    docs = [(1, "many words here " * 300)] * 3 + [(2, "other words " * 30)]
    assert run(spark, docs, ["many"], chunk=100, percent=50) == order(brute(docs, ["many"], percent=50))


def test_chunks_keep_every_start_once():
    raw = ("Überlange Wörter, and  short ones. " * 50 + "x" * 500 + " end").encode()
    for size in (1, 7, 64, 10_000):
        for carry in (0, 1, 2):
            made = list(importance.cut(raw, size, carry))
            assert b"".join(c[:own] for c, own in made) == raw
            for (c, own), (after, _) in zip(made, made[1:]):
                found = importance._WORD.findall(after)[:carry]
                assert importance._WORD.findall(c[own:]) == found or carry > len(found)


def test_crc_of_spans():
    rnd = random.Random(1)
    spans = [bytes(rnd.randrange(256) for _ in range(n)) for n in [0, 1, 3, 8, 47, 48, 49, 300]]
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    begin = np.array([zlib.crc32(b"before")] * len(spans), np.uint32)
    got = importance.crc_continued(begin, data, ends - [len(s) for s in spans], ends)
    assert got.tolist() == [zlib.crc32(b"before" + s) for s in spans]


def test_drawn_rows_keep_their_columns(spark):
    docs, items = sample()
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], TYPES)
    target = spark.createDataFrame([(t,) for t in items], "text string")
    drawn = importance.resample(df, target)
    assert drawn.columns == df.columns
    assert {r.doc_id for r in drawn.collect()} == {r[0] for r in brute(docs, items) if r[4]}


def test_empty_tables(spark):
    docs, _ = sample()
    assert run(spark, [], ["some words"]) == []
    assert run(spark, docs, []) == order(brute(docs, []))
