"""Toxicity: held-out accuracy, learner properties and edge cases."""

import math
import random
import struct

import numpy as np
import pytest
import xxhash

from rivulet.llm import toxicity as tx


def corpus(rnd, n):
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "ré", "tu", "sha"]) for _ in range(rnd.randint(1, 4)))
    rows = []
    for i in range(n):
        bad = rnd.random() < 0.2
        words = [word() for _ in range(rnd.randint(20, 120))]
        for _ in range(rnd.randint(2, 5) * bad):
            words[rnd.randrange(len(words))] = rnd.choice(["vile", "grotty", "rancid"]) + rnd.choice(["", "er", "ness"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(random.Random(1), 1500)
    docs = spark.createDataFrame([r[:2] for r in rows], "id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 1000], "id bigint, label int")
    model = tx.fit(docs, labels)
    assert 0 < len(model[0]) < 2000
    got = {r.id: r.score for r in tx.score(docs, model, keep=("id",)).collect()}
    held = [(y, got[i]) for i, _, y in rows if i >= 1000]
    assert sum(s >= tx.THRESHOLD for y, s in held if y) > 0.9 * sum(y for y, _ in held)
    assert sum(s >= tx.THRESHOLD for y, s in held if not y) <= 3


def test_scores_match_a_plain_sum_and_edge_cases(spark):
    model = (np.array([3, 70, 900_000], np.int32), np.array([0.5, -1, 2], np.float32))
    weights = dict(zip(model[0].tolist(), model[1].tolist()))
    rnd = random.Random(2)
    rows = [(i, " ".join(f"w{rnd.randint(0, 4000)}" for _ in range(rnd.randint(0, 3000)))) for i in range(60)] + [(99, None), (99, ""), (None, "x y"), (100, "..!")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id bigint, text string, slots double")
    got = tx.score(df, model, keep=("doc_id", "slots")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r.score for r in got}
    for i, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        slots = set(tx.features(data, np.array([0, len(data)]))[0].tolist())
        assert abs(by_id[i] - 1 / (1 + np.exp(-sum(weights.get(s, 0) for s in slots)))) < 1e-6
    assert by_id[99] == by_id[100] == 0.5


def test_empty_inputs_and_removal(spark):
    none = spark.createDataFrame([], "id bigint, label int")
    docs = spark.createDataFrame([(1, "a", "x"), (2, None, None)], "id bigint, text string, score string")
    model = tx.fit(docs, none)
    assert len(model[0]) == 0
    assert tx.drop_toxic(docs, model).columns == docs.columns and tx.drop_toxic(docs, model).count() == 2
    assert tx.score(docs.limit(0), model, keep=("id",)).collect() == []


def test_skip_grams_do_not_cross_documents():
    data = np.frombuffer(b"aa bb" + b"cc dd", np.uint8)
    _, first = tx.features(data, np.array([0, 5, 10]))
    assert first.tolist() == [0, 3, 6]


def plain_ftrl(data, epochs, alpha, beta, l1, l2):
    """FTRL-proximal one coordinate at a time, with dictionaries."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    ones = sum(y for _, y in data)
    boost = max(1.0, min(4.0, (len(data) - ones) / ones / 2)) if ones else 1.0
    for _ in range(epochs):
        for slots, y in data:
            p = 1 / (1 + math.exp(-sum(map(weight, slots))))
            g = (p - y) * (boost if y else 1.0)
            for i in slots:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - sigma * weight(i), n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_fit_matches_plain_ftrl(spark):
    rows = corpus(random.Random(6), 300)
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[3][:2]], "id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(rows[5][0], rows[5][2]), (None, 1), (9999, 1)], "id bigint, label int")
    slots, weights = tx.fit(docs, labels)

    def order(i):
        h = xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)
        return h - (1 << 64) if h >= 1 << 63 else h

    data = []
    for i, text, y in sorted(rows, key=lambda r: order(r[0])):
        raw = np.frombuffer(text.encode(), np.uint8)
        data.append((set(tx.features(raw, np.array([0, len(raw)]))[0].tolist()), y))
    like = tx.Ftrl()
    want = plain_ftrl(data, 3, like.alpha, like.beta, like.l1, like.l2)
    assert want and dict(zip(slots.tolist(), weights.tolist())) == pytest.approx(want, rel=1e-4)


def test_sampling_is_by_hash_alone(spark):
    """Beyond the bounds the fit is the same however rows are dealt, and repeats change nothing."""
    rows = corpus(random.Random(7), 600)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "id bigint, label int")
    fits = []
    for parts in (1, 7):
        docs = spark.createDataFrame([r[:2] for r in rows] + [rows[0][:2]] * 50 * (parts > 1), "id bigint, text string").repartition(parts)
        fits.append(tx.fit(docs, labels, train_rows=200, train_bytes=60_000))
    assert all((a == b).all() for a, b in zip(*fits))


def test_a_very_long_text_is_scored_whole(spark):
    model = (np.sort(np.unique(tx.features(np.frombuffer(b"vile", np.uint8), np.array([0, 4]))[0])).astype(np.int32), np.array([3.0], np.float32))
    rows = spark.createDataFrame([(1, "word " * 400_000), (2, "word " * 400_000 + "vile")], "doc_id bigint, text string")
    assert [r.score > 0.9 for r in tx.score(rows, model).orderBy("doc_id").collect()] == [False, True]
