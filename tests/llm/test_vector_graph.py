"""Nearest vectors against brute force."""

import math

import numpy as np
import pytest

from rivulet.llm import vector_graph

TYPES = "vec_id bigint, embedding array<float>, label int, rank string"


def sample(n, dim, seed=4, spread=0.0):
    """Vectors of uneven length, with groups of copies and near copies and rows that take no part."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[: n // 3] = v[0] + (rng.normal(size=(n // 3, dim)) * 1e-3).astype(np.float32)  # near copies of one
    v[n // 3 : n // 2] = v[n // 3]  # exact copies
    v *= np.exp(rng.normal(size=(n, 1)) * spread).astype(np.float32)
    rows = [(i * 5, [float(x) for x in w], i % 7) for i, w in enumerate(v)]
    bad = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [math.nan] * dim, [math.inf] * dim]
    rows += [(20 * (n + k), w, 0) for k, w in enumerate(bad)] + [(None, [1.0] * dim, 0)]
    return rows + [(20 * (n + 50), [1.0] * (dim + 1), 0)]  # of another length: meets nothing


def plain(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(vectors, queries, k):
    kept = [(i, np.array(v, np.float64)) for i, v in vectors if i is not None and plain(v)]
    out = []
    for q, w in queries:
        if q is None or not plain(w):
            continue
        found = []
        for i, v in kept:
            if i != q and len(v) == len(w):
                score = 0.0
                for x, y in zip(v.tolist(), w):
                    score += x * y
                found.append((-score, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return out


def run(spark, rows, every=20, **how):
    df = spark.createDataFrame([(*r, "extra") for r in rows], TYPES).repartition(3)
    return [tuple(r) for r in vector_graph.nearest_vectors(df, df.filter(f"vec_id % {every} = 0"), **how).collect()]


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_small_shards_are_exact(spark, spread):
    rows = sample(400, 6, spread=spread)
    got = run(spark, rows, k=20)
    assert sorted(got) == sorted(brute([r[:2] for r in rows], [r[:2] for r in rows if r[0] is not None and r[0] % 20 == 0], 20))


def test_fewer_candidates_than_asked_for_and_several_blocks(spark):
    rows = sample(9, 3)
    got = run(spark, rows, every=5, k=20, query_unit=2)
    assert sorted(got) == sorted(brute([r[:2] for r in rows], [r[:2] for r in rows if r[0] is not None], 20))


def test_repeated_ids_count_once(spark):
    rows = [(20, [1.0, 0.0], 0), (20, [1.0, 0.0], 1), (40, [0.5, 0.5], 0), (60, [0.25, 0.0], 0)]
    assert [r[:3] for r in sorted(run(spark, rows))] == [(20, 1, 40), (20, 2, 60), (40, 1, 20), (40, 2, 60), (60, 1, 20), (60, 2, 40)]


@pytest.mark.parametrize("kind", ["even", "copies", "lengths"])
def test_recall(spark, kind):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 32)).astype(np.float32)
    if kind == "copies":
        v[:1000] = v[0] + (rng.normal(size=(1000, 32)) * 1e-3).astype(np.float32)
        v[1000:1400] = v[1000]
    if kind == "lengths":
        v *= np.exp(rng.normal(size=(3000, 1))).astype(np.float32)
    got = run(spark, [(i, [float(x) for x in w], 0) for i, w in enumerate(v)])
    asked = np.arange(0, 3000, 20)
    exact = v[asked].astype(float) @ v.T.astype(float)
    exact[np.arange(len(asked)), asked] = -np.inf
    cut = np.sort(exact, 1)[:, -20] - 1e-9  # copies tie
    assert [r[:2] for r in sorted(got)] == [(q, k + 1) for q in asked for k in range(20)]
    assert sum(exact[q // 20, i] >= cut[q // 20] for q, _, i, _ in got) >= 0.95 * 20 * len(asked)
    assert all(abs(s - exact[q // 20, i]) < 1e-9 for q, _, i, s in got)


def test_every_vector_is_reached():
    rng = np.random.default_rng(2)
    far = [rng.normal(size=(40, 8)) * 1e-4 + rng.normal(size=(1, 8)) * 10 for _ in range(30)]
    graph = vector_graph.Graph(np.concatenate(far).astype(np.float32), degree=4, beam=8)
    seen, front = {graph.entry}, [graph.entry]
    while front:
        front = [j for i in front for j in graph.edges[i].tolist() if j >= 0 and j not in seen and not seen.add(j)]
    assert len(seen) == 1200


def test_double_vectors_and_long_shards(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "ROW_BYTES", 1000)
    rows = [(i * 20, [float(x) for x in w], 0) for i, w in enumerate(np.random.default_rng(5).normal(size=(90, 4)) * 1e160)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = vector_graph.nearest_vectors(df, df.limit(90), k=3).collect()
    assert {r.query_id: r.vec_id for r in got if r["rank"] == 1}.keys() == {r[0] for r in rows}


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [(20, None, 1), (None, [1.0], 2)]) == []
