"""Language identification: held-out accuracy, several centroids, edge cases."""

import random

import numpy as np

from rivulet.llm import language_id as li

SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["ré", "tü", "shé"], "cc": ["st", "ung", "ver"]}


def corpus(rnd, n):
    rows = []
    for i in range(n):
        lang = rnd.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(4, 60))), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(random.Random(1), 900)
    df = spark.createDataFrame(rows, "id bigint, text string, lang string").repartition(3)
    model = li.fit(df.filter("id < 500"), train_rows=300)
    got = {r.id: r for r in li.predict(df, model, keep=("id",)).collect()}
    assert all(got[i].lang_pred == lang and 0 < got[i].score <= 1 for i, _, lang in rows if i >= 500)
    assert all(model.languages.count(x) == li.CENTROIDS for x in SYLLABLES)


def unit(v):
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def test_clusters_equal_a_plain_version():
    """Kinds of text that lie apart are each a centroid, whatever outliers there are."""
    rng = np.random.default_rng(3)
    kinds = np.eye(12)[:4] * 5
    v = unit(np.concatenate([rng.normal(size=(n, 12)) * 0.4 + kinds[k] for k, n in enumerate((90, 60, 40, 30))] + [rng.normal(size=(2, 12))])).astype(np.float32)
    got = li.cluster(v, 4)
    assert got.shape == (4, 12) and np.allclose(np.linalg.norm(got, axis=1), 1, atol=1e-5)
    own = [max(range(4), key=lambda k: sum(float(x) * float(y) for x, y in zip(row, got[k]))) for row in v]
    for k in range(4):  # each is the mean of the rows nearest to it, and of one kind
        rows = [v[i] for i in range(len(v)) if own[i] == k]
        assert np.allclose(got[k], unit(np.sum(rows, axis=0)), atol=1e-4)
    assert len({own[i] for i in (0, 100, 160, 200)}) == 4 and all(len(set(own[a:b])) == 1 for a, b in ((0, 90), (90, 150), (150, 190), (190, 220)))


def test_clusters_of_few_or_equal_rows():
    v = unit(np.random.default_rng(1).normal(size=(3, 5)).astype(np.float32))
    assert len(li.cluster(v, 4)) == 3 and len(li.cluster(np.repeat(v[:1], 50, axis=0), 4)) == 1
    copies = np.concatenate([np.repeat(v[:1], 60, axis=0), v[1:]])
    assert len(li.cluster(copies, 4)) >= 2


def test_reach_leaves_outliers_aside(spark):
    rows = [(i, "ka lo mi " * (3 + i % 5), "aa") for i in range(400)] + [(999, "qq xx zz ww", "aa")]
    model = li.fit(spark.createDataFrame(rows, "id bigint, text string, lang string"))
    assert min(model.reach) < 0.5


def test_edge_cases(spark):
    df = spark.createDataFrame(corpus(random.Random(2), 200), "id bigint, text string, lang string")
    model = li.fit(df)
    long = "ka lo " * 300_000
    odd = [(1, None), (2, ""), (3, "12 .. \n"), (4, "…—“ \U0001f600"), (5, "日本"), (6, long), (6, long), (7, "lomika mi kalo milomi kaka lo mika"), (None, "réré")]
    rows = spark.createDataFrame([(i, t, "zz") for i, t in odd], "doc_id bigint, text string, lang_pred string")
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in li.predict(rows, model).collect()), key=str)
    assert len(got) == len(odd)
    by_id = {g[0]: g for g in got}
    assert all(by_id[i][1:] == ("und", 0.0) for i in (1, 2, 3, 4))
    assert by_id[5][1] in SYLLABLES and by_id[6][1] == "aa" and by_id[None][1] == "bb"
    far = {r.doc_id: r.lang_pred for r in li.predict(rows, model, reject=True).collect()}
    assert far[5] == "und" and far[7] == "aa"
    assert li.predict(rows.limit(0), model).collect() == []


def test_without_labels_everything_is_undetermined(spark):
    df = spark.createDataFrame([(1, "ka", None)], "id bigint, text string, lang string")
    assert [r.lang_pred for r in li.predict(df, li.fit(df), keep=("id",)).collect()] == ["und"]
