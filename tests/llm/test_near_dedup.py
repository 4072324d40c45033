"""Near-duplicate components against a brute-force comparison of all sets."""

import itertools
import random
import re

import numpy as np
import pytest

from rivulet.llm import near_dedup as nd
from test_substring_dedup import twins


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def corpus(rnd):
    word = lambda: rnd.choice(["Al", "bé", "c", "日"]) + str(rnd.randint(0, 300))
    rows, i = [], 0
    for n in (3, 5, 6, 8, 12, 20, 40, 80, 200, 600):
        for _ in range(6):
            base = [word() for _ in range(n)]
            for _ in range(rnd.randint(1, 6)):
                own = list(base)
                for _ in range(rnd.randint(0, max(1, n // 45))):
                    own[rnd.randrange(len(own))] = word()
                if rnd.random() < 0.3:
                    own += [word() for _ in range(rnd.randint(1, max(1, n // 10)))]
                rows.append((i, " ".join(own)))
                i += 1
    # A chain whose ends do not link, and one large family.
    chain = [word() for _ in range(100)]
    for k in range(12):
        rows.append((i, " ".join(chain)))
        i += 1
        for j in range(4):
            chain[k * 8 + j] = word()
    base = [word() for _ in range(150)]
    for _ in range(120):
        own = list(base)
        own[rnd.randrange(150)] = word()
        rows.append((i, " ".join(own)))
        i += 1
    rnd.shuffle(rows)
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, "One"), (9004, "one"), (9005, "wort " * 50_000), (9006, "wort " * 4)]


def test_components_match_brute_force(spark):
    rows = corpus(random.Random(4))
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)


def test_missing_and_repeated_ids_empty_tables_and_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, 1), (4, text, 2), (4, text, 2), (2, text + " x", 3), (7, "other words here now", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    got = sorted(map(tuple, nd.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 27, None, True), (4, 27, 2, False), (4, 27, 2, False), (2, 28, 2, True), (7, 1, 7, True)], key=str)
    kept = nd.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "7", "None"]
    assert nd.near_duplicates(df.limit(0)).collect() == []


def test_registers_estimate_similarity():
    rnd = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.8, 0.95):
        found = []
        for n in (30, 400, 5000):
            both = rnd.integers(1, (1 << 64) - 1, int(n * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rnd.integers(1, (1 << 64) - 1, n - len(both), dtype=np.uint64)])) for _ in range(2))
            true = len(both) / (2 * n - len(both))
            r = nd.sketches([a, b])
            n_ab = np.array([n])
            found.append(abs(nd.estimate(r[:1], r[1:], n_ab, n_ab)[0] - true) / np.sqrt(1 / min(n, nd.REGISTERS)))
        assert max(found) < 3


def test_equal_sets_have_equal_registers_and_empty_sets_none():
    s = np.array([3, 1 << 40, 1 << 63], np.uint64)
    r = nd.sketches([s, np.zeros(0, np.uint64), s, s[:1]])
    assert (r[0] == r[2]).all() and not r[1].any() and len(set(r[3])) == 1


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_of_a_fixed_pattern_do_not_link(spark, size):
    docs = [(k, f"one two three {t}") for k, t in enumerate(twins(size))]
    assert {r.component_id for r in nd.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()} == {0, 1}


def test_crowded_buckets_of_unlike_members_match_brute_force(spark, monkeypatch):
    """Families with one large common part, just under and over the threshold, dealt by salt."""
    monkeypatch.setattr(nd, "SALT", 7)
    monkeypatch.setattr(nd, "GROUP", 5)
    rnd, rows = random.Random(8), []
    for family in range(3):
        common = [f"c{family}x{i}" for i in range(60)]
        for k in range(50):
            own = [f"u{family}y{k if rnd.random() < 0.7 else k % 4}z{i}" for i in range(rnd.randint(3, 14))]
            rows.append((len(rows), " ".join(common + own)))
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)
