"""Removal of repeated byte strings against a brute-force search."""

import random

import numpy as np
import pytest

from rivulet.llm import blobs, suffix_dedup
from rivulet.llm.suffix_dedup import drop_repeated_strings
from test_substring_dedup import twins


def brute(rows, size=200):
    places = {}
    for d, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - size + 1):
            places.setdefault(raw[i : i + size], set()).add((d, i))
    out = {}
    for d, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - size + 1):
            if len(places[raw[i : i + size]]) > 1:
                gone[i : i + size] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(raw), int(gone.sum()), runs, raw[: len(gone)][:0] + np.frombuffer(raw, np.uint8)[~gone].tobytes())
    return out


def corpus(rnd):
    say = lambda n: "".join(rnd.choice("abcdeé \n") for _ in range(n))
    shared = [say(n) for n in (180, 199, 200, 201, 230, 260, 300, 420, 700)]
    docs = []
    for d in range(150):
        parts = [say(rnd.randint(0, 150))]
        for _ in range(rnd.randint(0, 4)):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) // 3)
            parts += [s[a:] if rnd.random() < 0.4 else s[: len(s) - a] if rnd.random() < 0.5 else s, say(rnd.randint(0, 60))]
        docs.append((d, "".join(parts)))
    docs += [(200, None), (201, ""), (202, "x" * 3000), (203, "x" * 200), (204, "y" * 201), (205, "xy" * 400), (206, docs[3][1]), (207, say(40_000))]
    docs += [(300 + k, shared[8] + say(30)) for k in range(90)]  # one core, many different ends
    return docs


@pytest.mark.parametrize("flush, hot, kinds", [(1 << 21, 1000, 1000), (400, 64, 1000), (1 << 21, 3, 9), (150, 2, 4)])
def test_matches_brute_force_whatever_the_flush(spark, monkeypatch, flush, hot, kinds):
    monkeypatch.setattr(blobs, "FLUSH", flush)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "KINDS", kinds)
    docs = corpus(random.Random(flush + hot))
    want = brute(docs)
    rows = drop_repeated_strings(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    bad = {r.doc_id: ((r.n_bytes, r.n_removed, r.n_spans), want[r.doc_id][:3]) for r in rows if (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) != want[r.doc_id]}
    assert len(rows) == len(docs) and not bad


def test_missing_and_repeated_ids_and_clashing_columns(spark):
    a, b = "".join(chr(97 + i * i % 23) + str(i) for i in range(150)), "".join(chr(98 + i * 7 % 19) + str(i) for i in range(150))
    rows = [(None, a, 1), (5, a, 2), (5, a, 2), (5, b, 3)]
    got = drop_repeated_strings(spark.createDataFrame(rows, "doc_id bigint, text string, wholes int")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == sorted([("None", len(a)), ("5", len(a)), ("5", len(a)), ("5", 0)])
    assert drop_repeated_strings(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_every_window_is_in_one_segment_or_alone():
    rnd = random.Random(1)
    raw = "".join(rnd.choice("abcdefgh") for _ in range(20_000)).encode() + b"z" * 3000
    data = np.frombuffer(raw, np.uint8)
    offs = np.array([0, 0, 150, 5_000, 5_199, 5_400, 23_000])
    _, first, final, _, lone, _, _ = suffix_dedup.parse(suffix_dedup.Hashes(data), offs)
    found = sorted([s for a, b in zip(first, final) for s in range(a, b + 1)] + lone.tolist())
    assert found == [s for a, b in zip(offs[:-1], offs[1:]) for s in range(a, b - 199)]


@pytest.mark.parametrize("size", [1024, 4096])
def test_strings_of_a_fixed_pattern_do_not_collide(spark, size):
    """Lone windows and segments of words that hashes modulo 2**64 cannot tell apart."""
    docs = [(k, t) for k, t in enumerate(twins(size))]
    want = brute(docs)
    rows = drop_repeated_strings(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_removed, bytes(r.kept)) for r in rows} == {d: (w[1], w[3]) for d, w in want.items()}


def test_the_largest_id_is_not_the_missing_one(spark):
    last, text = (1 << 63) - 1, "".join(chr(97 + i * i % 23) + str(i) for i in range(150))
    rows = drop_repeated_strings(spark.createDataFrame([(last, text), (None, text), (4, "x")], "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.n_removed) for r in rows} == {(last, len(text)), (None, len(text)), (4, 0)}


def test_suffix_ranks_are_the_order_of_suffixes():
    rnd = random.Random(5)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 30))) for _ in range(60)]
    ends = np.cumsum([len(s) for s in strings])
    rank = suffix_dedup.suffix_ranks(np.frombuffer(b"".join(strings), np.uint8), np.repeat(ends, [len(s) for s in strings]))
    suffixes = [s[i:] for s in strings for i in range(len(s))]
    assert [rank.tolist().index(r) for r in sorted(set(rank.tolist()))] == [suffixes.index(x) for x in sorted(set(suffixes))]


def test_fingerprints_are_polynomials_modulo_a_prime():
    data = np.frombuffer(bytes(random.Random(3).randrange(256) for _ in range(900)), np.uint8)
    a, b = np.array([0, 5, 100, 700]), np.array([900, 5, 300, 900])
    for k, base in enumerate(suffix_dedup.BASES):
        want = [sum((int(x) + 1) * pow(base, i, suffix_dedup.PRIME) for i, x in enumerate(data[p:q])) % suffix_dedup.PRIME for p, q in zip(a, b)]
        assert suffix_dedup.Hashes(data).polynomial(k, a, b).tolist() == want


def test_repeated_runs_match_brute_force():
    """Random segments around one trigger, on either side of it alike for a while."""
    rnd = random.Random(9)
    probe = bytes(rnd.choice(b"abcdefgh") for _ in range(4000))
    at = next(int(t) for t in suffix_dedup.Hashes(np.frombuffer(probe, np.uint8)).triggers() if t > 300)
    lefts = [probe[at - 150 : at], *(bytes(rnd.choice(b"uvw") for _ in range(150)) for _ in range(3))]
    rights = [probe[at : at + 200], probe[at : at + 120] + b"q" * 80, probe[at : at + 60] + b"r" * 140]
    segments = []
    for _ in range(80):
        n = rnd.randint(0, 150)
        left = rnd.choice(lefts)[:n] + probe[at - 150 + n : at]
        left = left[len(left) - rnd.randint(0, 150) :]
        if suffix_dedup.Hashes(np.frombuffer(left + probe[at : at + 12], np.uint8)).triggers().tolist() == [len(left)]:
            segments.append((left, rnd.choice(rights)))
    whole = [a + b for a, b in segments]
    data, offs = np.frombuffer(b"".join(whole), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in whole])]).astype(np.int64)
    t = np.array([len(a) for a, _ in segments])
    places = {}
    for k, w in enumerate(whole):
        for i in range(len(w) - 199):
            places.setdefault(w[i : i + 200], set()).add((k, i))
    want = {x for found in places.values() if len(found) > 1 for x in found}
    got = set()
    for k, s, size in zip(*suffix_dedup.repeated_runs(data, offs, t)):
        got |= {(int(k), int(i)) for i in range(s, s + size - 199)}
    assert len(segments) > 20 and want and got == want
