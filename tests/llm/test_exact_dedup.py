"""Exact dedup against a brute-force grouping, with edge cases."""

import hashlib
import random
import re
from pathlib import Path

from pyspark.sql import functions as F

from rivulet.llm import exact_dedup
from rivulet.llm.exact_dedup import DigestIndex, drop_exact_duplicates, exact_duplicates
from rivulet.llm.filters import KeyFilter, with_keys, without_keys
from rivulet.llm.storage import Scratch, fresh_path, join_counted

SCHEMA = "doc_id bigint, text string, keep_id string"


def brute(rows):
    groups = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t, *_ in rows:
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_nulls_long_texts_and_clashing_columns(spark):
    long = "wort " * 200_000
    rows = [(5, "a  b", "x"), (3, "a\t\nb", "y"), (9, "a b ", None), (1, None, None), (2, "", None), (7, long, ""), (6, long.replace(" ", "\r\n"), ""),
            (None, "a b", None), (None, "alone", None), (8, "é  b", None), (4, "é  b", None), (3, "a b", "again")]
    got = exact_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    kept = drop_exact_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "keep_id"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 3, 4, 6, 9]


def test_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_compaction_merges_flushes_and_keeps_the_smallest(spark):
    index = DigestIndex(spark, fresh_path(spark, "index"))
    for ids in ([4, 9], [2, 7], [11]):
        index.flush(spark.createDataFrame([(bytes([i % 2]), i, 1) for i in ids], DigestIndex.SCHEMA))
    first = sorted(map(tuple, index.compact().collect()))
    assert first == [(b"\0", 2, 2), (b"\1", 7, 3)]
    assert [tuple(r) for r in index.find([b"\1", b"\7"]).collect()] == [(b"\1", 7, 3)]
    index.flush(spark.createDataFrame([(b"\1", 1, 1)], DigestIndex.SCHEMA))
    assert sorted(map(tuple, index.compact().collect())) == [(b"\0", 2, 2), (b"\1", 1, 4)]


def test_levels_fill_and_filters_keep_rows_in_place(spark):
    index = DigestIndex(spark, fresh_path(spark, "index"))
    rnd, want, shapes = random.Random(6), {}, []
    for k in range(7):
        rows = [(bytes([rnd.randrange(40), 7]), rnd.randrange(1000), 1) for _ in range(25)]
        for d, i, n in rows:
            least, many = want.get(d, (i, 0))
            want[d] = (min(least, i), many + n)
        index.flush(spark.createDataFrame(rows, DigestIndex.SCHEMA).repartition(3))
        shapes.append([len(level) for level in index.levels])
    assert shapes[0] == [1] and shapes[1] == [0, 1] and shapes[3] == [0, 0, 1] and shapes[6] == [1, 1, 1]
    some = sorted(want)[:5]
    assert {bytes(r.digest): (r.id, r.n) for r in index.find(some).collect()} == {d: want[d] for d in some}
    plan = index.levels[0][0].filter.mark(index.read(index.levels[1][0]), F.col("digest"), "hit")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan
    assert {bytes(r.digest): (r.id, r.n) for r in index.compact().collect()} == want
    assert len(list(Path(index.path.removeprefix("file://")).rglob("run=*"))) == 1  # merged runs are gone


def test_a_shared_digest_is_split_by_text(spark, monkeypatch):
    """Digests cut to a few bits stand for several texts; bytes tell them apart."""
    real = exact_dedup.F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: exact_dedup.F.rpad(exact_dedup.F.substring(real(c, n), 1, 1), 64, "0"))
    rows = [(i, f"text {i % 40}", "") for i in range(90)] + [(None, "text 3", ""), (None, "text 90", "")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {r[:4] for r in brute(rows)}


def test_filters_hold_every_key_and_few_others(spark):
    scratch = Scratch(spark)
    keys = spark.createDataFrame([(i,) for i in [*range(0, 4000, 2), None]], "k bigint")
    found = KeyFilter(keys, "k", scratch).mark(spark.range(4000), F.col("id"), "hit").collect()
    assert all(r.hit for r in found if r.id % 2 == 0) and sum(r.hit for r in found if r.id % 2) < 20
    none = KeyFilter(keys.limit(0), "k", scratch)
    assert none.mark(spark.range(9), F.col("id"), "hit").filter("hit").count() == 0
    wanted = spark.createDataFrame([(3,), (5,)], "w bigint")
    assert sorted(r.id for r in with_keys(spark.range(9), wanted, F.col("id"), "w", scratch).collect()) == [3, 5]
    assert sorted(r.id for r in without_keys(spark.range(5), wanted, F.col("id"), "w", scratch).collect()) == [0, 1, 2, 4]
    scratch.release()


def test_a_hot_key_is_broadcast(spark):
    rows = spark.createDataFrame([(i % 3 if i < 60 else i, i) for i in range(2100)], "k bigint, v bigint")
    keyed = spark.createDataFrame([(0, 20, "a"), (1, 20, "b"), (70, 1, "c")], "k bigint, n bigint, x string")
    joined = join_counted(rows, keyed, "k", "n", 2100)
    assert sorted((r.v, r.x) for r in joined.collect() if r.x) == sorted((i, "ab"[i % 3]) for i in range(60) if i % 3 < 2) + [(70, "c")]
    assert joined.count() == 2100
