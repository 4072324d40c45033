"""Selection, purge and merge operators against imperative models."""

import random
from datetime import datetime, timedelta

import pytest

from rivulet import schema
from rivulet.operators import lists, merge
from rivulet.operators import relations as R
from rivulet.operators import selection as sel

NOW = datetime(2024, 1, 25)


def random_items(rnd, feeds=40):
    rows, i = [], 0
    for f in range(feeds):
        for _ in range(rnd.randint(0, 14)):
            at = NOW - timedelta(hours=rnd.randint(-60, 400)) if rnd.random() > 0.05 else None
            rows.append((i, f"f{f}", f"g{i}", at, rnd.random() < 0.5))
            i += 1
    return rows


ITEM = "id bigint, feed_url string, guid string, published_date timestamp_ntz, archived boolean"


@pytest.mark.parametrize("minimum", [1, 3, 5, 20])
def test_minimum_items_match_a_loop(spark, minimum):
    rows = random_items(random.Random(minimum))
    start, end = NOW - timedelta(days=3), NOW
    want = {}
    for f in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == f), key=lambda r: (r[3] or datetime.min, r[0]), reverse=True)
        chosen = [r for r in own if r[3] and start <= r[3] <= end]
        if len(chosen) < minimum:
            chosen += [r for r in own if r not in chosen][: minimum - len(chosen)]
        want |= {r[0]: k + 1 for k, r in enumerate(chosen)}
    got = sel.with_minimum(spark.createDataFrame(rows, ITEM), start, end, minimum).collect()
    assert {r.id: r.position for r in got} == want


@pytest.mark.parametrize("minimum", [0, 1, 4])
def test_purge_floor_matches_a_loop(spark, minimum):
    rows = random_items(random.Random(minimum + 50))
    cutoff = NOW - timedelta(days=5)
    gone = set()
    for f in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == f), key=lambda r: (r[3] or datetime.min, r[0]), reverse=True)
        gone |= {r[0] for r in own[minimum:] if r[4] and r[3] and r[3] < cutoff}
    deleted, kept = merge.purge_with_floor(spark.createDataFrame(rows, ITEM), cutoff, minimum)
    assert {r.id for r in deleted.collect()} == gone and {r.id for r in kept.collect()} == {r[0] for r in rows} - gone


def test_ranks_are_total_over_hours(spark):
    rnd = random.Random(3)
    rows = [(f"u{i}", rnd.choice([None, NOW - timedelta(minutes=rnd.randint(-500, 9000))]), rnd.choice([None, NOW - timedelta(days=rnd.randint(0, 9))])) for i in range(300)]
    df = spark.createDataFrame(rows, "url string, latest_item_date timestamp_ntz, last_updated timestamp_ntz")
    key = lambda r: min(r[1], NOW) if r[1] else r[2]
    order = sorted(rows, key=lambda r: (-(key(r) or datetime(1970, 1, 1)).timestamp() if key(r) else float("inf"), r[0]))
    assert [r.url for r in sel.ranked_feeds(df, NOW).orderBy("rank").collect()] == [r[0] for r in order]
    assert [r["first"] for r in sel.page_ranges(sel.paged(df, NOW, 25), 25).orderBy("page").collect()][:2] == [1, 26]


def stored(spark, *rows):
    names = [c.split()[0] for c in schema.ITEMS.split(", ")]
    return spark.createDataFrame([tuple({"title": "", "link": "", "content": "", "summary": "", "archived": False, **r}.get(n) for n in names) for r in rows], schema.ITEMS)


def test_upsert_keeps_dates_and_is_idempotent(spark):
    t = datetime(2024, 1, 1)
    old = stored(spark, {"id": 1, "feed_url": "f", "guid": "a", "title": "old", "published_date": t, "first_seen": t})
    new = stored(spark, {"id": 9, "feed_url": "f", "guid": "a", "title": "new", "published_date": NOW, "first_seen": NOW}, {"id": 2, "feed_url": "f", "guid": "b", "title": "b", "published_date": NOW})
    once = merge.upsert_items(old, new)
    twice = merge.upsert_items(once, new)
    want = {("a", 1, "new", t, t), ("b", 2, "b", NOW, None)}
    for df in (once, twice):
        assert {(r.guid, r.id, r.title, r.published_date, r.first_seen) for r in df.collect()} == want


def test_first_occurrence_fixes_dates_and_last_gives_the_rest(spark):
    rows = [("f", "a", 0, NOW, NOW, "one"), ("f", "a", 2, None, None, "three"), ("f", "a", 1, datetime(2020, 1, 1), NOW, "two"), ("f", "b", 3, None, NOW, None)]
    df = spark.createDataFrame(rows, "feed_url string, guid string, pos int, published_date timestamp_ntz, first_seen timestamp_ntz, title string")
    got = {r.guid: (r.published_date, r.title) for r in merge.collapse_items(df).collect()}
    assert got == {"a": (NOW, "three"), "b": (None, None)}


def test_archive_scope(spark):
    items = stored(spark, *({"id": i, "feed_url": f, "guid": g} for i, (f, g) in enumerate([("f", "1"), ("f", "2"), ("e", "1"), ("x", "1")])))
    active = spark.createDataFrame([("f", "2")], "feed_url string, guid string")
    parsed = spark.createDataFrame([("f",), ("e",)], "feed_url string")
    assert {(r.feed_url, r.guid): r.archived for r in merge.archive_absent(items, active, parsed).collect()} == {("f", "1"): True, ("f", "2"): False, ("e", "1"): True, ("x", "1"): False}


def test_feed_state_updates(spark):
    df = spark.createDataFrame([("a", "e", "m", 2, "old", NOW, NOW), ("b", "e", "m", 1, "old", NOW, NOW)], "url string, etag string, last_modified string, error_count int, last_error string, last_fetch_time timestamp_ntz, last_successful_fetch timestamp_ntz")
    later = NOW + timedelta(days=1)
    err = {r.url: r for r in merge.apply_errors(df, spark.createDataFrame([("a", "HTTP 500"), ("new", "x")], "url string, error string"), later).collect()}
    assert set(err) == {"a", "b"} and (err["a"].error_count, err["a"].last_error, err["a"].last_fetch_time, err["a"].last_successful_fetch) == (3, "HTTP 500", later, NOW)
    same = {r.url: r for r in merge.apply_not_modified(df, spark.createDataFrame([("a",)], "url string"), later).collect()}
    assert (same["a"].error_count, same["a"].last_error, same["a"].last_successful_fetch, same["b"].last_fetch_time) == (2, "old", later, NOW)
    good = {r.url: r for r in merge.apply_success(df, spark.createDataFrame([("a", None, "n")], "url string, etag string, last_modified string"), later).collect()}
    assert (good["a"].etag, good["a"].last_modified, good["a"].error_count, good["a"].last_error) == ("", "n", 0, "")


def test_upsert_feeds_overwrites_but_keeps_the_latest_date(spark):
    old = spark.createDataFrame([("a", "t", NOW)], "url string, title string, latest_item_date timestamp_ntz")
    new = spark.createDataFrame([("a", "", None), ("b", "n", None)], "url string, title string, latest_item_date timestamp_ntz")
    assert {tuple(r) for r in merge.upsert_feeds(old, new).collect()} == {("a", "", NOW), ("b", "n", None)}


def test_lists_and_marks(spark):
    cur = spark.createDataFrame([("a", 0), ("b", 1)], "feed_url string, ordinal bigint")
    new = spark.createDataFrame([("c", 0), ("b", 1), ("c", 2)], "feed_url string, ordinal bigint")
    assert [r.feed_url for r in lists.added(cur, new, 2).orderBy("ordinal").collect()] == ["a", "b", "c"]
    assert lists.added_count(cur, new).first().added == 2  # a repeated new URL counts twice
    assert [r.feed_url for r in lists.duplicates(cur, new).collect()] == ["b"]
    meta = spark.createDataFrame([("a",), ("c",)], "url string")
    urls = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    assert {r.url: r.has_metadata for r in R.metadata_mark(urls, meta).collect()} == {"a": True, "b": False, "c": True}


def test_ids_continue_after_the_stored_ones(spark):
    cur = stored(spark, {"id": 7, "feed_url": "f", "guid": "a"})
    batch = spark.createDataFrame([("f", "a", 0), ("f", "b", 1), ("e", "x", 0), ("e", "y", 1)], "feed_url string, guid string, pos int")
    got = {(r.feed_url, r.guid): r.id for r in merge.numbered_inserts(cur, batch).collect()}
    assert got["f", "a"] == 7 and sorted(v for k, v in got.items() if k != ("f", "a")) == [8, 9, 10] and got["e", "x"] < got["e", "y"]


def test_null_dates_survive_deletes(spark):
    df = spark.createDataFrame([(1, "f", "a", None, True), (2, "f", "b", datetime(2020, 1, 1), True)], ITEM)
    assert [r.id for r in merge.purge_by_age(df, NOW)[1].collect()] == [1]
