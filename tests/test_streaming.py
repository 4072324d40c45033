"""Streams: in-order release, late and repeated responses."""

import random
from datetime import datetime, timedelta

import pytest

from rivulet.operators.ordering import with_running
from rivulet.sources.store import Store
from rivulet.streaming import ingest, release
from pyspark.sql import functions as F

NOW = datetime(2024, 1, 2)
DOC = '<rss version="2.0"><channel><title>{}</title>{}</channel></rss>'
ITEM = "<item><title>{0}</title><link>https://ex.com/{0}</link><guid>{0}</guid><pubDate>Mon, 01 Jan 2024 12:00:00 GMT</pubDate></item>"


def body(title, *items):
    return DOC.format(title, "".join(map(ITEM.format, items)))


def drain(stream, path, checkpoint):
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(180) and q.exception() is None


def test_results_are_released_in_list_order(spark, tmp_path):
    rnd = random.Random(4)
    runs = {"a": 23, "b": 7}
    rows = [(run, k, n, f"https://{run}/{k}", k % 3 == 0, "broken" if k % 5 == 4 else None, k) for run, n in runs.items() for k in range(n)]
    rnd.shuffle(rows)
    rows += rows[:4]  # some come again
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: release.in_order(spark.readStream.schema(release.RESULTS).parquet(source))
    arrived, held = [], {r: 0 for r in runs}
    for at in range(0, len(rows), 9):  # a batch each, restarting the stream every time
        part = rows[at : at + 9]
        spark.createDataFrame(part, release.RESULTS).coalesce(1).write.mode("append").parquet(source)
        arrived += part
        drain(stream(), out, str(tmp_path / "checkpoint"))
        got = spark.read.schema(release.RELEASED).parquet(out).collect()
        for run, n in runs.items():
            seen = {r[1] for r in arrived if r[0] == run}
            first = next(k for k in range(n + 1) if k not in seen)
            own = sorted((r for r in got if r.run == run), key=lambda r: r.completed)
            assert [r.ordinal for r in own] == list(range(first)) == [r.completed - 1 for r in own]
            assert [r.percent for r in own] == [(k + 1) * 100 // n for k in range(first)]
            held[run] = max(held[run], len(seen) - first)
    final = spark.read.schema(release.RELEASED).parquet(out)
    assert final.count() == sum(runs.values()) and held["a"] > 0
    lines = {r.line for r in final.filter("run = 'b'").select(release.progress_line(2).alias("line")).collect()}
    assert " 14%  1/7 cached https://b/0" in lines and " 71%  5/7 failed https://b/4: broken" in lines and "100%  7/7 cached https://b/6" in lines


def test_release_times_of_finished_results(spark):
    rnd = random.Random(9)
    times = [NOW + timedelta(seconds=rnd.randint(0, 500)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(times)), "ordinal int, at timestamp_ntz").repartition(5)
    got = release.release_times(df, [F.col("ordinal").asc()], "at").orderBy("ordinal").collect()
    assert [r.release_at for r in got] == [max(times[: k + 1]) for k in range(300)]
    assert [(r.completed, r.percent) for r in got] == [(k + 1, (k + 1) * 100 // 300) for k in range(300)]
    assert release.release_times(df.limit(0), [F.col("ordinal").asc()], "at").count() == 0


def test_running_totals(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS v").repartition(6)
    rows = with_running(df, [F.col("v").desc(), F.col("id").asc()], F.col("v"), "total").collect()
    total, want = 0, {}
    for i in sorted(range(1000), key=lambda i: (-(i % 7), i)):
        total += i % 7
        want[i] = total
    assert {r.id: r.total for r in rows} == want and "total" in rows[0] and len(rows[0]) == 3


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "archive")).init()


def respond(spark, folder, *rows):
    """(feed, minutes after NOW, etag, body, status) rows as one arriving file."""
    made = [(u, k, status, etag, "", text, None, NOW + timedelta(minutes=m)) for k, (u, m, etag, text, status) in enumerate(rows)]
    spark.createDataFrame(made, ingest.TIMED).coalesce(1).write.mode("append").parquet(folder)


def merge(spark, store, folder, checkpoint, minutes):
    q = ingest.start(ingest.read_responses(spark, folder, timed=True), store, str(checkpoint), now=lambda: NOW + timedelta(minutes=minutes))
    assert q.awaitTermination(180) and q.exception() is None
    store.open()
    return sorted((r.feed_url, r.guid, r.archived) for r in store.items.collect()), {r.url: (r.title, r.etag, r.error_count) for r in store.feeds.collect()}


def test_late_and_repeated_responses_change_nothing(spark, store, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), tmp_path / "checkpoint"
    respond(spark, folder, ("https://f", 10, "v2", body("Two", "a", "b"), 200), ("https://g", 5, "", body("G", "x"), 200))
    first = merge(spark, store, folder, checkpoint, 11)
    assert first[0] == [("https://f", "a", False), ("https://f", "b", False), ("https://g", "x", False)] and first[1]["https://f"] == ("Two", "v2", 0)
    # Older than what has been merged, the same version again, the same body without an ETag, a failure from before.
    respond(spark, folder, ("https://f", 3, "v1", body("One", "a"), 200), ("https://f", 12, "v2", body("Two", "a", "b"), 200), ("https://g", 6, "", body("G", "x"), 200), ("https://g", 4, "", None, 500))
    number = store.manifest["number"]
    assert merge(spark, store, folder, checkpoint, 13) == first and store.manifest["number"] == number
    assert ingest.counters(store) == {"late": 2, "duplicate": 2}
    # In one batch the latest counts; a failure after it is noted.
    respond(spark, folder, ("https://f", 21, "v4", body("Four", "a"), 200), ("https://f", 20, "v3", body("Three", "a", "b", "c"), 200), ("https://g", 30, "", None, 500))
    items, feeds = merge(spark, store, folder, checkpoint, 31)
    assert items == [("https://f", "a", False), ("https://f", "b", True), ("https://g", "x", False)]
    assert feeds["https://f"] == ("Four", "v4", 0) and feeds["https://g"][2] == 1
    assert ingest.counters(store) == {"late": 2, "duplicate": 2}
    aside = ingest.put_aside(store).collect()
    assert {(r.feed_url, r.verdict) for r in aside} == {("https://f", "late"), ("https://f", "duplicate"), ("https://g", "late"), ("https://g", "duplicate")}


def test_two_streams_share_an_archive(spark, store, tmp_path):
    for k, name in enumerate(("one", "two")):
        respond(spark, str(tmp_path / name), (f"https://{name}", k, "e", body(name, name), 200))
        merge(spark, store, str(tmp_path / name), tmp_path / f"checkpoint-{name}", 5)
    assert {r.url for r in store.feeds.collect()} == {"https://one", "https://two"}
    assert len({p.name for p in (tmp_path / "archive" / "landing").glob("stream-*-0")}) == 2
