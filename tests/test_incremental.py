"""Summaries kept by merges equal the full recomputation."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rivulet import schema
from rivulet.operators import incremental
from rivulet.operators import relations as R
from rivulet.sources.store import Store

AT = datetime(2024, 1, 1)
ITEM = "id bigint, feed_url string, guid string, title string, link string, published_date timestamp_ntz, archived boolean"


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def agree(store):
    items, metadata = store.items, store.url_metadata
    counts, links, votes = (store.table(n) for n in schema.SUMMARIES)
    feeds = items.select(F.col("feed_url").alias("url"), F.col("feed_url").alias("title")).distinct()
    assert rows(incremental.items_per_feed(feeds, counts), "url", "item_count") == rows(R.items_per_feed(feeds, items), "url", "item_count")
    assert rows(incremental.feed_favicons(votes), "feed_url", "favicon_url", "votes") == rows(R.feed_favicons(items, metadata), "feed_url", "favicon_url", "votes")
    assert rows(incremental.orphan_metadata(metadata, links), "url") == rows(R.orphan_metadata(metadata, items), "url")
    assert rows(counts, "feed_url", "total") == rows(items.groupBy("feed_url").agg(F.count("*").alias("total")), "feed_url", "total")


def test_random_merges(spark, tmp_path):
    rnd = random.Random(8)
    store = Store(spark, str(tmp_path / "archive"))
    store.manifest = {"version": 4, "tables": {}, "applied": {}, "buckets": 3}
    store.commit({n: spark.createDataFrame([], t) for n, t in schema.TABLES.items()})
    store.summarise()
    agree(store)
    items, metadata = {}, {}
    for step in range(12):
        feed_rows = {}
        for _ in range(rnd.randint(0, 25)):
            feed, k = f"https://f{rnd.randrange(7)}", rnd.randrange(30)
            link = rnd.choice(["", None, *(f"https://l/{n}" for n in range(9))])
            feed_rows[(feed, k)] = (k, feed, f"g{k}", "t", link, AT, rnd.random() < 0.3)
        items |= feed_rows
        for key in rnd.sample(sorted(items), min(len(items), rnd.randrange(6))):
            feed_rows[key] = items.pop(key)  # gone
        for n in rnd.sample(range(9), rnd.randrange(4)):
            url = f"https://l/{n}"
            if url in metadata and rnd.random() < 0.3:
                del metadata[url]
            else:
                metadata[url] = rnd.choice([None, "", "https://i/a", "https://i/b"])
        new_items = spark.createDataFrame([*items.values()], ITEM)
        new_metadata = spark.createDataFrame([*metadata.items()], "url string, favicon_url string")
        touched = store.touched(spark.createDataFrame([(f,) for f, _ in feed_rows] or [("none",)], "feed_url string"), "feed_url")
        part = {"items": new_items.filter(store.bucket("feed_url").isin(touched)), "url_metadata": new_metadata}
        if step % 3 == 0:
            store.commit(part, {"items": touched, "url_metadata": [0, 1, 2]})
        else:
            store.commit({"items": part["items"]}, {"items": touched})
            store.commit({"url_metadata": new_metadata.filter(store.bucket("url") == step % 3).unionByName(store.url_metadata.filter(store.bucket("url") != step % 3).select("url", "favicon_url"))})
            metadata = {r.url: r.favicon_url for r in store.url_metadata.collect()}
        if step % 4 == 3:
            agree(store)
    number = store.manifest["number"]
    store.compact()
    agree(Store(spark, store.path).open())
    assert store.manifest["number"] >= number and store.clear_landing() == 0
    assert store.clear_landing(timedelta(0)) > 0


def test_only_touched_buckets_are_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "archive")).init()
    made = [(k, f"https://f{k % 40}", f"g{k}", "t", f"https://l/{k % 50}", AT, False) for k in range(400)]
    store.commit({"items": spark.createDataFrame(made, ITEM), "url_metadata": spark.createDataFrame([(f"https://l/{k}", f"https://i/{k % 3}") for k in range(50)], "url string, favicon_url string")})
    store.summarise()
    before = {n: dict(store.manifest["tables"][n]) for n in schema.SUMMARIES}
    own = store.touched(spark.createDataFrame([("https://f3",)], "u string"), "u")
    store.commit({"items": store.table("items", own).filter("feed_url <> 'https://f3'")}, {"items": own})
    after = store.manifest["tables"]
    kept = {n: [b for b in before[n] if after[n].get(b) == before[n][b]] for n in schema.SUMMARIES}
    assert len(kept["feed_counts"]) >= len(before["feed_counts"]) - 1
    assert len(kept["link_feeds"]) >= len(before["link_feeds"]) - 10 and len(kept["icon_votes"]) >= len(before["icon_votes"]) - 1
    agree(store)


def test_link_change_shuffles_once(spark):
    """The difference of two aggregates, by one shuffle of the rows themselves."""
    names = "link string, feed_url string, archived boolean"
    before = spark.createDataFrame([("a", "f", False), ("a", "f", True), ("b", "f", None), ("", "f", False), (None, "g", False), ("c", "g", False)], names)
    after = spark.createDataFrame([("a", "f", True), ("a", "f", True), ("b", "f", False), ("d", "g", None), ("c", "g", False), ("", "g", False)], names)
    got = incremental.link_change(after, before)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    keys, values = ["link", "feed_url"], ["live", "total"]
    want = incremental.difference(incremental.link_feeds(after), incremental.link_feeds(before), keys, values)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [("a", "f", -1, 0), ("b", "f", 1, 0), ("d", "g", 0, 1)]
