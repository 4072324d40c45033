"""Selecting, ranking and paging feeds and items."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.functions.scalars import feed_id, ts
from rivulet.operators.ordering import with_running


def newest_first() -> list[Column]:
    """Order of items; the id makes it total."""
    return [F.col("published_date").desc_nulls_last(), F.col("id").desc()]


def all_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.orderBy("url")


def feed_by_url(feeds: DataFrame, url: str) -> DataFrame:
    """No row, and no error, for an unknown URL."""
    return feeds.filter(F.col("url") == url).limit(1)


def feed_urls(feeds: DataFrame) -> DataFrame:
    return feeds.select("url").orderBy("url")


def metadata_by_url(metadata: DataFrame, url: str) -> DataFrame:
    return metadata.filter(F.col("url") == url).limit(1)


def items_of_feed(items: DataFrame, feed_url: str, limit: int = 0, since: datetime | str | None = None, until: datetime | str | None = None, oldest: bool = False) -> DataFrame:
    """Items of a feed, archived ones too, newest first, with their position.

    Bounds are inclusive; limit 0 means all. ``oldest`` turns the order of what the
    limit has left.
    """
    rows = items.filter(F.col("feed_url") == feed_url)
    if since is not None:
        rows = rows.filter(F.col("published_date") >= ts(since))
    if until is not None:
        rows = rows.filter(F.col("published_date") <= ts(until))
    rows = rows.orderBy(*newest_first())
    if limit > 0:
        rows = rows.limit(limit)
    # One feed's rows, as asked for by name: the window has a single partition by nature.
    order = [F.col("published_date").asc_nulls_first(), F.col("id").asc()] if oldest else newest_first()
    return rows.withColumn("position", F.row_number().over(W.partitionBy("feed_url").orderBy(*order)))


def items_of_feeds(items: DataFrame, feed_set: DataFrame, start, end) -> DataFrame:
    """Items of the feeds in ``feed_set(feed_url)`` within inclusive bounds."""
    return items.filter(F.col("published_date").between(ts(start), ts(end))).join(feed_set.select("feed_url"), "feed_url", "left_semi")


def restricted(feeds: DataFrame, listed: DataFrame | None) -> DataFrame:
    """Feeds on a subscription list; no list means no restriction."""
    return feeds if listed is None else feeds.join(listed.select(F.col("feed_url").alias("url")), "url", "left_semi")


def recency(now) -> Column:
    """Ranking key of a feed: its latest item, not after now, else its own update."""
    latest = F.col("latest_item_date")
    return F.coalesce(F.when(latest > ts(now), ts(now)).otherwise(latest), F.col("last_updated"))


def ranked_feeds(feeds: DataFrame, now, name: str = "rank") -> DataFrame:
    """Feeds with their 1-based rank by capped recency, ties by URL.

    No task sees all feeds, even if one refresh has given most of them the same time.
    """
    keyed = feeds.withColumn("__key", recency(now))
    order = [F.col("__key").desc_nulls_last(), F.col("url").asc()]
    return with_running(keyed, order, F.lit(1).cast("bigint"), name).drop("__key")


def feeds_in_window(feeds: DataFrame, start, end, listed: DataFrame | None = None) -> DataFrame:
    """Feeds whose latest item, or without one whose update, lies within the bounds.

    Written as two plain ranges so that both reach the Parquet scan.
    """
    a, b = ts(start), ts(end)
    latest, updated = F.col("latest_item_date"), F.col("last_updated")
    rows = feeds.filter(latest.between(a, b) | (latest.isNull() & updated.between(a, b)))
    return restricted(rows, listed)


def feeds_by_max_age(feeds: DataFrame, now: datetime, age: timedelta, listed: DataFrame | None = None) -> DataFrame:
    return feeds_in_window(feeds, now - age, now, listed)


def with_minimum(items: DataFrame, start, end, minimum: int) -> DataFrame:
    """Items in the window, filled up with the newest others to ``minimum`` a feed.

    Adds in_window and position. Fill items follow the window's items, even those
    dated after its end. The window reaches the scan as a range; of the other items each
    task keeps ``minimum`` a feed before anything is shuffled.
    """
    inside = F.col("published_date").between(ts(start), ts(end))
    here = items.filter(inside)
    counted = here.groupBy("feed_url").agg(F.count("*").alias("__n"))
    rank = F.row_number().over(W.partitionBy("feed_url").orderBy(*newest_first()))
    newest = items.filter(~F.coalesce(inside, F.lit(False))).withColumn("__rank", rank).filter(F.col("__rank") <= minimum)
    fill = newest.join(counted, "feed_url", "left").filter(F.col("__rank") <= minimum - F.coalesce("__n", F.lit(0)))
    both = here.withColumn("in_window", F.lit(True)).unionByName(fill.select(*items.columns, F.lit(False).alias("in_window")))
    return both.withColumn("position", F.row_number().over(W.partitionBy("feed_url").orderBy(F.col("in_window").desc(), *newest_first())))


def select_for_render(feeds: DataFrame, items: DataFrame, start, end, minimum: int, maximum: int, listed: DataFrame | None = None) -> DataFrame:
    """Items to show with feed columns.

    With a minimum, every listed feed that has any item takes part. Minimum 0 takes
    the feeds in the window, by their own date, instead.
    """
    if minimum <= 0:
        chosen = feeds_in_window(feeds, start, end, listed)
        picked = items_of_feeds(items, chosen.select(F.col("url").alias("feed_url")), start, end).withColumn("in_window", F.lit(True))
        picked = picked.withColumn("position", F.row_number().over(W.partitionBy("feed_url").orderBy(*newest_first())))
    else:
        chosen = restricted(feeds, listed)
        picked = with_minimum(items, start, end, minimum)
    if maximum > 0:
        picked = picked.filter(F.col("position") <= maximum)
    f = chosen.select(F.col("url").alias("feed_url"), F.col("title").alias("feed_title"), "latest_item_date", "last_updated")
    return picked.join(f, "feed_url")


def paged(feeds: DataFrame, now, size: int) -> DataFrame:
    """Feeds with rank, page and the short id; size 0 or less means one page."""
    rows = ranked_feeds(feeds, now)
    page = F.ceil(F.col("rank") / size).cast("bigint") if size > 0 else F.lit(1).cast("bigint")
    return rows.withColumn("page", page).withColumn("feed_id", feed_id("url"))


def render_frame(feeds: DataFrame, items: DataFrame, now, start, end, minimum: int, maximum: int, page_size: int, listed: DataFrame | None = None) -> DataFrame:
    """The flagship: what is new per feed, capped, ranked and paged."""
    rows = select_for_render(feeds, items, start, end, minimum, maximum, listed)
    shown = rows.select(F.col("feed_url").alias("url"), "feed_title", "latest_item_date", "last_updated").distinct()
    pages = paged(shown, now, page_size).select(F.col("url").alias("feed_url"), "feed_id", "rank", "page")
    return rows.drop("latest_item_date", "last_updated").join(pages, "feed_url")


def page_ranges(pages: DataFrame, size: int) -> DataFrame:
    """(page, first, last): the ranks that each page shows."""
    if size <= 0:
        return pages.groupBy(F.lit(1).cast("bigint").alias("page")).agg(F.lit(1).cast("bigint").alias("first"), F.max("rank").alias("last"))
    return pages.groupBy("page").agg(F.max("rank").alias("__last")).select(
        "page", ((F.col("page") - 1) * size + 1).alias("first"), F.least(F.col("page") * size, F.col("__last")).alias("last")
    )


def ingest_cap(items: DataFrame, maximum: int, position: str = "pos") -> DataFrame:
    """The first entries of each document; 0 or less means all."""
    return items if maximum <= 0 else items.filter(F.col(position) < maximum)


def recent_items(items: DataFrame, feeds: DataFrame, limit: int = 50) -> DataFrame:
    """Newest live items with their feed's title."""
    live = items.filter(~F.col("archived")).join(feeds.select(F.col("url").alias("feed_url"), F.col("title").alias("feed_title")), "feed_url")
    return live.orderBy(*newest_first()).limit(limit)


def new_since(items: DataFrame, feeds: DataFrame, since) -> DataFrame:
    """Live items first seen after a time, with their feed's title."""
    live = items.filter(~F.col("archived") & (F.col("first_seen") > ts(since)))
    return live.join(feeds.select(F.col("url").alias("feed_url"), F.col("title").alias("feed_title")), "feed_url")


def topic_search(items: DataFrame, topic: str) -> DataFrame:
    """Live items that mention a topic in title, content or summary, in any case."""
    pattern = "%" + topic.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return items.filter(~F.col("archived") & (F.col("title").ilike(pattern) | F.col("content").ilike(pattern) | F.col("summary").ilike(pattern)))


def stale_feeds(feeds: DataFrame, cutoff) -> DataFrame:
    """Feeds without an item since the cutoff; those without any item come first."""
    latest = F.col("latest_item_date")
    return feeds.filter(latest.isNull() | (latest < ts(cutoff))).orderBy(latest.asc_nulls_first(), "url")


def failing_feeds(feeds: DataFrame, over: int = 3) -> DataFrame:
    return feeds.filter(F.col("error_count") > over).orderBy(F.col("error_count").desc(), "url")


def due_for_fetch(feeds: DataFrame, now, max_age: timedelta | None, force: bool = False) -> DataFrame:
    """Feeds with ``due``: false for those fetched less than ``max_age`` ago."""
    if force or not max_age or max_age <= timedelta():
        return feeds.withColumn("due", F.lit(True))
    fresh = F.col("last_fetch_time") > ts(now) - F.lit(max_age)
    return feeds.withColumn("due", ~F.coalesce(fresh, F.lit(False)))


def retry_eligible(now, retry_after: timedelta) -> Column:
    """Whether link metadata may be fetched again."""
    at, code = F.col("last_fetch_at"), F.col("fetch_status_code")
    return F.when(at.isNull(), True).when(F.coalesce(code.between(200, 299), F.lit(False)), False).otherwise(at + F.lit(retry_after) < ts(now))
