"""Joins and aggregates between feeds, items and link metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.functions.scalars import ts


def metadata_for_items(metadata: DataFrame, items: DataFrame, feed_url: str) -> DataFrame:
    """Metadata of the links of one feed's live items, one row per URL."""
    links = items.filter((F.col("feed_url") == feed_url) & ~F.col("archived")).select(F.col("link").alias("url"))
    return metadata.join(links, "url", "left_semi")


def urls_needing_fetch(items: DataFrame, metadata: DataFrame, retry_cutoff, limit: int = 0) -> DataFrame:
    """(link, newest, rank) of live items without metadata, or with a failed fetch
    before the cutoff.

    Links are ordered by their newest item, then by themselves. A link never fetched
    has no row; a row without a fetch time is not retried.
    """
    links = items.filter(~F.col("archived") & (F.col("link") != "")).groupBy("link").agg(F.max("published_date").alias("newest"))
    m = metadata.select(F.col("url").alias("link"), "fetch_status_code", "last_fetch_at", F.lit(True).alias("known"))
    code = F.col("fetch_status_code")
    failed = (code.isNull() | ~code.between(200, 299)) & (F.col("last_fetch_at") < ts(retry_cutoff))
    rows = links.join(m, "link", "left").filter(F.col("known").isNull() | failed).select("link", "newest")
    if limit > 0:
        rows = rows.orderBy(F.col("newest").desc_nulls_last(), "link").limit(limit)
    return rows


def items_missing_metadata(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """Live items whose link has no metadata; not distinct."""
    return items.filter(~F.col("archived") & (F.col("link") != "")).join(metadata.select(F.col("url").alias("link")), "link", "left_anti")


def referenced(items: DataFrame) -> DataFrame:
    return items.filter(F.col("link").isNotNull() & (F.col("link") != "")).select(F.col("link").alias("url"))


def orphan_metadata(metadata: DataFrame, items: DataFrame) -> DataFrame:
    """Metadata that no item, archived or not, refers to."""
    return metadata.join(referenced(items), "url", "left_anti")


def metadata_survivors(metadata: DataFrame, items: DataFrame) -> DataFrame:
    return metadata.join(referenced(items), "url", "left_semi")


def feeds_not_listed(feeds: DataFrame, listed: DataFrame) -> DataFrame:
    """Feeds that are not on the subscription list."""
    return feeds.join(listed.select(F.col("feed_url").alias("url")), "url", "left_anti")


def items_per_feed(feeds: DataFrame, items: DataFrame) -> DataFrame:
    """Live items of every feed, feeds without any included."""
    live = items.filter(~F.col("archived")).groupBy("feed_url").agg(F.count("id").alias("n"))
    return feeds.join(live, F.col("url") == F.col("feed_url"), "left").select("url", "title", F.coalesce("n", F.lit(0)).cast("bigint").alias("item_count"))


def items_with_metadata(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """Items with the metadata of their link, where there is any."""
    m = metadata.select(F.col("url").alias("link"), "favicon_url", "fetch_status_code")
    return items.join(m, "link", "left")


def metadata_mark(urls: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every distinct input URL with whether metadata exists."""
    known = metadata.select("url").distinct().withColumn("known", F.lit(True))
    return urls.select("url").distinct().join(known, "url", "left").select("url", F.coalesce("known", F.lit(False)).alias("has_metadata"))


def urls_without_metadata(urls: DataFrame, metadata: DataFrame) -> DataFrame:
    """Input rows, repeats too, whose URL is new; ``ordinal`` keeps their order."""
    return urls.join(metadata.select("url"), "url", "left_anti")


def new_items(batch: DataFrame, items: DataFrame) -> DataFrame:
    """Items of a batch whose key is not stored yet."""
    return batch.join(items.select("feed_url", "guid"), ["feed_url", "guid"], "left_anti")


def with_first_seen(batch: DataFrame, items: DataFrame, now) -> DataFrame:
    """The stored first_seen of each key, and now for new keys."""
    known = items.select("feed_url", "guid", F.col("first_seen").alias("__seen"), F.lit(True).alias("__known"))
    return (
        batch.join(known, ["feed_url", "guid"], "left")
        .withColumn("is_new", F.col("__known").isNull())
        .withColumn("first_seen", F.when(F.col("is_new"), ts(now)).otherwise(F.col("__seen")))
        .drop("__seen", "__known")
    )


def feed_favicons(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """The favicon most live items of a feed have; of equals the least.

    Counts meet on the map side; links are joined before counting, once for all feeds.
    """
    icons = metadata.filter(F.coalesce("favicon_url", F.lit("")) != "").select(F.col("url").alias("link"), "favicon_url")
    per_link = items.filter(~F.col("archived") & (F.col("link") != "")).groupBy("feed_url", "link").agg(F.count("*").alias("n"))
    votes = per_link.join(icons, "link").groupBy("feed_url", "favicon_url").agg(F.sum("n").alias("votes"))
    best = F.row_number().over(W.partitionBy("feed_url").orderBy(F.col("votes").desc(), F.col("favicon_url").asc()))
    return votes.withColumn("__r", best).filter("__r = 1").drop("__r")


def latest_by_first_seen(feeds: DataFrame, items: DataFrame) -> DataFrame:
    """latest_item_date := newest first_seen of the feed's items, null without any."""
    newest = items.groupBy("feed_url").agg(F.max("first_seen").alias("latest"))
    return feeds.drop("latest_item_date").join(newest, F.col("url") == F.col("feed_url"), "left").drop("feed_url").withColumnRenamed("latest", "latest_item_date")


def existence_counts(table: DataFrame, keys: list[str], probe: DataFrame) -> DataFrame:
    """COUNT(*) of stored rows for each probed key, zero included."""
    found = table.join(probe.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return probe.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def fetch_summary(results: DataFrame) -> DataFrame:
    """Totals of fetch results (error, cached, item_count); an error beats a cache hit."""
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    cached = ~failed & F.col("cached")
    ok = ~failed & ~F.col("cached")
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(failed).alias("errors"),
        F.count_if(cached).alias("cached"),
        F.count_if(ok).alias("successful"),
        F.coalesce(F.sum(F.when(ok, F.col("item_count"))), F.lit(0)).cast("bigint").alias("items"),
    )


def unfurl_summary(results: DataFrame) -> DataFrame:
    """Numbers of successful and failed unfurls."""
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    return results.agg(F.count_if(~failed).alias("successful"), F.count_if(failed).alias("failed"))


def latest_version(applied: DataFrame) -> DataFrame:
    """One row with the newest of the applied versions; null before any."""
    return applied.agg(F.max("version").alias("version"))
