"""Summaries that merges keep up to date: item counts, links' references, favicon votes.

A change of items or metadata is taken as a difference (rows after less rows before) of
the buckets that it touches. Counts and votes are sums, so the difference of a summary
follows from that alone, and only the summary's own touched buckets are rewritten:

* ``feed_counts`` (feed_url, live, total),
* ``link_feeds`` (link, feed_url, live, total): which feeds' items refer to a link,
* ``icon_votes`` (feed_url, favicon_url, votes): live items of a feed by their link's icon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def feed_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("feed_url").agg(F.count_if(~F.col("archived")).alias("live"), F.count("*").alias("total"))


def link_feeds(items: DataFrame) -> DataFrame:
    """References of items to links; empty links are none."""
    named = items.filter(F.coalesce("link", F.lit("")) != "")
    return named.groupBy("link", "feed_url").agg(F.count_if(~F.col("archived")).alias("live"), F.count("*").alias("total"))


def link_change(after: DataFrame, before: DataFrame) -> DataFrame:
    """Difference of ``link_feeds`` where items change from ``before`` to ``after``: their
    rows are counted once together, added or taken away."""

    def signed(items: DataFrame, sign: int) -> DataFrame:
        named = items.filter(F.coalesce("link", F.lit("")) != "")
        return named.select("link", "feed_url", F.when(~F.col("archived"), sign).otherwise(0).cast("bigint").alias("live"), F.lit(sign).cast("bigint").alias("total"))

    return added(signed(after, 1), signed(before, -1), ["link", "feed_url"], ["live", "total"])


def _icons(metadata: DataFrame) -> DataFrame:
    return metadata.filter(F.coalesce("favicon_url", F.lit("")) != "").select(F.col("url").alias("link"), "favicon_url")


def icon_votes(links: DataFrame, metadata: DataFrame) -> DataFrame:
    """Votes of references (or of a difference of them) by the icons of their links."""
    votes = links.join(_icons(metadata), "link").groupBy("feed_url", "favicon_url").agg(F.sum("live").alias("votes"))
    return votes.filter("votes <> 0")


def difference(after: DataFrame, before: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sums of ``after`` less those of ``before`` for each key; keys without a change are left out."""
    less = before.select(*keys, *((-F.col(v)).alias(v) for v in values))
    return added(after.select(*keys, *values), less, keys, values)


def added(table: DataFrame, change: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A summary with a difference added to it; keys that come to nothing go."""
    both = table.select(*keys, *values).unionByName(change.select(*keys, *values))
    sums = both.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))
    return sums.filter(" or ".join(f"{v} <> 0" for v in values))


def icon_change(before: DataFrame, after: DataFrame, links: DataFrame) -> DataFrame:
    """Difference of votes where metadata changes from ``before`` to ``after``; ``links`` are
    the references as they are now."""
    one = F.lit(1).cast("bigint").alias("n")
    moved = difference(_icons(after).select("link", "favicon_url", one), _icons(before).select("link", "favicon_url", one), ["link", "favicon_url"], ["n"])
    votes = moved.join(links, "link").groupBy("feed_url", "favicon_url").agg(F.sum(F.col("n") * F.col("live")).alias("votes"))
    return votes.filter("votes <> 0")


def carry(store, before: dict, held: dict, changed: dict[str, list[int] | None]) -> None:
    """Bring the summaries in ``held`` from the tables of ``before`` to those of ``held``.

    ``changed`` has the changed tables with their touched buckets (None: all). Votes move
    first with the items, by the icons as they were, then with the metadata.
    """

    def apply(name: str, change: DataFrame, keys: list[str], values: list[str]) -> tuple[DataFrame, list[int]]:
        change = store.landed(change)
        touched = store.touched(change, keys[0])
        if touched:
            store.put(held, name, added(store.read(held, name, touched), change, keys, values), touched)
        return change, touched

    if "items" in changed:
        only = changed["items"]
        now = store.read(held, "items", only)
        store.put(held, "feed_counts", feed_counts(now), only)
        moved = link_change(now, store.read(before, "items", only))
        moved, touched = apply("link_feeds", moved, ["link", "feed_url"], ["live", "total"])
        if touched:
            apply("icon_votes", icon_votes(moved, store.read(before, "url_metadata", touched)), ["feed_url", "favicon_url"], ["votes"])
    if "url_metadata" in changed:
        only = changed["url_metadata"]
        # Links and metadata are divided into buckets alike.
        change = icon_change(store.read(before, "url_metadata", only), store.read(held, "url_metadata", only), store.read(held, "link_feeds", only))
        apply("icon_votes", change, ["feed_url", "favicon_url"], ["votes"])


def items_per_feed(feeds: DataFrame, counts: DataFrame) -> DataFrame:
    """Live items of every feed, from the counts alone."""
    live = counts.select(F.col("feed_url").alias("url"), "live")
    return feeds.join(live, "url", "left").select("url", "title", F.coalesce("live", F.lit(0)).alias("item_count"))


def feed_favicons(votes: DataFrame) -> DataFrame:
    """The favicon most live items of a feed have; of equals the least."""
    best = F.row_number().over(W.partitionBy("feed_url").orderBy(F.col("votes").desc(), F.col("favicon_url").asc()))
    return votes.withColumn("__r", best).filter("__r = 1").drop("__r")


def orphan_metadata(metadata: DataFrame, links: DataFrame) -> DataFrame:
    """Metadata that no item, archived or not, refers to."""
    return metadata.join(links.select(F.col("link").alias("url")), "url", "left_anti")
