"""Fetch: a batch of responses merged into the archive as one step."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rivulet import schema
from rivulet.functions import scalars as S
from rivulet.operators import merge, selection
from rivulet.operators import relations as R
from rivulet.sources import feeds as source
from rivulet.sources.store import Part, Store

#: Defaults of a fetch.
MAX_ITEMS, CONCURRENCY = 100, 32


@dataclass
class Merged:
    """Next feeds and items, one result row for each URL, and links of new items."""

    feeds: DataFrame
    items: DataFrame
    results: DataFrame
    new_links: DataFrame


def single_result(result: Row | None, feed: Row | None) -> dict:
    """What the fetch of one URL prints besides the totals."""
    out = {"mode": "single", "url": result.url if result else "", "cached": bool(result and result.cached), "items": result.item_count if result else 0}
    if result is not None and result.error:
        return out | {"error": result.error}
    return out | ({"title": feed.title, "description": feed.description} if feed is not None else {})


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A table without rows; one made of a Python list would start workers in every task that reads it."""
    types = StructType.fromDDL(schema.TABLES[name])
    return spark.range(1).filter(F.lit(False)).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in types))


def feed_rows(parsed: DataFrame) -> DataFrame:
    """Parsed documents as feed columns."""
    return parsed.filter("error is null").select(
        F.col("feed_url").alias("url"), "title", "description", F.col("updated").alias("last_updated"), "feed_json"
    )


def item_rows(parsed: DataFrame, now: datetime, max_items: int) -> DataFrame:
    """Items of parsed documents as item columns, in document order, up to a maximum."""
    flat = parsed.filter("error is null").select("feed_url", F.explode("items").alias("i")).select("feed_url", "i.*")
    raw = selection.ingest_cap(flat, max_items)
    return raw.select(
        "feed_url",
        "pos",
        S.normalised_guid("guid", "link", "title").alias("guid"),
        F.col("plain_title").alias("title"),
        F.coalesce("link", F.lit("")).alias("link"),
        S.published("published", "updated", now).alias("published_date"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("description", F.lit("")).alias("summary"),
        F.lit(False).alias("archived"),
        "item_json",
    )


def fetch_batch(spark: SparkSession, store: Part | None, responses: DataFrame, now: datetime, max_items: int = MAX_ITEMS, landing: str | None = None) -> Merged:
    """Merge responses into the archive's tables, or into the buckets of them that the
    responses' feeds fall into.

    Parsed documents are written to ``landing`` first where it is given: several
    branches of the merge read them.

    Items of a parsed document are merged by identity: those beyond the maximum and
    those gone from the document are archived. Unchanged and failed feeds leave items
    alone; a failure is noted for stored feeds only.
    """
    feeds, items = (store.feeds, store.items) if store else (empty(spark, "feeds"), empty(spark, "items"))
    parsed = source.parse_documents(responses)
    if landing:
        parsed.write.mode("overwrite").parquet(landing)
        parsed = spark.read.schema(parsed.schema).parquet(landing)
    ok = parsed.filter("error is null").select(F.col("feed_url").alias("url"))

    every = item_rows(parsed, now, max_items)
    seen = R.with_first_seen(every, items, now)
    # Every occurrence counts for the feed's date, by its rank date; the stored date stays as published.
    latest = seen.groupBy("feed_url").agg(F.max(S.clamped("published_date", F.when(~F.col("is_new"), F.col("first_seen")), now)).alias("latest"), F.count("*").alias("item_count"))
    batch = merge.numbered_inserts(items, merge.collapse_items(seen), store.top_id if store else 0)
    next_items = merge.archive_absent(merge.upsert_items(items, batch), batch, parsed.filter("error is null").select("feed_url"))

    got = responses.filter("status = 200").select(F.col("feed_url").alias("url"), "etag", "last_modified").join(ok, "url", "left_semi")
    fresh = (
        feed_rows(parsed)
        .join(latest.select(F.col("feed_url").alias("url"), F.col("latest").alias("latest_item_date")), "url", "left")
        .join(got.dropDuplicates(["url"]), "url")
        .select(
            "url", "title", "description", "last_updated", F.coalesce("etag", F.lit("")).alias("etag"), F.coalesce("last_modified", F.lit("")).alias("last_modified"),
            S.ts(now).alias("last_fetch_time"), S.ts(now).alias("last_successful_fetch"), F.lit(0).alias("error_count"), F.lit("").alias("last_error"), "latest_item_date", "feed_json",
        )
    )
    unchanged = responses.filter("status = 304").select(F.col("feed_url").alias("url"))
    failed = (
        responses.filter("status is null or status not in (200, 304)")
        .select(F.col("feed_url").alias("url"), F.coalesce("error", F.concat(F.lit("HTTP "), F.col("status").cast("string"))).alias("error"))
        .unionByName(parsed.filter("error is not null").select(F.col("feed_url").alias("url"), "error"))
        .dropDuplicates(["url"])
    )
    next_feeds = merge.apply_errors(merge.apply_not_modified(merge.upsert_feeds(feeds, fresh), unchanged, now), failed, now)

    results = (
        responses.select(F.col("feed_url").alias("url"), (F.coalesce("status", F.lit(0)) == 304).alias("cached"))
        .join(failed, "url", "left")
        .join(latest.select(F.col("feed_url").alias("url"), "item_count"), "url", "left")
        .select("url", "cached", "error", F.coalesce("item_count", F.lit(0)).alias("item_count"))
    )
    # Links of new items, for metadata that is missing.
    links = seen.filter(F.col("is_new") & (F.col("link") != "")).select(F.col("link").alias("url"), "feed_url", "pos")
    return Merged(next_feeds, next_items, results, links)


def due_urls(store: Store, urls: DataFrame, now: datetime, max_age: timedelta | None, force: bool) -> tuple[DataFrame, DataFrame]:
    """(URLs to fetch, URLs fetched recently enough)."""
    feeds = selection.due_for_fetch(store.feeds, now, max_age, force).select(F.col("url").alias("feed_url"), "due")
    marked = urls.join(feeds, "feed_url", "left").withColumn("due", F.coalesce("due", F.lit(True)))
    return marked.filter("due").drop("due"), marked.filter("not due").drop("due")


def fetch_into(store: Store, landed: DataFrame, now: datetime, max_items: int, landing: str) -> tuple[Merged, dict[str, list[int]]]:
    """(merge of landed responses into the buckets of their feeds, those buckets)."""
    buckets = store.touched(landed, "feed_url")
    merged = fetch_batch(store.spark, store.part(buckets), landed, now, max_items, landing)
    return merged, {"feeds": buckets, "items": buckets}
