"""Feed archive views over an event log and a page table.

One feed per user, one item per event; a page stands for the link of some items and
for link metadata. The same definitions are written once more as SQL text in
``rivulet.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import scalars as S


def _url(user):
    return F.concat(F.lit("https://feeds.example.com/"), user.cast("string"), F.lit("/rss.xml"))


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feeds(url, title, last_updated, latest_item_date, last_fetch_time, error_count)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(
        F.min("ts").alias("last_updated"), F.max("ts").alias("newest"), F.count_if(F.col("event_type") == "error").alias("error_count")
    )
    return e.select(
        _url(F.col("user_id")).alias("url"),
        F.concat(F.lit("Feed "), F.col("user_id").cast("string")).alias("title"),
        "last_updated",
        F.expr("CASE WHEN user_id % 10 = 0 THEN NULL ELSE newest - make_dt_interval(CAST(user_id % 30 AS INT)) END").alias("latest_item_date"),
        F.col("newest").alias("last_fetch_time"),
        "error_count",
        "user_id",
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event; ``id`` is unique, (feed_url, guid) on purpose is not."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").filter("page_id % 11 <> 5")
    link = F.coalesce(F.col("url"), F.lit(""))
    k = F.col("event_id").cast("string")
    raw = F.when((F.col("event_id") % 10 == 0) & F.col("url").isNotNull(), F.concat(link, F.lit("#"), k)).when(F.col("event_id") % 10 == 1, "").otherwise(k)
    seen = F.expr(
        "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN ts - INTERVAL '1' DAY ELSE ts + INTERVAL '5' MINUTE END"
    )
    return (
        e.join(p, F.col("event_id") % 400 == F.col("page_id"), "left")
        .select(
            F.col("event_id").alias("id"),
            _url(F.col("user_id")).alias("feed_url"),
            raw.alias("raw_guid"),
            F.col("event_type").alias("title"),
            link.alias("link"),
            F.col("ts").alias("published_date"),
            seen.alias("first_seen"),
            F.col("props").alias("content"),
            F.lit("").alias("summary"),
            (F.col("event_type") == "error").alias("archived"),
            "user_id",
        )
        .withColumn("guid", S.normalised_guid("raw_guid", "link", "title"))
    )


def url_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link metadata of most pages, with failures and holes."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").filter("page_id % 7 <> 3")
    return p.select(
        "url",
        S.default_favicon("url").alias("favicon_url"),
        F.expr("CASE WHEN page_id % 5 = 0 THEN 404 WHEN page_id % 5 = 1 THEN NULL ELSE 200 END").cast("bigint").alias("fetch_status_code"),
        F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00' + make_dt_interval(0, CAST(page_id AS INT))").alias("last_fetch_at"),
        "page_id",
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subscription list: feeds of every third user."""
    return feeds(spark, sf_dir).filter("user_id % 3 = 0").select(F.col("url").alias("feed_url"))
