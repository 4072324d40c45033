"""Unfurl: link pages into metadata rows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions import html as H
from rivulet.functions import scalars as S
from rivulet.plans import politeness
from rivulet.sources import feeds as source
from rivulet.sources.scratch import landed

#: Most workers of a batch.
MAX_WORKERS = 100


def workers(n: int) -> int:
    """Number of workers, within bounds."""
    return min(max(n, 1), MAX_WORKERS)


def metadata_rows(pages: DataFrame, now: datetime) -> DataFrame:
    """Metadata rows of fetched pages (url, status, body, error).

    OpenGraph values come before the page's own; a page without an icon gets its
    host's default. Empty values are null. A failed fetch has its status, from the
    response or its error text, and the error.
    """
    head = F.decode(S.page_head(F.coalesce("body", F.lit(""))), "UTF-8")
    m = pages.select("url", "status", "error", H.page_meta("url", head).alias("m")).select("url", "status", "error", "m.*")
    ok = F.col("error").isNull()
    null = lambda c: F.nullif(c, F.lit(""))
    either = lambda a, b: F.coalesce(null(F.col(a)), null(F.col(b)))
    image = F.try_element_at("og_images", F.lit(1))["url"]
    images = F.when(F.size("og_images") > 0, F.col("og_images"))
    extra = F.struct(
        null(F.col("og_type")).alias("og:type"), null(F.col("og_url")).alias("og:url"), null(F.col("og_site_name")).alias("og:site_name"), images.alias("og:images")
    )
    text = F.to_json(extra)
    status = F.when(ok, F.coalesce("status", F.lit(200))).otherwise(F.coalesce("status", S.status_from_error("error")))
    when_ok = lambda c: F.when(ok, c)
    return m.select(
        "url",
        when_ok(either("og_title", "html_title")).alias("title"),
        when_ok(either("og_description", "html_description")).alias("description"),
        when_ok(F.coalesce(null(image), null(F.col("html_image")))).alias("image_url"),
        when_ok(F.coalesce(null(F.col("html_icon")), null(S.default_favicon("url")))).alias("favicon_url"),
        when_ok(F.when(text != "{}", text)).alias("metadata"),
        S.ts(now).alias("last_fetch_at"),
        F.when(status > 0, status).cast("bigint").alias("fetch_status_code"),
        null(F.col("error")).alias("fetch_error"),
    )


def with_robots(urls: DataFrame, robots: DataFrame) -> DataFrame:
    """URLs with ``allowed``; robots(host, body) is what hosts answered.

    A host without an answer allows everything. One rule set per host is parsed.
    """
    rules = robots.groupBy("host").agg(F.first("body").alias("body")).select("host", H.parse_robots("body").alias("r")).select("host", "r.allow", "r.disallow")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    marked = urls.withColumn("host", host).join(rules, "host", "left")
    return marked.withColumn("allowed", F.coalesce(S.robots_allowed(path, "allow", "disallow"), F.lit(True))).drop("host", "allow", "disallow")


def _get_pages(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = pd.DataFrame([source.get(u, limit=limit) for u in batch["url"]], columns=["status", "etag", "last_modified", "body", "error"])
            got["status"] = got["status"].astype("Int32")
            got.insert(0, "url", batch["url"].to_list())
            yield got[["url", "status", "body", "error"]]

    return run


#: Most bytes of a robots.txt that are read, as crawlers commonly do; further rules do not count.
ROBOTS_LIMIT = 500_000
#: How long a host's answer counts.
ROBOTS_LIFE = timedelta(hours=1)
ROBOTS_ANSWERS = "host string, body string, fetched_at timestamp_ntz"


def fetch_robots(urls: DataFrame, concurrency: int, now: datetime, known: DataFrame | None = None) -> DataFrame:
    """(host, body, fetched_at) for the hosts of URLs; no body unless the answer is 200.

    ``known`` has earlier answers, which are taken for an hour.
    """
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    hosts = urls.select(F.concat(origin, F.lit("/robots.txt")).alias("url")).distinct()
    name = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    if known is not None:
        known = known.filter(F.col("fetched_at") > S.ts(now - ROBOTS_LIFE)).groupBy("host").agg(F.max_by(F.struct("body", "fetched_at"), "fetched_at").alias("r")).select("host", "r.*")
        hosts = hosts.withColumn("host", name).join(known, "host", "left_anti").drop("host")
    got = hosts.repartition(workers(concurrency)).mapInPandas(_get_pages(ROBOTS_LIMIT), "url string, status int, body string, error string")
    got = got.select(name.alias("host"), F.when(F.col("status") == 200, F.col("body")).alias("body"), S.ts(now).alias("fetched_at"))
    return got if known is None else got.unionByName(known.join(urls.select(name.alias("host")).distinct(), "host", "left_semi"))


def fetch_pages(urls: DataFrame, concurrency: int = 32) -> DataFrame:
    """(url, status, body, error): the head of each page."""
    return urls.select("url").repartition(workers(concurrency)).mapInPandas(_get_pages(H.PAGE_LIMIT), "url string, status int, body string, error string")


def unfurl(urls: DataFrame, now: datetime, landing: str, concurrency: int = 32, skip_robots: bool = False) -> DataFrame:
    """Metadata rows for URLs, fetched over the network; refused ones get an error.

    Where a host asks for a crawl delay, pages are fetched by a plan that keeps it. What
    hosts say in robots.txt is kept below ``landing`` for an hour, and what they
    have said is written before it is used: both branches see one answer.
    """
    if skip_robots:
        return metadata_rows(fetch_pages(urls, concurrency), now)
    spark = urls.sparkSession
    # A folder for each hour: only those whose answers may still count are read.
    hours = [f"{landing}/robots/hour={(now - ROBOTS_LIFE * k).strftime('%Y%m%dT%H')}" for k in range(2)]
    known = [h for h in hours if (p := spark._jvm.org.apache.hadoop.fs.Path(h)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]
    known = spark.read.schema(ROBOTS_ANSWERS).parquet(*known) if known else None
    answers = f"{landing}/robots-{now.strftime('%Y%m%dT%H%M%S%f')}"
    robots = landed(fetch_robots(urls, concurrency, now, known), answers)
    robots.filter(F.col("fetched_at") == S.ts(now)).write.mode("append").parquet(hours[0])
    marked = with_robots(urls.select("url"), robots)
    delays = politeness.crawl_delays(robots)
    if delays.isEmpty():
        pages = fetch_pages(marked.filter("allowed"), concurrency)
    else:
        # Written, as the reading of pages must not run twice or be divided by later steps.
        allowed = landed(marked.filter("allowed").select("url"), f"{answers}-allowed")
        pages = landed(politeness.scheduled_pages(allowed, delays, workers(concurrency)), f"{answers}-pages")
    refused = marked.filter("not allowed").select("url", F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("body"), F.lit("blocked by robots.txt").alias("error"))
    return metadata_rows(pages.unionByName(refused), now)
