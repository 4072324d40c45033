"""The parsers as functions of SQL: table functions for LATERAL joins, and scalars.

    SELECT f.url, i.title FROM documents f, LATERAL parse_feed(f.body) i
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rivulet.functions import html as H
from rivulet.functions import times

FEED_ITEMS = "pos int, guid string, title string, link string, content string, description string, published timestamp_ntz, updated timestamp_ntz"
FEED_HEADER = "title string, description string, updated timestamp_ntz, item_count int, error string"
PAGE = ", ".join(f"{n} string" for n in H.PAGE_META.names[:-1]) + ", image_count int"
RULES = "kind string, path string, crawl_delay double"


class ParseFeed:
    """A row for each item of a feed document, in its order; none for what is no feed."""

    def eval(self, body: str):
        from rivulet.sources.feeds import read_document

        try:
            rows = [(i["pos"], i["guid"], i["title"], i["link"], i["content"], i["description"], i["published"], i["updated"]) for i in read_document(body)[1]]
        except (ValueError, TypeError, AttributeError):
            return
        yield from rows


class FeedHeader:
    """One row for a document: its title and number of items, or why it could not be read."""

    def eval(self, body: str):
        from rivulet.sources.feeds import read_document

        try:
            doc, items = read_document(body)
            count = sum(1 for _ in items)
        except (ValueError, TypeError, AttributeError) as e:
            yield None, None, None, None, str(e)[:500]
            return
        yield doc["title"], doc["description"], doc["updated"], count, None


class PageMeta:
    """One row for a page: its own and its OpenGraph metadata."""

    def eval(self, url: str, page: str):
        m = H.page_metadata(url, page)
        yield *(m[n] for n in H.PAGE_META.names[:-1]), len(m["og_images"])


class ParseRobots:
    """A row for each rule of a robots.txt that counts, with the crawl delay on each; a
    file with a delay alone gives one row without a rule."""

    def eval(self, body: str):
        r = H.parse_robots_text(body)
        rules = [(kind, path) for kind in ("allow", "disallow") for path in r[kind]]
        if not rules and r["crawl_delay"] is not None:
            rules = [(None, None)]
        for kind, path in rules:
            yield kind, path, r["crawl_delay"]


def seconds_of(text: str | None) -> float | None:
    """Seconds of a duration such as '7d' or '1h30m'; null for anything else."""
    try:
        return None if text is None else times.parse_duration(text).total_seconds()
    except (ValueError, OverflowError):
        return None


def rfc3339(text: str | None):
    try:
        return None if text is None else times.parse_rfc3339(text)
    except (ValueError, OverflowError):
        return None


def register(spark: SparkSession) -> SparkSession:
    """Make the functions known to ``spark.sql``: parse_feed, feed_header, page_meta,
    parse_robots (tables); html_unescape, resolve_url, duration_seconds, rfc3339_time (scalars)."""
    for name, maker, types in (("parse_feed", ParseFeed, FEED_ITEMS), ("feed_header", FeedHeader, FEED_HEADER), ("page_meta", PageMeta, PAGE), ("parse_robots", ParseRobots, RULES)):
        # A class of its own for each session: the decorator changes the one it gets.
        spark.udtf.register(name, F.udtf(type(maker.__name__, (maker,), {}), returnType=types))
    spark.udf.register("html_unescape", H.html_unescape)
    spark.udf.register("resolve_url", H.resolve_url)
    spark.udf.register("duration_seconds", F.udf(seconds_of, "double", useArrow=True))
    spark.udf.register("rfc3339_time", F.udf(rfc3339, "timestamp_ntz", useArrow=True))
    return spark
