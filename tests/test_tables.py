"""Parsers as SQL functions equal the DataFrame path."""

from datetime import datetime

from rivulet.functions import html as H
from rivulet.functions import tables
from rivulet.sources import feeds

RSS = '<rss version="2.0"><channel><title>T</title><item><title>One</title><guid>1</guid><pubDate>Mon, 01 Jan 2024 12:00:00 GMT</pubDate></item><item><title>Two &amp; 3</title><link>https://x/2</link></item></channel></rss>'


def test_table_functions_equal_the_dataframe_path(spark):
    tables.register(tables.register(spark))  # again is allowed
    rows = [("a", RSS), ("b", "garbage"), ("c", None), ("d", '<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title></feed>')]
    documents = spark.createDataFrame(rows, "feed_url string, body string")
    got = spark.sql("SELECT r.feed_url, i.* FROM {d} r, LATERAL parse_feed(r.body) i ORDER BY 1, 2", d=documents).collect()
    parsed = feeds.parse_documents(documents.selectExpr("feed_url", "0 AS ordinal", "200 AS status", "body")).collect()
    want = [(p.feed_url, i.pos, i.guid, i.title, i.link, i.content, i.description, i.published, i.updated) for p in parsed for i in p["items"]]
    assert [tuple(r) for r in got] == sorted(want) and len(got) == 2 and got[0].published == datetime(2024, 1, 1, 12)
    heads = {r.feed_url: r for r in spark.sql("SELECT r.feed_url, h.* FROM {d} r, LATERAL feed_header(r.body) h", d=documents).collect()}
    assert {u: (r.title, r.item_count, r.error) for u, r in heads.items()} == {p.feed_url: (p.title, None if p.error else len(p["items"]), p.error) for p in parsed}


def test_pages_and_robots(spark):
    tables.register(spark)
    pages = spark.createDataFrame([("https://x/a", '<title>A</title><link rel="icon" href="i.png"><meta property="og:image" content="/p.png">'), ("https://x/b", ""), (None, None)], "url string, html string")
    got = spark.sql("SELECT p.url, m.* FROM {p} p, LATERAL page_meta(p.url, p.html) m", p=pages).collect()
    want = {r.url: r.m for r in pages.select("url", H.page_meta("url", "html").alias("m")).collect()}
    for r in got:
        assert [r[n] for n in H.PAGE_META.names[:-1]] == [want[r.url][n] for n in H.PAGE_META.names[:-1]] and r.image_count == len(want[r.url].og_images)
    robots = spark.createDataFrame([("a", "User-agent: rivulet\nAllow: /x\nDisallow: /\nCrawl-delay: 2"), ("b", "User-agent: *\nCrawl-delay: 1.5"), ("c", None)], "host string, body string")
    rules = sorted(tuple(r) for r in spark.sql("SELECT r.host, x.* FROM {r} r, LATERAL parse_robots(r.body) x", r=robots).collect())
    assert rules == [("a", "allow", "/x", 2.0), ("a", "disallow", "/", 2.0), ("b", None, None, 1.5)]


def test_scalars(spark):
    tables.register(spark)
    r = spark.sql("SELECT html_unescape('a &amp;amp; b') u, resolve_url('https://x/a/', 'b') l, duration_seconds('1h30m') d, duration_seconds('soon') x, rfc3339_time('2024-01-01T02:00:00+02:00') t, rfc3339_time(null) n").first()
    assert (r.u, r.l, r.d, r.x, r.t, r.n) == ("a &amp; b", "https://x/a/b", 5400.0, None, datetime(2024, 1, 1), None)


def test_joined_with_the_archive(spark):
    """The manual's kind of question over stored feeds, with a parser in it."""
    tables.register(spark)
    documents = spark.createDataFrame([("https://f", RSS)], "feed_url string, body string")
    stored = spark.createDataFrame([("https://f", "1", datetime(2024, 1, 1)), ("https://f", "9", None)], "feed_url string, guid string, first_seen timestamp_ntz")
    rows = spark.sql(
        "SELECT i.title, s.first_seen IS NULL AS is_new FROM {d} r, LATERAL parse_feed(r.body) i LEFT JOIN {s} s ON s.feed_url = r.feed_url AND s.guid = i.guid ORDER BY i.pos",
        d=documents, s=stored).collect()
    assert [tuple(r) for r in rows] == [("One", False), ("Two & 3", True)]
