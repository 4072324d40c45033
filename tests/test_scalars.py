"""Scalar definitions against vectors."""

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rivulet.functions import html as H
from rivulet.functions import scalars as S
from rivulet.functions import times


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_guid_identity(spark):
    h = hashlib.sha256(b"https://a/xT").hexdigest()
    cases = [("https://a/x#0", "https://a/x", h), ("https://a/x#10", "https://a/x", h), ("https://a/x#", "https://a/x", h), ("", "https://a/x", h),
             ("https://a/x", "https://a/x", "https://a/x"), ("tag:1", "https://a/x", "tag:1"), ("#5", "", "#5")]
    for guid, link, want in cases:
        assert one(spark, S.normalised_guid("g", "l", "t"), g=guid, l=link, t="T") == want


def test_clamp(spark):
    d = lambda *a: datetime(*a)
    now = d(2024, 1, 25)
    cases = [(None, None, None), (d(2024, 1, 10), d(2024, 1, 5), d(2024, 1, 5)), (d(2024, 1, 3), d(2024, 1, 5), d(2024, 1, 3)), (d(2025, 1, 1), None, now),
             (d(1990, 1, 1), None, d(2000, 1, 1)), (d(1999, 6, 1), d(1999, 1, 1), d(1999, 1, 1)), (d(2024, 1, 1), None, d(2024, 1, 1))]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, d timestamp_ntz, s timestamp_ntz")
    got = {r.k: r.x for r in df.select("k", S.clamped("d", "s", now).alias("x")).collect()}
    assert [got[k] for k in range(len(cases))] == [c[2] for c in cases]


def test_url_validity_by_parser_and_by_pattern(spark):
    cases = {"": False, "https://example.com": True, "http://example.com/a?b=c": True, "ftp://example.com": False, "javascript:alert(1)": False, "https://": False, "word": False, "http://example.com:8080/x": True}
    df = spark.createDataFrame(list(cases.items()), "u string, want boolean")
    for r in df.select("u", "want", S.is_valid_url("u").alias("a"), S.looks_like_url("u").alias("b")).collect():
        assert r.a == r.b == r.want, r


def test_feed_links(spark):
    rss = '<link rel="alternate" type="application/rss+xml" href="/rss.xml">'
    atom = "<LINK HREF='/atom.xml' TYPE='application/atom+xml' />"
    assert one(spark, S.feed_links("h"), h=rss + "<p>" + atom) == ["/rss.xml", "/atom.xml"]
    assert one(spark, S.feed_links("h"), h=rss + rss) == ["/rss.xml"]
    assert one(spark, S.feed_links("h"), h='<link type="text/css" href="a.css"><link type=application/rss+xml href=/x>') == []


def test_text_helpers(spark):
    assert one(spark, S.strip_tags("h"), h=" <p>a<b>b</b>\n\n c </p> ") == "ab c"
    assert one(spark, S.table_title("t"), t="x" * 61) == "x" * 57 + "..." and one(spark, S.table_title("t"), t="x" * 60) == "x" * 60
    assert one(spark, S.display_title("t", "s", "c"), t="", s="", c="y" * 90) == "y" * 80 + "..."
    assert one(spark, S.display_title("t", "s", "c"), t=None, s=None, c=None) == "Untitled"
    assert one(spark, S.excerpt("s", "c"), s="<i>hi</i>", c="no") == "hi..."
    assert one(spark, S.default_favicon("u"), u="https://a.b:81/x?y") == "https://a.b:81/favicon.ico"
    assert one(spark, S.status_from_error("e"), e="HTTP 404: Not Found") == 404 and one(spark, S.status_from_error("e"), e=None) == 0
    assert [one(spark, S.list_format("f"), f=f) for f in ("a.OPML", "a.xml", "a.txt", "none", "a.b/c")] == ["opml", "opml", "text", "text", "text"]


def test_robots_rules(spark):
    r = H.parse_robots_text("User-agent: *\nDisallow: /a\nDisallow: /b\nAllow: /a/ok\nAllow: /c\nCrawl-delay: 2", "bot")
    assert r == {"allow": ["/a/ok"], "disallow": ["/a"], "crawl_delay": 2.0}
    assert H.parse_robots_text("User-agent: Bo\nDisallow: /x\nDisallow: /y\nUser-agent: other\nDisallow: /z", "bot")["disallow"] == ["/x", "/y"]
    assert H.parse_robots_text("User-agent:\nDisallow: /q\n# Disallow: /n\nnonsense", "bot")["disallow"] == ["/q"]
    check = lambda path: one(spark, S.robots_allowed("p", F.array(F.lit("/a/ok")), F.array(F.lit("/a"), F.lit("/b"))), p=path)
    assert [check(p) for p in ("/", "/a", "/a/ok/1", "/b/x")] == [True, False, True, False]


def test_page_metadata():
    page = """<html><head><title> First </title><meta name=Description content="one"><meta property="description" content="two">
    <meta property="twitter:image" content="/t.png"><meta property="twitter:image" content="/u.png"><meta name="twitter:image" content="/n.png">
    <link rel="shortcut ICON" href="/fav.ico"><meta property="og:image" content="/og.png"><meta property="og:image:width" content="40"><meta property="og:title" content="OG &amp; co"></head><body><svg><title>Last</title>"""
    m = H.page_metadata("https://a.b/c/d", page)
    assert (m["html_title"], m["html_description"], m["html_image"], m["html_icon"]) == ("Last", "two", "https://a.b/t.png", "https://a.b/fav.ico")
    assert m["og_title"] == "OG & co" and m["og_images"] == [{"url": "https://a.b/og.png", "width": 40, "height": None, "alt": None}]
    assert H.page_metadata(None, None)["html_title"] == "" and H.page_metadata("x", "<title>a" + "b" * 200_000)["html_title"].startswith("ab")


def test_url_resolution():
    assert H.resolve("https://test.com/page", "https://x.y/i.jpg") == "https://x.y/i.jpg"
    assert H.resolve("https://test.com/page", "/image.jpg") == "https://test.com/image.jpg"
    assert H.resolve("https://test.com/folder/page", "image.jpg") == "https://test.com/folder/image.jpg"
    assert H.resolve("https://test.com", "http://[bad") == "http://[bad"


def test_times():
    hours = lambda **k: timedelta(**k)
    for text, want in {"7d": hours(days=7), "2W": hours(weeks=2), "36h": hours(hours=36), "1h30m": hours(minutes=90), "-1.5s": hours(seconds=-1.5), "0": hours(), "100ms": hours(milliseconds=100)}.items():
        assert times.parse_duration(text) == want
    for bad in ("", "d", "5", "1x", "1h x", "5dd"):
        with pytest.raises(ValueError):
            times.parse_duration(bad)
    now = datetime(2024, 1, 25)
    assert times.parse_window(now) == (datetime(2024, 1, 24), now)
    assert times.parse_window(now, "7d") == (datetime(2024, 1, 18), now)
    assert times.parse_window(now, "7d", "2024-01-01T00:00:00+02:00") == (datetime(2023, 12, 31, 22), now)
    assert times.parse_window(now, "", "", "2024-01-02T00:00:00Z") == (times.BEGINNING, datetime(2024, 1, 2))
    with pytest.raises(ValueError):
        times.parse_window(now, "", "2024-01-03T00:00:00Z", "2024-01-02T00:00:00Z")
    assert times.window_label("24h", now, now) == "Last 24h" and times.window_label("24h", datetime(2024, 1, 1), now, True) == "From 2024-01-01 00:00 to 2024-01-25 00:00"


def test_json_fields(spark):
    doc = '{"a": "1", "b": "x"}'
    made = S.with_metadata_field("d", "a", F.lit("2"))
    assert one(spark, S.metadata_field(made, "a"), d=doc) == "2" and one(spark, S.metadata_field(made, "b"), d=doc) == "x"
    assert one(spark, S.metadata_field(S.with_metadata_field("d", "k", F.lit("v")), "k"), d=None) == "v"


def test_html_unescape(spark):
    df = spark.createDataFrame([("a &amp; b &eacute; &#8217;",), (None,)], "t string")
    assert [r.x for r in df.select(H.html_unescape("t").alias("x")).collect()] == ["a & b é ’", None]
    assert H.iframe_source("x").startswith("data:text/html")
