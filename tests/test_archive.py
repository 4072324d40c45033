"""The archive from the outside: lists, fetch, show, unfurl, render, purge, streaming."""

import http.server
import json
import threading
import urllib.request
import uuid
from datetime import datetime, timedelta

import pandas as pd
import pytest

from rivulet import schema
from rivulet.plans.commands import Archive
from rivulet.plans.config import Config
from rivulet.sources import feeds as source
from rivulet.sources import opml
from rivulet.sources.store import Conflict, Store
from rivulet.streaming import ingest as streaming

NOW = datetime(2024, 1, 2)
RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>Test &amp;amp; Feed</title><description>d</description>
<item><title>One</title><link>https://ex.com/1</link><description>first</description><pubDate>Mon, 01 Jan 2024 12:00:00 GMT</pubDate><guid>g1</guid></item>
<item><title>Two</title><link>https://ex.com/2</link><description>second</description><pubDate>Mon, 01 Jan 2024 13:00:00 GMT</pubDate><guid>g2</guid></item>
</channel></rss>"""
ONE = RSS[: RSS.index("<item><title>Two")] + "</channel></rss>"


@pytest.fixture
def archive(spark, tmp_path):
    a = Archive(spark, Config.load({"path": str(tmp_path / "archive"), "render_output": str(tmp_path / "site")}, {}), lambda: a.clock)
    a.clock = NOW
    a.init()
    return a


def responses(spark, *rows):
    return spark.createDataFrame([(u, k, status, "e1", "", body, error) for k, (u, status, body, error) in enumerate(rows)], schema.RESPONSES)


def fetch(archive, *rows, **kw):
    df = responses(archive.spark, *rows)
    return archive.fetch(responses=df, **kw)


def test_parse_documents():
    d = source.parse_document(RSS)
    assert d["title"] == "Test & Feed" and [i["guid"] for i in d["items"]] == ["g1", "g2"] and d["items"][0]["published"] == datetime(2024, 1, 1, 12)
    atom = source.parse_document('<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><entry><id>i</id><title>T</title><link rel="self" href="/s"/><link href="/x"/><updated>2024-01-01T01:00:00+01:00</updated><content>c</content></entry></feed>')
    assert atom["items"][0]["link"] == "/x" and atom["items"][0]["updated"] == datetime(2024, 1, 1)
    j = source.parse_document(json.dumps({"version": "https://jsonfeed.org/version/1", "title": "J", "items": [{"id": 1, "url": "u", "content_html": "h"}]}))
    assert j["items"][0]["guid"] == "1" and j["items"][0]["content"] == "h"
    rdf = source.parse_document('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><channel><title>R</title></channel><item><title>x</title><link>l</link></item></rdf:RDF>')
    assert rdf["title"] == "R" and rdf["items"][0]["link"] == "l"
    for bad in ("garbage", "", "<html></html>", "{}"):
        with pytest.raises(ValueError):
            source.parse_document(bad)


def test_lists_round_trip(spark, tmp_path):
    text = '<?xml version="1.0"?><opml version="2.0"><head><title>x</title></head><body><outline text="G"><outline text="A &nbsp; B & C" xmlUrl="https://a/1?x=1&y=2"/><outline text="no"/></outline><outline xmlUrl="https://b/2"/><outline xmlUrl="https://b/2"/></body></opml>'
    urls = opml.parse_opml(text)
    assert urls == ["https://a/1?x=1&y=2", "https://b/2", "https://b/2"]
    again = opml.format_opml([urls[0], "https://c/3"], base=text)
    assert opml.parse_opml(again) == [urls[0], "https://c/3"] and 'text="G"' in again
    assert opml.parse_opml(opml.format_opml(['https://q/"x"'])) == ['https://q/"x"']
    assert opml.parse_text_list("# c\n\n https://a/ \nhttp://b/\n") == ["https://a/", "http://b/"]
    with pytest.raises(ValueError, match="line 2"):
        opml.parse_text_list("https://a/\nnot-a-url\n")
    path = tmp_path / "l.txt"
    opml.save_list(str(path), "text", ["https://a/"], NOW)
    assert [r.feed_url for r in opml.load_list(spark, "text", str(path)).collect()] == ["https://a/"]
    with pytest.raises(ValueError):
        opml.load_list(spark, "yaml", str(path))
    docs = spark.createDataFrame([("d", text), ("bad", "<opml"), ("none", None)], "name string, text string")
    assert [(r.name, r.feed_url) for r in opml.urls_of(docs).collect()] == [("d", u) for u in urls]


def test_subscribe_unsubscribe_export(archive, tmp_path):
    path = str(tmp_path / "feeds.opml")
    assert archive.subscribe(["https://a/1", "https://b/2"], path) == (2, [])
    assert archive.subscribe(["https://b/2", "https://c/3"], path) == (1, ["https://b/2"])
    assert archive.unsubscribe("https://a/1", path) and not archive.unsubscribe("https://a/1", path)
    assert opml.parse_opml(open(path).read()) == ["https://b/2", "https://c/3"]
    with pytest.raises(ValueError):
        archive.subscribe(["ftp://x"], path)
    assert archive.discover("https://x.y/z", '<link type="application/rss+xml" href="/f"><link href="https://q/a" type="application/atom+xml">') == ["https://x.y/f", "https://q/a"]
    assert archive.export(str(tmp_path / "out.opml")) == 0 and not (tmp_path / "out.opml").exists()


def test_fetch_life_cycle(archive, tmp_path):
    listed = tmp_path / "l.txt"
    listed.write_text("https://f/1\nhttps://f/2\nhttps://f/3\n")
    s = fetch(archive, ("https://f/1", 200, RSS, None), ("https://f/2", 404, None, "HTTP 404: Not Found"), ("https://f/3", 200, "garbage", None), listed=str(listed))
    assert (s["total"], s["errors"], s["successful"], s["items"]) == (3, 2, 1, 2)
    feed = archive.store.feeds.collect()
    assert [(f.url, f.title, f.etag, f.latest_item_date) for f in feed] == [("https://f/1", "Test & Feed", "e1", datetime(2024, 1, 1, 13))]
    first = {r.guid: r for r in archive.store.items.collect()}
    assert set(first) == {"g1", "g2"} and first["g1"].first_seen == NOW and not first["g1"].archived

    archive.clock = NOW + timedelta(hours=1)
    assert fetch(archive, ("https://f/1", 304, None, None))["cached"] == 1
    assert archive.store.feeds.first().last_successful_fetch == archive.clock and archive.store.items.filter("archived").count() == 0
    assert fetch(archive, ("https://f/1", 500, None, "HTTP 500"))["errors"] == 1
    assert archive.store.feeds.first().error_count == 1
    assert fetch(archive, ("https://f/1", 200, RSS, None), max_age="2h")["cached"] == 1
    changed = ONE.replace("One", "Uno").replace("12:00:00", "18:00:00")
    assert fetch(archive, ("https://f/1", 200, changed, None), max_age="2h", force=True)["items"] == 1
    second = {r.guid: r for r in archive.store.items.collect()}
    assert second["g1"].title == "Uno" and second["g1"].published_date == datetime(2024, 1, 1, 12) and second["g1"].id == first["g1"].id
    assert second["g2"].archived and archive.store.feeds.first().error_count == 0
    assert fetch(archive, ("https://f/1", 200, RSS, None), max_items=1)["items"] == 1

    out = json.loads(archive.show("https://f/1", "json"))
    assert out["URL"] == "https://f/1" and [i["GUID"] for i in out["Items"]] == ["g2", "g1"]
    assert archive.show("https://f/1", "csv", limit=1).splitlines() == ["Date,Title,Link,Summary", "2024-01-01T13:00:00Z,Two,https://ex.com/2,second"]
    assert archive.show("https://f/1", since="2024-01-01T12:30:00Z").startswith("2024-01-01 13:00  Two")
    assert json.loads(archive.show("https://unknown/", "json")) == {"Items": []}

    page = "<title>Page</title><meta property='og:image' content='/i.png'>"
    pages = archive.spark.createDataFrame([("https://ex.com/1", 200, page, None), ("https://ex.com/2", None, None, "HTTP 404: gone")], "url string, status int, body string, error string")
    assert archive.unfurl(pages=pages) == {"successful": 1, "failed": 0}  # the link of an archived item is not asked for
    meta = archive.store.url_metadata.first()
    assert (meta.title, meta.image_url, meta.favicon_url, meta.fetch_status_code) == ("Page", "https://ex.com/i.png", "https://ex.com/favicon.ico", 200)
    assert archive.unfurl(pages=pages) == {"successful": 0, "failed": 0}

    assert archive.render(max_age="48h") == 1
    site = tmp_path / "site"
    index = (site / "index.html").read_text()
    feed_page = next(p for p in (site / "feeds").glob("*.html") if not p.name.startswith("page-")).read_text()
    assert "page-1.html" in index and "One" in feed_page and "https://ex.com/i.png" in feed_page
    server = archive.serve(str(site), 0)
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/index.html") as r:
        assert r.headers["X-Content-Type-Options"] == "nosniff" and b"Feeds" in r.read()
    server.shutdown()

    archive.clock = NOW + timedelta(days=60)
    dry = archive.purge(dry_run=True)
    assert dry["items"] == 1 and archive.store.items.count() == 2
    assert archive.purge() == dry and archive.store.items.count() == 1
    listed.write_text("https://other/1\n")
    assert archive.purge(listed=str(listed))["feeds"] == 1
    assert (archive.store.feeds.count(), archive.store.items.count(), archive.store.url_metadata.count()) == (0, 0, 0)


def test_conditional_requests_over_http(spark):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.headers.get("If-None-Match"))
            if self.headers.get("If-None-Match") == "e9":
                self.send_response(304)
                self.end_headers()
                return
            self.send_response(200)
            self.send_header("ETag", "e9")
            self.end_headers()
            self.wfile.write(RSS.encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}/f"
    urls = spark.createDataFrame([(url, 0)], opml.LIST)
    first = source.fetch(urls, concurrency=1).first()
    assert first.status == 200 and first.etag == "e9" and first.body == RSS
    feeds = spark.createDataFrame([(url, "e9", "")], "url string, etag string, last_modified string")
    assert source.fetch(urls, feeds, 1).first().status == 304 and source.fetch(urls, feeds, 1, force=True).first().status == 200
    assert seen == [None, "e9", None]
    assert source.get(url, limit=10)["body"] == RSS[:10]
    server.shutdown()
    assert source.get("http://127.0.0.1:9/x")["error"].startswith("request failed")


def test_streamed_batches_merge_like_fetches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a")).init()
    folder = str(tmp_path / "in")
    responses(spark, ("https://f/1", 200, RSS, None)).coalesce(1).write.parquet(folder)
    for _ in range(2):
        streaming.start(streaming.read_responses(spark, folder), store, str(tmp_path / "ck"), now=lambda: NOW).awaitTermination()
        assert store.open().items.count() == 2
    responses(spark, ("https://f/1", 200, ONE, None)).coalesce(1).write.mode("append").parquet(folder)
    streaming.start(streaming.read_responses(spark, folder), store, str(tmp_path / "ck"), now=lambda: NOW).awaitTermination()
    assert {r.guid: r.archived for r in store.open().items.collect()} == {"g1": False, "g2": True}


def test_migration_fills_first_seen_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "old"))
    store.manifest = {"version": 1, "tables": {"feeds": "feeds/s0", "items": "items/s0"}, "applied": {}}
    spark.createDataFrame([("f",), ("g",)], "url string").write.parquet(f"{store.path}/feeds/s0")
    spark.createDataFrame([("f", "a", datetime(1990, 1, 1)), ("f", "b", datetime(2030, 1, 1)), ("f", "c", None)], "feed_url string, guid string, published_date timestamp_ntz").write.parquet(f"{store.path}/items/s0")
    store.migrate(NOW)
    assert {r.guid: r.first_seen for r in store.items.collect()} == {"a": datetime(2000, 1, 1), "b": NOW, "c": None}
    assert {r.url: r.latest_item_date for r in store.feeds.collect()} == {"f": NOW, "g": None}
    again = Store(spark, store.path).open()
    assert again.manifest["version"] == 4 and again.url_metadata.count() == 0
    tables = dict(again.manifest["tables"])
    assert Store(spark, store.path).open().manifest["tables"] == tables
    again.vacuum()
    assert again.items.count() == 3


def test_config_layers():
    c = Config.load({"fetch_concurrency": 8}, {"RIVULET_PATH": "/x", "RIVULET_WITH_UNFURL": "yes"})
    assert (c.fetch_concurrency, c.path, c.with_unfurl, c.min_items_per_feed, c.serve_port) == (8, "/x", True, 5, 8889)
    with pytest.raises(ValueError):
        Config.load({"nope": 1}, {})


def test_manifests_are_numbered_and_never_replaced(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a")).init()
    other = Store(spark, store.path).open()
    feed = spark.createDataFrame([("https://f/1",)], "url string")
    store.commit({"feeds": feed}, {"feeds": store.touched(feed, "url")})
    with pytest.raises(Conflict):
        other.commit({"feeds": feed}, {"feeds": other.touched(feed, "url")})
    assert [f.url for f in other.open().feeds.collect()] == ["https://f/1"]
    # A manifest that was written aside but never renamed does not count.
    (tmp_path / "a" / "manifest-half.tmp").write_text("{")
    assert Store(spark, store.path).open().manifest["number"] == 2
    store.vacuum()
    assert not (tmp_path / "a" / "manifest-half.tmp").exists() and Store(spark, store.path).open().feeds.count() == 1


def test_a_change_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a")).init()
    urls = [f"https://f/{k}" for k in range(40)]
    rows = spark.createDataFrame([(k, u, "g", f"t{k}") for k, u in enumerate(urls)], "id bigint, feed_url string, guid string, title string")
    store.commit({"items": rows})
    before = dict(store.manifest["tables"]["items"])
    one = spark.createDataFrame([(99, urls[3], "h", "new")], "id bigint, feed_url string, guid string, title string")
    buckets = store.touched(one, "feed_url")
    store.commit({"items": store.table("items", buckets).select(*one.columns).unionByName(one)}, {"items": buckets})
    after = store.manifest["tables"]["items"]
    assert len(buckets) == 1 and {b for b in after if after[b] != before.get(b)} == {str(buckets[0])}
    assert store.items.count() == 41 and store.next_id == 99
    gone = store.table("items", buckets).limit(0)
    store.commit({"items": gone}, {"items": buckets})
    assert str(buckets[0]) not in store.manifest["tables"]["items"] and store.table("items", buckets).count() == 0


def test_compaction_joins_small_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a")).init()
    rows = spark.createDataFrame([(k, "https://f/1", f"g{k}", datetime(2024, 1, 1 + k % 28)) for k in range(400)], "id bigint, feed_url string, guid string, published_date timestamp_ntz")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.commit({"items": rows})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    (bucket,) = store.manifest["tables"]["items"]
    files = lambda: len(list((tmp_path / "a" / store.manifest["tables"]["items"][bucket]).glob("*.parquet")))
    assert files() > 1
    assert store.compact() == {"items": [int(bucket)]} and files() == 1 and store.compact() == {}
    assert store.items.count() == 400


def test_single_results_counts_and_views(archive):
    s = fetch(archive, ("https://f/1", 200, RSS, None), url="https://f/1")
    assert (s["mode"], s["title"], s["items"], s["cached"]) == ("single", "Test & Feed", 2, False)
    assert (s["upserted"], s["archived"]) == (2, 0)
    s = fetch(archive, ("https://f/1", 200, ONE, None), url="https://f/1")
    assert (s["upserted"], s["archived"]) == (1, 1)
    s = fetch(archive, ("https://f/1", 304, None, None), url="https://f/1")
    assert s["cached"] is True and s["title"] == "Test & Feed"
    s = fetch(archive, ("https://f/1", 500, None, "HTTP 500"), url="https://f/1")
    assert s["error"] == "HTTP 500" and "title" not in s
    sql = archive.views().sql("SELECT f.title, count(i.id) AS n FROM feeds f JOIN items i ON i.feed_url = f.url AND NOT i.archived GROUP BY f.title")
    assert [tuple(r) for r in sql.collect()] == [("Test & Feed", 1)]


def test_templates_and_assets_of_ones_own(archive, tmp_path):
    archive.init(str(tmp_path / "t"), str(tmp_path / "assets"))
    page = tmp_path / "t" / "page.html"
    page.write_text(page.read_text().replace("<h1>", "<h1>Mine: $5 "))
    (tmp_path / "assets" / "fonts").mkdir()
    (tmp_path / "assets" / "fonts" / "f.bin").write_bytes(b"x")
    fetch(archive, ("https://f/1", 200, RSS, None), url="https://f/1")
    assert archive.render(max_age="48h", templates=str(tmp_path / "t"), assets=str(tmp_path / "assets")) == 1
    site = tmp_path / "site"
    assert "Mine: $5" in (site / "index.html").read_text() and (site / "assets" / "fonts" / "f.bin").exists() and (site / "assets" / "style.css").exists()
    assert archive.render(max_age="48h", templates=str(tmp_path / "none")) == 1 and "Mine" not in (site / "index.html").read_text()
    (tmp_path / "t" / "list.html").write_text("list of $body")
    assert archive.render(max_age="48h", templates=str(tmp_path / "t")) == 1 and "Mine" in (site / "index.html").read_text()
    assert (site / "feeds" / "page-1.html").read_text().startswith("list of <ul>")
    archive.init(str(tmp_path / "t"))
    assert "Mine" in page.read_text()  # what is there is kept


def test_robots_answers_count_for_an_hour(spark, tmp_path, monkeypatch):
    from rivulet.plans import unfurl

    seen = tmp_path / "seen"
    seen.mkdir()

    def pages(limit):
        def run(batches):
            for b in batches:
                for u in b["url"]:
                    if u.endswith("robots.txt"):
                        (seen / uuid.uuid4().hex).write_text(u)
                yield pd.DataFrame({"url": b["url"], "status": 200, "body": ["User-agent: *\nDisallow: /no" if u.endswith("robots.txt") else "<title>T</title>" for u in b["url"]], "error": None})

        return run

    monkeypatch.setattr(unfurl, "_get_pages", pages)
    urls = spark.createDataFrame([("https://h/a",), ("https://h/no/b",), ("https://k/c",)], "url string")
    for at, asked in ((NOW, 2), (NOW + timedelta(minutes=30), 2), (NOW + timedelta(hours=2), 4)):
        rows = {r.url: r.fetch_error for r in unfurl.unfurl(urls, at, str(tmp_path / "landing")).collect()}
        assert rows == {"https://h/a": None, "https://h/no/b": "blocked by robots.txt", "https://k/c": None}
        assert len(list(seen.iterdir())) == asked


def test_page_title_is_the_last_one(spark):
    from rivulet.functions import scalars as S

    df = spark.createDataFrame([("<head><title>a</title><TITLE x>b</TITLE></head>",), ("none",)], "h string")
    assert [r[0] for r in df.select(S.page_title("h")).collect()] == ["b", ""]


def test_ranks_do_not_depend_on_the_ranges(spark):
    from rivulet.operators import selection

    rows = [(f"https://f/{k:03d}", NOW if k % 3 else NOW - timedelta(days=k), None) for k in range(200)] + [(f"https://n/{k}", None, None) for k in range(20)]
    feeds = spark.createDataFrame(rows, "url string, latest_item_date timestamp_ntz, last_updated timestamp_ntz")
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] - datetime(1970, 1, 1)).total_seconds() if r[1] else 0, r[0]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for ranges in ("1", "3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            got = {r.url: r["rank"] for r in selection.ranked_feeds(feeds, NOW).collect()}
            assert got == {r[0]: k for k, r in enumerate(want, 1)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert selection.ranked_feeds(feeds.limit(0), NOW).count() == 0
