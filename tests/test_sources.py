"""Feeds and file trees as data sources, against local servers and folders."""

import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from rivulet.sources import datasource, feeds

RSS = '<rss version="2.0"><channel><title>{}</title><item><title>One</title><guid>g</guid></item></channel></rss>'


class _Server(http.server.ThreadingHTTPServer):
    """Answers every path with a feed and an ETag, and keeps what it was asked."""

    def __init__(self, delay=0.0):
        self.asked, self.delay = [], delay
        super().__init__(("127.0.0.1", 0), _Handler)
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def url(self):
        return f"http://127.0.0.1:{self.server_port}"


class _Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        self.server.asked.append(self.path)
        time.sleep(self.server.delay)
        if self.path == "/none":
            return self.send_error(404)
        if self.headers.get("If-None-Match") == f'"{self.path}"':
            self.send_response(304)
            return self.end_headers()
        self.send_response(200)
        self.send_header("ETag", f'"{self.path}"')
        self.end_headers()
        self.wfile.write(RSS.format(self.path).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def servers():
    made = [_Server() for _ in range(3)]
    yield made
    for s in made:
        s.shutdown()


@pytest.fixture
def session(spark):
    return datasource.register(spark)


def test_batch_read_fetches_each_url_once(session, servers, tmp_path):
    urls = [f"{s.url}/{k}" for k in range(4) for s in servers] + [f"{servers[0].url}/none", "ftp://example.com/x"]
    path = tmp_path / "feeds.txt"
    path.write_text("# list\n" + "\n".join(u for u in urls if u.startswith("http")) + "\n")
    rows = session.read.format("feed").option("list", str(path)).option("concurrency", 2).load().collect()
    assert [r.feed_url for r in sorted(rows, key=lambda r: r.ordinal)] == urls[:-1]
    assert {r.feed_url: r.status for r in rows} == {u: 404 if u.endswith("none") else 200 for u in urls[:-1]}
    assert sum(len(s.asked) for s in servers) == len(urls) - 1
    parsed = feeds.parse_documents(session.read.format("feed").option("list", f"file://{path}").load())
    assert {r.title for r in parsed.collect()} == {"/0", "/1", "/2", "/3"}


def test_pushed_filters_decide_what_is_requested(session, servers, tmp_path):
    path = tmp_path / "feeds.txt"
    path.write_text("\n".join(f"{s.url}/{k}" for s in servers for k in range(3)))
    df = session.read.format("feed").option("list", str(path)).load()
    host = servers[1].url.removeprefix("http://")
    assert {r.feed_url for r in df.filter(df.host == host).collect()} == {f"{servers[1].url}/{k}" for k in range(3)}
    assert [len(s.asked) for s in servers] == [0, 3, 0]
    assert df.filter(df.feed_url.isin(f"{servers[0].url}/1", f"{servers[2].url}/2") & (df.status == 200)).count() == 2
    assert df.filter(df.feed_url.startswith(servers[2].url)).count() == 3
    assert [len(s.asked) for s in servers] == [1, 3, 4]


def test_whole_hosts_are_dealt_largest_first():
    urls = list(enumerate([f"https://big/{k}" for k in range(6)] + [f"https://h{k}/" for k in range(6)]))
    parts = datasource.by_host(urls, 3)
    assert sorted(u for p in parts for u in p.urls) == urls and sorted(len(p.urls) for p in parts) == [3, 3, 6]
    assert datasource.by_host([], 3) == [] and len(datasource.by_host(urls[:6], 3)) == 1


def test_conditional_requests(session, servers, tmp_path):
    urls = [f"{servers[0].url}/{k}" for k in range(3)]
    (tmp_path / "feeds.txt").write_text("\n".join(urls))
    known = str(tmp_path / "known")
    session.createDataFrame([(urls[1], '"/1"', None), ("https://other/", "x", "y")], "url string, etag string, last_modified string").write.parquet(known)
    rows = session.read.format("feed").option("list", str(tmp_path / "feeds.txt")).option("validators", known).load().collect()
    assert {r.feed_url: r.status for r in rows} == {urls[0]: 200, urls[1]: 304, urls[2]: 200}


def test_concurrent_partitions(session, tmp_path):
    slow = [_Server(delay=1.0) for _ in range(3)]
    (tmp_path / "feeds.txt").write_text("\n".join(f"{s.url}/a" for s in slow))
    began = time.time()
    assert session.read.format("feed").option("list", str(tmp_path / "feeds.txt")).load().filter("status = 200").count() == 3
    assert time.time() - began < 2.9  # one after the other they would take 3 s
    for s in slow:
        s.shutdown()


def test_stream_restarts_where_it_stopped(session, servers, tmp_path):
    path = tmp_path / "feeds.txt"
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        rows = session.readStream.format("feed").option("list", str(path)).load()
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    path.write_text("\n".join(f"{s.url}/1" for s in servers) + "\n")
    run()
    assert [s.asked for s in servers] == [["/1"]] * 3
    run()  # nothing new
    path.write_text(path.read_text() + f"{servers[0].url}/2\n")
    run()
    assert [s.asked for s in servers] == [["/1", "/2"], ["/1"], ["/1"]]
    got = session.read.schema(datasource.RESPONSES).parquet(out).collect()
    assert sorted((r.ordinal, r.status) for r in got) == [(0, 200), (1, 200), (2, 200), (3, 200)]


def test_stream_periods_ask_again(tmp_path):
    (tmp_path / "feeds.txt").write_text("https://a/1\nhttps://a/2\n")
    reader = datasource.FeedStreamReader({"list": str(tmp_path / "feeds.txt"), "every": "0.001"})
    end = reader.latestOffset()
    assert end["listed"] == 2 and end["period"] > 0
    assert [u for p in reader.partitions(end, end | {"period": end["period"] + 1}) for u in p.urls] == [(0, "https://a/1"), (1, "https://a/2")]
    assert reader.partitions(end, end) == []


def test_file_tree(session, tmp_path):
    root = tmp_path / "tree"
    rows = session.createDataFrame([(f"d{k % 3}/f{k}.txt", f"body {k}") for k in range(20)], "path string, body string").repartition(4)
    rows.write.format("files").mode("append").save(str(root))
    assert {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()} == {f"d{k % 3}/f{k}.txt": f"body {k}" for k in range(20)}
    session.createDataFrame([("d0/f0.txt", None), ("new.txt", "n")], "path string, body string").write.format("files").mode("overwrite").save(f"file://{root}")
    assert {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()} == {"d0/f0.txt": "", "new.txt": "n"}
    for bad in ("../out.txt", "/etc/x", ""):
        with pytest.raises(Exception, match="not a path below"):
            session.createDataFrame([(bad, "x")], "path string, body string").write.format("files").mode("append").save(str(root))
    with pytest.raises(Exception, match="two rows have one path"):
        session.createDataFrame([("same", "1"), ("same", "2")], "path string, body string").repartition(2).write.format("files").mode("append").save(str(root))
    assert sorted(p.name for p in root.rglob("*") if p.is_file()) == ["f0.txt", "new.txt"] and not list(root.glob(".staging-*"))


def test_failed_and_killed_tasks_leave_no_file(session, tmp_path):
    root = tmp_path / "tree"
    rows = session.range(40).repartition(4).selectExpr("concat('f', id) AS path", "CASE WHEN id = 33 THEN raise_error('task dies') ELSE 'x' END AS body")
    with pytest.raises(Exception, match="task dies"):
        rows.write.format("files").mode("append").save(str(root))
    # Tasks that are killed late may leave staged files; none has its name.
    assert not root.exists() or not [p for p in root.rglob("*") if p.is_file() and ".staging-" not in str(p)]
    root = tmp_path / "other"
    # An attempt that has staged files and then died is not in the commit's messages.
    writer = datasource.FileTreeWriter({"path": str(root)}, False)
    writer.write(iter([{"path": "lost.txt", "body": "half"}]))
    writer.commit([writer.write(iter([{"path": "kept.txt", "body": "whole"}])), None])
    assert [p.name for p in root.rglob("*")] == ["kept.txt"]


def test_feed_source_where_the_shared_folder_is_a_plain_path(spark, tmp_path, monkeypatch):
    from rivulet.plans import catalogue
    from rivulet.sources import scratch

    assert datasource.as_url("/a b/x") == "file:///a%20b/x" and datasource.as_url("file:/x") == "file:/x" and datasource.as_url("hdfs://h/x") == "hdfs://h/x"
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"{tmp_path}/a b")
    spark.range(20).selectExpr("id AS event_id", "id % 3 AS user_id", "TIMESTAMP_NTZ '2024-01-02 03:04:05' AS ts", "'view' AS event_type", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(5).selectExpr("id AS page_id", "concat('https://x/', id) AS url").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.queries()["feed_source"](spark, str(tmp_path)).collect()
    assert {r.title: r.item_count for r in got} == {f"https://feeds.example.com/{u}/rss.xml": n for u, n in ((0, 7), (1, 7), (2, 6))}


def test_requests_of_a_process_share_an_opener(tmp_path, monkeypatch):
    import urllib.request

    made, build = [], urllib.request.build_opener
    monkeypatch.setattr(urllib.request, "build_opener", lambda *handlers: made.append(build(*handlers)) or made[-1])
    for k in range(5):
        (tmp_path / f"{k}.xml").write_text(RSS.format(k))
    got = [feeds.get((tmp_path / f"{k}.xml").as_uri(), files=True) for k in range(5)]
    assert [g["body"] for g in got] == [RSS.format(k) for k in range(5)] and len(made) <= 1


def test_responses_are_handed_on_by_megabytes(session, tmp_path):
    (tmp_path / "long.xml").write_text("x" * 1_500_000)
    (tmp_path / "list.txt").write_text("\n".join([f"{tmp_path.as_uri()}/long.xml"] * 7 + ["ftp://example.com/x"] * 3_000))
    reader = datasource.FeedReader({"list": f"{tmp_path}/list.txt", "files": "true", "concurrency": "1"})
    (partition,) = reader.partitions()
    batches = list(reader.read(partition))
    assert all(b.nbytes < 7_000_000 and b.num_rows <= 3_000 for b in batches) and [o for b in batches for o in b.column("ordinal").to_pylist()] == list(range(3_007))
    read = session.read.format("feed").options(list=f"{tmp_path}/list.txt", files="true", concurrency="1").load()
    got = {r.host: (r.n, r.size, r.errors) for r in read.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("size"), F.count("error").alias("errors")).collect()}
    assert got == {"": (7, 10_500_000, 0), "example.com": (3_000, None, 3_000)}


@pytest.mark.parametrize("kind", ["rss", "rdf", "atom"])
def test_items_take_the_first_text_that_is_not_empty(kind):
    first = "<title> </title><m:title>other</m:title><title>One <b>two</b></title><title>late</title>"
    body = {
        "rss": f'<rss xmlns:m="http://m/"><channel><item>{first}<pubDate>2024-01-02T03:04:05Z</pubDate></item></channel></rss>',
        "rdf": f'<r:RDF xmlns:r="http://r/" xmlns="http://purl.org/rss/1.0/" xmlns:m="http://m/"><item>{first}<pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item></r:RDF>',
        "atom": f'<feed xmlns="http://www.w3.org/2005/Atom" xmlns:m="http://m/"><entry>{first}<published/><issued>2024-01-02T05:04:05+02:00</issued></entry></feed>',
    }[kind]
    (item,) = feeds.parse_document(body)["items"]
    assert (item["title"], str(item["published"])) == ("One two" if kind == "rss" else "other", "2024-01-02 03:04:05")


def test_parsed_items_are_handed_on_by_the_megabyte(spark):
    import pyarrow as pa

    body = '<rss version="2.0"><channel><title>T</title>' + "<item><title>One</title><guid>g</guid></item>" * 5_000 + "</channel></rss>"
    rows = [(str(k), k, body if k % 4 else "garbage") for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["feed_url", "ordinal", "body"])
    out = list(feeds.parsed_batches(iter([batch])))
    assert max(sum(len(i) for i in b.column("items").to_pylist()) for b in out) <= 25_000 and [u for b in out for u in b.column("feed_url").to_pylist()] == [u for u, _, _ in rows]
    parsed = feeds.parse_documents(spark.createDataFrame(rows, "feed_url string, ordinal int, body string").selectExpr("*", "200 AS status"))
    got = {r.feed_url: (r.n, r.error is None) for r in parsed.selectExpr("feed_url", "size(items) AS n", "error").collect()}
    assert got == {u: (5_000, True) if k % 4 else (0, False) for u, k, _ in rows}


def test_only_the_parser_runs_in_python(spark, tmp_path):
    from datetime import datetime

    from rivulet.plans import catalogue, ingest
    from rivulet.sources.store import Part

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    body = '<rss version="2.0"><channel><title>T</title><item><title>A &amp;amp; B</title><link>l</link></item></channel></rss>'
    made = spark.createDataFrame([("u", 0, 200, "", "", body, None)], "feed_url string, ordinal int, status int, etag string, last_modified string, body string, error string")
    old = Part(ingest.empty(spark, "feeds"), ingest.empty(spark, "items"), 0)
    merged = ingest.fetch_batch(spark, old, made, datetime(2024, 1, 1), landing=str(tmp_path / "parsed"))
    assert not any(x in plan(merged.items) for x in ("pythonUDF", "html_unescape", "MapInArrow"))
    (item,) = merged.items.collect()
    raw = feeds.parse_documents(made).selectExpr("inline(items)").select(ingest.S.normalised_guid("guid", "link", "title").alias("g")).first().g
    assert item.title == "A & B" and item.guid == raw
    # The registered query parses once, before the merge.
    assert "MapInArrow" not in plan(catalogue.queries()["ingest_snapshot"](spark, "/root/testdata/sf0.001"))


def test_a_second_fetch_merges_without_python(spark):
    from rivulet.plans import catalogue

    plan = catalogue.queries()["ingest_again"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("pythonUDF", "html_unescape", "MapInArrow"))


def test_items_of_a_long_document_are_python_objects_a_few_at_a_time():
    import tracemalloc

    import pyarrow as pa

    item = "<item><title>{0} &amp;amp;</title><link>https://example.com/page/{0}</link><description>text</description><pubDate>2024-01-01T00:00:11Z</pubDate><guid>{0}</guid></item>"
    rss = '<rss version="2.0"><channel><title>T</title>' + "".join(item.format(k) for k in range(10_000)) + "</channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title>' + "".join(f"<entry><id>{k}</id></entry>" for k in range(3_000)) + "</feed>"
    # An item that can't be read makes an error of the whole document, whatever came before.
    bad = json.dumps({"version": "https://jsonfeed.org/version/1", "items": [{"id": k} for k in range(3_000)] + [7]})
    rows = [("r", 0, rss), ("b", 1, bad), ("n", 2, None), ("a", 3, atom)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["feed_url", "ordinal", "body"])
    tracemalloc.start()
    try:
        batches = list(feeds.parsed_batches(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    got = [r for b in batches for r in b.to_pylist()]
    assert [(r["feed_url"], r["error"] is None, r["title"], len(r["items"])) for r in got] == [("r", True, "T", 10_000), ("b", False, None, 0), ("n", False, None, 0), ("a", True, "A", 3_000)]
    assert [(i["pos"], i["guid"], i["plain_title"]) for i in got[0]["items"]] == [(k, str(k), f"{k} &") for k in range(10_000)]
    # The document, its tree and a few items; with all its items as objects it is more.
    assert [i["guid"] for i in got[3]["items"]] == [str(k) for k in range(3_000)] and most < 11 * len(rss), most / len(rss)


def test_batches_of_documents_are_bounded_by_bytes(spark):
    session = spark.newSession()
    feeds.parse_documents(session.range(1).selectExpr("'u' AS feed_url", "0 AS ordinal", "200 AS status", "'x' AS body"))
    assert int(session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20


def test_an_empty_archive_starts_no_python(spark):
    from rivulet import schema
    from rivulet.plans import ingest

    for name, types in schema.TABLES.items():
        rows = ingest.empty(spark, name)
        assert "RDD" not in rows._jdf.queryExecution().optimizedPlan().toString() and rows.count() == 0
        assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], types).schema]
