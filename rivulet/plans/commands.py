"""The archive's commands as one object: what a feed reader does from the outside."""

from __future__ import annotations

import functools
import http.server
import json
import logging
import threading
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rivulet import schema
from rivulet.functions import scalars as S
from rivulet.functions import times
from rivulet.operators import incremental, lists, merge, selection
from rivulet.operators import relations as R
from rivulet.plans import ingest, unfurl
from rivulet.plans.config import Config
from rivulet.sources import feeds as source
from rivulet.sources import opml, sinks
from rivulet.sources.store import Store

__version__ = "0.1.0"
log = logging.getLogger("rivulet")


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Archive:
    """A stored archive with its configuration. ``now`` may be fixed for tests."""

    def __init__(self, spark: SparkSession, config: Config | None = None, now=utc_now) -> None:
        self.spark, self.config, self.now = spark, config or Config.load(), now
        self.store = Store(spark, self.config.path)

    def init(self, templates: str | None = None, assets: str | None = None) -> None:
        """Make the archive; with folders named, also write the site's page template
        and assets there, to be changed and given to ``render``."""
        self.store.init()
        if templates:
            sinks.extract(sinks.TEMPLATES, templates)
        if assets:
            sinks.extract(sinks.ASSETS, assets)

    def views(self) -> SparkSession:
        """Register feeds, items and url_metadata as temporary views for ``spark.sql``."""
        self.store.open()
        for name in schema.TABLES:
            self.store.table(name).createOrReplaceTempView(name)
        return self.spark

    def _urls(self, urls: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(zip(urls, range(len(urls)))), opml.LIST)

    # Subscription lists

    def _list(self, path: str, fmt: str) -> list[str]:
        """URLs of a list file; a missing file is an empty list, an unreadable one an error."""
        if not Path(path).exists():
            return []
        return [r.feed_url for r in opml.load_list(self.spark, fmt, path).orderBy("ordinal").collect()]

    def subscribe(self, urls: list[str], path: str, fmt: str | None = None, discover: bool = False) -> tuple[int, list[str]]:
        """Add URLs to a list; returns (how many were new, URLs already there).

        With ``discover`` the URLs are pages, whose announced feeds are added.
        """
        fmt = fmt or opml.detect_format(path)
        if discover:
            urls = [f for u in urls for f in self.discover(u)]
        for u in urls:
            if not self.valid(u):
                raise ValueError(f"not a feed URL: {u}")
        old = self._list(path, fmt)
        current, new = self._urls(old), self._urls(urls)
        base = Path(path).read_text(encoding="utf-8") if fmt == "opml" and Path(path).exists() else None
        merged = [r.feed_url for r in lists.added(current, new, len(old)).orderBy("ordinal").collect()]
        opml.save_list(path, fmt, merged, self.now(), base)
        return lists.added_count(current, new).first().added, [r.feed_url for r in lists.duplicates(current, new).collect()]

    def unsubscribe(self, url: str, path: str, fmt: str | None = None) -> bool:
        """Remove a URL from a list; False if it was not there."""
        fmt = fmt or opml.detect_format(path)
        old = self._list(path, fmt)
        kept = [r.feed_url for r in lists.removed(self._urls(old), url).orderBy("ordinal").collect()]
        if len(kept) == len(old):
            return False
        base = Path(path).read_text(encoding="utf-8") if fmt == "opml" else None
        opml.save_list(path, fmt, kept, self.now(), base)
        return True

    def valid(self, url: str) -> bool:
        return self.spark.range(1).select(S.is_valid_url(F.lit(url)).alias("v")).first().v

    def discover(self, url: str, page: str | None = None) -> list[str]:
        """Absolute URLs of the feeds that a page announces."""
        from rivulet.functions.html import resolve

        if page is None:
            got = source.get(url, timeout=10)
            if got["status"] != 200:
                raise ValueError(got["error"] or f"HTTP {got['status']}")
            page = got["body"]
        found = self.spark.createDataFrame([(page,)], "html string").select(S.feed_links("html").alias("l")).first().l
        return [resolve(url, h) for h in found]

    def export(self, path: str, fmt: str | None = None) -> int:
        """Write all stored feed URLs; nothing is written for an empty archive."""
        self.store.open()
        # One file of short lines; the driver holds a partition of URLs at a time.
        urls = (r.url for r in selection.feed_urls(self.store.feeds).toLocalIterator())
        return opml.write_list(path, fmt or opml.detect_format(path), urls, self.now())

    # Fetch

    def fetch(
        self, url: str = "", listed: str = "", fmt: str | None = None, responses: DataFrame | None = None, max_items: int | None = None,
        max_age: str | None = None, force: bool = False, remove_missing: bool = False, with_unfurl: bool | None = None,
    ) -> dict:
        """Fetch one URL, a list file, or every stored feed; returns the summary.

        ``responses`` replaces the network. With ``remove_missing`` stored feeds that
        are not on the list go, with their items.
        """
        self.store.open()
        now = self.now()
        if url:
            urls = self._urls([url])
        elif listed:
            urls = opml.load_list(self.spark, fmt or opml.detect_format(listed), listed)
        else:
            urls = self.store.feeds.select(F.col("url").alias("feed_url"), F.lit(0).cast("bigint").alias("ordinal"))
        urls = urls.groupBy("feed_url").agg(F.min("ordinal").alias("ordinal"))
        age = max_age if max_age is not None else self.config.fetch_max_age
        due, fresh = ingest.due_urls(self.store, urls, now, times.parse_duration(age) if age else None, force)
        if responses is None:
            got = source.fetch(due, self.store.feeds, self.config.fetch_concurrency, force)
        else:
            got = responses.join(due.select("feed_url"), "feed_url", "left_semi").select(*[c.split()[0] for c in schema.RESPONSES.split(", ")])
        # What the network gave is kept: the merge must not fetch twice.
        landed = f"{self.store.path}/landing/{now.strftime('%Y%m%dT%H%M%S%f')}"
        got.write.mode("overwrite").parquet(landed)
        got = self.spark.read.schema(schema.RESPONSES).parquet(landed)
        limit = self.config.fetch_max_items if max_items is None else max_items
        merged, buckets = ingest.fetch_into(self.store, got, now, limit, f"{landed}-parsed")
        cached = fresh.select(F.col("feed_url").alias("url"), F.lit(True).alias("cached"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("bigint").alias("item_count"))
        results = merged.results.unionByName(cached)
        summary = R.fetch_summary(results).first().asDict()
        old = self.store.table("items", buckets["items"]).filter(~F.col("archived")).select("id")
        self.store.commit({"feeds": merged.feeds, "items": merged.items}, buckets)
        summary |= {"upserted": summary["items"], "archived": self.store.table("items", buckets["items"]).filter("archived").join(old, "id", "left_semi").count()}
        links = None
        if self.config.with_unfurl if with_unfurl is None else with_unfurl:
            # Written before the metadata changes, since it depends on what is missing there.
            R.urls_without_metadata(merged.new_links, self.store.url_metadata).select("url").distinct().write.mode("overwrite").parquet(f"{landed}-links")
            links = self.spark.read.schema("url string").parquet(f"{landed}-links")
        if url:
            feed = selection.feed_by_url(self.store.table("feeds", self.store.touched(urls, "feed_url")), url)
            summary |= ingest.single_result(results.filter(F.col("url") == url).first(), feed.first())
        if remove_missing and listed:
            gone = R.feeds_not_listed(self.store.feeds, urls)
            summary["removed"] = gone.count()
            self._delete(gone)
        if links is not None and not links.isEmpty():
            summary["unfurled"] = self._unfurl(links)["successful"]
        return summary

    def _delete(self, gone: DataFrame) -> None:
        """Delete the feeds in ``gone`` and their items; other buckets stay as they are."""
        buckets = self.store.touched(gone, "url")
        if buckets:
            part = self.store.part(buckets)
            feeds, items = merge.delete_feeds(part.feeds, part.items, gone.select("url"))
            self.store.commit({"feeds": feeds, "items": items}, {"feeds": buckets, "items": buckets})

    # Show

    def show(self, url: str, fmt: str = "table", limit: int = 0, since: str = "", until: str = "", oldest: bool = False) -> str:
        self.store.open()
        at = lambda t: times.parse_rfc3339(t) if t else None
        items = selection.items_of_feed(self.store.items, url, limit, at(since), at(until), oldest)
        if fmt == "json":
            return sinks.format_json(selection.feed_by_url(self.store.feeds, url), items)
        if fmt not in ("table", "csv"):
            raise ValueError(f"unknown format {fmt!r}")
        return sinks.format_csv(items) if fmt == "csv" else sinks.format_table(items)

    # Unfurl

    def _unfurl(self, urls: DataFrame, pages: DataFrame | None = None) -> dict:
        now, landing = self.now(), f"{self.store.path}/landing"
        if pages is not None:
            rows = unfurl.metadata_rows(pages, now)
        else:
            rows = unfurl.unfurl(urls, now, landing, self.config.unfurl_concurrency, self.config.unfurl_skip_robots)
        landed = f"{landing}/unfurl-{now.strftime('%Y%m%dT%H%M%S%f')}"
        progress = Observation("unfurl")
        failed = F.col("fetch_error").isNotNull()
        seen = rows.observe(progress, F.count("*").alias("processed"), F.count_if(~failed).alias("successful"), F.count_if(failed).alias("failed"))
        seen.write.mode("overwrite").parquet(landed)
        log.info("unfurl: %(processed)d processed, %(successful)d successful, %(failed)d failed", progress.get)
        rows = self.spark.read.schema(rows.schema).parquet(landed)
        summary = R.unfurl_summary(rows.select(F.col("fetch_error").alias("error"))).first().asDict()
        buckets = self.store.touched(rows, "url")
        if buckets:
            merged = merge.upsert_metadata(self.store.table("url_metadata", buckets), rows, now)
            self.store.commit({"url_metadata": merged}, {"url_metadata": buckets})
        return summary

    def unfurl(self, url: str = "", limit: int = 0, retry_after: str | None = None, retry_immediate: bool = False, pages: DataFrame | None = None) -> dict:
        """Unfurl one URL, or all links that need it; ``pages`` replaces the network."""
        self.store.open()
        now = self.now()
        after = times.parse_duration(retry_after or self.config.unfurl_retry_after)
        if url:
            known = selection.metadata_by_url(self.store.url_metadata, url).select(selection.retry_eligible(now, after).alias("due")).first()
            if known and not known.due and not retry_immediate:
                return {"successful": 0, "failed": 0}
            urls = self.spark.createDataFrame([(url,)], "url string")
        else:
            cutoff = now if retry_immediate else now - after
            urls = R.urls_needing_fetch(self.store.items, self.store.url_metadata, cutoff, limit).select(F.col("link").alias("url"))
        return self._unfurl(urls, pages.join(urls, "url", "left_semi") if pages is not None else None)

    # Render

    def render(self, output: str | None = None, max_age: str | None = None, start: str = "", end: str = "", listed: str = "", minimum: int | None = None, maximum: int | None = None, page_size: int | None = None, templates: str = "", assets: str = "") -> int:
        """Write the static site; returns the number of feeds shown. Explicit bounds beat
        the age. ``templates`` and ``assets`` name folders that replace the own ones."""
        self.store.open()
        c, now = self.config, self.now()
        age = c.render_max_age if max_age is None else max_age
        a, b = times.parse_window(now, age, start, end)
        only = opml.load_list(self.spark, opml.detect_format(listed), listed) if listed else None
        size = c.feeds_per_page if page_size is None else page_size
        frame = selection.render_frame(
            self.store.feeds, self.store.items, now, a, b, c.min_items_per_feed if minimum is None else minimum, c.max_items_per_feed if maximum is None else maximum, size, only
        )
        icons = incremental.feed_favicons(self.store.table("icon_votes")) if self.store.summarised else R.feed_favicons(self.store.items, self.store.url_metadata)
        out = output or c.render_output
        sinks.clean(out)
        rows = sinks.site_frames(frame, self.store.feeds, self.store.url_metadata, icons)
        landing = f"{self.store.path}/landing/site-{now.strftime('%Y%m%dT%H%M%S%f')}"
        return sinks.write_site(rows, out, times.window_label(age, a, b, bool(start or end)), size, templates, assets, landing)

    # Purge

    def purge(self, max_age: str | None = None, listed: str = "", minimum: int | None = None, dry_run: bool = False, vacuum: bool = True) -> dict:
        """Delete unlisted feeds, then old archived items, then unused metadata.

        A dry run reports the same numbers and changes nothing.
        """
        self.store.open()
        c, out = self.config, {}
        store = self.store
        feeds, items = store.feeds, store.items
        gone = feeds.limit(0)
        if listed:
            gone = R.feeds_not_listed(feeds, opml.load_list(self.spark, opml.detect_format(listed), listed))
            out["feeds"] = gone.count()
            feeds, items = merge.delete_feeds(feeds, items, gone)
        cutoff = self.now() - times.parse_duration(c.purge_max_age if max_age is None else max_age)
        deleted, items = merge.purge_with_floor(items, cutoff, c.purge_min_items if minimum is None else minimum)
        # Keys alone are kept: they give the numbers, the buckets and, later, the rows that go.
        landed = f"{store.path}/landing/purge-{self.now().strftime('%Y%m%dT%H%M%S%f')}"
        deleted.select("id", "feed_url").write.mode("overwrite").parquet(landed)
        deleted = self.spark.read.schema("id bigint, feed_url string").parquet(landed)
        items = store.items.join(gone.select(F.col("url").alias("feed_url")), "feed_url", "left_anti").join(deleted.select("id"), "id", "left_anti")
        orphans = R.orphan_metadata(store.url_metadata, items)
        out["items"], out["metadata"] = deleted.count(), orphans.count()
        if not dry_run:
            own = store.touched(gone, "url")
            touched = {"feeds": own, "items": sorted({*own, *store.touched(deleted, "feed_url")}), "url_metadata": store.touched(orphans, "url")}
            left = {n: store.table(n, b) for n, b in touched.items()}
            left["feeds"], left["items"] = merge.delete_feeds(left["feeds"], left["items"].join(deleted.select("id"), "id", "left_anti"), gone)
            left["url_metadata"] = left["url_metadata"].join(orphans.select("url"), "url", "left_anti")
            if any(touched.values()):
                store.commit(left, touched)
            if vacuum:
                store.vacuum()
        return out

    # Serve

    def serve(self, directory: str | None = None, port: int | None = None) -> http.server.ThreadingHTTPServer:
        """Start a server of static files in a thread; the caller shuts it down."""
        server = http.server.ThreadingHTTPServer(("127.0.0.1", self.config.serve_port if port is None else port), functools.partial(_Handler, directory=directory or self.config.serve_dir))
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server


class _Handler(http.server.SimpleHTTPRequestHandler):
    timeout = 15

    def end_headers(self):
        for name, value in (("X-Content-Type-Options", "nosniff"), ("X-Frame-Options", "SAMEORIGIN"), ("Referrer-Policy", "strict-origin-when-cross-origin")):
            self.send_header(name, value)
        super().end_headers()

    def list_directory(self, path):
        self.send_error(404, "Not found")

    def log_message(self, *args):
        pass


def to_json(summary: dict) -> str:
    return json.dumps(summary, indent=2, default=str)
