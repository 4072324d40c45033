"""Outputs: tables, JSON, CSV and the static site.

Row work is done in DataFrames; only what a printed table holds reaches the driver, page
by page, and the static site is rendered and written by executors.
"""

from __future__ import annotations

import html
import json
import re
import shutil
from collections.abc import Iterator
from datetime import date, datetime
from pathlib import Path
from string import Template

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.functions import scalars as S
from rivulet.functions.html import iframe_source
from rivulet.sources import datasource
from rivulet.sources.scratch import landed

#: Names that printed JSON uses for stored columns.
FEED_NAMES = {
    "url": "URL", "title": "Title", "description": "Description", "last_updated": "LastUpdated", "etag": "ETag", "last_modified": "LastModified",
    "last_fetch_time": "LastFetchTime", "last_successful_fetch": "LastSuccessfulFetch", "error_count": "ErrorCount", "last_error": "LastError",
    "latest_item_date": "LatestItemDate", "feed_json": "FeedJSON",
}
ITEM_NAMES = {
    "id": "ID", "feed_url": "FeedURL", "guid": "GUID", "title": "Title", "link": "Link", "published_date": "PublishedDate", "first_seen": "FirstSeen",
    "content": "Content", "summary": "Summary", "archived": "Archived", "item_json": "ItemJSON",
}


def rfc3339(t: datetime | None) -> str | None:
    return None if t is None else t.isoformat(timespec="seconds" if not t.microsecond else "microseconds") + "Z"


def _plain(value):
    if isinstance(value, datetime):
        return rfc3339(value)
    return value.isoformat() if isinstance(value, date) else value


def _named(row: dict, names: dict[str, str]) -> dict:
    """A row under its printed names; JSON columns become nested JSON."""
    out = {}
    for c, v in row.items():
        if c in names:
            out[names[c]] = json.loads(v) if c.endswith("_json") and v else _plain(v)
    return out


def table_rows(items: DataFrame) -> DataFrame:
    """Columns of the printed table, in the order of ``position``."""
    return items.select("position", F.date_format("published_date", "yyyy-MM-dd HH:mm").alias("date"), S.table_title("title").alias("title"), "link")


def format_table(items: DataFrame) -> str:
    return "\n".join(f"{r.date or ''}  {r.title}\n    {r.link}" for r in table_rows(items).orderBy("position").toLocalIterator())


def format_json(feed: DataFrame, items: DataFrame) -> str:
    """The feed's fields and its items; an unknown feed has only items."""
    row = feed.first()
    found = [_named(r.asDict(), ITEM_NAMES) for r in items.orderBy("position").toLocalIterator()]
    return json.dumps((_named(row.asDict(), FEED_NAMES) if row else {}) | {"Items": found}, indent=2, ensure_ascii=False)


def csv_rows(items: DataFrame) -> DataFrame:
    return items.select(
        "position", F.date_format("published_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Date"), F.col("title").alias("Title"), F.col("link").alias("Link"), F.col("summary").alias("Summary")
    )


def format_csv(items: DataFrame) -> str:
    import csv
    import io

    out = io.StringIO()
    write = csv.writer(out, lineterminator="\n")
    write.writerow(["Date", "Title", "Link", "Summary"])
    for r in csv_rows(items).orderBy("position").toLocalIterator():
        write.writerow([r.Date, r.Title, r.Link, r.Summary])
    return out.getvalue()


def write_csv(items: DataFrame, path: str) -> None:
    """CSV files with a header, written by the executors."""
    csv_rows(items).orderBy("position").drop("position").write.option("header", True).csv(path)


# Static site


def site_frames(frame: DataFrame, feeds: DataFrame, metadata: DataFrame, favicons: DataFrame) -> DataFrame:
    """One row for each feed of a render frame, its items nested in order.

    Joins attach link metadata and favicons once for all items.
    """
    m = metadata.select(F.col("url").alias("link"), F.col("title").alias("link_title"), F.col("description").alias("link_description"), "image_url")
    rich = frame.join(m, "link", "left").select(
        "feed_url", "feed_id", "rank", "page", "position",
        F.struct(
            "position", S.display_title("title", "summary", "content").alias("title"), "link", S.excerpt("summary", "content").alias("excerpt"), "content", "summary",
            "published_date", "image_url", "link_title", "link_description",
        ).alias("item"),
    )
    nested = rich.groupBy("feed_url", "feed_id", "rank", "page").agg(F.array_sort(F.collect_list("item")).alias("items"))
    f = feeds.select(F.col("url").alias("feed_url"), F.col("title").alias("feed_title"), "description", S.feed_time_label("latest_item_date", "last_successful_fetch").alias("label"))
    icons = favicons.select("feed_url", F.col("favicon_url").alias("favicon"))
    return nested.join(f, "feed_url").join(icons, "feed_url", "left")


#: The site's page and its assets; ``extract`` writes them out, ``write_site`` takes
#: folders with changed ones (index.html, list.html and feed.html go before page.html for
#: pages of that kind). A page has $title, $root, $window and $body.
TEMPLATES = {
    "page.html": """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>$title</title><link rel="stylesheet" href="${root}assets/style.css"></head>
<body><header><h1><a href="${root}index.html">Feeds</a></h1><p>$window</p></header><main>
$body
</main></body></html>
"""
}
ASSETS = {"style.css": "body{font-family:sans-serif;max-width:60em;margin:auto}.icon{width:16px}details{margin:.5em 0}iframe{width:100%}"}


def extract(files: dict[str, str], folder: str) -> list[str]:
    """Write files to a folder; those already there are kept. Returns the names written."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    new = [n for n in files if not (root / n).exists()]
    for n in new:
        (root / n).write_text(files[n], encoding="utf-8")
    return new


#: Kinds of page; a folder may have a template for each beside the common one.
KINDS = ("index", "list", "feed")


def page_template(folder: str = "", kind: str = "page") -> Template:
    """The template of a kind in a folder, else the folder's common page, else the own one."""
    for name in (f"{kind}.html", "page.html") if folder else ():
        try:
            return Template((Path(folder) / name).read_text(encoding="utf-8"))
        except OSError:
            continue
    return Template(TEMPLATES["page.html"])


def copy_assets(out: Path, folder: str = "") -> None:
    """Copy all files below a folder, or the own assets."""
    if not folder:
        extract(ASSETS, str(out))
        return
    for p in Path(folder).rglob("*"):
        if p.is_file():
            to = out / p.relative_to(folder)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(p.read_bytes())


def _esc(text) -> str:
    return html.escape("" if text is None else str(text))


def _feed_line(r, root: str) -> str:
    icon = f'<img src="{_esc(r.favicon)}" alt="" class="icon">' if r.favicon else ""
    return f'<li>{icon}<a href="{root}feeds/{r.feed_id}.html">{_esc(r.feed_title or r.feed_url)}</a> <time>{_esc(r.label)}</time></li>'


def _item(i) -> str:
    title = f'<a href="{_esc(i.link)}" target="_blank">{_esc(i.title)}</a>' if i.link else _esc(i.title)
    image = f'<img src="{_esc(i.image_url)}" alt="" loading="lazy">' if i.image_url else ""
    frame = f'<iframe sandbox data-src="{iframe_source(i.content)}"></iframe>' if i.content else f"<p>{_esc(S_plain(i.summary))}</p>"
    when = i.published_date.strftime("%b %-d, %Y %H:%M UTC") if i.published_date else ""
    return f"<details><summary>{image}{title}<p>{_esc(i.excerpt)}</p><time>{when}</time></summary>{frame}</details>"


def S_plain(text: str | None) -> str:
    """Text without tags, as the strip function gives it."""
    return re.sub(r"\s+", " ", re.sub(r"<[^>]*>", "", text or "").strip())


def write_site(frame: DataFrame, out: str, label: str, page_size: int, templates: str = "", assets: str = "", landing: str = "") -> int:
    """Write index, list pages and feed pages; returns the number of feeds.

    Executors render the pages, and the ``files`` writer moves them to their names once
    all are there. With ``landing`` what is rendered is kept there first, so that the
    frame is computed once; else once for each kind of page.
    """
    spark = datasource.register(frame.sparkSession)
    root = Path(out)
    (root / "feeds").mkdir(parents=True, exist_ok=True)
    copy_assets(root / "assets", assets)
    template = {kind: page_template(templates, kind) for kind in KINDS}

    def page(kind: str, title: str | None, up: str, body: str) -> str:
        return template[kind].safe_substitute(title=_esc(title), root=up, window=_esc(label), body=body)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in map(_Named, batch.to_pylist()):
                body = f"<h2><a href=\"{_esc(r.feed_url)}\">{_esc(r.feed_title)}</a></h2><p>{_esc(r.description)}</p>" + "\n".join(_item(_Named(i)) for i in r["items"])
                rows.append({"page": r.page, "rank": r.rank, "line": _feed_line(r, "../"), "path": f"feeds/{r.feed_id}.html", "body": page("feed", r.feed_title, "../", body)})
            yield pa.RecordBatch.from_pylist(rows, _RENDERED)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                body = "<ul>" + "\n".join(x["line"] for x in r["lines"]) + "</ul>"
                if r["page"] is None:
                    rows.append({"path": "index.html", "body": page("index", "Feeds", "", body)})
                else:
                    rows.append({"path": f"feeds/page-{r['page']}.html", "body": page("list", f"Page {r['page']}", "../", body)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("body", pa.string())]))

    feeds = frame.mapInArrow(render, "page bigint, rank bigint, line string, path string, body string")
    if landing:
        feeds = landed(feeds, landing)
    total = feeds.count()
    nested = lambda rank, line: F.array_sort(F.collect_list(F.struct(rank.cast("bigint").alias("rank"), line.alias("line")))).alias("lines")
    pages = feeds.groupBy("page").agg(nested(F.col("rank"), F.col("line")))
    number = F.col("page")
    first = (number - 1) * page_size + 1 if page_size > 0 else F.lit(1)
    last = F.least(number * page_size, F.lit(total)) if page_size > 0 else F.lit(total)
    entry = F.format_string('<li><a href="feeds/page-%d.html">Feeds %d to %d</a></li>', number, first.cast("bigint"), last.cast("bigint"))
    # One short line for each page, whatever the feeds hold; an empty site has an index too.
    entries = feeds.select("page").distinct().select(nested(number, entry)).select(F.lit(None).cast("bigint").alias("page"), "lines")
    listed = pages.unionByName(entries).mapInArrow(lists, "path string, body string")
    feeds.select("path", "body").unionByName(listed).write.format("files").mode("append").save(str(root.absolute()))
    return total


class _Named(dict):
    """A row of Arrow by names."""

    __getattr__ = dict.__getitem__


_RENDERED = pa.schema([("page", pa.int64()), ("rank", pa.int64()), ("line", pa.string()), ("path", pa.string()), ("body", pa.string())])


def clean(out: str) -> None:
    """Remove what an earlier site has left, half-written pages too; other files stay."""
    root = Path(out)
    for staged in root.glob(".staging-*"):
        shutil.rmtree(staged, ignore_errors=True)
    for p in [root / "index.html", *root.glob("feeds/*.html"), *root.glob("assets/*")]:
        if p.is_file():
            p.unlink()


def nested_json(feeds: DataFrame, items: DataFrame) -> DataFrame:
    """(url, json) of every feed with its items, built by the executors."""
    position = F.row_number().over(W.partitionBy("feed_url").orderBy(F.col("published_date").desc_nulls_last(), F.col("id").desc()))
    own = items.withColumn("position", position).groupBy("feed_url").agg(
        F.array_sort(F.collect_list(F.struct("position", *(F.col(c).alias(n) for c, n in ITEM_NAMES.items() if c in items.columns)))).alias("Items"))
    f = feeds.select(F.col("url").alias("feed_url"), *(F.col(c).alias(n) for c, n in FEED_NAMES.items() if c in feeds.columns))
    return f.join(own, "feed_url", "left").select(F.col("feed_url").alias("url"), F.to_json(F.struct(*[c for c in f.columns if c != "feed_url"], "Items")).alias("json"))
