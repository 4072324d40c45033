"""Feed documents: RSS, Atom and JSON Feed into rows.

``responses`` rows (see ``rivulet.schema``) stand for what a fetch has brought; they
may come from the HTTP source below or from any table. Parsing is per document, in
Arrow batches; a document that cannot be read gives an error text.
"""

from __future__ import annotations

import functools
import html
import itertools
import json
import re
import urllib.error
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet import schema
from rivulet.session import bounded_batches

AGENT = "rivulet/1.0"
TIMEOUT, REDIRECTS = 30, 10
_CONTENT = "{http://purl.org/rss/1.0/modules/content/}encoded"
_DATE = "{http://purl.org/dc/elements/1.1/}date"
_ATOM = re.compile(r"\{http://(?:www\.w3\.org/2005/Atom|purl\.org/atom/ns#)\}")


def parse_time(text: str | None) -> datetime | None:
    """RFC 822 or ISO 8601, as UTC without zone; None if it is neither."""
    text = (text or "").strip()
    if not text:
        return None
    iso = lambda t: datetime.fromisoformat(t.replace("Z", "+00:00"))
    # A single word is no RFC 822 date.
    for read in (parsedate_to_datetime, iso) if len(text.split(None, 1)) > 1 else (iso,):
        try:
            t = read(text)
            return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t
        except (ValueError, TypeError, IndexError):
            pass
    return None


_json = json.JSONEncoder(default=str, ensure_ascii=False).encode


def _text(node: ET.Element | None) -> str:
    if node is None:
        return ""
    return ("".join(node.itertext()) if len(node) else node.text or "").strip()


def _texts(node: ET.Element, local: bool) -> dict[str, str]:
    """Texts of the children by name, of several the first that is not empty; ``local``
    names them without their namespace too."""
    out: dict[str, str] = {}
    for c in node:
        if t := _text(c):
            out.setdefault(c.tag, t)
            if local:
                out.setdefault(c.tag.rpartition("}")[2], t)
    return out


def _entry(item: dict, pos: int) -> dict:
    """An item with its place and its JSON. Title and texts are decoded once more, as they
    often are escaped twice; guid and link are not."""
    raw = {"pos": pos} | item | {"item_json": _json(item), "raw_title": item["title"], "plain_title": html.unescape(item["title"])}
    return raw | {f: html.unescape(item[f]) for f in ("content", "description")}


def _each(nodes: list[ET.Element], item: Callable[[ET.Element], dict]) -> Iterator[dict]:
    """Items of nodes one by one; a node that has been read is emptied."""
    for n in nodes:
        yield item(n)
        n.clear()


def _rss(root: ET.Element) -> tuple[dict, Iterable[dict]]:
    channel = root if root.tag == "channel" else next((c for c in root if c.tag.rpartition("}")[2] == "channel"), root)
    rdf = root.tag.endswith("}RDF")
    plain = lambda n: n.tag.rpartition("}")[2] if rdf else n.tag

    def get(node, *names):
        return next((t for name in names for c in node if (c.tag if name.startswith("{") else plain(c)) == name and (t := _text(c))), "")

    nodes = [n for n in ([*root] if rdf else [*channel]) if plain(n) == "item"]

    def item(n):
        t = _texts(n, rdf)
        return {f: t.get(f, "") for f in ("guid", "title", "link")} | {
            "content": t.get(_CONTENT, ""), "description": t.get("description", ""), "published": parse_time(t.get("pubDate") or t.get(_DATE)), "updated": None,
        }

    return {"title": get(channel, "title"), "description": get(channel, "description"), "updated": parse_time(get(channel, "lastBuildDate", "pubDate", _DATE))}, _each(nodes, item)


def _atom(root: ET.Element) -> tuple[dict, Iterable[dict]]:
    local = lambda n: n.tag.rpartition("}")[2]

    def get(node, *names):
        return next((t for name in names for c in node if local(c) == name and (t := _text(c))), "")

    def link(node):
        links = [c for c in node if local(c) == "link" and c.get("href")]
        return next((c.get("href") for c in links if c.get("rel", "alternate") == "alternate"), links[0].get("href") if links else "")

    def item(n):
        t = _texts(n, True)
        return {
            "guid": t.get("id", ""), "title": t.get("title", ""), "link": link(n), "content": t.get("content", ""), "description": t.get("summary", ""),
            "published": parse_time(t.get("published") or t.get("issued")), "updated": parse_time(t.get("updated") or t.get("modified")),
        }

    entries = [n for n in root if local(n) == "entry"]
    return {"title": get(root, "title"), "description": get(root, "subtitle", "tagline"), "updated": parse_time(get(root, "updated", "modified"))}, _each(entries, item)


def _json_feed(doc: dict) -> tuple[dict, Iterable[dict]]:
    items = (
        {
            "guid": str(i.get("id") or ""), "title": i.get("title") or "", "link": i.get("url") or i.get("external_url") or "",
            "content": i.get("content_html") or i.get("content_text") or "", "description": i.get("summary") or "",
            "published": parse_time(i.get("date_published")), "updated": parse_time(i.get("date_modified")),
        }
        for i in doc.get("items") or []
    )
    return {"title": doc.get("title") or "", "description": doc.get("description") or "", "updated": None}, items


def read_document(body: str | None) -> tuple[dict, Iterator[dict]]:
    """What one feed document says of itself, and its items one by one; raises ValueError
    for anything that is no feed, also while its items are taken."""
    text = (body or "").strip().lstrip("﻿")
    if text.startswith("{"):
        doc = json.loads(text)
        if "jsonfeed" not in str(doc.get("version", "")):
            raise ValueError("no feed version in the JSON document")
        raw, items = _json_feed(doc)
    else:
        try:
            root = ET.fromstring(re.sub(r"^<\?xml[^>]*\?>", "", text))
        except ET.ParseError as e:
            raise ValueError(f"failed to parse feed: {e}") from e
        if _ATOM.match(root.tag) or root.tag == "feed":
            raw, items = _atom(root)
        elif root.tag in ("rss", "channel") or root.tag.endswith("}RDF"):
            raw, items = _rss(root)
        else:
            raise ValueError(f"failed to parse feed: unknown root element {root.tag}")
    head = {"title": html.unescape(raw["title"]), "description": html.unescape(raw["description"]), "updated": raw["updated"], "feed_json": _json(raw)}
    return head, (_entry(item, k) for k, item in enumerate(items))


def parse_document(body: str | None) -> dict:
    """One feed document with all its items; raises ValueError for anything that is no feed."""
    head, items = read_document(body)
    return head | {"items": list(items)}


_TIME, _TEXT = pa.timestamp("us"), pa.string()
_ITEM = pa.struct([
    ("pos", pa.int32()), *((f, _TEXT) for f in ("guid", "title", "plain_title", "link", "content", "description")), ("published", _TIME), ("updated", _TIME), ("item_json", _TEXT),
])
#: ``schema.PARSED`` in Arrow's types.
_PARSED = pa.schema([
    ("feed_url", _TEXT), ("ordinal", pa.int32()), ("error", _TEXT), ("title", _TEXT), ("description", _TEXT), ("updated", _TIME), ("feed_json", _TEXT), ("items", pa.list_(_ITEM)),
])
_HEAD = _PARSED.remove(_PARSED.get_field_index("items"))
#: Characters of documents after which what they gave is handed on.
PARSED_CHARS = 1 << 20
#: Items of a document that are Python objects at a time; the others are Arrow, a fraction of it.
ITEMS_AT_ONCE = 512


def _batch(rows: list[dict], counts: list[int], items: list[pa.Array]) -> pa.RecordBatch:
    """Rows without their items, the number of items of each, and the items of all."""
    flat = pa.concat_arrays(items) if items else pa.array([], _ITEM)
    items.clear()  # copied
    lists = pa.ListArray.from_arrays(pa.array(itertools.accumulate(counts, initial=0), pa.int32()), flat)
    return pa.RecordBatch.from_arrays([*pa.RecordBatch.from_pylist(rows, schema=_HEAD).columns, lists], schema=_PARSED)


def parsed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``schema.PARSED`` for batches of (feed_url, ordinal, body)."""
    for batch in batches:
        rows, counts, found, size = [], [], [], 0
        for url, ordinal, text in zip(*batch.columns):
            row, own, body = {"feed_url": url.as_py(), "ordinal": ordinal.as_py()}, [], text.as_py()
            size += len(body or "")
            try:
                head, items = read_document(body)
                while some := list(itertools.islice(items, ITEMS_AT_ONCE)):
                    own.append(pa.array(some, _ITEM))
                row |= head
            except (ValueError, TypeError, AttributeError) as e:
                own, row["error"] = [], str(e)[:500]
            rows.append(row)
            counts.append(sum(map(len, own)))
            found += own
            if size >= PARSED_CHARS:
                body = text = items = some = own = None  # not held beside the batch
                yield _batch(rows, counts, found)
                rows, counts, found, size = [], [], [], 0
        if rows:
            yield _batch(rows, counts, found)


def parse_documents(responses: DataFrame) -> DataFrame:
    """Parsed documents of responses with status 200; see ``schema.PARSED``.

    Item titles are raw here: the generated guid is over the raw title. ``plain_title`` is
    decoded, so that no second Python worker does it. A task holds an Arrow batch of
    documents and, as Arrow, the items of a megabyte of them, or of one larger document.
    """
    return bounded_batches(responses).filter("status = 200").select("feed_url", F.col("ordinal").cast("int"), "body").mapInArrow(parsed_batches, schema.PARSED)


class _Redirects(urllib.request.HTTPRedirectHandler):
    max_redirections = REDIRECTS


@functools.cache
def _opener() -> urllib.request.OpenerDirector:
    """The process's opener: a new one reads all certificates of the system, which takes
    longer than most requests."""
    return urllib.request.build_opener(_Redirects)


def get(url: str, etag: str = "", last_modified: str = "", limit: int | None = None, timeout: float = TIMEOUT, headers: dict | None = None, files: bool = False) -> dict:
    """One conditional GET: status, etag, last_modified, body, error.

    Only http and https URLs are asked for, and with ``files`` those of files.
    """
    if not re.match("https?:|file:" if files else "https?:", url, re.IGNORECASE):
        return {"status": None, "etag": "", "last_modified": "", "body": None, "error": f"request failed: unsupported URL {url}"[:500]}
    request = urllib.request.Request(url, headers={"User-Agent": AGENT} | (headers or {}))
    if etag:
        request.add_header("If-None-Match", etag)
    if last_modified:
        request.add_header("If-Modified-Since", last_modified)
    try:
        with _opener().open(request, timeout=timeout) as r:
            body = r.read(limit) if limit else r.read()
            return {"status": r.status or 200, "etag": r.headers.get("ETag", ""), "last_modified": r.headers.get("Last-Modified", ""), "body": body.decode(r.headers.get_content_charset() or "utf-8", "replace"), "error": None}
    except urllib.error.HTTPError as e:
        if e.code == 304:
            return {"status": 304, "etag": etag, "last_modified": last_modified, "body": None, "error": None}
        return {"status": e.code, "etag": "", "last_modified": "", "body": None, "error": f"HTTP {e.code}: {e.reason}"}
    except (OSError, ValueError) as e:
        return {"status": None, "etag": "", "last_modified": "", "body": None, "error": f"request failed: {e}"[:500]}


def fetch(urls: DataFrame, feeds: DataFrame | None = None, concurrency: int = 32, force: bool = False) -> DataFrame:
    """Responses for (feed_url, ordinal); the cluster's partitions are the workers.

    Stored validators make requests conditional unless ``force``.
    """
    rows = urls.select("feed_url", "ordinal")
    if feeds is not None and not force:
        rows = rows.join(feeds.select(F.col("url").alias("feed_url"), "etag", "last_modified"), "feed_url", "left")
    else:
        rows = rows.withColumns({"etag": F.lit(""), "last_modified": F.lit("")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [get(r.feed_url, r.etag or "", r.last_modified or "") for r in batch.itertuples(index=False)]
            out = pd.DataFrame(got, columns=["status", "etag", "last_modified", "body", "error"])
            out["status"] = out["status"].astype("Int32")
            yield pd.concat([batch[["feed_url", "ordinal"]].reset_index(drop=True), out], axis=1)[[c.split()[0] for c in schema.RESPONSES.split(", ")]]

    return rows.repartition(concurrency).select("feed_url", F.col("ordinal").cast("int"), "etag", "last_modified").mapInPandas(run, schema.RESPONSES)


def sample_responses(items: DataFrame) -> DataFrame:
    """RSS documents made of archive items, one a feed; for queries over test tables."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), "&", "&amp;"), "<", "&lt;")
    item = F.concat(
        F.lit("<item><title>"), esc("title"), F.lit("</title><link>"), esc("link"), F.lit("</link><description>"), esc("content"),
        F.lit("</description><pubDate>"), F.date_format("published_date", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</pubDate><guid>"), esc("raw_guid"), F.lit("</guid></item>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id"), item.alias("x")))), lambda s: s["x"]), "")
    return items.groupBy("feed_url").agg(F.concat(F.lit("<rss version=\"2.0\"><channel><title>"), F.first("feed_url"), F.lit("</title>"), body, F.lit("</channel></rss>")).alias("body")).select(
        "feed_url", F.lit(0).alias("ordinal"), F.lit(200).alias("status"), F.lit("").alias("etag"), F.lit("").alias("last_modified"), "body", F.lit(None).cast("string").alias("error"))
