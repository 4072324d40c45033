"""Subscription lists: OPML and plain text, read and written.

Lists are small files that a person edits; whole files are parsed by the driver, or,
as a column of documents, by executors.
"""

from __future__ import annotations

import html
import html.entities
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from datetime import datetime
from itertools import chain
from pathlib import Path
from urllib.parse import urlsplit
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("opml", "text")
LIST = "feed_url string, ordinal bigint"
_XML_NAMES = {"amp", "lt", "gt", "quot", "apos"}


def _tree(text: str) -> ET.Element:
    """Parse leniently: HTML entities are known, stray ampersands are text."""

    def entity(m: re.Match) -> str:
        if m[1] in _XML_NAMES or m[1].startswith("#"):
            return m[0]
        char = html.entities.html5.get(m[1] + ";")
        return char if char else "&amp;" + m[1] + ";"

    text = re.sub(r"&([A-Za-z][A-Za-z0-9]*|#\d+|#x[0-9A-Fa-f]+);", entity, text)
    text = re.sub(r"&(?![A-Za-z#][A-Za-z0-9]*;)", "&amp;", text)
    return ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", text))


def parse_opml(text: str) -> list[str]:
    """xmlUrl of every outline, parents before children, repeats kept."""
    root = _tree(text)
    return [o.get("xmlUrl") for o in root.iter("outline") if o.get("xmlUrl")]


def parse_text_list(text: str) -> list[str]:
    """One URL a line; blank lines and comments are skipped, a bad line is an error."""
    urls = []
    for number, line in enumerate(text.split("\n"), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        try:
            scheme = urlsplit(line).scheme
        except ValueError as e:
            raise ValueError(f"invalid URL on line {number}: {line}") from e
        if not scheme:
            raise ValueError(f"URL without scheme on line {number}: {line}")
        urls.append(line)
    return urls


def detect_format(filename: str) -> str:
    return "opml" if Path(filename).suffix.lower() in (".opml", ".xml") else "text"


def read_file(spark: SparkSession, path: str) -> str:
    """A whole file through Spark's readers, from any file system they know."""
    row = spark.read.text(path, wholetext=True).first()
    return row.value if row else ""


def load_list(spark: SparkSession, fmt: str, path: str) -> DataFrame:
    """(feed_url, ordinal) of a list file; an unknown format is an error."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown feed list format {fmt!r}")
    urls = (parse_opml if fmt == "opml" else parse_text_list)(read_file(spark, path))
    return spark.createDataFrame(list(zip(urls, range(len(urls)))), LIST)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _opml_column(text: pd.Series) -> pd.Series:
    def one(t):
        try:
            return parse_opml(t or "")
        except ET.ParseError:
            return []

    return text.map(one)


def urls_of(documents: DataFrame) -> DataFrame:
    """(name, ordinal, feed_url) of OPML documents (name, text); a document that
    cannot be read has none."""
    return documents.select("name", F.posexplode(_opml_column("text")).alias("ordinal", "feed_url"))


def documents_from_list(listed: DataFrame) -> DataFrame:
    """OPML documents of a list, dealt over 256 groups by a hash of the URL."""
    outline = F.concat(F.lit('<outline text="'), "feed_url", F.lit('" xmlUrl="'), "feed_url", F.lit('"/>'))
    named = listed.withColumn("name", F.concat(F.lit("list-"), F.substring(F.md5("feed_url"), 1, 2)))
    body = F.array_join(F.array_sort(F.collect_list(outline)), "")
    return named.groupBy("name").agg(F.concat(F.lit('<opml version="2.0"><body><outline text="all">'), body, F.lit("</outline></body></opml>")).alias("text"))


def format_opml(urls: list[str], title: str = "Feeds", base: str | None = None) -> str:
    """An OPML document with these URLs.

    With the text of a list in ``base``, its outlines keep their nesting and
    attributes: outlines of URLs that are gone are dropped, new URLs are appended.
    """
    if base is None:
        return "\n".join([*list_lines("opml", urls, datetime.min, title), ""])
    root = _tree(base)
    body = root.find("body")
    if body is None:
        body = ET.SubElement(root, "body")
    have = set()

    def prune(node: ET.Element) -> None:
        for child in list(node):
            prune(child)
            url = child.get("xmlUrl")
            if url and url not in urls:
                node.remove(child)
            elif url:
                have.add(url)

    prune(body)
    for u in urls:
        if u not in have:
            ET.SubElement(body, "outline", {"text": u, "type": "rss", "xmlUrl": u})
            have.add(u)
    ET.indent(root)
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, "unicode") + "\n"


def format_text_list(urls: list[str], at: datetime) -> str:
    return "\n".join([*list_lines("text", urls, at), ""])


def list_lines(fmt: str, urls: Iterable[str], at: datetime, title: str = "Feeds") -> Iterator[str]:
    """The lines of a new list file, one by one."""
    if fmt == "opml":
        yield from ('<?xml version="1.0" encoding="UTF-8"?>', '<opml version="2.0">', f"  <head><title>{html.escape(title)}</title></head>", "  <body>")
        yield from (f"    <outline text={quoteattr(u)} type=\"rss\" xmlUrl={quoteattr(u)}/>" for u in urls)
        yield from ("  </body>", "</opml>")
        return
    yield from (f"# Subscriptions, written {at:%Y-%m-%d %H:%M:%S} UTC", "# A line is a feed's address or, after a number sign, a remark", "")
    yield from urls


def write_list(path: str, fmt: str, urls: Iterable[str], at: datetime) -> int:
    """Write a new list file from URLs that come one by one; nothing for none. Returns how many."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown feed list format {fmt!r}")
    many = 0

    def counted() -> Iterator[str]:
        nonlocal many
        for many, u in enumerate(urls, 1):  # noqa: B007
            yield u

    own = iter(counted())
    first = next(own, None)
    if first is None:
        return 0
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{line}\n" for line in list_lines(fmt, chain([first], own), at))
    return many


def save_list(path: str, fmt: str, urls: list[str], at: datetime, base: str | None = None) -> None:
    """Write a list file on the driver's machine."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown feed list format {fmt!r}")
    Path(path).write_text(format_opml(urls, base=base) if fmt == "opml" else format_text_list(urls, at), encoding="utf-8")
