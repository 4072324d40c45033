"""Parsers that no built-in covers, as Arrow-batched pandas UDFs.

All of them are lenient: bad input gives an empty result or an error column, never a
failed job.
"""

from __future__ import annotations

import base64
import html
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a page that an unfurl reads.
PAGE_LIMIT = 102_400

# Types are objects, not text, so that the module imports without a session.
_IMAGE = T.StructType().add("url", T.StringType()).add("width", T.IntegerType()).add("height", T.IntegerType()).add("alt", T.StringType())
PAGE_META = T.StructType()
for _name in ("html_title", "html_description", "html_image", "html_icon", "og_title", "og_description", "og_type", "og_url", "og_site_name"):
    PAGE_META.add(_name, T.StringType())
PAGE_META.add("og_images", T.ArrayType(_IMAGE))
ROBOTS_RULES = T.StructType().add("allow", T.ArrayType(T.StringType())).add("disallow", T.ArrayType(T.StringType())).add("crawl_delay", T.DoubleType())
#: Product token that robots groups are matched with.
AGENT = "rivulet"


@F.pandas_udf(T.StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """Character references of HTML5 decoded; null stays null."""
    return text.map(html.unescape, na_action="ignore")


def resolve(base: str | None, ref: str | None) -> str | None:
    """``ref`` as an absolute URL; a reference that cannot be read stays as it is."""
    if not ref:
        return ref
    try:
        return urljoin(base or "", ref)
    except ValueError:
        return ref


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([resolve(b, r) for b, r in zip(base, ref)], dtype=object)


class _PageParser(HTMLParser):
    """Collects a page's own metadata and its OpenGraph properties."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.in_title, self.meta, self.og, self.images = "", False, {}, {}, []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "title":
            self.in_title, self.fresh = True, True
        elif tag == "meta":
            content, prop = a.get("content", ""), a.get("property", "").lower()
            if content and "description" in (a.get("name", "").lower(), prop):
                self.meta["description"] = content  # the last one counts
            if content and prop == "twitter:image":
                self.meta.setdefault("image", content)  # the first one counts
            if prop.startswith("og:"):
                self._open_graph(prop[3:], content)
        elif tag == "link" and "icon" in a.get("rel", "").lower() and a.get("href"):
            self.meta["icon"] = a["href"]

    handle_startendtag = handle_starttag

    def _open_graph(self, key: str, value: str) -> None:
        if key in ("image", "image:url"):
            if key == "image:url" and self.images and self.images[-1]["url"] == value:
                return
            self.images.append({"url": value, "width": None, "height": None, "alt": None})
        elif key in ("image:width", "image:height") and self.images:
            if value.isdecimal() and len(value) < 9:
                self.images[-1][key[6:]] = int(value)
        elif key == "image:alt" and self.images:
            self.images[-1]["alt"] = value
        elif key in ("title", "description", "type", "url", "site_name"):
            self.og[key] = value

    def handle_data(self, data):
        if self.in_title and self.fresh and data:
            self.title, self.fresh = data, False

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False


def page_metadata(url: str | None, page: str | bytes | None, limit: int = PAGE_LIMIT) -> dict:
    """Metadata of the first ``limit`` bytes of a page; links are made absolute."""
    raw = (page.encode() if isinstance(page, str) else page or b"")[:limit]
    p = _PageParser()
    try:
        p.feed(raw.decode("utf-8", "replace"))
        p.close()
    except Exception:  # noqa: BLE001 - whatever was read up to here counts
        pass
    out = {f"html_{k}": p.meta.get(k, "") for k in ("description", "image", "icon")}
    for k in ("html_image", "html_icon"):
        out[k] = resolve(url, out[k]) or ""
    images = [i | {"url": resolve(url, i["url"])} for i in p.images if i["url"]]
    return out | {"html_title": p.title.strip(), "og_images": images} | {f"og_{k}": p.og.get(k, "") for k in ("title", "description", "type", "url", "site_name")}


@F.pandas_udf(PAGE_META)
def page_meta(url: pd.Series, page: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_metadata(u, p) for u, p in zip(url, page)], columns=PAGE_META.names)


def parse_robots_text(body: str | None, agent: str = AGENT, single_wildcard: bool = True) -> dict:
    """Rules of a robots.txt that apply to ``agent``.

    A group applies if its name equals the agent's or the agent's name starts with it.
    Rules of the group for all robots count only while none is known, so with
    ``single_wildcard`` at most one of each kind comes from it.
    """
    allow: list[str] = []
    disallow: list[str] = []
    delay, applies, everyone = None, False, False
    for line in (body or "").splitlines():
        key, colon, value = line.strip().partition(":")
        if not colon or key.startswith("#"):
            continue
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            everyone = value == "*"
            applies = not everyone and agent.lower().startswith(value.lower())
        elif key in ("disallow", "allow") and value:
            rules = disallow if key == "disallow" else allow
            if applies or everyone and not (single_wildcard and rules):
                rules.append(value)
        elif key == "crawl-delay" and (applies or everyone):
            try:
                delay = float(value)
            except ValueError:
                pass
    return {"allow": allow, "disallow": disallow, "crawl_delay": delay}


@F.pandas_udf(ROBOTS_RULES)
def parse_robots(body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_robots_text(b) for b in body], columns=["allow", "disallow", "crawl_delay"])


def iframe_source(content: str | None) -> str:
    """Content in a bare page as a data URL, for a sandboxed frame."""
    page = f"<!DOCTYPE html><html><head><meta charset='utf-8'><base target='_blank'></head><body>{content or ''}</body></html>"
    return "data:text/html;charset=utf-8;base64," + base64.b64encode(page.encode()).decode()
