"""Scalar definitions of the feed archive as column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: No item is dated before this.
FLOOR = datetime(2000, 1, 1)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts(value: datetime | str | Column) -> Column:
    """A timestamp without zone from a literal or a column."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def generated_guid(link, title) -> Column:
    """Identity of an item without one: SHA-256 of link and raw title."""
    return F.sha2(F.concat(F.coalesce(_col(link), F.lit("")), F.coalesce(_col(title), F.lit(""))), 256)


def normalised_guid(guid, link, title) -> Column:
    """The stored identity.

    A missing guid, and one that is the link plus a fragment, become the generated
    one; any other stays.
    """
    g, a = F.coalesce(_col(guid), F.lit("")), F.coalesce(_col(link), F.lit(""))
    fragment = (a != "") & F.startswith(g, F.concat(a, F.lit("#")))
    return F.when((g == "") | fragment, generated_guid(link, title)).otherwise(g)


def feed_id(url) -> Column:
    """Short stable name of a feed for file names."""
    return F.substring(F.sha2(_col(url), 256), 1, 8)


def published(published_col, updated_col, now) -> Column:
    """Published, else updated, else the time of the fetch."""
    return F.coalesce(_col(published_col), _col(updated_col), ts(now))


def clamped(date, first_seen, now) -> Column:
    """The date that ranks an item.

    Never after the item was first seen (or, for a new item, after now), and never
    before 2000. The ceiling is applied first and is final.
    """
    d, seen, at = _col(date), _col(first_seen), ts(now)
    return (
        F.when(d.isNull(), F.lit(None).cast("timestamp_ntz"))
        .when(seen.isNotNull() & (d > seen), seen)
        .when(seen.isNull() & (d > at), at)
        .when(d < ts(FLOOR), ts(FLOOR))
        .otherwise(d)
    )


def backfilled_first_seen(published_col, now) -> Column:
    """first_seen of rows that predate the column."""
    p = _col(published_col)
    return F.when(p > ts(now), ts(now)).when(p < ts(FLOOR), ts(FLOOR)).otherwise(p)


def is_valid_url(url) -> Column:
    """http or https with a host; never raises on bad input."""
    u = _col(url)
    return F.coalesce(
        F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))).isin("http", "https")
        & (F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit("")) != ""),
        F.lit(False),
    )


def looks_like_url(url) -> Column:
    """The same test as an anchored pattern, for engines without a URL parser."""
    return F.coalesce(_col(url).rlike(r"^[hH][tT][tT][pP][sS]?://[^/?#\s:@]+(:[0-9]*)?([/?#]|$)"), F.lit(False))


def default_favicon(url) -> Column:
    """/favicon.ico on the host of the URL, with its port; '' without a host."""
    origin = F.regexp_extract(_col(url), r"^(https?://[^/?#]+)", 1)
    return F.when(origin != "", F.concat(origin, F.lit("/favicon.ico"))).otherwise("")


def strip_tags(html) -> Column:
    """Text without tags: tags go without a trace, ends are trimmed, white space
    collapses."""
    bare = F.regexp_replace(_col(html), r"<[^>]*>", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^\s+|\s+$", ""), r"\s+", " ")


def display_title(title, summary, content) -> Column:
    """Title, else the start of summary or content, else 'Untitled'."""
    t, s, c = (F.coalesce(_col(x), F.lit("")) for x in (title, summary, content))
    cut = lambda x: F.concat(F.substring(x, 1, 80), F.lit("..."))
    return F.when(t != "", t).when(s != "", cut(s)).when(c != "", cut(c)).otherwise("Untitled")


def excerpt(summary, content) -> Column:
    """200 characters of stripped summary or content, always with an ellipsis."""
    s, c = (F.coalesce(_col(x), F.lit("")) for x in (summary, content))
    cut = lambda x: F.concat(F.substring(strip_tags(x), 1, 200), F.lit("..."))
    return F.when(s != "", cut(s)).when(c != "", cut(c)).otherwise("")


def table_title(title) -> Column:
    """Title of a table row: over 60 bytes, the first 57 and an ellipsis."""
    t = F.coalesce(_col(title), F.lit(""))
    cut = F.decode(F.substring(t.cast("binary"), 1, 57), "UTF-8")
    return F.when(F.octet_length(t) > 60, F.concat(cut, F.lit("..."))).otherwise(t)


def shortened(text, limit: int) -> Column:
    """At most ``limit`` characters; a cut text ends in an ellipsis."""
    t = _col(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def feed_time_label(latest, last_success) -> Column:
    """'Latest:' with the newest item's time, else 'Fetched:' with the last success."""
    fmt = "MMM d, yyyy HH:mm 'UTC'"
    a, b = _col(latest), _col(last_success)
    return F.when(a.isNotNull(), F.concat(F.lit("Latest: "), F.date_format(a, fmt))).when(
        b.isNotNull(), F.concat(F.lit("Fetched: "), F.date_format(b, fmt))
    ).otherwise("")


def status_from_error(error) -> Column:
    """Status code that an error text begins with ('HTTP nnn'), else 0."""
    code = F.regexp_extract(F.coalesce(_col(error), F.lit("")), r"^HTTP (\d{1,9})", 1)
    return F.coalesce(code.try_cast("int"), F.lit(0))


def list_format(filename) -> Column:
    """'opml' for .opml and .xml, else 'text'."""
    return F.when(F.lower(F.regexp_extract(_col(filename), r"(\.[^./]*)$", 1)).isin(".opml", ".xml"), "opml").otherwise("text")


def page_head(html, limit: int = 102_400) -> Column:
    """The first bytes of a page, as much as an unfurl reads."""
    return F.substring(_col(html).cast("binary"), 1, limit)


def page_title(html) -> Column:
    """Text of the last title element within the page's head."""
    return F.regexp_extract(F.decode(page_head(html), "UTF-8"), r"(?is).*<title[^>]*>([^<]*)</title>", 1)


def feed_links(html) -> Column:
    """Distinct href values of <link> tags that announce a feed, in page order.

    Only quoted attributes count, in either order and with either quote.
    """
    kind = r"""application/(?:rss|atom)\+xml"""
    tag = rf"""(?is)<link\b[^>]*\btype\s*=\s*["']{kind}["'][^>]*>"""
    tags = F.regexp_extract_all(_col(html), F.lit(tag), F.lit(0))
    hrefs = F.transform(tags, lambda t: F.regexp_extract(t, r"""(?is)\bhref\s*=\s*["']([^"']+)["']""", 1))
    return F.array_distinct(F.filter(hrefs, lambda h: h != ""))


def robots_allowed(path, allow, disallow) -> Column:
    """Whether rules permit a path: the first matching disallow prefix decides,
    unless a longer allow prefix matches."""
    p = _col(path)
    rule = F.try_element_at(F.filter(_col(disallow), lambda x: (x != "") & F.startswith(p, x)), F.lit(1))
    longer = F.exists(_col(allow), lambda x: F.startswith(p, x) & (F.length(x) > F.length(rule)))
    return rule.isNull() | longer


def metadata_field(metadata, key: str) -> Column:
    """A top-level value of a JSON document as text."""
    return F.get_json_object(_col(metadata), f"$['{key}']")


def with_metadata_field(metadata, key: str, value) -> Column:
    """The JSON document with one top-level text value set."""
    old = F.coalesce(F.from_json(_col(metadata), "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: k != key), F.create_map(F.lit(key), _col(value).cast("string"))))


def relative_time(at, now) -> Column:
    """'2 hours ago' for recent times, else the date."""
    s = F.timestamp_diff("SECOND", _col(at), ts(now))
    unit = lambda n, name: F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, " ago").otherwise("s ago"))
    return (
        F.when(s < 60, "just now")
        .when(s < 3600, unit(F.floor(s / 60), "minute"))
        .when(s < 86400, unit(F.floor(s / 3600), "hour"))
        .when(s < 7 * 86400, unit(F.floor(s / 86400), "day"))
        .otherwise(F.date_format(_col(at), "MMM d, yyyy"))
    )
