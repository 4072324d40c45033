"""Explicit schemas of the feed archive; nothing is ever inferred."""

from __future__ import annotations

FEEDS = (
    "url string, title string, description string, last_updated timestamp_ntz, etag string, last_modified string, "
    "last_fetch_time timestamp_ntz, last_successful_fetch timestamp_ntz, error_count int, last_error string, "
    "latest_item_date timestamp_ntz, feed_json string"
)
ITEMS = (
    "id bigint, feed_url string, guid string, title string, link string, published_date timestamp_ntz, "
    "first_seen timestamp_ntz, content string, summary string, archived boolean, item_json string"
)
URL_METADATA = (
    "url string, title string, description string, image_url string, favicon_url string, metadata string, "
    "last_fetch_at timestamp_ntz, fetch_status_code bigint, fetch_error string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
#: What a fetch brings; stands in for the network.
RESPONSES = "feed_url string, ordinal int, status int, etag string, last_modified string, body string, error string"
#: One parsed feed document.
PARSED = (
    "feed_url string, ordinal int, error string, title string, description string, updated timestamp_ntz, feed_json string, "
    "items array<struct<pos:int,guid:string,title:string,plain_title:string,link:string,content:string,description:string,"
    "published:timestamp_ntz,updated:timestamp_ntz,item_json:string>>"
)
ROBOTS = "host string, allow array<string>, disallow array<string>, crawl_delay double"
#: Sums over items and metadata, kept by merges once an archive has them.
SUMMARIES = {
    "feed_counts": "feed_url string, live bigint, total bigint",
    "link_feeds": "link string, feed_url string, live bigint, total bigint",
    "icon_votes": "feed_url string, favicon_url string, votes bigint",
}
TABLES = {"feeds": FEEDS, "items": ITEMS, "url_metadata": URL_METADATA}
#: Keys that merges keep unique; Parquet enforces none.
KEYS = {"feeds": ["url"], "items": ["feed_url", "guid"], "url_metadata": ["url"], "feed_counts": ["feed_url"], "link_feeds": ["link"], "icon_votes": ["feed_url"]}
STORED = TABLES | SUMMARIES
