"""SQL text of the archive views, for comparison in DuckDB."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-01-25 00:00:00'"

VIEWS = """
feeds AS (
  SELECT 'https://feeds.example.com/' || user_id || '/rss.xml' AS url, 'Feed ' || user_id AS title, min(ts) AS last_updated,
         CASE WHEN user_id % 10 = 0 THEN NULL ELSE max(ts) - to_days(CAST(user_id % 30 AS INTEGER)) END AS latest_item_date,
         max(ts) AS last_fetch_time, count(*) FILTER (event_type = 'error') AS error_count, user_id
  FROM events GROUP BY user_id
), items0 AS (
  SELECT event_id AS id, 'https://feeds.example.com/' || user_id || '/rss.xml' AS feed_url,
         CASE WHEN event_id % 10 = 0 AND p.url IS NOT NULL THEN p.url || '#' || event_id WHEN event_id % 10 = 1 THEN '' ELSE CAST(event_id AS VARCHAR) END AS raw_guid,
         event_type AS title, coalesce(p.url, '') AS link, ts AS published_date,
         CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN ts - INTERVAL 1 DAY ELSE ts + INTERVAL 5 MINUTE END AS first_seen,
         props AS content, '' AS summary, event_type = 'error' AS archived, user_id
  FROM events e LEFT JOIN pages p ON p.page_id = e.event_id % 400 AND p.page_id % 11 <> 5
), items AS (
  SELECT *, CASE WHEN raw_guid = '' OR (link <> '' AND starts_with(raw_guid, link || '#')) THEN sha256(link || title) ELSE raw_guid END AS guid FROM items0
), url_metadata AS (
  SELECT url, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/favicon.ico' AS favicon_url,
         CASE WHEN page_id % 5 = 0 THEN 404 WHEN page_id % 5 = 1 THEN NULL ELSE 200 END AS fetch_status_code,
         TIMESTAMP '2024-01-15 00:00:00' + to_hours(CAST(page_id AS INTEGER)) AS last_fetch_at, page_id
  FROM pages WHERE page_id % 7 <> 3
), subscriptions AS (SELECT url AS feed_url FROM feeds WHERE user_id % 3 = 0)
"""


def with_views(body: str, more: str = "") -> str:
    """A statement over the views; ``more`` adds further named queries."""
    return f"WITH {VIEWS}{', ' + more if more else ''} {body}"


def clamp(date: str, seen: str, now: str = NOW) -> str:
    return (
        f"CASE WHEN {date} IS NULL THEN NULL WHEN {seen} IS NOT NULL AND {date} > {seen} THEN {seen} "
        f"WHEN {seen} IS NULL AND {date} > {now} THEN {now} WHEN {date} < TIMESTAMP '2000-01-01' THEN TIMESTAMP '2000-01-01' ELSE {date} END"
    )


def minimum(start: str, end: str, floor: int) -> str:
    """Named query ``picked``: the window's items filled up to a floor."""
    return f"""flagged AS (
  SELECT *, coalesce(published_date BETWEEN {start} AND {end}, FALSE) AS in_window FROM items
), counted AS (
  SELECT *, count(*) FILTER (in_window) OVER (PARTITION BY feed_url) AS n_in,
         row_number() OVER (PARTITION BY feed_url, in_window ORDER BY published_date DESC NULLS LAST, id DESC) AS out_rank FROM flagged
), picked AS (
  SELECT *, row_number() OVER (PARTITION BY feed_url ORDER BY in_window DESC, published_date DESC NULLS LAST, id DESC) AS position
  FROM counted WHERE in_window OR (n_in < {floor} AND out_rank <= {floor} - n_in)
)"""


def ranked(source: str = "feeds", now: str = NOW) -> str:
    """Named query ``ranked`` over a feed query."""
    return f"""ranked AS (
  SELECT *, row_number() OVER (ORDER BY coalesce(CASE WHEN latest_item_date > {now} THEN {now} ELSE latest_item_date END, last_updated) DESC NULLS LAST, url ASC) AS rank FROM {source}
)"""
