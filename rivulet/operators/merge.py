"""Copy-on-write merges: (current table, batch) -> next table.

Parquet tables have no MERGE, so each statement is an expression for the next
snapshot. Deletes keep every row whose predicate is not true, null included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.scalars import ts


def survivors(table: DataFrame, deleted: Column) -> DataFrame:
    return table.filter(~F.coalesce(deleted, F.lit(False)))


def expired(cutoff) -> Column:
    """Archived and published before the cutoff (strictly)."""
    return F.col("archived") & (F.col("published_date") < ts(cutoff))


def purge_by_age(items: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """(deleted, surviving) items."""
    return items.filter(F.coalesce(expired(cutoff), F.lit(False))), survivors(items, expired(cutoff))


def purge_with_floor(items: DataFrame, cutoff, minimum: int) -> tuple[DataFrame, DataFrame]:
    """As ``purge_by_age``, but the newest ``minimum`` items of each feed stay.

    Items that are not expired stay without a shuffle. Keys of feeds with expired items
    are ranked, of which each task keeps ``minimum`` a feed; expired items meet these.
    """
    if minimum <= 0:
        return purge_by_age(items, cutoff)
    from pyspark.sql import Window as W

    old, young = purge_by_age(items, cutoff)
    rank = F.row_number().over(W.partitionBy("feed_url").orderBy(F.col("published_date").desc_nulls_last(), F.col("id").desc()))
    keys = items.select("feed_url", "id", "published_date").join(old.select("feed_url").distinct(), "feed_url", "left_semi")
    newest = keys.withColumn("__rank", rank).filter(F.col("__rank") <= minimum).select("feed_url", "id")
    on = ["feed_url", "id"]
    return old.join(newest, on, "left_anti").select(*items.columns), young.unionByName(old.join(newest, on, "left_semi").select(*items.columns))


def archive_absent(items: DataFrame, active: DataFrame, parsed_feeds: DataFrame) -> DataFrame:
    """Archive items of ``parsed_feeds(feed_url)`` that ``active(feed_url, guid)`` lacks.

    A parsed feed without active items has all its items archived. Feeds that were not
    parsed (unchanged or failed) are left alone. Archived items stay archived.
    """
    a = active.select("feed_url", "guid").distinct().withColumn("__active", F.lit(True))
    p = parsed_feeds.select("feed_url").distinct().withColumn("__parsed", F.lit(True))
    gone = F.col("__parsed").isNotNull() & F.col("__active").isNull()
    return items.join(a, ["feed_url", "guid"], "left").join(p, "feed_url", "left").withColumn("archived", F.col("archived") | gone).select(*items.columns)


def delete_feeds(feeds: DataFrame, items: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feeds, items) without the feeds in ``gone(url)``; their items go with them."""
    return feeds.join(gone.select("url"), "url", "left_anti"), items.join(gone.select(F.col("url").alias("feed_url")), "feed_url", "left_anti")


def collapse_items(batch: DataFrame, position: str = "pos") -> DataFrame:
    """One row for each (feed_url, guid) of a document.

    Occurrences act in order: the first fixes published_date and first_seen, the last
    gives every other column.
    """
    fixed = ("published_date", "first_seen")
    rest = [c for c in batch.columns if c not in (*fixed, "feed_url", "guid")]
    # One ordered pick for all columns: min_by and max_by over structs combine on the map side.
    return batch.groupBy("feed_url", "guid").agg(
        F.min_by(F.struct(*fixed), position).alias("__first"), F.max_by(F.struct(*rest), position).alias("__last")
    ).select("feed_url", "guid", *(F.col(f"__first.{c}").alias(c) for c in fixed), *(F.col(f"__last.{c}").alias(c) for c in rest))


def _merge(current: DataFrame, batch: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Full outer merge: ``rules`` give a matched row's columns, else the batch's win."""
    old = current.select(*(F.col(c).alias(f"o_{c}") for c in current.columns), F.lit(True).alias("o__"))
    new = batch.select(*(F.col(c).alias(f"n_{c}") for c in batch.columns), F.lit(True).alias("n__"))
    on = [F.col(f"o_{k}") == F.col(f"n_{k}") for k in keys]
    in_old, in_new = F.col("o__").isNotNull(), F.col("n__").isNotNull()

    def column(c: str) -> Column:
        o = F.col(f"o_{c}")
        n = F.col(f"n_{c}") if c in batch.columns else F.lit(None).cast(current.schema[c].dataType)
        matched = rules.get(c, n if c in batch.columns else o)
        return F.when(in_old & in_new, matched).when(in_new, n).otherwise(o).alias(c)

    return old.join(new, on, "full_outer").select(*map(column, current.columns))


def upsert_feeds(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Overwrite by url; latest_item_date only if the batch has one."""
    return _merge(current, batch, ["url"], {"latest_item_date": F.coalesce("n_latest_item_date", "o_latest_item_date")})


def upsert_items(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge by (feed_url, guid); stored published_date, first_seen and id stay.

    The batch has one row for each key (see ``collapse_items``).
    """
    keep = {c: F.col(f"o_{c}") for c in ("published_date", "first_seen", "id") if c in current.columns}
    return _merge(current, batch, ["feed_url", "guid"], keep)


def upsert_metadata(current: DataFrame, batch: DataFrame, now) -> DataFrame:
    """Overwrite by url, nulls too; created_at stays and updated_at becomes now."""
    stamped = batch.drop("created_at", "updated_at").withColumn("created_at", ts(now)).withColumn("updated_at", ts(now))
    return _merge(current, stamped, ["url"], {"created_at": F.col("o_created_at")})


def numbered_inserts(current: DataFrame, batch: DataFrame, top: int | None = None) -> DataFrame:
    """Batch rows with an id: new keys get ids above all stored ones, or above ``top``
    where ``current`` is a part of the table.

    Ids follow (feed_url, pos). New keys of one feed are numbered together and feeds
    get offsets, so no task numbers the whole batch.
    """
    from pyspark.sql import Window as W

    known = current.select("feed_url", "guid", F.col("id").alias("__old"))
    if top is None:
        top = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
    rows = batch.drop("id").join(known, ["feed_url", "guid"], "left")
    fresh = F.col("__old").isNull()
    sizes = rows.filter(fresh).groupBy("feed_url").agg(F.count("*").alias("__n"))
    # Feeds fall into 4096 groups by hash; offsets of groups and of feeds within them add up.
    sizes = sizes.withColumn("__g", F.pmod(F.xxhash64("feed_url"), F.lit(4096)))
    groups = sizes.groupBy("__g").agg(F.sum("__n").alias("__gn"))
    before = W.orderBy("__g").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("__g", F.coalesce(F.sum("__gn").over(before), F.lit(0)).alias("__go"))
    inner = W.partitionBy("__g").orderBy("feed_url").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("__fo", F.coalesce(F.sum("__n").over(inner), F.lit(0))).join(groups, "__g").select("feed_url", (F.col("__fo") + F.col("__go")).alias("__offset"))
    place = F.row_number().over(W.partitionBy("feed_url", "__new").orderBy("pos"))
    out = rows.withColumn("__new", fresh).withColumn("__place", place).join(offsets, "feed_url", "left")
    return out.withColumn("id", F.when(F.col("__new"), F.lit(top) + F.col("__offset") + F.col("__place")).otherwise(F.col("__old"))).drop("__old", "__new", "__place", "__offset")


def apply_errors(feeds: DataFrame, errors: DataFrame, now) -> DataFrame:
    """Count a failed fetch and note its message, for stored feeds only.

    errors(url, error) has one row for each URL.
    """
    e = errors.select("url", F.col("error").alias("__error"))
    hit = F.col("__error").isNotNull()
    return (
        feeds.join(e, "url", "left")
        .withColumn("error_count", F.when(hit, F.col("error_count") + 1).otherwise(F.col("error_count")))
        .withColumn("last_error", F.when(hit, F.col("__error")).otherwise(F.col("last_error")))
        .withColumn("last_fetch_time", F.when(hit, ts(now)).otherwise(F.col("last_fetch_time")))
        .select(*feeds.columns)
    )


def apply_not_modified(feeds: DataFrame, unchanged: DataFrame, now) -> DataFrame:
    """Note a fetch that found nothing new; error columns stay as they are."""
    u = unchanged.select("url").distinct().withColumn("__hit", F.lit(True))
    hit = F.col("__hit").isNotNull()
    rows = feeds.join(u, "url", "left")
    for c in ("last_fetch_time", "last_successful_fetch"):
        rows = rows.withColumn(c, F.when(hit, ts(now)).otherwise(F.col(c)))
    return rows.select(*feeds.columns)


def apply_success(feeds: DataFrame, fetched: DataFrame, now) -> DataFrame:
    """Take validators from the response, which may lack them, and clear errors.

    fetched(url, etag, last_modified) has one row for each URL.
    """
    f = fetched.select("url", F.coalesce("etag", F.lit("")).alias("__etag"), F.coalesce("last_modified", F.lit("")).alias("__modified"), F.lit(True).alias("__hit"))
    hit = F.col("__hit").isNotNull()
    new = {
        "etag": F.col("__etag"), "last_modified": F.col("__modified"), "error_count": F.lit(0), "last_error": F.lit(""),
        "last_fetch_time": ts(now), "last_successful_fetch": ts(now),
    }
    rows = feeds.join(f, "url", "left")
    return rows.select(*(F.when(hit, new[c]).otherwise(F.col(c)).cast(feeds.schema[c].dataType).alias(c) if c in new else F.col(c) for c in feeds.columns))
