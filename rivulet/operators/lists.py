"""Set operations on subscription lists: (feed_url, ordinal) DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def added(current: DataFrame, new: DataFrame, offset: int) -> DataFrame:
    """Union without repeats; a URL keeps its first place.

    New URLs come after the current ones, whose ordinals lie under ``offset``.
    """
    both = current.select("feed_url", "ordinal").unionByName(new.select("feed_url", (F.col("ordinal") + offset).alias("ordinal")))
    return both.groupBy("feed_url").agg(F.min("ordinal").alias("ordinal"))


def added_count(current: DataFrame, new: DataFrame) -> DataFrame:
    """How many input rows are not on the list; a repeated input row counts again."""
    return new.join(current.select("feed_url"), "feed_url", "left_anti").agg(F.count("*").alias("added"))


def duplicates(current: DataFrame, new: DataFrame) -> DataFrame:
    """Input rows already on the list, to warn about."""
    return new.join(current.select("feed_url"), "feed_url", "left_semi")


def removed(current: DataFrame, url: str) -> DataFrame:
    """The list without any copy of a URL."""
    return current.filter(F.col("feed_url") != url)
