"""Running totals over a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rivulet.sources.scratch import fresh, landed


def with_running(rows: DataFrame, order: list[Column], value: Column, name: str, how: str = "sum") -> DataFrame:
    """``rows`` with the running sum (or, ``how`` "max", maximum) of ``value`` up to each row.

    Rows are dealt to tasks by ranges of the order and written once, so that each range
    keeps its rows; what the ranges before it come to, a number a range, is then added.
    The order must be total. An empty table gives no rows.
    """
    total = {"sum": F.sum, "max": F.max}[how]
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("__value", value).repartitionByRange(many, *order).withColumn("__range", F.spark_partition_id())
    placed = landed(ranged, fresh(rows.sparkSession, "ranges"))
    own = total("__value").over(W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ranges = placed.groupBy("__range").agg(total("__value").alias("__all")).select("__range", total("__all").over(before).alias("__before"))
    both = placed.withColumn("__own", own).join(F.broadcast(ranges), "__range")
    running = F.coalesce("__before", F.lit(0)) + F.col("__own") if how == "sum" else F.greatest("__before", "__own")
    return both.withColumn(name, running).drop("__value", "__range", "__own", "__before")
