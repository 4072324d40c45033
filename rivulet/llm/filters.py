"""Membership filters of bounded size, made and asked with DataFrame functions.

A filter is a table of bitmaps: a key's hash names a bit, and a row whose bit is not
set has a key that is not in the set. Such rows need no join, so whole texts of rows
that a join would leave alone stay where they are. A set bit proves nothing; what it
lets through is joined exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.storage import Scratch

#: Bits of one bitmap, as Spark's bitmap functions have them.
BITMAP = 1 << 15
#: Bits of a filter: sixteen a key between these bounds, so at most 32 MB are broadcast.
#: A larger set fills the filter, which then lets more rows through to the join.
LEAST, MOST = 1 << 20, 1 << 28


class KeyFilter:
    """Filter of the values of one column; a null key is not in the set."""

    def __init__(self, keys: DataFrame, column: str, scratch: Scratch, label: str = "filter") -> None:
        keys = keys.select(F.col(column).alias("key")).filter("key is not null")
        self.bits = LEAST
        while self.bits < min(16 * keys.count(), MOST):
            self.bits *= 2
        slot = self.slot(F.col("key"))
        self.table = scratch.write(
            keys.groupBy(F.floor(slot / BITMAP).alias("__bucket")).agg(F.bitmap_construct_agg(slot % BITMAP).alias("__bits")), label
        )

    def slot(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits))

    def mark(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """``rows`` with a flag: false where the key is not in the set."""
        marked = rows.withColumn("__slot", self.slot(key)).withColumn("__bucket", F.floor(F.col("__slot") / BITMAP))
        at = (F.col("__slot") % BITMAP).cast("int")
        byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
        hit = key.isNotNull() & F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))
        return marked.join(F.broadcast(self.table), "__bucket", "left").withColumn(name, hit).drop("__slot", "__bucket", "__bits")


def without_keys(rows: DataFrame, gone: DataFrame, key: Column, column: str, scratch: Scratch) -> DataFrame:
    """Rows whose key is not in ``column`` of ``gone``, which has no key twice.

    Only rows that the filter lets through are shuffled.
    """
    marked = KeyFilter(gone, column, scratch).mark(rows, key, "__maybe")
    asked = marked.filter("`__maybe`").withColumn("__key", key)
    left = asked.join(gone.select(F.col(column).alias("__key")), "__key", "left_anti").drop("__key")
    return marked.filter("not `__maybe`").unionByName(left).drop("__maybe")


def with_keys(rows: DataFrame, wanted: DataFrame, key: Column, column: str, scratch: Scratch) -> DataFrame:
    """Rows whose key is in ``column`` of ``wanted``."""
    asked = KeyFilter(wanted, column, scratch).mark(rows, key, "__maybe").filter("`__maybe`").drop("__maybe").withColumn("__key", key)
    return asked.join(wanted.select(F.col(column).alias("__key")), "__key", "left_semi").drop("__key")
