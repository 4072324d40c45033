"""Shared scratch space for tables that cut lineage, and what operators need of a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.session import bounded_batches


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the session runs in one process (tests, single-machine
    use) is a folder of this machine made and set; on a cluster that is an error, as
    executors and driver would see different disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        ref = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = ref.get() if ref.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="rivulet-checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system API."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one computation in the shared folder.

    Writing a table and reading it back cuts the lineage there, and what executors have
    computed survives their loss. ``release`` deletes all tables made so far but those
    still needed, once what was derived from them has been written.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def path(self, label: str) -> str:
        found = fresh_path(self.spark, label)
        self.paths[found] = label
        return found

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, *labels: str) -> None:
        """Delete the tables of these labels, or all."""
        for path in [p for p, label in self.paths.items() if not labels or label in labels]:
            remove(self.spark, path)
            del self.paths[path]

    def finish(self, df: DataFrame, label: str) -> DataFrame:
        """Write the result, delete every other table and return it."""
        old = list(self.paths)
        out = self.write(df, label)
        for path in old:
            remove(self.spark, path)
            del self.paths[path]
        return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table of a data folder."""
    return bounded_batches(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def numbered_columns(df: DataFrame, prefix: str = "c") -> DataFrame:
    """``df`` with its columns named by place, so that no name of the caller's clashes."""
    return df.select(*(F.col(f"`{name}`").alias(f"{prefix}{k}") for k, name in enumerate(df.columns)))


def named_again(df: DataFrame, names: list[str], prefix: str = "c") -> DataFrame:
    """The columns of ``numbered_columns`` under their names."""
    return df.select(*(F.col(f"{prefix}{k}").alias(name) for k, name in enumerate(names)))


#: Shares of all rows from which a key counts as hot; so there are at most so many hot keys.
HOT_KEYS = 1000


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``keyed`` (one row a key, which has ``count`` rows).

    Keys that over a thousandth of the ``total`` rows have are at most a thousand, so
    they are broadcast whatever the size of the data; of any other key a task gets
    under a thousandth of the rows.
    """
    hot = keyed.filter(F.col(count) * HOT_KEYS > total)
    here = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    first = rows.join(here, key, "left")
    names = [c for c in keyed.columns if c != key]
    cold = first.filter("`__hot` is null").drop("__hot", *names).join(keyed.filter(F.col(count) * HOT_KEYS <= total), key, "left")
    return first.filter("`__hot` is not null").drop("__hot").unionByName(cold)
