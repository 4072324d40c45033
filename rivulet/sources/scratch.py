"""Folders that driver and executors share, for what a plan writes before it is used."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, one process may use a
    temporary folder of its own, and a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    ref = spark.sparkContext._jsc.sc().getCheckpointDir()
    if ref.isDefined():
        return ref.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = "file://" + tempfile.mkdtemp(prefix="rivulet-shared-")
    spark.sparkContext.setCheckpointDir(found)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Paths given out in this process that have not been deleted.
_held: list[str] = []


def fresh(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    _held.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _held[-1]


def release(spark: SparkSession) -> int:
    """Delete what has been written below paths given out, once results are written;
    returns how many paths there were."""
    many = len(_held)
    while _held:
        p = spark._jvm.org.apache.hadoop.fs.Path(_held.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return many


def landed(df: DataFrame, path: str) -> DataFrame:
    """``df`` as written to ``path``: computed once, and not lost with an executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
