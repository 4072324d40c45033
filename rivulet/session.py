"""Spark session with the settings the plans assume."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch between Spark and Python; whole texts make rows large.
BATCH_BYTES = 4 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session bounded by bytes.

    Spark has the bound as a setting of the session alone; it is lowered only where it
    still has Spark's default, so a value that the user chose stays.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH_SETTING, str(_BATCH_DEFAULT)).rstrip("b")) == _BATCH_DEFAULT:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def get_spark(app: str = "rivulet", master: str | None = None, **conf: str) -> SparkSession:
    """Build or fetch a session: UTC, AQE with skew handling, Arrow.

    ``master`` is left to spark-submit unless given; extra settings override the
    defaults below (keys with dots go through ``**{"spark.x": "y"}``).
    """
    b = SparkSession.builder.appName(app)
    if master or os.environ.get("RIVULET_MASTER"):
        b = b.master(master or os.environ["RIVULET_MASTER"])
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
