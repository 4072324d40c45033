"""Continuous ingest: each micro-batch of responses is merged as one fetch.

What has been merged is in the archive's tables, so a batch that is replayed after a
failure merges to the same keys. Responses that carry the time they were given at go
through event-time state first: for each feed the newest time and the versions seen
since are known, and what is late or comes again is put aside instead of merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rivulet import schema
from rivulet.plans import ingest
from rivulet.plans.commands import utc_now
from rivulet.sources.store import Store
from rivulet.streaming.release import use_state

#: Responses with the time at which the host gave them.
TIMED = f"{schema.RESPONSES}, responded_at timestamp"
JUDGED = f"{TIMED}, verdict string"


def read_responses(spark: SparkSession, path: str, timed: bool = False) -> DataFrame:
    """Responses that arrive as Parquet files in a folder."""
    return spark.readStream.schema(TIMED if timed else schema.RESPONSES).parquet(path)


def version(row) -> str:
    """What tells one answer of a feed from another: its ETag, else its content."""
    body = hashlib.sha256((row.body or "").encode()).hexdigest()
    return f"{row.status} {row.etag}" if row.etag else f"{row.status} {body}"


class Judge(StatefulProcessor):
    """Adds ``verdict`` to the responses of a feed: new, late or duplicate.

    Late is what was given before the newest response so far. A duplicate is the version
    that the feed has already; if another came in between it is new again. Failed
    responses have no version; they are new or late. The state is one row a feed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "at timestamp, version string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["responded_at", "ordinal"], kind="stable")
        at, last = self.newest.get() if self.newest.exists() else (None, None)
        at = None if at is None else pd.Timestamp(at)
        verdicts = []
        for r in batch.itertuples(index=False):
            when, own = pd.Timestamp(r.responded_at), version(r) if r.status in (200, 304) else None
            if own is not None and own == last:
                verdicts.append("duplicate")
            elif at is not None and when <= at:
                verdicts.append("late")
                continue
            else:
                verdicts.append("new")
                last = own or last
            at = when if at is None or when > at else at
        if at is not None:
            self.newest.update((at.to_pydatetime(), last))
        yield batch.assign(verdict=verdicts)[[c.split()[0] for c in JUDGED.split(", ")]]

    def close(self) -> None:
        pass


def judged(responses: DataFrame) -> DataFrame:
    """A stream of ``TIMED`` rows with their verdict; those without a feed or time are left out."""
    use_state(responses.sparkSession)
    rows = responses.select(*[c.split()[0] for c in TIMED.split(", ")]).filter("feed_url is not null and responded_at is not null")
    return rows.groupBy("feed_url").transformWithStateInPandas(Judge(), JUDGED, "append", "None")


def with_late(responses: DataFrame, arrival: str) -> DataFrame:
    """A table of responses with ``late``: whether one of the same feed that was given no
    earlier had arrived before. ``arrival`` orders the rows of a feed."""
    before = W.partitionBy("feed_url").orderBy(arrival).rowsBetween(W.unboundedPreceding, -1)
    return responses.withColumn("late", F.coalesce(F.col("responded_at") <= F.max("responded_at").over(before), F.lit(False)))


def put_aside(store: Store) -> DataFrame:
    """Responses that were late or came again, with the stream and batch they came in."""
    path = f"{store.path}/landing/aside"
    fs, p = store._fs(path)
    types = f"{JUDGED}, stream string, batch bigint"
    if not fs.exists(p):
        return store.spark.createDataFrame([], types)
    return store.spark.read.schema(types).parquet(path)


def counters(store: Store) -> dict[str, int]:
    """How many responses have been put aside, by verdict."""
    return {r.verdict: r["count"] for r in put_aside(store).groupBy("verdict").count().collect()}


def start(responses: DataFrame, store: Store, checkpoint: str, max_items: int = ingest.MAX_ITEMS, now=utc_now, trigger: dict | None = None) -> StreamingQuery:
    """Merge responses into the archive until stopped (by default: all that is there).

    A feed that comes several times in one micro-batch counts with its last response: the
    latest, where responses are timed (column ``responded_at``), else that with the
    highest ordinal. Streams with checkpoints of their own may share an archive.
    """
    timed = "responded_at" in responses.columns
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        at: datetime = now()
        landed = f"{store.path}/landing/stream-{stream}-{batch_id}"
        spark = batch.sparkSession
        if timed:
            # Written once: state must not be asked again for each use.
            batch.write.mode("overwrite").parquet(f"{landed}-judged")
            batch = spark.read.schema(JUDGED).parquet(f"{landed}-judged")
            aside = f"{store.path}/landing/aside/stream={stream}/batch={batch_id}"
            batch.filter("verdict <> 'new'").write.mode("overwrite").parquet(aside)
            batch = batch.filter("verdict = 'new'").drop("verdict")
        names = [c.split()[0] for c in schema.RESPONSES.split(", ")]
        order = F.struct(F.col("responded_at"), F.col("ordinal")) if timed else F.col("ordinal")
        newest = batch.groupBy("feed_url").agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*").select(*names)
        newest.write.mode("overwrite").parquet(landed)
        rows = spark.read.schema(schema.RESPONSES).parquet(landed)
        store.open()
        merged, buckets = ingest.fetch_into(store, rows, at, max_items, f"{landed}-parsed")
        if buckets["feeds"]:
            store.commit({"feeds": merged.feeds, "items": merged.items}, buckets)

    rows = judged(responses) if timed else responses
    return rows.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
