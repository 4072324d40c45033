"""Results of a concurrent fetch, released in the order of its list.

Workers finish in any order; a result is held back until all before it are there, so a
log or a page that follows the stream shows feeds in list order with a percentage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rivulet.operators.ordering import with_running

#: One finished request; ``total`` is the length of the run's list.
RESULTS = "run string, ordinal int, total int, url string, cached boolean, error string, item_count bigint"
RELEASED = f"{RESULTS}, completed int, percent int"
_COLUMNS = [c.split()[0] for c in RESULTS.split(", ")]


def use_state(spark: SparkSession) -> None:
    """Stateful processors need the state store on disk, which also bounds their memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """A reorder buffer for each run: the next ordinal, and results that came too early.

    A result that comes again, or whose place has been released, is dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "ordinal int")
        self.early = handle.getMapState("early", "ordinal int", ", ".join(RESULTS.split(", ")[2:]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else 0
        got: dict[int, tuple] = {}
        for batch in rows:
            for r in batch[_COLUMNS].astype(object).where(batch[_COLUMNS].notna(), None).itertuples(index=False):
                if r.ordinal >= at:
                    got.setdefault(int(r.ordinal), tuple(r[2:]))
        out = []
        while True:
            if at in got:
                row = got.pop(at)
            elif self.early.containsKey((at,)):
                row = tuple(self.early.getValue((at,)))
                self.early.removeKey((at,))
            else:
                break
            at += 1
            total = int(row[0])
            out.append((key[0], at - 1, total, *row[1:], at, at * 100 // total))
        for ordinal, row in got.items():
            if not self.early.containsKey((ordinal,)):
                self.early.updateValue((ordinal,), (int(row[0]), row[1], None if row[2] is None else bool(row[2]), row[3], None if row[4] is None else int(row[4])))
        self.next.update((at,))
        if out:
            yield pd.DataFrame(out, columns=[*_COLUMNS, "completed", "percent"])

    def close(self) -> None:
        pass


def in_order(results: DataFrame) -> DataFrame:
    """A stream of ``RESULTS`` as ``RELEASED`` rows; within a run, ordinals rise without a gap.

    What is held back is a run's results after the first that is still missing. Rows
    without a run or ordinal are left out.
    """
    use_state(results.sparkSession)
    rows = results.select(*_COLUMNS).filter("run is not null and ordinal >= 0 and total > ordinal")
    return rows.groupBy("run").transformWithStateInPandas(InOrder(), RELEASED, "append", "None")


def release_times(results: DataFrame, order: list[Column], arrival: str, name: str = "release_at") -> DataFrame:
    """The same for results that are all there: when each was released, which is when the
    last of those up to its place had arrived; with ``completed`` and ``percent``."""
    total = results.count()
    timed = with_running(results, order, F.col(arrival), name, "max")
    counted = with_running(timed, order, F.lit(1).cast("bigint"), "completed")
    return counted.withColumn("percent", F.floor(F.col("completed") * 100 / max(total, 1)).cast("int"))


def progress_line(width: int = 1) -> Column:
    """One line of text for a released result."""
    kind = F.when(F.col("error").isNotNull(), "failed").when(F.col("cached"), "cached").otherwise("fetched")
    count = F.concat(F.lpad(F.col("completed").cast("string"), width, " "), F.lit("/"), F.col("total").cast("string"))
    note = F.when(F.col("error").isNotNull(), F.concat(F.lit(": "), "error")).when(F.col("cached"), "").otherwise(F.concat(F.lit(", "), F.col("item_count").cast("string"), F.lit(" items")))
    return F.concat(F.lpad(F.col("percent").cast("string"), 3, " "), F.lit("% "), count, F.lit(" "), kind, F.lit(" "), "url", note)
