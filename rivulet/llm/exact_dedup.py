"""Exact deduplication by a log-structured merge index of digests.

Only DataFrame functions run here. ``DigestIndex`` keeps, in the shared folder,
levels of sorted runs:

* *flush*: a batch of rows is a memtable. It is combined by digest and left as a run:
  Parquet sorted by digest, with a filter of its digests beside it.
* *compact*: when a level has ``FANOUT`` runs, they are merged into a run of the next
  level that holds, for each digest, the smallest identifier and the number of rows. The
  rows of a run go through the filters of the others: what no other run has stays in its
  task, and only possible hits are shuffled and combined.
* *lookup*: rows get the smallest identifier of their digest. A filter of the digests
  that more than one row has picks the *hits*, whose texts alone are shuffled and
  compared byte by byte. A digest that stands for several texts is split by text.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.filters import KeyFilter
from rivulet.llm.storage import Scratch, documents, join_counted, named_again, numbered_columns, remove

#: Fixed by the contract: runs of these bytes count as one space.
WHITE_SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Batches that a table is flushed in, and runs of a level that are merged.
MEMTABLES, FANOUT = 4, 2


def normalised(text: Column) -> Column:
    """The text that equality is judged on; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE_RUN, " ")


@dataclass
class Run:
    """A sorted run: one row for each digest, and the filter of them."""

    path: str
    scratch: Scratch
    filter: KeyFilter

    def drop(self) -> None:
        remove(self.scratch.spark, self.path)
        self.scratch.release()


class DigestIndex:
    """Levels of sorted digest runs below ``path``; ``levels[k]`` has the runs of level k."""

    SCHEMA = "digest binary, id bigint, n bigint"

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.fanout, self.made = spark, path, fanout, 0
        self.levels: list[list[Run]] = [[]]

    def read(self, run: Run) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(run.path)

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.path}/level={level}/run={self.made}"
        self.made += 1
        # Files are of any size, and so are their Bloom filters.
        bloom = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        rows.sortWithinPartitions("digest").write.options(**bloom).parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        own = Scratch(self.spark)
        self.levels[level].append(Run(path, own, KeyFilter(self.spark.read.schema(self.SCHEMA).parquet(path), "digest", own)))

    def flush(self, rows: DataFrame) -> None:
        """Add a batch of (digest, id, n) rows as a new run; full levels are merged."""
        self._write(_combined(rows.select("digest", "id", "n")), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._merge(self.levels[level], level + 1)
            self.levels[level] = []
            level += 1

    def _merge(self, runs: list[Run], level: int) -> None:
        """Merge runs into one of a level."""
        if len(runs) == 1:
            while len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(runs[0])
            return
        alone, shared = [], []
        for run in runs:
            rows = self.read(run).withColumn("hit", F.lit(False))
            for other in runs:
                if other is not run:
                    rows = other.filter.mark(rows, F.col("digest"), "here").withColumn("hit", F.col("hit") | F.col("here")).drop("here")
            alone.append(rows.filter("not hit").drop("hit"))
            shared.append(rows.filter("hit").drop("hit"))
        union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
        self._write(union([_combined(union(shared)), *alone]), level)
        for run in runs:
            run.drop()

    def compact(self) -> DataFrame:
        """Merge all runs there are into one of a new last level and return it."""
        runs = [run for level in self.levels for run in level]
        last = len(self.levels)
        self._merge(runs, last)
        self.levels = [[] for _ in range(last)] + [self.levels[last]]
        return self.read(self.levels[last][0])

    def find(self, digests: list[bytes]) -> DataFrame:
        """(digest, id, n) of those of a few digests that the index holds; Parquet skips
        files and row groups by statistics and Bloom filters."""
        runs = [self.read(run).filter(F.col("digest").isin(digests)) for level in self.levels for run in level]
        return _combined(functools.reduce(DataFrame.unionByName, runs))


def _combined(rows: DataFrame) -> DataFrame:
    """One row for each digest: a digest that a third of all rows share reaches the merge
    as one row a task."""
    return rows.groupBy("digest").agg(F.min("id").alias("id"), F.sum("n").alias("n"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Decide for every row which row of its group of equal texts stays.

    Returns one row for each input row: (id, keep_id, group_size, kept,
    text_sha256). The row with the smallest id of a group stays. A null text is an
    empty text, and empty texts are equal. Rows that repeat an id and its text share
    one decision and all count in group_size. A row without an id never stays while
    the group has an id; a group without any has keep_id null and stays. Other
    columns, whatever their names, are ignored. An empty table gives no rows; a very
    long text is one row like any other. ``path`` keeps the index for later use.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    flushed = scratch.write(rows.select("digest", "id"), "digests")
    index = DigestIndex(spark, path or scratch.path("digest-index"))
    batch, one = F.pmod(F.xxhash64("id"), F.lit(MEMTABLES)), F.lit(1).cast("bigint").alias("n")
    for k in range(MEMTABLES):
        index.flush(flushed.filter(batch == k).select("digest", "id", one))
    repeated = index.compact().filter("n > 1").select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    found = join_counted(flushed.select("digest", "id"), repeated, "digest", "group_size", flushed.count())
    # A digest that one row has keeps that row.
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id")
    found = found.select("digest", "id", keep_id, F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"))

    # Hits: texts whose digest the level's filter knows as repeated meet by their bytes.
    hits = KeyFilter(repeated, "digest", scratch).mark(rows, F.col("digest"), "hit").filter("hit")
    classes = hits.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    collided = scratch.write(classes.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"), "collided")
    if not collided.isEmpty():
        split = rows.join(collided, "digest", "left_semi").join(classes, ["digest", "norm"]).select(*found.columns)
        found = found.join(collided, "digest", "left_anti").unionByName(split)
    kept = F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")
    decisions = scratch.finish(found.select(F.col("id").alias(id_col), "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256")), "decisions")
    for run in (run for level in index.levels for run in level):
        run.scratch.release()
    return decisions


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns whatever their names.

    Rows that repeat an id and a text stay together; so do rows without an id whose
    group has none.
    """
    own = numbered_columns(docs)
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    decided = exact_duplicates(own, key, text).filter("not kept")
    gone = decided.select(F.col(key).alias("gone"), F.col("text_sha256").alias("digest")).distinct()
    # Ids alone pass most rows; what is left is told by id and digest, since an id may be repeated with other texts.
    ids = KeyFilter(gone.select(F.coalesce(F.col("gone"), F.lit(-1)).alias("gone")), "gone", Scratch(docs.sparkSession))
    marked = ids.mark(own, F.coalesce(F.col(key).cast("bigint"), F.lit(-1)), "maybe")
    asked = marked.filter("maybe").withColumn("sha", F.sha2(normalised(F.col(text)), 256))
    left = asked.join(gone, asked[key].cast("bigint").eqNullSafe(gone["gone"]) & (asked["sha"] == gone["digest"]), "left_anti").drop("sha")
    return named_again(marked.filter("not maybe").unionByName(left), docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision for each row of ``documents``."""
    return exact_duplicates(documents(spark, sf_dir))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
