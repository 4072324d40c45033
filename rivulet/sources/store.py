"""The archive as versioned Parquet snapshots.

Spark cannot overwrite what it reads, so a change writes new directories and then a new
manifest that names them. Manifests are numbered and never replaced: the newest one
counts, a crash leaves the one before, and of two writers that started from the same
manifest the second fails. Tables are divided into buckets by a hash of their first
key, and a change rewrites only the buckets it touches. All paths go through Hadoop's
file system API.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet import schema
from rivulet.functions.scalars import backfilled_first_seen
from rivulet.operators import incremental
from rivulet.sources.scratch import landed

#: Forward-only versions: 2 item archive columns, 3 link metadata, 4 first_seen.
MIGRATIONS = (1, 2, 3, 4)
VERSION = max(MIGRATIONS)
#: Buckets of a new archive's tables; kept in its manifest.
BUCKETS = 64
#: Column that a snapshot is divided by; bytes of a file that compaction aims at.
BUCKET, FILE_BYTES = "__bucket", 128 << 20
#: How long what a command has landed may still be in use, and what is no such thing.
LANDING_LIFE, KEPT_LANDING = timedelta(hours=24), ("robots", "aside")
_MANIFEST = re.compile(r"manifest-(\d{10})\.json$")


class Conflict(RuntimeError):
    """Another writer has committed since the manifest was read."""


@dataclass
class Store:
    """Tables below ``path``; the manifest names the directory of each bucket."""

    spark: SparkSession
    path: str
    manifest: dict = field(default_factory=dict)

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _newest(self) -> int:
        """Number of the newest manifest; 0 is an unnumbered one, -1 none."""
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return -1
        names = [status.getPath().getName() for status in fs.listStatus(p)]
        return max([int(m[1]) for n in names if (m := _MANIFEST.match(n))], default=0 if "manifest.json" in names else -1)

    def exists(self) -> bool:
        return self._newest() >= 0

    def open(self) -> Store:
        """Read the newest manifest and bring older archives up to date."""
        number = self._newest()
        if number < 0:
            raise FileNotFoundError(f"no archive at {self.path}")
        name = f"manifest-{number:010d}.json" if number else "manifest.json"
        self.manifest = json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/{name}").collect()))
        self.manifest["number"] = number
        if self.manifest["version"] < VERSION:
            self.migrate()
        return self

    def init(self) -> Store:
        """Make an empty archive; an existing one is opened."""
        if self.exists():
            return self.open()
        self.manifest = {"version": VERSION, "tables": {}, "applied": {}, "buckets": BUCKETS}
        self.commit({n: self.spark.createDataFrame([], s) for n, s in schema.TABLES.items()})
        return self

    def _save(self) -> None:
        """Add the next manifest: written aside, then renamed to a name that must be free."""
        jvm = self.spark._jvm
        temporary = f"{self.path}/manifest-{uuid.uuid4().hex}.tmp"
        fs, p = self._fs(temporary)
        number = self.manifest.get("number", 0) + 1
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(self.manifest | {"number": number}, indent=1, default=str).encode()))
        out.close()
        _, target = self._fs(f"{self.path}/manifest-{number:010d}.json")
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), self.spark._jsc.hadoopConfiguration()).rename(
                fs.makeQualified(p), fs.makeQualified(target), options
            )
        except Exception as error:
            fs.delete(p, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"{self.path}: manifest {number} is there already; open the archive again") from None
            raise
        self.manifest["number"] = number

    @property
    def buckets(self) -> int:
        return self.manifest.get("buckets", BUCKETS)

    def bucket(self, key: str | Column) -> Column:
        """Bucket of a feed's URL (items, feeds) or a link (metadata)."""
        return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """Buckets that the keys of some rows fall into."""
        return sorted(r[0] for r in rows.select(self.bucket(key)).distinct().collect())

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or those of its buckets alone."""
        return self.read(self.manifest["tables"], name, buckets)

    def read(self, tables: dict, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table as a manifest's ``tables`` name it."""
        types, held = schema.STORED[name], tables.get(name, {})
        if isinstance(held, str):  # of an archive before there were buckets
            rows = self.spark.read.schema(types).parquet(f"{self.path}/{held}")
            return rows if buckets is None else rows.filter(self.bucket(schema.KEYS[name][0]).isin(buckets))
        found = [held[str(b)] for b in (range(self.buckets) if buckets is None else buckets) if str(b) in held]
        if not found:
            return self.spark.createDataFrame([], types)
        return self.spark.read.schema(types).parquet(*(f"{self.path}/{p}" for p in found))

    def landed(self, rows: DataFrame) -> DataFrame:
        """``rows`` as written to the archive's landing folder."""
        return landed(rows, f"{self.path}/landing/change-{uuid.uuid4().hex}")

    def part(self, feed_buckets: list[int]) -> Part:
        """The feeds and items of some buckets, for a merge that touches no others."""
        return Part(self.table("feeds", feed_buckets), self.table("items", feed_buckets), self.next_id)

    @property
    def next_id(self) -> int:
        """The largest item id in use; one column of the whole table is read."""
        return self.items.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top

    @property
    def feeds(self) -> DataFrame:
        return self.table("feeds")

    @property
    def items(self) -> DataFrame:
        return self.table("items")

    @property
    def url_metadata(self) -> DataFrame:
        return self.table("url_metadata")

    def commit(self, tables: dict[str, DataFrame], buckets: dict[str, list[int]] | None = None, same_rows: bool = False) -> None:
        """Replace tables together, or of each the ``buckets`` named for it.

        Summaries that the archive has follow, unless the tables hold the same rows as
        before.
        """
        copy = lambda: {n: dict(h) if isinstance(h, dict) else h for n, h in self.manifest.get("tables", {}).items()}
        before, held, changed = copy(), copy(), {}
        for name, df in tables.items():
            only = None if buckets is None else buckets.get(name)
            if only != []:
                self.put(held, name, df, only)
                changed[name] = only
        if "feed_counts" in before and not same_rows:
            incremental.carry(self, before, held, changed)
        self.manifest["tables"] = held
        self._save()

    def put(self, held: dict, name: str, df: DataFrame, only: list[int] | None = None) -> None:
        """Write a table, or some buckets of it, and name the new directories in ``held``.

        A bucket's rows are sorted by key (items by feed and date), so that file
        statistics let scans of one feed or period skip files and row groups. Rows go to
        files by ranges, so a bucket with one large feed is many files.
        """
        types = {c.split()[0]: c.split()[1] for c in schema.STORED[name].split(", ")}
        df = df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()))
        if only is not None and isinstance(held.get(name), str):
            df, only = df.unionByName(self.read(held, name).filter(~self.bucket(schema.KEYS[name][0]).isin(only))), None
        order = [BUCKET, schema.KEYS[name][0], *(["published_date"] if name == "items" else [])]
        rows = df.withColumn(BUCKET, self.bucket(schema.KEYS[name][0]))
        snapshot = f"{name}/snapshot={uuid.uuid4().hex}"
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(BUCKET).parquet(f"{self.path}/{snapshot}")
        fs, p = self._fs(f"{self.path}/{snapshot}")
        names = [status.getPath().getName() for status in fs.listStatus(p)]
        made = {n.split("=")[1]: f"{snapshot}/{n}" for n in names if n.startswith(f"{BUCKET}=")}
        old = held.get(name, {}) if only is not None else {}
        held[name] = {b: d for b, d in old.items() if int(b) not in only} | made if only is not None else made

    def summarise(self) -> None:
        """Make the summaries of all rows; from then on merges keep them."""
        links = self.landed(incremental.link_feeds(self.items))
        made = {"feed_counts": incremental.feed_counts(self.items), "link_feeds": links, "icon_votes": incremental.icon_votes(links, self.url_metadata)}
        self.commit(made, same_rows=True)

    @property
    def summarised(self) -> bool:
        return "feed_counts" in self.manifest["tables"]

    def _used(self) -> set[str]:
        held = self.manifest["tables"].values()
        return {d for h in held for d in (h.values() if isinstance(h, dict) else [h])}

    def versions(self) -> DataFrame:
        """(version, applied_at) of every migration that the manifests tell of."""
        applied = [(int(v), str(at)) for v, at in self.manifest.get("applied", {}).items()]
        if str(self.manifest["version"]) not in self.manifest.get("applied", {}):
            applied.append((self.manifest["version"], None))
        rows = self.spark.createDataFrame(applied, "version bigint, at string")
        return rows.select("version", F.col("at").cast("timestamp_ntz").alias("applied_at"))

    def clear_landing(self, older_than: timedelta = LANDING_LIFE) -> int:
        """Delete what finished commands have landed, and robots answers that no longer
        count; what is put aside stays. Returns how many folders went."""
        gone = 0
        before = time.time() - older_than.total_seconds()
        for folder in ("landing", "landing/robots"):
            fs, p = self._fs(f"{self.path}/{folder}")
            for status in fs.listStatus(p) if fs.exists(p) else []:
                if status.getPath().getName() not in KEPT_LANDING and status.getModificationTime() / 1000 <= before:
                    gone += fs.delete(status.getPath(), True)
        return gone

    def vacuum(self, landing_life: timedelta = LANDING_LIFE) -> None:
        """Join small files, and delete what the newest manifest no longer names, and what
        has stood in ``landing`` for longer than any command takes."""
        self.compact()
        self.clear_landing(landing_life)
        used = self._used()
        for name in schema.STORED:
            fs, p = self._fs(f"{self.path}/{name}")
            for snapshot in fs.listStatus(p) if fs.exists(p) else []:
                at = f"{name}/{snapshot.getPath().getName()}"
                kept = [d for d in used if d == at or d.startswith(f"{at}/")]
                if not kept:
                    fs.delete(snapshot.getPath(), True)
                elif at not in kept:
                    for bucket in fs.listStatus(snapshot.getPath()):
                        if f"{at}/{bucket.getPath().getName()}" not in kept:
                            fs.delete(bucket.getPath(), True)
        fs, p = self._fs(self.path)
        for status in fs.listStatus(p):
            m = _MANIFEST.match(status.getPath().getName())
            if (m and int(m[1]) < self.manifest["number"]) or status.getPath().getName().endswith(".tmp"):
                fs.delete(status.getPath(), False)

    def compact(self, file_bytes: int = FILE_BYTES) -> dict[str, list[int]]:
        """Rewrite buckets that have more files than their bytes need; returns them."""
        found: dict[str, list[int]] = {}
        for name, held in self.manifest["tables"].items():
            for bucket, at in held.items() if isinstance(held, dict) else ():
                fs, p = self._fs(f"{self.path}/{at}")
                sizes = [s.getLen() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]
                if len(sizes) > max(1, -(-sum(sizes) // file_bytes)):
                    found.setdefault(name, []).append(int(bucket))
        if found:
            self.commit({n: self.table(n, b) for n, b in found.items()}, found, same_rows=True)
        return found

    def migrate(self, now: datetime | None = None) -> None:
        """Bring the tables to the current version, once for each version."""
        now = now or datetime.utcnow()
        version = self.manifest["version"]
        self.manifest.setdefault("buckets", BUCKETS)
        read = lambda n: self.spark.read.parquet(f"{self.path}/{self.manifest['tables'][n]}")
        changed = {}
        if version < 2:
            feeds = read("feeds")
            changed["feeds"] = feeds if "latest_item_date" in feeds.columns else feeds.withColumn("latest_item_date", F.lit(None).cast("timestamp_ntz"))
        if version < 3 and "url_metadata" not in self.manifest["tables"]:
            changed["url_metadata"] = self.spark.createDataFrame([], schema.URL_METADATA)
        if version < 4:
            changed |= migrate_first_seen(changed.get("feeds", read("feeds")), read("items"), now)
        self.manifest["version"] = VERSION
        self.manifest.setdefault("applied", {})[str(VERSION)] = now.isoformat()
        self.commit(changed)


@dataclass
class Part:
    """Some buckets of feeds and items, and the largest item id of the whole archive."""

    feeds: DataFrame
    items: DataFrame
    top_id: int


def migrate_first_seen(feeds: DataFrame, items: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """Fill first_seen where it is missing, and take latest dates from it."""
    from rivulet.operators.relations import latest_by_first_seen

    if "first_seen" not in items.columns:
        items = items.withColumn("first_seen", F.lit(None).cast("timestamp_ntz"))
    filled = items.withColumn("first_seen", F.coalesce("first_seen", backfilled_first_seen("published_date", now)))
    return {"items": filled, "feeds": latest_by_first_seen(feeds, filled)}
