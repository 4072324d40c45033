"""Feeds and file trees as Spark data sources.

``spark.read.format("feed")`` and ``spark.readStream.format("feed")`` fetch the URLs of a
subscription list; a partition has whole hosts. ``df.write.format("files")`` writes one
file a row: tasks stage their files, and only a commit of all tasks moves them to their
names. ``register`` makes both known to a session.
"""

from __future__ import annotations

import heapq
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from rivulet.session import BATCH_BYTES
from rivulet.sources import feeds, opml

#: What a fetch brings (see ``schema.RESPONSES``), and the host that was asked.
RESPONSES = "feed_url string, ordinal int, status int, etag string, last_modified string, body string, error string, host string"
_ROWS = pa.schema([(n, pa.int32() if t == "int" else pa.string()) for n, t in (c.split() for c in RESPONSES.split(", "))])
CONCURRENCY = 32
#: Responses of an Arrow batch at most; bodies are bounded by ``BATCH_BYTES`` besides.
BATCH_ROWS = 1024


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """(file system, path in it) of a path or URI."""
    if "://" not in path and not path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(path)


def as_url(path: str) -> str:
    """The path of a file as a URL that a list may have; a URI stays as it is."""
    return path if "://" in path or path.startswith("file:") else PurePosixPath(os.path.abspath(path)).as_uri()


def read_text(path: str) -> str:
    own, at = file_system(path)
    with own.open_input_stream(at) as f:
        return f.read().decode()


def host_of(url: str) -> str:
    try:
        return urlsplit(url).netloc.lower()
    except ValueError:
        return ""


@dataclass
class Hosts(InputPartition):
    """All URLs of some hosts, in list order: (ordinal, url)."""

    urls: list[tuple[int, str]]


def by_host(urls: list[tuple[int, str]], concurrency: int) -> list[Hosts]:
    """Whole hosts dealt to partitions, those with most URLs first, each to the emptiest.
    A URL without a host (a file) stands for itself."""
    hosts: dict[str, list[tuple[int, str]]] = {}
    for ordinal, url in urls:
        hosts.setdefault(host_of(url) or url, []).append((ordinal, url))
    heap = [(0, k, []) for k in range(min(concurrency, len(hosts)))]
    for _, own in sorted(hosts.items(), key=lambda h: (-len(h[1]), h[0])):
        size, k, held = heapq.heappop(heap)
        held.extend(own)
        heapq.heappush(heap, (size + len(own), k, held))
    return [Hosts(sorted(held)) for _, _, held in sorted(heap, key=lambda p: p[1])]


class _Fetching:
    """Options of the source, its list and the requests of a partition."""

    def __init__(self, options: dict) -> None:
        self.list = options.get("list") or options.get("path")
        if not self.list:
            raise ValueError("the feed source needs the option list: a file of URLs")
        self.format = options.get("format") or opml.detect_format(self.list)
        self.concurrency = max(1, int(options.get("concurrency", CONCURRENCY)))
        self.timeout = float(options.get("timeout", feeds.TIMEOUT))
        self.validators = options.get("validators")
        self.files = str(options.get("files", "false")).lower() == "true"

    def urls(self) -> list[str]:
        text = read_text(self.list)
        return opml.parse_opml(text) if self.format == "opml" else opml.parse_text_list(text)

    def known(self, urls: list[str]) -> dict[str, tuple[str, str]]:
        """Validators of the URLs, from a Parquet folder with url, etag and last_modified."""
        if not self.validators:
            return {}
        import pyarrow.dataset as ds

        own, at = file_system(self.validators)
        rows = ds.dataset(at, filesystem=own, format="parquet").to_table(columns=["url", "etag", "last_modified"], filter=ds.field("url").isin(urls))
        return {r["url"]: (r["etag"] or "", r["last_modified"] or "") for r in rows.to_pylist()}

    def read(self, partition: Hosts) -> Iterator[pa.RecordBatch]:
        """Responses in batches of some megabytes; Spark would gather ten thousand rows."""
        known, rows, size = self.known([u for _, u in partition.urls]), [], 0
        for ordinal, url in partition.urls:
            got = feeds.get(url, *known.get(url, ("", "")), timeout=self.timeout, files=self.files)
            rows.append({"feed_url": url, "ordinal": ordinal, "host": host_of(url)} | got)
            size += len(got["body"] or "")
            if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)


class FeedReader(_Fetching, DataSourceReader):
    """One fetch of the list. Filters on feed_url or host decide what is requested."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute in (("feed_url",), ("host",)):
                self.pushed.append(f)
            else:
                yield f

    def wanted(self, url: str) -> bool:
        for f in self.pushed:
            value = url if f.attribute == ("feed_url",) else host_of(url)
            if isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value or isinstance(f, StringStartsWith) and not value.startswith(f.value):
                return False
        return True

    def partitions(self) -> list[Hosts]:
        return by_host([(k, u) for k, u in enumerate(self.urls()) if self.wanted(u)], self.concurrency)


class FeedStreamReader(_Fetching, DataSourceStreamReader):
    """URLs that a growing list has got, and with ``every`` (seconds) all again each period.

    An offset is how many URLs the list had and the period's number, so a query that is
    started again from its checkpoint asks only for what has come since. A batch that is
    planned but not committed is fetched again.
    """

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.every = float(options.get("every", 0))

    def initialOffset(self) -> dict:
        return {"listed": 0, "period": 0}

    def latestOffset(self) -> dict:
        return {"listed": len(self.urls()), "period": int(time.time() // self.every) if self.every else 0}

    def partitions(self, start: dict, end: dict) -> list[Hosts]:
        first = 0 if end["period"] > start["period"] else start["listed"]
        return by_host(list(enumerate(self.urls()))[first : end["listed"]], self.concurrency)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class FeedSource(DataSource):
    """Options: ``list`` (text or OPML file of URLs), ``format``, ``concurrency`` (partitions
    at most), ``timeout`` (seconds), ``validators`` (Parquet folder with url, etag and
    last_modified: requests are then conditional), ``every`` (streams), ``files`` (true
    lets ``file:`` URLs be read)."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return RESPONSES

    def reader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))

    def streamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(dict(self.options))


@dataclass
class Staged(WriterCommitMessage):
    """What one task has written, below the job's staging folder."""

    folder: str
    names: list[str]


class FileTreeWriter(DataSourceWriter):
    """Rows (path, body) as files below a folder, in two phases.

    A task writes to a folder of its own attempt; the driver moves the files of the
    attempts that Spark has committed and deletes the rest. A name that two tasks write
    is an error before anything is moved.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.root, self.overwrite = options["path"], overwrite
        self.staging = f".staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Staged:
        own, root = file_system(self.root)
        folder, names, made = f"{self.staging}/{uuid.uuid4().hex}", [], set()
        for row in rows:
            name = PurePosixPath(row["path"])
            if name.is_absolute() or ".." in name.parts or not name.parts:
                raise ValueError(f"not a path below the folder: {row['path']!r}")
            to = PurePosixPath(root, folder, name)
            if to.parent not in made:
                own.create_dir(str(to.parent), recursive=True)
                made.add(to.parent)
            with own.open_output_stream(str(to)) as f:
                f.write((row["body"] or "").encode())
            names.append(str(name))
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        own, root = file_system(self.root)
        staged = [m for m in messages if m is not None]
        names = [n for m in staged for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have one path")
        own.create_dir(root, recursive=True)
        if self.overwrite:
            kept = set(names)
            for info in own.get_file_info(arrow_fs.FileSelector(root, recursive=True)):
                name = info.path.removeprefix(f"{root}/")
                if info.type == arrow_fs.FileType.File and name not in kept and not name.startswith(".staging-"):
                    own.delete_file(info.path)
        for folder in {str(PurePosixPath(root, n).parent) for n in names}:
            own.create_dir(folder, recursive=True)
        for m in staged:
            for n in m.names:
                own.move(f"{root}/{m.folder}/{n}", f"{root}/{n}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        own, root = file_system(self.root)
        if own.get_file_info(f"{root}/{self.staging}").type == arrow_fs.FileType.Directory:
            own.delete_dir(f"{root}/{self.staging}")


class FileTree(DataSource):
    """Write only: ``path`` (string) and ``body`` (string) of each file. Mode append adds to
    a folder and replaces files of the same name; overwrite also deletes all others."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "path string, body string"

    def writer(self, schema, overwrite: bool) -> FileTreeWriter:
        return FileTreeWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make the formats ``feed`` and ``files`` known to the session, which then also lets
    sources written in Python take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)
    spark.dataSource.register(FileTree)
    return spark
