"""Shuffling numeric records as packed arrays.

A task packs its records by hash bucket: one row holds all that goes from one flush to
one bucket, as raw columns. Tens of millions of records then cross the shuffle as
thousands of rows, and both sides handle them with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.textscan import mix, trimmed

#: Packed columns for a bucket: of records, or (marks) of what a task already knows.
SCHEMA = "bucket int, marks boolean, blob binary"
#: All records of one document.
MARKS = "id bigint, blob binary"
#: Records that a task gathers before it packs them.
FLUSH = 1 << 20
#: Bytes of text for which there is a bucket at least; a task holds one bucket.
BUCKET_BYTES = 128 << 20
#: Rows without an id count as one document after all others. Its key may also be an
#: id, so places in it are shifted by ``MISSING``, which no text reaches.
LAST, MISSING = (1 << 63) - 1, 1 << 31


def bucket_count(docs: DataFrame, text_col: str) -> int:
    """Buckets for the texts: the session's shuffle partitions, or as many more as keep
    a bucket's share of the text under ``BUCKET_BYTES``. Counts all bytes, one scan."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, missing) rows; missing flags those whose id is null."""
    own = F.col(id_col).cast("bigint")
    return docs.select(F.coalesce(own, F.lit(LAST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), own.isNull().alias("missing"))


def places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids, what to add to places in each document) of a batch of keyed rows."""
    return batch.column(0).to_numpy(), np.where(batch.column(2).to_numpy(zero_copy_only=False), np.uint32(MISSING), np.uint32(0))


def is_own(found: np.ndarray, shift: np.uint32) -> np.ndarray:
    """Which places are of rows with an id, or (by ``shift``) of those without."""
    return (found >= MISSING) == (shift > 0)


def own_places(found: np.ndarray, shift: np.uint32) -> np.ndarray:
    return found[is_own(found, shift)] - shift


def planes(column: np.ndarray) -> bytes:
    """A column byte plane by byte plane, 64-bit ids as differences.

    Leading zeros and slowly rising ids then fall to the shuffle's own compression.
    """
    if column.dtype == np.int64:
        column = np.diff(column, prepend=np.int64(0))
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), column.dtype.itemsize).T.tobytes()


def from_planes(blob: bytes, kind, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T
    column = np.ascontiguousarray(raw).reshape(-1).view(kind)
    return np.cumsum(column) if np.dtype(kind) == np.int64 else column


def pack(hashes: np.ndarray, columns: list[np.ndarray], buckets: int, marks: bool = False) -> pa.RecordBatch:
    """Rows that carry the columns to the bucket of each record's hash, in their order."""
    bucket = ((hashes >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    bounds = np.append(first, len(bucket))
    blobs = [b"".join(planes(c[a:b]) for c in columns) for a, b in zip(bounds[:-1], bounds[1:])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array([marks] * len(first), pa.bool_()), pa.array(blobs, pa.binary())], ["bucket", "marks", "blob"])


def pack_marks(ids: np.ndarray, records: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Marks for documents, dealt by document."""
    order = np.argsort(ids, kind="stable")  # runs of one id compress well
    return pack(mix(ids[order].astype(np.uint64)), [ids[order], records[order]], buckets, True)


def unpack(blobs: list[bytes], types: list) -> list[np.ndarray]:
    """The columns of all blobs together."""
    sizes = [np.dtype(t).itemsize for t in types]
    parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in types]
    for blob in blobs:
        n, at = len(blob) // sum(sizes), 0
        for k, t in enumerate(types):
            parts[k].append(from_planes(blob, t, n, at))
            at += n * sizes[k]
    return [np.concatenate(p) for p in parts]


def pack_spans(hashes: np.ndarray, columns: list[np.ndarray], sizes: np.ndarray, raw: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Like ``pack``, with a byte string for each record (``raw`` holds all of them)."""
    ends = np.cumsum(sizes)
    bucket = ((hashes >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bounds = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)), len(order)) if len(order) else np.zeros(1, np.int64)
    blobs = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        own = order[a:b]
        numbers = [planes(c[own]) for c in (*columns, sizes.astype(np.uint16))]
        strings = raw[spread_ranges((ends - sizes)[own], sizes[own])].tobytes()
        blobs.append(b"".join([np.uint32(b - a).tobytes(), *numbers, strings]))
    flags = pa.array([False] * len(blobs), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(bucket[order][bounds[:-1]]), flags, pa.array(blobs, pa.binary())], ["bucket", "marks", "blob"])


def unpack_spans(blobs: list[bytes], types: list) -> list[np.ndarray]:
    """The columns of all blobs together, the sizes and the bytes."""
    types = [*types, "<u2"]
    parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (*types, np.uint8)]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, "<u4", 1)[0]), 4
        for k, t in enumerate(types):
            parts[k].append(from_planes(blob, t, n, at))
            at += n * np.dtype(t).itemsize
        parts[-1].append(np.frombuffer(blob, np.uint8, offset=at))
    return [np.concatenate(p) for p in parts]


def spread_ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each range, one after the other."""
    many = np.asarray(many, np.int64)
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


def by_document(ids: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """One row for each id, with all its records."""
    order = np.argsort(ids, kind="stable")
    ids, raw = ids[order], np.ascontiguousarray(records[order]).view(np.uint8)
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    offsets = np.append(first, len(ids)) * records.dtype.itemsize
    column = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
    return pa.RecordBatch.from_arrays([pa.array(ids[first], pa.int64()), column.cast(pa.binary())], ["id", "blob"])


def settle_buckets(rows: DataFrame, settle, types: list, record, buckets: int, read=unpack) -> DataFrame:
    """Deal rows by bucket, settle each bucket's records, and gather marks by document.

    ``settle`` takes the unpacked columns and returns (ids, marks of dtype ``record``).
    A partition has whole buckets, so equal hashes are together. The marks then go,
    packed again, to the bucket of their document, which leaves one row a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for batch in batches:
            known = batch.filter(batch.column(1))
            if known.num_rows:
                yield known
            blobs += batch.filter(pa.compute.invert(batch.column(1))).column(2).to_pylist()
        ids, records = settle(*read(blobs, types))
        del blobs
        if len(ids):
            yield pack_marks(ids, records, buckets)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in batches for b in batch.column(2).to_pylist()]
        if blobs:
            yield by_document(*unpack(blobs, ["<i8", record]))

    settled = rows.repartitionById(buckets, "bucket").mapInArrow(trimmed(run), SCHEMA)
    return settled.repartitionById(buckets, "bucket").mapInArrow(gather, MARKS)
