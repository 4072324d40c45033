"""Substring dedup of word windows by difference-cover anchors.

Two equal windows of 20 words at any two positions have an offset at which both lie on
a position of the cover modulo 13 (every difference modulo 13 is one of two members
of the cover). So both hold the same *anchor*, 8 words that start at a cover position,
and it is enough to hash 4 of 13 positions to find every document with a repeated
window. Anchors that occur once end the search; around the others the match is
extended: the windows that hold them are hashed in full, and of equal ones the first
occurrence stays.

Both rounds pre-aggregate in the task: of equal hashes in one flush only one goes on,
so a passage that a third of all documents share sends one record a flush.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import blobs
from rivulet.llm.storage import documents
from rivulet.llm.textscan import WHITE_SPACE, pieces, span_hashes, text_bytes, window_hashes, word_spans

#: Fixed by the contract.
WINDOW = 20
#: A perfect difference set: each residue but 0 is the difference of one pair.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1

_IS_COVER = np.isin(np.arange(PERIOD), COVER)
_RECORD = np.dtype([("start", "<u4"), ("check", "<u4")])


class Words:
    """Word hashes of a piece of a batch, and windows of them."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        self.data = data
        self.starts, self.ends, self.first = word_spans(data, offs, WHITE_SPACE)
        self.hashes = span_hashes(data, self.starts, self.ends)
        self.lengths = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)

    def __len__(self) -> int:
        return len(self.hashes)

    def checks(self) -> np.ndarray:
        """32 further bits of each window, from word hashes of their own."""
        return (window_hashes(span_hashes(self.data, self.starts, self.ends, 2), WINDOW, 2) >> np.uint64(32)).astype(np.uint32)


def find_anchors(keyed: DataFrame, buckets: int) -> DataFrame:
    """Records of anchors, and marks for those that repeat within a flush."""

    def flush(h, d, p):
        h_all, d, p = map(np.concatenate, (h, d, p))
        order = np.argsort(h_all, kind="stable")
        h = h_all[order]
        new = np.append(True, h[1:] != h[:-1])
        again = ~new | ~np.append(new[1:], True)
        if again.any():
            yield blobs.pack_marks(d[order[again]], p[order[again]], buckets)
        go = np.sort(order[new])  # in document order, which compresses
        low = h_all[go]
        # 40 bits beside the bucket's do: buckets grow with the input, and an anchor taken
        # for repeated only costs a look at its windows.
        yield blobs.pack(low, [low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint8), d[go], p[go]], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], []), 0
        for batch in batches:
            ids, shift = blobs.places(batch)
            data, offs = text_bytes(batch.column(1))
            for i, j in pieces(offs):
                words = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                doc, lengths = words.doc, words.lengths
                pos = np.arange(len(words)) - words.first[doc]
                use = np.flatnonzero(_IS_COVER[pos % PERIOD] & (pos + ANCHOR <= lengths[doc]) & (lengths[doc] >= WINDOW))
                if len(use):
                    own = i + doc[use]
                    for into, x in zip(held, (window_hashes(words.hashes, ANCHOR)[use], ids[own], pos[use].astype(np.uint32) + shift[own])):
                        into.append(x)
                    size += len(use)
                if size >= blobs.FLUSH:
                    yield from flush(*held)
                    held, size = ([], [], []), 0
        if size:
            yield from flush(*held)

    return keyed.mapInArrow(run, blobs.SCHEMA)


def repeated_anchors(low: np.ndarray, high: np.ndarray, d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
    order = np.argsort(h, kind="stable")
    h = h[order]
    same = h[1:] == h[:-1]
    again = order[np.append(same, False) | np.append(False, same)] if len(h) else order
    return d[again], p[again]


def extend(marked: DataFrame, buckets: int) -> DataFrame:
    """Records of the windows that hold a repeated anchor, and marks for those that
    come again within a flush."""

    def flush(h, c, d, p):
        h, c, d, p = map(np.concatenate, (h, c, d, p))
        order = np.lexsort((p, d, c, h))
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1]))
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = order[(d[order] != d[head]) | (p[order] != p[head])]
        if len(later):
            yield blobs.pack_marks(d[later], records(p[later], c[later]), buckets)
        go = np.sort(order[new])
        yield blobs.pack(h[go], [h[go], c[go], d[go], p[go]], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], [], []), 0
        for batch in batches:
            ids, shift = blobs.places(batch)
            data, offs = text_bytes(batch.column(1))
            marks = batch.column(3)
            for i, j in pieces(offs):
                words = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                first = words.first
                hit = np.zeros(len(words) + 1, np.int32)
                for k in range(i, j):
                    own = blobs.own_places(np.frombuffer(marks[k].as_py(), "<u4"), shift[k]).astype(np.int64)
                    # An id that other texts share may bring marks beyond this text.
                    own = own[own < first[k - i + 1] - first[k - i]] + first[k - i]
                    hit[own + 1] = 1
                seen = np.cumsum(hit)
                if len(words) < WINDOW:
                    continue
                doc = words.doc
                begin = np.arange(len(words) - WINDOW + 1)
                use = begin[(doc[: len(begin)] == doc[WINDOW - 1 :]) & (seen[begin + PERIOD] > seen[begin])]
                if len(use):
                    own, at = i + doc[use], (use - first[doc[use]]).astype(np.uint32)
                    for into, x in zip(held, (window_hashes(words.hashes, WINDOW)[use], words.checks()[use], ids[own], at + shift[own])):
                        into.append(x)
                    size += len(use)
                if size >= blobs.FLUSH:
                    yield from flush(*held)
                    held, size = ([], [], [], []), 0
        if size:
            yield from flush(*held)

    return marked.mapInArrow(run, blobs.SCHEMA)


def records(start: np.ndarray, check: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), _RECORD)
    out["start"], out["check"] = start, check
    return out


def later_windows(h: np.ndarray, c: np.ndarray, d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(h):
        return d, records(p, c)
    order = np.lexsort((p, d, c, h))
    h, c, d, p = h[order], c[order], d[order], p[order]
    new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (d != d[head]) | (p != p[head])
    return d[later], records(p[later], c[later])


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove the words of every window that starts earlier in the corpus, too.

    Returns one row for each input row: (id, n_words, n_removed, spans, kept_text).
    spans are half-open ranges of removed words, kept_text the other words joined by
    one space. Earlier means a smaller id, or a smaller start in the same document;
    windows are judged on the input. A null text has no words; a text under 20 words
    has no window. Rows that repeat an id and a text are the same place, neither is
    earlier; an id with several texts has each judged by itself. Rows without an id
    count as one document after all others. Other columns are ignored.

    An empty table gives no rows; a very long text is one document like any other and
    bounds the memory of its task.

    Windows are told apart by 64 and 32 bits of two independent hashes; a mark applies
    only to a window with the same check bits.
    """
    keyed = blobs.keyed(docs, id_col, text_col)
    buckets = blobs.bucket_count(docs, text_col)

    anchors = blobs.settle_buckets(find_anchors(keyed, buckets), repeated_anchors, ["<u4", "<u1", "<i8", "<u4"], "<u4", buckets)
    candidates = keyed.join(anchors, "id").select("id", "text", "missing", F.col("blob").alias("marks"))
    later = blobs.settle_buckets(extend(candidates, buckets), later_windows, ["<u8", "<u4", "<i8", "<u4"], _RECORD, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            _, shift = blobs.places(batch)
            data, offs = text_bytes(batch.column(1))
            marks = batch.column(3)
            for i, j in pieces(offs):
                total, removed, spans, kept = [], [], [], []
                for k in range(i, j):
                    words = data[offs[k] : offs[k + 1]].tobytes().split()
                    own: list[tuple[int, int]] = []
                    if marks[k].is_valid and len(words) >= WINDOW:
                        mine = np.frombuffer(marks[k].as_py(), _RECORD)
                        check = Words(data[offs[k] : offs[k + 1]], np.array([0, offs[k + 1] - offs[k]])).checks()
                        mine = records(blobs.own_places(mine["start"], shift[k]), mine["check"][blobs.is_own(mine["start"], shift[k])])
                        mine = mine[mine["start"] < len(check)]
                        start = np.unique(mine["start"][check[mine["start"]] == mine["check"]]).astype(np.int64)
                        if len(start):
                            cut = np.flatnonzero(np.diff(start) > WINDOW)
                            own = list(zip(start[np.append(0, cut + 1)].tolist(), (start[np.append(cut, len(start) - 1)] + WINDOW).tolist()))
                    total.append(len(words))
                    removed.append(sum(b - a for a, b in own))
                    spans.append([{"first": a, "last": b} for a, b in own])
                    for a, b in reversed(own):
                        del words[a:b]
                    kept.append(b" ".join(words).decode())
                own = [batch.column(c).slice(i, j - i) for c in (0, 2)]
                found = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*own, *found], ["id", "missing", "n_words", "n_removed", "spans", "kept_text"])

    out = keyed.join(later, "id", "left").select("id", "text", "missing", F.col("blob").alias("marks"))
    schema = "id bigint, missing boolean, n_words bigint, n_removed bigint, spans array<struct<first:int,last:int>>, kept_text string"
    return out.mapInArrow(run, schema).select(
        F.when(~F.col("missing"), F.col("id")).alias(id_col), "n_words", "n_removed", "spans", "kept_text"
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed words of every document."""
    return drop_repeated_windows(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS key
  FROM words, unnest(generate_series(1, len(w) - 19)) AS s(i) WHERE len(w) >= 20
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1
), gone AS (SELECT DISTINCT doc_id, p FROM later, unnest(generate_series(i, i + 19)) AS s(p)),
removed AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i : NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id)
"""
