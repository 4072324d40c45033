"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all other
non-ASCII characters. Benchmark items give windows of consecutive words; each
executor holds their hashes, scans the word windows of its documents, and compares
the words of every hit with those of the item. Hit words can be removed as spans, or
the documents can.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.storage import Scratch, documents, numbered_columns
from rivulet.llm.textscan import LOWER, pieces, separators, span_hashes, text_bytes, trimmed, window_hashes, word_spans

#: Fixed by the contract: bytes outside words once A-Z are lower-cased.
SEPARATORS = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
WINDOW = 10
#: Most benchmark words that one broadcast set may hold (about 50 bytes each, the words
#: included). A larger benchmark is scanned in blocks of whole items under this bound.
BLOCK_WORDS = 1_000_000


class WindowSet:
    """Hash set of item windows by length, with the words for verification.

    All is held in flat arrays: the words of all items with one space between, where
    each word stands, and for each length the sorted hashes of its windows with the
    number of their first word. A window of an item is then one slice of the words.
    """

    def __init__(self, items: list[tuple[str, str]], width: int = WINDOW) -> None:
        self.items = [item for item, _ in items]
        words, hashes, sizes = [], [], []
        for _, text in items:
            data = LOWER[np.frombuffer(text.encode(), np.uint8)]
            starts, ends, _ = word_spans(data, np.array([0, len(data)]), SEPARATORS)
            hashes.append(span_hashes(data, starts, ends))
            raw = data.tobytes()
            words += [raw[a:b] for a, b in zip(starts, ends)]
            sizes.append(len(starts))
        self.text = b" ".join(words)
        self.ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
        self.starts = np.append(0, self.ends[:-1] + 1)[: len(words)]
        own = np.concatenate([np.zeros(0, np.uint64), *hashes])
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), sizes)
        self.vocabulary = np.unique(own)
        #: length -> (sorted hashes, first word of each window)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({min(width, n) for n in sizes if n}):
            at = np.concatenate([np.arange(first[k], first[k + 1] - size + 1) for k, n in enumerate(sizes) if n and min(width, n) == size])
            found = window_hashes(own, size)[at]
            order = np.argsort(found, kind="stable")
            self.windows[size] = (found[order], at[order].astype(np.int32))

    def items_at(self, size: int, low: int, high: int, words: bytes) -> set[str]:
        """Items of those windows low..high of a length that have just these words."""
        found = set()
        for w in self.windows[size][1][low:high].tolist():
            if self.text[self.starts[w] : self.ends[w + size - 1]] == words:
                found.add(self.items[self.item[w]])
        return found

    def scan(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]], set[str]]]:
        """(document, number of words, spans of hit words, items) for each document."""
        data = LOWER[data]
        starts, ends, first = word_spans(data, offs, SEPARATORS)
        hashes = span_hashes(data, starts, ends)
        at = np.searchsorted(self.vocabulary, hashes)
        known = np.zeros(len(hashes), bool)
        if len(self.vocabulary):
            known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == hashes
        unknown = np.concatenate([[0], np.cumsum(~known)])
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for size, (have, _) in self.windows.items():
            if len(hashes) < size:
                continue
            begin = np.flatnonzero((unknown[size:] == unknown[:-size]) & (doc[: len(doc) - size + 1] == doc[size - 1 :]))
            if not len(begin):
                continue
            found = window_hashes(hashes, size)[begin]
            low, high = np.searchsorted(have, found, "left"), np.searchsorted(have, found, "right")
            for k in np.flatnonzero(low < high).tolist():
                i = int(begin[k])
                key = b" ".join(data[a:b].tobytes() for a, b in zip(starts[i : i + size], ends[i : i + size]))
                hit = self.items_at(size, int(low[k]), int(high[k]), key)
                if hit:
                    d = int(doc[i])
                    spans.setdefault(d, []).append((i - int(first[d]), i - int(first[d]) + size))
                    items.setdefault(d, set()).update(hit)
        for d in range(len(offs) - 1):
            yield d, int(first[d + 1] - first[d]), merge(spans.get(d, [])), items.get(d, set())


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans as sorted, separate spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """Distinct items, gathered one partition at a time, in blocks under the bound.

    No more than a block and a partition of the benchmark is held by the driver; an
    item longer than a block is a block of its own.
    """
    block: list[tuple[str, str]] = []
    held = 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("item is not null").distinct()
    for item, text in rows.toLocalIterator():
        size = 1 + len(text.encode()) // 2
        if block and held + size > block_words:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += size
    yield block


def find_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Occurrences of benchmark windows in every whole document.

    Returns the ``keep`` columns, n_words,
    spans (array of half-open word ranges that any window covers), items (sorted
    item ids as strings whose windows occur) and clean_text, the text without the
    bytes of the hit words.

    A null text has no words; so has an item with a null text, which is in no
    document, as an item without an id is. Repeated rows each get a row; items with equal
    ids or windows all count. A benchmark beyond ``block_words`` is scanned in several
    passes, each with a broadcast of bounded size and written to the shared folder. An
    empty table gives no rows; a very long text bounds the memory of its task.
    """
    spark = docs.sparkSession
    types = dict(docs.dtypes)
    plain = docs.select(*(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)), F.col(f"`{text_col}`").alias("text"))
    inputs = [f"k{n}" for n in range(len(keep))]
    kept = ", ".join(f"`{n}` {types[c]}" for n, c in zip(inputs, keep))
    found_type = "n_words bigint, spans array<struct<first:int,last:int>>, items array<string>"
    span_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def scan(rows: DataFrame, block, last: bool) -> DataFrame:
        """Adds a block's hits to those found before; the last pass cleans the text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = pickle.loads(block.value)
            for batch in batches:
                data, offs = text_bytes(batch.column("text"))
                for i, j in pieces(offs):
                    part = batch.slice(i, j - i)
                    hits = [h[1:] for h in windows.scan(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])]
                    if "spans" in part.schema.names:
                        before = zip(part.column("spans").to_pylist(), part.column("items").to_pylist())
                        hits = [(n, merge([*s, *((x["first"], x["last"]) for x in s0)]), t | {*t0}) for (n, s, t), (s0, t0) in zip(hits, before)]
                    columns = [
                        *(part.column(n) for n in inputs),
                        pa.array([n for n, _, _ in hits], pa.int64()),
                        pa.array([[{"first": a, "last": b} for a, b in s] for _, s, _ in hits], span_type),
                        pa.array([sorted(t) for _, _, t in hits], pa.list_(pa.string())),
                    ]
                    texts = part.column("text")
                    if last:
                        texts = pa.array([without(t, s) if s else t for t, (_, s, _) in zip(texts.to_pylist(), hits)], pa.string())
                    yield pa.RecordBatch.from_arrays([*columns, texts], [*inputs, "n_words", "spans", "items", "text"])

        return rows.mapInArrow(trimmed(run), ", ".join([*([kept] if kept else []), found_type, "text string"]))

    scratch, rows, block = Scratch(spark), plain, None
    for k, items in enumerate(item_blocks(benchmark, item_col, item_text_col, block_words)):
        if block is not None:
            rows = scratch.write(scan(rows, block, False), f"pass-{k}")
            scratch.release(f"pass-{k - 1}")
        block = spark.sparkContext.broadcast(pickle.dumps(WindowSet(items, width)))
    rows = scan(rows, block, True)
    return rows.select(*(F.col(n).alias(c) for n, c in zip(inputs, keep)), "n_words", "spans", "items", F.col("text").alias("clean_text"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the words in the spans; what stands between words stays."""
    raw = text.encode()
    data = LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), SEPARATORS)
    drop = np.zeros(len(data), bool)
    for a, b in spans:
        for k in range(a, b):
            drop[starts[k] : ends[k]] = True
    return np.frombuffer(raw, np.uint8)[~drop].tobytes().decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, or (mode "spans") without hit words.

    All columns of ``docs`` are kept. Clean documents stay as they are.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    plain = numbered_columns(docs)
    text = f"c{docs.columns.index(text_col)}"
    found = find_windows(plain, benchmark, text, keep=tuple(plain.columns))
    if mode == "documents":
        found = found.filter(F.size("spans") == 0)
    return found.select(*(F.col("clean_text" if mode == "spans" and c == text else c).alias(name) for c, name in zip(plain.columns, docs.columns)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    found = find_windows(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS key
  FROM item_words, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS key
  FROM words, sizes, unnest(generate_series(1, len(w) - size + 1)) AS s(i) WHERE len(w) >= size
), hits AS (SELECT d.doc_id, d.i, d.size, w.item_id FROM doc_windows d JOIN item_windows w ON d.key = w.key AND d.size = w.size),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(generate_series(i, i + size - 1)) AS s(p) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
