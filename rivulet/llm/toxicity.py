"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are the distinct word unigrams (whole words and the stems of longer ones),
bigrams and one-word skip-grams of a text, hashed into a fixed number of slots. Training
follows the proximal form of follow-the-regularised-leader with a learning rate for each coordinate and an L1
term that keeps most weights at zero; what is left is a short list of slots and
weights, which is broadcast for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.storage import Scratch, documents, named_again, numbered_columns
from rivulet.llm.textscan import LOWER, mix, pieces, separators, span_hashes, text_bytes, trimmed, word_spans

#: Words are runs of lower-cased ASCII letters, digits and of non-ASCII bytes.
SEPARATORS = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
SLOT_BITS = 20
#: Characters of a stem.
STEM = 4
#: Fixed by the contract: a score from here on is predicted toxic.
THRESHOLD = 0.7
#: Labelled rows, and bytes of their features, that a model is fitted on; a larger set
#: is sampled by hashes at a rate that expects this many. Every row of the table is scored.
TRAIN_ROWS, TRAIN_BYTES = 12_000, 48 << 20
_U = np.uint64


def features(data: np.ndarray, offs: np.ndarray, bits: int = SLOT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all features, first feature of each document), repeats included."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offs, SEPARATORS)
    words = span_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    shift = _U(64 - bits)
    slots, owner = [words >> shift], [doc]
    # Stems: the first characters of longer words, so that endings not seen in training count.
    letters = np.append(np.flatnonzero((data & 0xC0) != 0x80), [len(data)] * (STEM + 1))
    cut = letters[np.searchsorted(letters, starts) + STEM]
    longer = cut < ends
    slots.append(mix(span_hashes(data, starts[longer], cut[longer]) + _U(1)) >> shift)
    owner.append(doc[longer])
    for gap, seed in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(words) > gap:
            same = doc[gap:] == doc[:-gap]
            slots.append(mix(words[:-gap] * _U(seed) + words[gap:])[same] >> shift)
            owner.append(doc[gap:][same])
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    return np.concatenate(slots)[order].astype(np.int64), np.searchsorted(owner_all[order], np.arange(len(offs)))


@dataclass
class Ftrl:
    """FTRL-proximal learner; ``beta`` and the L terms are its usual parameters."""

    bits: int = SLOT_BITS
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 20.0
    l2: float = 1.0
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(1 << self.bits), np.zeros(1 << self.bits)

    def weights(self, slots) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, label: int, importance: float = 1.0) -> float:
        """One step on a document's distinct slots; returns the probability before it."""
        w = self.weights(slots)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = (p - label) * importance
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g
        return float(p)

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        """(slots, weights) that are not zero."""
        w = self.weights(slice(None))
        slots = np.flatnonzero(w)
        return slots.astype(np.int32), w[slots].astype(np.float32)


def slot_rows(docs: DataFrame, text_col: str, keep: tuple[str, ...], bits: int = SLOT_BITS) -> DataFrame:
    """``keep`` columns and slots (binary: distinct sorted 32-bit integers)."""
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column(len(keep)))
            for i, j in pieces(offs):
                slots, first = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], bits)
                out = [np.unique(slots[a:b]).astype("<i4").tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(keep))), pa.array(out, pa.binary())], [*keep, "slots"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "slots binary"])
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(trimmed(run), schema)


def fit(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, epochs: int = 3, bits: int = SLOT_BITS, train_bytes: int = TRAIN_BYTES
) -> tuple[np.ndarray, np.ndarray]:
    """Fit on (id, text) and (id, label) rows; returns the (slots, weights) not zero.

    Rows with a null id, text or label teach nothing; repeated rows teach once. Rows are
    taken in the order of a hash, ties by id and features, so a fit does not depend on
    partitioning. Above ``train_rows`` rows or ``train_bytes`` of features they are
    sampled by hash thresholds alone: labels first, which bounds their broadcast, then
    the joined rows, which bounds what the driver gathers. Without any row the model is
    empty.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)

    def sampled(rows: DataFrame, rate: float, *columns: str) -> DataFrame:
        return rows if rate >= 1 else rows.filter(F.shiftrightunsigned(F.xxhash64(*columns), 1) < F.lit(int(rate * (1 << 63))))

    labels = labels.filter("id is not null and label is not null").select("id", F.col("label").cast("int").alias("label"))
    labels = scratch.write(labels.distinct(), "labels")
    labels = sampled(labels, train_rows / max(labels.count(), 1), "id")
    rows = docs.select("id", "text").filter("text is not null").join(F.broadcast(labels), "id")
    rows = scratch.write(slot_rows(rows, "text", ("id", "label"), bits).distinct(), "features")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("slots")).alias("bytes")).first()
    # Twice the rows are only there where ids repeat: the first sample expects train_rows.
    rate = min(1.0 if size["n"] <= 2 * train_rows else train_rows / size["n"], train_bytes / (size["bytes"] or 1))
    found = sampled(rows, rate, "id", "slots").select(F.xxhash64("id").alias("o"), "id", "label", "slots").toArrow()
    scratch.release()
    found = found.take(pc.sort_indices(found, [(c, "ascending") for c in found.column_names])).combine_chunks()
    slots, offs = (column_bytes(found.column("slots")) if len(found) else (np.zeros(0, np.uint8), np.zeros(1, np.int64)))
    labelled = zip(offs[:-1].tolist(), offs[1:].tolist(), found.column("label").to_pylist())
    data = [(slots[a:b].view("<i4"), y) for a, b, y in labelled if b > a]
    ones = sum(y for _, y in data)
    learner = Ftrl(bits)
    boost = max(1.0, min(4.0, (len(data) - ones) / ones / 2)) if ones else 1.0
    for _ in range(epochs):
        for slots, label in data:
            learner.learn(slots, label, boost if label else 1.0)
    return learner.model()


def column_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a binary column without nulls."""
    whole = column.cast(pa.large_binary()).combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    _, offsets, data = whole.buffers()
    offs = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offs


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), bits: int = SLOT_BITS) -> DataFrame:
    """The ``keep`` columns and score (0 to 1) of every whole text.

    The model has at most 2**bits weights, which bounds the broadcast. A text without
    words, null included, has the score of no evidence, 0.5. Repeated rows each get a
    row and equal scores; no shuffle. An empty table gives no rows; a very long text
    bounds the memory of its task.
    """
    types = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = keep.index(text_col) if text_col in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << bits, np.float32)
        dense[shared.value[0]] = shared.value[1]
        weighted = np.flatnonzero(dense)
        number = np.zeros(1 << bits, np.int64)
        number[weighted] = np.arange(len(weighted)) + 1
        for batch in batches:
            data, offs = text_bytes(batch.column(place))
            for i, j in pieces(offs):
                slots, first = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], bits)
                # Only slots with a weight matter: few are left to make distinct.
                own = np.flatnonzero(dense[slots])
                doc = np.searchsorted(first, own, "right") - 1
                pair = np.unique(doc * (len(weighted) + 1) + number[slots[own]])
                sums = np.bincount(pair // (len(weighted) + 1), dense[weighted[pair % (len(weighted) + 1) - 1]].astype(float) if len(pair) else None, j - i)
                p = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(keep))), pa.array(p, pa.float64())], [*keep, "score"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "score double"])
    return docs.select(*keep, *([] if text_col in keep else [text_col])).mapInArrow(trimmed(run), schema)


def held_out(id_col: str = "doc_id"):
    """Rows that the contract keeps from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_from(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, np.ndarray]:
    """The model that the labelled rows of a data folder teach."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out()).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    return fit(documents(spark, sf_dir).filter(~held_out()).select(F.col("doc_id").alias("id"), "text"), labels)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return score(documents(spark, sf_dir), learn_from(spark, sf_dir)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all their columns."""
    plain = numbered_columns(docs)
    scored = score(plain, model, f"c{docs.columns.index(text_col)}", tuple(plain.columns))
    return named_again(scored.filter(F.col("score") < threshold), docs.columns)
