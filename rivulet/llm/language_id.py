"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is a vector of hashed byte trigrams of its letters, weighted by TF-IDF and
normalised. Each language has several centroids, since one language has several kinds of
text: its texts in a bounded labelled sample are halved along their main direction until
there are enough parts, which spherical k-means then settles. The nearest centroid by
cosine names the language. Each centroid reaches as far as nearly all texts that it was
made of, and a little further; a text beyond is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.storage import documents
from rivulet.llm.textscan import LOWER, pieces, text_bytes

DIMENSIONS = 1 << 13
CENTROIDS = 4
#: Most texts that one fit uses, shared evenly by the languages. Where a language has
#: more, its texts are sampled by a hash of their id.
TRAIN_ROWS = 4_000
UNDETERMINED = "und"
#: Share of a centroid's training texts that it reaches, and cosine distance beyond them.
REACHED, REACH = 0.995, 0.05
#: Documents whose vectors are held densely at once.
ROWS = 256

_LETTERS = LOWER.copy()
_LETTERS[:0x41] = _LETTERS[0x5B:0x61] = _LETTERS[0x7B:0x80] = 0x20


def trigram_slots(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each trigram, its document) of the lower-cased letters.

    All that is no letter in ASCII counts as space; bytes of other characters count as
    letters. Trigrams without a letter and across documents are left out. The first
    and the last letter of a text border on a space.
    """
    sizes = np.diff(offs)
    padded = np.full(len(data) + 2 * len(sizes), 0x20, np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes + 2)
    padded[np.arange(len(data)) + 2 * np.repeat(np.arange(len(sizes)), sizes) + 1] = _LETTERS[data]
    if len(padded) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    use = (owner[:-2] == owner[2:]) & (b != 0x20)
    code = (a[use].astype(np.uint32) << 16 | b[use].astype(np.uint32) << 8 | c[use]) * np.uint32(2654435761)
    return (code >> np.uint32(32 - 13)).astype(np.int64), owner[:-2][use]


def counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Dense trigram counts, one row for each document."""
    slots, owner = trigram_slots(data, offs)
    n = len(offs) - 1
    return np.bincount(owner * DIMENSIONS + slots, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.float32)


@dataclass
class LanguageModel:
    """idf weights and centroids (rows) with the language of each."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    fallback: str
    #: Greatest cosine distance at which each centroid still speaks for a text.
    reach: np.ndarray

    def vectors(self, raw: np.ndarray) -> np.ndarray:
        """Normalised TF-IDF vectors in the place of the counts."""
        np.log1p(raw, out=raw)
        raw *= self.idf
        raw /= np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
        return raw

    def nearest(self, raw: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, whether out of reach) for rows of counts; of equal
        cosines the first language in alphabetical order has it."""
        if not len(self.centroids):
            return [self.fallback] * len(raw), np.zeros(len(raw)), np.ones(len(raw), bool)
        cosine = self.vectors(raw) @ self.centroids.T
        best = cosine.argmax(axis=1)
        top = np.clip(cosine[np.arange(len(raw)), best], 0, 1)
        return [self.languages[b] if t > 0 else self.fallback for b, t in zip(best, top)], top, 1 - top > self.reach[best]


def halves(v: np.ndarray) -> np.ndarray | None:
    """Which rows lie beyond the median along the direction of most variance; None if
    all rows are alike."""
    x = v - v.mean(axis=0)
    d = x[np.argmax((x * x).sum(axis=1))]
    for _ in range(10):
        d = x.T @ (x @ d)
        d /= max(float(np.linalg.norm(d)), 1e-12)
    at = x @ d
    upper = at > np.median(at)
    return upper if upper.any() and at.max() - at.min() > 1e-5 else None


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the parts of repeated halving; deterministic.

    There are ``k`` centroids unless there are fewer different rows. One that loses all
    its rows takes over the row that is farthest from its own centroid.
    """
    parts, done = [np.arange(len(v))], []
    while parts and len(parts) + len(done) < k:
        parts.sort(key=lambda p: (-len(p), p[0]))
        own = parts.pop(0)
        upper = halves(v[own]) if len(own) > 1 else None
        if upper is None:
            done.append(own)
        else:
            parts += [own[~upper], own[upper]]
    unit = lambda c: c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    c = unit(np.array([v[p].mean(axis=0) for p in sorted([*parts, *done], key=lambda p: p[0])]))
    for _ in range(rounds):
        cosine = v @ c.T
        own = cosine.argmax(axis=1)
        near = cosine[np.arange(len(v)), own]
        for i in range(len(c)):
            if not (own == i).any():
                far = int(near.argmin())
                own[far], near[far] = i, 1.0
        c = unit(np.array([v[own == i].mean(axis=0) for i in range(len(c))]))
    return c


def fit(rows: DataFrame, train_rows: int = TRAIN_ROWS, centroids: int = CENTROIDS) -> LanguageModel:
    """Fit on (id, text, lang) rows; rows with a null id, text or lang teach nothing,
    repeated rows teach once. Each language's rows are sampled by a hash of id and text
    alone, at a rate that expects its share of ``train_rows``."""
    spark = rows.sparkSession
    rows = rows.filter("id is not null and text is not null and lang is not null")
    totals = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return LanguageModel(np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), [], UNDETERMINED, np.zeros(0))
    share = max(1, train_rows // len(totals))
    rate = spark.createDataFrame([(k, min(1.0, share / n)) for k, n in totals.items()], "lang string, rate double")
    order = F.xxhash64("id", "text")
    picked = rows.join(F.broadcast(rate), "lang").filter(F.shiftrightunsigned(order, 1) / F.lit(float(1 << 63)) <= F.col("rate"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column(2))
            for i in range(0, len(offs) - 1, ROWS):
                j = min(i + ROWS, len(offs) - 1)
                raw = counts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                found = [np.flatnonzero(r) for r in raw]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array([f.astype("<u2").tobytes() for f in found], pa.binary()),
                        pa.array([r[f].astype("<f4").tobytes() for r, f in zip(raw, found)], pa.binary()),
                    ],
                    ["o", "lang", "slots", "n"],
                )

    sample = picked.select(order.alias("o"), "lang", "text").mapInArrow(run, "o bigint, lang string, slots binary, n binary").distinct().collect()
    sample = sorted((r for r in sample if len(r.slots)), key=lambda r: (r.lang, r.o, bytes(r.slots)))
    raw = np.zeros((len(sample), DIMENSIONS), np.float32)
    for k, r in enumerate(sample):
        raw[k, np.frombuffer(r.slots, "<u2")] = np.frombuffer(r.n, "<f4")
    seen = np.count_nonzero(raw, axis=0)
    idf = np.log((1 + len(sample)) / (1 + seen)).astype(np.float32) + 1
    model = LanguageModel(idf, np.zeros((0, DIMENSIONS), np.float32), [], max(sorted(totals), key=totals.get), np.zeros(0))
    v = model.vectors(raw)
    langs = [r.lang for r in sample]
    made, reach = [], []
    for lang in sorted(set(langs)):
        own = v[langs.index(lang) : len(langs) - langs[::-1].index(lang)]
        c = cluster(own, centroids)
        cosine = own @ c.T
        nearest = cosine.argmax(axis=1)
        made.append(c)
        model.languages += [lang] * len(c)
        reach += [float(np.quantile(1 - np.append(cosine[nearest == k, k], [] if (nearest == k).any() else [1.0]), REACHED)) + REACH for k in range(len(c))]
    if made:
        model.centroids, model.reach = np.concatenate(made).astype(np.float32), np.array(reach)
    return model


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), reject: bool = False) -> DataFrame:
    """The ``keep`` columns, lang_pred, score (cosine, 0 to 1) and rejected of every
    whole text.

    A text is rejected if it is out of reach of its nearest centroid; with ``reject``
    its lang_pred is then ``und``. A text that is null or has no letter is ``und`` with
    score 0 and rejected. A text with letters but no known trigram gets the language
    with most training rows and score 0. Repeated rows each get a row; no shuffle. The
    model's size is bounded by its dimensions and the number of languages. An empty
    table gives no rows; a very long text bounds the memory of its task.
    """
    types = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column(len(keep))
            data, offs = text_bytes(column)
            for i, j in pieces(offs):
                for a in range(i, j, ROWS):
                    b = min(a + ROWS, j)
                    part = data[offs[a] : offs[b]]
                    langs, scores, far = own.nearest(counts(part, offs[a : b + 1] - offs[a]))
                    # ASCII letters settle most texts; for the others every character is looked at.
                    lettered = np.concatenate([[0], np.cumsum((_LETTERS[part] != 0x20) & (part < 0x80))])
                    own_offs = offs[a : b + 1] - offs[a]
                    for k in np.flatnonzero(np.diff(lettered[own_offs]) == 0):
                        if not any(map(str.isalpha, column[a + int(k)].as_py() or "")):
                            langs[k], scores[k], far[k] = UNDETERMINED, 0.0, True
                    for k in np.flatnonzero(far) if reject else ():
                        langs[k] = UNDETERMINED
                    columns = [pa.array(langs, pa.string()), pa.array(scores.astype(float)), pa.array(far)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), *columns], [*keep, "lang_pred", "score", "rejected"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "lang_pred string, score double, rejected boolean"])
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows that the contract keeps from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(~held_out()).select(F.col("doc_id").alias("id"), "text", "lang"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
