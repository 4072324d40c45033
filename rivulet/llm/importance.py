"""Resampling towards a target distribution by importance weights of hashed n-grams.

A feature is a run of one to ``n`` words, its bucket the crc32 of its bytes. What the
buckets hold in the corpus and in the target gives each bucket a gain; a document's
weight is the sum of its features' gains, and noise from its id turns the order by
weight into a draw without replacement (the largest perturbed weights).

Long texts are cut into chunks at word boundaries. A chunk also carries the n - 1 words
after it, but owns only the features that start in its own part, so each feature is
counted once, in whichever task the chunk is; counts and weights are then summed by
document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.storage import Scratch, bounded_batches, documents
from rivulet.llm.textscan import LOWER, pieces, separators, text_bytes, trimmed, word_spans

#: Everything that is neither a digit, a letter a-z nor beyond ASCII, once lowered.
SEPARATORS = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_GAP, _WORD = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of text from which a document is dealt out in chunks of so many bytes.
CHUNK = 1 << 16
#: Fixed by the contract: buckets, longest run, fewest words of a drawn document, percent drawn, noise.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Longer words are hashed by a library.
LANES = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc_continued(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of what each ``crc`` stands for, followed by the span's bytes."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")  # the spans that go on are always a prefix
    state, at, size = ~crc[order], starts[order], size[order]
    live = np.searchsorted(-size, -np.arange(min(int(size[0]) if len(size) else 0, LANES)), "left")
    for k, many in enumerate(live.tolist()):
        own = state[:many]
        state[:many] = _CRC[(own ^ data[at[:many] + k]) & np.uint32(255)] ^ (own >> np.uint32(8))
    state = ~state
    for k in range(int(np.searchsorted(-size, -LANES, "left"))):
        state[k] = zlib.crc32(data[at[k] + LANES : at[k] + size[k]].tobytes(), int(state[k]))
    out = np.empty_like(state)
    out[order] = state
    return out


def cut(raw: bytes, size: int, carry: int) -> Iterator[tuple[bytes, int]]:
    """(bytes, bytes that are its own) of each chunk: cut where no word is divided."""
    at = 0
    while at < len(raw):
        gap = _GAP.search(raw, min(at + size, len(raw)))
        own = gap.start() if gap else len(raw)
        end = own
        if carry:
            for k, word in enumerate(_WORD.finditer(raw, own)):
                end = word.end()
                if k + 1 == carry:
                    break
        yield raw[at:end], own - at
        at = own


def feature_buckets(data: np.ndarray, offs: np.ndarray, own: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """(own words of each chunk, (chunk, bucket) arrays for each length of run)."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offs, SEPARATORS)
    chunk = np.repeat(np.arange(len(own)), np.diff(first))
    owned = starts < (offs[:-1] + own)[chunk]
    words = np.bincount(chunk[owned], minlength=len(own)).astype(np.int64)

    def runs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        crc = crc_continued(np.zeros(len(starts), np.uint32), data, starts, ends)
        for size in range(1, longest + 1):
            if size > 1:
                crc = crc[:-1]
                crc = _CRC[(~crc ^ np.uint32(0x20)) & np.uint32(255)] ^ (~crc >> np.uint32(8))
                crc = crc_continued(~crc, data, starts[size - 1 :], ends[size - 1 :])
            inside = owned[: len(crc)] & (chunk[: len(crc)] == chunk[size - 1 :])
            yield chunk[: len(crc)][inside], crc[inside] % np.uint32(buckets)
            if len(crc) < 2:
                return

    return words, runs()


def chunked(texts: DataFrame, size: int, carry: int) -> DataFrame:
    """(key columns, chunk, own bytes, ordinal) of (key columns, text) rows, dealt over all tasks."""
    names = [c for c in texts.columns if c != "text"]
    types = "".join(f"{c} {t}, " for c, t in texts.dtypes if c != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.select(names)
            for k in range(batch.num_rows):
                made, held = [], 0
                # A few chunks at a time: the text is never held twice.
                for n, (raw, own) in enumerate(cut(batch.column("text")[k].as_py().encode(), size, carry)):
                    made.append((raw, own, n))
                    held += len(raw)
                    if held > 1 << 20:
                        yield _chunk_rows(keys, k, made)
                        made, held = [], 0
                if made:
                    yield _chunk_rows(keys, k, made)

    # In turn, whatever the keys: partitions of one size, as many as the chunks need.
    return texts.mapInArrow(run, f"{types}chunk binary, own int, ordinal bigint").hint("rebalance")


def _chunk_rows(keys: pa.RecordBatch, k: int, made: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    fixed = [keys.column(c).slice(k, 1).take(pa.array([0] * len(made))) for c in keys.schema.names]
    chunk, own, ordinal = zip(*made)
    return pa.RecordBatch.from_arrays([*fixed, pa.array(chunk, pa.binary()), pa.array(own, pa.int32()), pa.array(ordinal, pa.int64())], [*keys.schema.names, "chunk", "own", "ordinal"])


def _whole(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets, own bytes) of parts of a batch of texts or chunks."""
    chunks = "chunk" in batch.schema.names
    column = batch.column("chunk" if chunks else "text")
    if chunks:  # whole words and characters: the bytes are UTF-8
        column = column.cast(pa.string())
    data, offs = text_bytes(column)
    own = batch.column("own").to_numpy().astype(np.int64) if chunks else np.diff(offs)
    for i, j in pieces(offs):
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], own[i:j]


def bucket_counts(texts: DataFrame, longest: int, buckets: int, chunk: int) -> DataFrame:
    """(bucket, n): features in each bucket over the ``text`` column; each task sums its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offs, own in _whole(batch):
                for _, slots in feature_buckets(data, offs, own, longest, buckets)[1]:
                    total += np.bincount(slots, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    short, long = _by_length(texts.select("text"), chunk)
    schema = "bucket bigint, n bigint"
    parts = short.mapInArrow(trimmed(run), schema).unionByName(chunked(long, chunk, longest - 1).mapInArrow(trimmed(run), schema))
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def _by_length(texts: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    length = F.octet_length("text")
    return texts.filter(length <= chunk), texts.filter(length > chunk)


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket, from (bucket, n) rows of corpus and target.

    ``buckets`` bounds what comes to the driver and what tasks are sent.
    """
    n = F.coalesce("n", F.lit(0))
    all_buckets = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    s = all_buckets.join(source, "bucket", "left").select("bucket", n.alias("s"))
    t = all_buckets.join(target, "bucket", "left").select("bucket", n.alias("t"))
    both = s.join(t, "bucket")
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    d = {c: F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t")}
    more = F.lit(float(buckets))
    ratio = (d["t"] + 1.0) * (d["all_s"] + more) / ((d["s"] + 1.0) * (d["all_t"] + more))
    rows = both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("bigint").alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, gain in rows:
        out[bucket] = gain
    return out


def weighted(rows: DataFrame, gain: np.ndarray, longest: int, chunk: int) -> DataFrame:
    """(id, n_words, n_features, weight) of (id, text) rows; one row for each.

    The chunks of a long text meet again by id and digest of the text. Rows that repeat
    both have equal sums, so they are summed together and divided by their number.
    """
    shared = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            names = [c for c in batch.schema.names if c not in ("text", "chunk", "own")]
            for i, j, data, offs, own in _whole(batch):
                words, runs = feature_buckets(data, offs, own, longest, len(gain))
                features, weight = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for at, slots in runs:
                    features += np.bincount(at, minlength=j - i)
                    if len(at):  # rows of one chunk stand together
                        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                        weight[at[first]] += np.add.reduceat(gain[slots], first)
                part = batch.select(names).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(words), pa.array(features), pa.array(weight)], [*names, "n_words", "n_features", "weight"])

    sums = "n_words bigint, n_features bigint, weight bigint"
    id_type = dict(rows.dtypes)["id"]
    short, long = _by_length(rows, chunk)
    here = short.mapInArrow(trimmed(run), f"id {id_type}, {sums}")
    long = long.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    dealt = chunked(long, chunk, longest - 1).mapInArrow(trimmed(run), f"id {id_type}, digest binary, ordinal bigint, {sums}")
    copies = F.sum((F.col("ordinal") == 0).cast("bigint"))
    names = ["n_words", "n_features", "weight"]
    met = dealt.groupBy("id", "digest").agg(copies.alias("copies"), *(F.sum(c).alias(c) for c in names))
    apart = met.select("id", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")), *(F.expr(f"{c} div copies").alias(c) for c in names))
    return here.unionByName(apart.select("id", *names))


def gumbel(id_: Column, seed: int) -> Column:
    """Noise in thousandths from the digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def numbered(rows: DataFrame, scratch: Scratch, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3 ...) in this order.

    Ranges of the order are sorted in tasks of their own; the sizes of the ranges before
    (a number a task) are then added to the places in a range.
    """
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(many, *order).sortWithinPartitions(*order)
    placed = scratch.write(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in placed.groupBy(part).count().collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    # As an array by range: ranges are as many as tasks.
    first = F.array(*(F.lit(before.get(p, 0)).cast("bigint") for p in range(max(before, default=0) + 1)))
    return placed.withColumn("rank", F.get(first, part.cast("int")) + at + 1).drop("__at")


def importance_weights(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    chunk: int = CHUNK,
) -> DataFrame:
    """(id, n_features, weight, score, rank) for every row of ``docs``.

    Of the documents with ``least_words`` words, ``percent`` of a hundred with the highest
    scores are drawn and ranked, ties to the smaller id; rank is null for all others.

    A null text has no words: no features, weight 0. A row without an id has a weight, but
    neither score nor rank, and does not count among those drawn from. Repeated rows each
    count, are weighed and ranked (rows with equal ids in any order). Texts without words
    are never drawn. Other columns are ignored. Empty tables give no rows; an empty target
    leaves the gains to the corpus. Texts over ``chunk`` bytes are dealt over tasks in
    chunks; only one that is itself held by the scan bounds a task's memory.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    wanted = target.select(F.coalesce(F.col(f"`{target_text_col}`"), F.lit("")).alias("text"))
    gain = gains(bucket_counts(rows, longest, buckets, chunk), bucket_counts(wanted, longest, buckets, chunk), buckets)
    weights = weighted(rows, gain, longest, chunk).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    weights = scratch.write(weights, "weights")
    able = weights.filter((F.col("n_words") >= least_words) & F.col("id").isNotNull())
    drawn = able.count() * percent // 100
    ranks = numbered(able, scratch, F.col("score").desc(), F.col("id").asc())
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = weights.filter((F.col("n_words") < least_words) | F.col("id").isNull()).withColumn("rank", F.lit(None).cast("bigint"))
    return ranks.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns (ids are taken to be unique)."""
    drawn = importance_weights(docs, target, id_col, **how).filter("rank is not null").select(F.col(id_col).alias("__drawn"))
    return docs.join(drawn, docs[f"`{id_col}`"] == drawn["__drawn"], "left_semi")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and place of every document in a draw towards the benchmark."""
    return importance_weights(documents(spark, sf_dir), bounded_batches(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


#: crc32 byte by byte over a table of 256 remainders, made by eight halvings each.
ORACLE = """
WITH RECURSIVE remainders AS (
  SELECT range AS byte, range::BIGINT AS value, 0 AS step FROM range(256)
  UNION ALL
  SELECT byte, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END, step + 1 FROM remainders WHERE step < 8
),
crc AS (SELECT list(value ORDER BY byte) AS remainder FROM remainders WHERE step = 8),
doc_words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM documents
),
item_words AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark
),
vocabulary AS (
  SELECT word, list_transform(range(octet_length(encode(word))), lambda k: ('0x' || substr(hex(encode(word)), 2 * k + 1, 2))::BIGINT) AS bytes
  FROM (SELECT word FROM doc_words UNION SELECT word FROM item_words)
),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, remainder[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc
),
source AS (SELECT bucket, count(*) AS n FROM doc_words JOIN hashed USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS n FROM item_words JOIN hashed USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln(
    (coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT count(*) FROM doc_words)::DOUBLE + 10000)
    / ((coalesce(s.n, 0)::DOUBLE + 1) * ((SELECT count(*) FROM item_words)::DOUBLE + 10000))))::BIGINT AS gain
  FROM source s FULL JOIN target t USING (bucket)
),
sums AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM doc_words JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN sums USING (doc_id)
),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
