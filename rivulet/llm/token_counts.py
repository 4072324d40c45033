"""Token counts through a digest cache.

Texts are normalised as the tokenizer itself normalises them (a byte-level one leaves
them as they are) and named by the digest of the result; a second digest names the
tokenizer's version (the bytes of its file and the options that change counts). Counts
already stored for both digests are joined in; only distinct texts without one are
encoded, and their counts are appended to the cache, a Parquet table in a shared folder.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.filters import KeyFilter
from rivulet.llm.storage import Scratch, documents, fresh_path, join_counted
from rivulet.llm.textscan import pieces, text_bytes
from rivulet.llm.tokenizers import MARKS, WORD_BYTES, Memo, piece_pattern, split_words, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
#: Token counts above this are flagged; fixed by the contract.
LIMIT = 512
CACHE_SCHEMA = "content binary, version string, n_tokens bigint"


class LibraryCounter:
    """Counts tokens as the tokenizers library does, without added begin or end tokens.

    For byte-level files (pieces by the known pattern, no normaliser, no truncation)
    the pieces of a text are independent, so the library is asked once for each
    distinct piece and its answer is remembered. Special strings stand for themselves
    first, as is the library's default. For any other file whole texts are encoded.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        added = made.get("added_tokens") or []
        self.by_piece = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and made.get("normalizer") is None
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
        )
        special = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.normalises = made.get("normalizer") is not None
        self.find = piece_pattern().findall
        self.of_piece = Memo(self._ask)
        self.of_part = Memo(lambda part: sum(map(self.of_piece.__getitem__, self.find(part))))
        self.of_spaced = Memo(self._spaced, WORD_BYTES)

    def normalised(self, text: str) -> str:
        """What decides a text's count: the text as the tokenizer's normaliser leaves it.
        A text with special strings, which are found before that, stands for itself."""
        if self.special is not None and self.special.search(text):
            return f"special {text}"
        return f"plain {self.library.normalizer.normalize_str(text)}"

    def _ask(self, piece: str) -> int:
        return len(self.library.encode(piece, add_special_tokens=False).ids)

    def _spaced(self, word: str) -> int:
        if word.isalpha():
            return self._ask(" " + word)
        if word[-1:] in MARKS and word[:-1].isalpha():
            return self.of_spaced[word[:-1]] + self.of_piece[word[-1]]
        return sum(map(self.of_piece.__getitem__, self.find(" " + word)))

    def _plain(self, text: str) -> int:
        parts, spaced = split_words(text)
        return sum(map(self.of_part.__getitem__, parts)) + sum(map(self.of_spaced.__getitem__, spaced))

    def count(self, text: str) -> int:
        if not self.by_piece:
            return self._ask(text)
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1


class SentencePieceCounter:
    """Counts of a sentencepiece model; whole texts, no begin or end tokens."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    normalises = True

    def normalised(self, text: str) -> str:
        return self.library.normalize(text)

    def count(self, text: str) -> int:
        return len(self.library.encode(text, num_threads=1))


@functools.lru_cache(maxsize=4)
def counter(path: str):
    """The counter for a vocabulary file, made once in each process."""
    return (SentencePieceCounter if path.endswith(".model") else LibraryCounter)(path)


def tokenizer_version(path: str) -> str:
    """Digest of all that a count depends on besides the text."""
    with open(path, "rb") as f:
        return hashlib.sha256(b"no begin or end tokens, no truncation\0" + f.read()).hexdigest()


class CountCache:
    """Stored counts by content and version digests: a Parquet table at ``path``.

    Appends are whole jobs: a job that fails leaves nothing to read, and writers that
    add the same text agree, so lookups take one count for each pair of digests.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, version: str) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], CACHE_SCHEMA).select("content", "n_tokens")
        rows = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path)
        return rows.filter(F.col("version") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, version: str) -> None:
        counts.select("content", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(self.path)


def count_texts(texts: DataFrame, vocabulary: str, folder: str | None) -> DataFrame:
    """(content, n_tokens) for (content, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary_path(vocabulary, folder))
        for batch in batches:
            column = batch.column(1)
            _, offs = text_bytes(column)
            for i, j in pieces(offs):
                counts = pa.array([own.count(t or "") for t in column.slice(i, j - i).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), counts], ["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(run, "content binary, n_tokens bigint")


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    folder: str | None = None,
    cache_path: str | None = None,
) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row.

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows each get a row; a
    text that occurs often is encoded once, and its rows meet its count by broadcast. The
    version digest is part of the key, so one cache serves several tokenizers.
    ``cache_path`` names a cache to use and to extend; without one a new cache is made
    for this call. Other columns are ignored. An empty table gives no rows; a very long
    text bounds the memory of its task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    version = tokenizer_version(vocabulary_path(vocabulary, folder))
    cache = CountCache(spark, cache_path or fresh_path(spark, "token-counts"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = named_texts(rows, vocabulary, folder)
    digests = scratch.write(rows.select("id", "content", F.octet_length("text").cast("bigint").alias("n_bytes")), "digests")
    # One text for each digest: copies meet on the map side first.
    missing = rows.select("content", "text")
    if cache.exists():
        # Digests alone are looked up; of the texts only those without a count are shuffled.
        wanted = scratch.write(digests.select("content").distinct().join(cache.read(version), "content", "left_anti"), "wanted")
        missing = KeyFilter(wanted, "content", scratch).mark(missing, F.col("content"), "maybe").filter("maybe").drop("maybe")
    distinct = missing.groupBy("content").agg(F.first("text").alias("text"))
    if cache.exists():
        distinct = distinct.join(wanted, "content", "left_semi")
    cache.append(count_texts(distinct, vocabulary, folder), version)
    sizes = digests.groupBy("content").agg(F.count("*").alias("rows")).join(cache.read(version), "content")
    found = join_counted(digests, sizes, "content", "rows", digests.count())
    return scratch.finish(found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens"), "counts")


def named_texts(rows: DataFrame, vocabulary: str, folder: str | None) -> DataFrame:
    """(id, text, content) rows: content is the digest of the normalised text."""
    if not counter(vocabulary_path(vocabulary, folder)).normalises:
        return rows.withColumn("content", F.unhex(F.sha2("text", 256)))
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary_path(vocabulary, folder))
        for batch in batches:
            digests = [hashlib.sha256(own.normalised(t).encode()).digest() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], ["id", "text", "content"])

    return rows.select("id", "text").mapInArrow(run, f"id {types['id']}, text string, content binary")


#: Batches in which the registered query counts: the second finds texts of the first stored.
BATCHES = 2


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte and token counts of every document, flagged above the limit.

    The table is counted in batches that share one cache, as a growing corpus is.
    """
    docs, path = documents(spark, sf_dir), fresh_path(spark, "token-counts")
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES))
    parts = [token_counts(docs.filter(batch == k), cache_path=path) for k in range(BATCHES)]
    return functools.reduce(DataFrame.unionByName, parts).withColumn("over_limit", F.col("n_tokens") > LIMIT)
