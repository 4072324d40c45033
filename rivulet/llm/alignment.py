"""Alignment of two tokenizers over a corpus: which tokens of one end where the other's do.

Two scans of one text give two rows of tokens; where a token of each ends at the same
byte the texts are cut into groups and the two tokens are linked. How often a pair of
ids is linked in the whole corpus, and which partners are an id's most frequent ones,
is decided where all its postings meet:

* a document gives its pairs of ids with their multiplicities;
* tasks pre-aggregate pair counts, which meet by bucket of the B id: counts and the
  highest count of each B id are final there;
* the postings (pair, document, multiplicity), sorted by pair, are dealt to the same
  buckets. A bucket of many postings is split into several units, each with a copy of
  the bucket's counts, so a frequent id is not one task's work. In a unit Spark's
  external sort puts the counts before the postings, which then stream by;
* each unit emits what it adds to documents, and that is summed by document.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.blobs import from_planes, planes
from rivulet.llm.storage import Scratch, bounded_batches, documents
from rivulet.llm.textscan import mix, pieces, text_bytes, trimmed
from rivulet.llm.tokenizers import vocabulary_path

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Records that a task gathers before it packs them, and pairs in a row of counts.
FLUSH, COUNT_ROWS = 1 << 20, 1 << 17
#: Buckets of B ids at most, so that what a flush sends to one is not a few records.
MOST_BUCKETS = 4096
#: Postings of a unit, about.
UNIT = 1 << 23
#: U+2581 stands for a space in pieces.
SPACE_MARK = "▁"
_SPACED = re.compile(r" +[^ ]*|[^ ]+")


def byte_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable bytes stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Ids of a byte-level vocabulary of the tokenizers library, without special tokens.

    Where merges are in the order of their ids, ids serve as ranks for a faster library.
    Special strings are plain text.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        alphabet = byte_alphabet()
        as_bytes = lambda content: bytes(map(alphabet.__getitem__, content)) if all(c in alphabet for c in content) else content.encode()
        vocabulary = made["model"].get("vocab") or {}
        known = {**vocabulary, **{t["content"]: t["id"] for t in made.get("added_tokens") or []}} if isinstance(vocabulary, dict) else {}
        self.token = [b""] * (max(known.values(), default=-1) + 1)
        for content, i in known.items():
            self.token[i] = as_bytes(content)
        self.ranks = None
        if self._by_rank(made, vocabulary):
            import public_tokenizers
            import tiktoken

            ranks = {as_bytes(content): i for content, i in vocabulary.items()}
            self.ranks = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            self.library.encode_special_tokens = True

    @staticmethod
    def _by_rank(made: dict, vocabulary: dict) -> bool:
        pre, model = made.get("pre_tokenizer") or {}, made["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and made.get("normalizer") is None
        if not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or not all(c in vocabulary for c in byte_alphabet()):
            return False
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocabulary.get(x + y, -1) for x, y in merges]
        return all(i < j for i, j in zip([255, *ids], ids)) and len(merges) + 256 == len(vocabulary)

    def ids(self, texts: list[str]) -> list[bytes | None]:
        """Ids of each space and text as 32-bit integers; None where their bytes differ from it."""
        if self.ranks is None:
            return [self._whole(" " + t) for t in texts]
        return [self.ranks.encode_to_numpy(" " + t, disallowed_special=()).tobytes() for t in texts]

    def _whole(self, text: str) -> bytes | None:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes() if b"".join(map(self.token.__getitem__, ids)) == text.encode() else None


class Pieces:
    """Ids of a sentencepiece model, which itself puts a space before a text.

    Where no piece has a space after another character, merges never cross from a
    character to a space after it, so what stands between is encoded once for the texts
    at hand; words of one language repeat within a megabyte as they do beyond. A model that
    leaves texts as they are and has a piece for every byte loses nothing but the sign
    that it uses for spaces itself.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        self.token = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(names)]
        probe = "a  b \tﬁ "
        own = library.normalize(probe) == (" " + probe).replace(" ", SPACE_MARK) and sum(map(library.is_byte, range(len(names)))) == 256
        self.by_word = own and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in names)

    def _encode(self, words: list[str]) -> Iterator[bytes]:
        # The space before a word is all there is of a last one; the library has nothing for an empty text.
        lone = array("I", [self.library.piece_to_id(SPACE_MARK)]).tobytes()
        for word, ids in zip(words, self.library.encode(words, num_threads=1)):
            yield array("I", ids).tobytes() if word else lone

    def ids(self, texts: list[str]) -> list[bytes | None]:
        """Ids of each text as 32-bit integers; None where their bytes differ from space and text."""
        if not self.by_word:
            return [self._whole(t) for t in texts]
        odd = lambda t: "  " in t or t[0] == " " or t[-1] == " "
        cut = [None if SPACE_MARK in t else [w[1:] for w in _SPACED.findall(" " + t)] if odd(t) else t.split(" ") for t in texts]
        distinct = list({w for words in cut if words for w in words})
        word = dict(zip(distinct, self._encode(distinct))).__getitem__
        return [None if words is None else b"".join(map(word, words)) for words in cut]

    def _whole(self, text: str) -> bytes | None:
        ids = self.library.encode(text, num_threads=1)
        return array("I", ids).tobytes() if b"".join(map(self.token.__getitem__, ids)) == b" " + text.encode() else None


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a vocabulary file with ``sizes`` (bytes of each token), made once in each process."""
    made = (Pieces if path.endswith(".model") else ByteLevel)(path)
    made.sizes = np.array([len(t) for t in made.token], np.int64)
    return made


@functools.lru_cache(maxsize=2)
def decimals(many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digits with a free last column, which of them are used, how many) of each id."""
    width = len(str(many))
    left, digits = np.arange(many), np.zeros((many, width + 1), np.uint8)
    for k in range(width - 1, -1, -1):
        digits[:, k] = 48 + left % 10
        left //= 10
    used = np.zeros((many, width + 1), bool)
    for k in range(width + 1):
        used[:, k] = np.arange(many) >= 10 ** (width - 1 - k) if k < width - 1 else True
    return digits, used, used.sum(1)


def grouped(a: np.ndarray, b: np.ndarray, link_a: np.ndarray, link_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters of `a1,a2|b1;a3|b2,b3;` , characters before each A token) of aligned rows.

    ``link_a`` and ``link_b`` are the places of the tokens that end each group.
    """
    into_a = np.searchsorted(link_a, np.arange(len(a)), "left")  # groups before
    into_b = np.searchsorted(link_b, np.arange(len(b)), "left")
    at_a = np.arange(len(a)) + np.concatenate([[0], link_b + 1])[into_a]
    at_b = np.arange(len(b)) + link_a[into_b] + 1
    tokens, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    tokens[at_a], tokens[at_b] = a, b
    marks[at_a[link_a]], marks[at_b[link_b]] = ord("|"), ord(";")
    digits, used, many = decimals(1 << int(max(tokens.max(initial=0), 1)).bit_length())
    rows = digits[tokens]
    rows[:, -1] = marks
    return rows[used[tokens]], np.concatenate([[0], np.cumsum(many[tokens])])[at_a]


def encode(docs: DataFrame, names: tuple[str, str], folder: str | None, with_groups: bool) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256[, groups], pairs) of (id, text) rows.

    ``pairs`` packs the distinct linked pairs of the document and their multiplicities.
    """
    group_type = "groups string, " if with_groups else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = (encoder(vocabulary_path(n, folder)) for n in names)
        wide = len(first.token)
        for batch in batches:
            _, offs = text_bytes(batch.column(1))
            for i, j in pieces(offs):
                ids_a, ids_b, n = [], [], j - i
                n_a, n_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
                texts = {k: t for k, t in enumerate(batch.column(1).slice(i, n).to_pylist()) if t}
                for k, x, y in zip(texts, first.ids([*texts.values()]), second.ids([*texts.values()])):
                    if x and y:
                        ids_a.append(x)
                        ids_b.append(y)
                        n_a[k], n_b[k] = len(x) // 4, len(y) // 4
                del texts
                a, b = np.frombuffer(b"".join(ids_a), "<u4").astype(np.int64), np.frombuffer(b"".join(ids_b), "<u4").astype(np.int64)
                del ids_a, ids_b
                ends_a, ends_b = np.cumsum(first.sizes[a]), np.cumsum(second.sizes[b])
                at = np.searchsorted(ends_b, ends_a)
                link_a = np.flatnonzero(ends_b[at] == ends_a) if len(a) else np.zeros(0, np.int64)
                link_b = at[link_a]
                chars, start = grouped(a, b, link_a, link_b)
                doc = np.searchsorted(np.cumsum(n_a), link_a, "right")
                n_groups = np.bincount(doc, minlength=n).astype(np.int64)
                bounds = np.concatenate([start, [len(chars)]])[np.concatenate([[0], np.cumsum(n_a)])]
                text_of = [bytes(chars[x : y - 1]) if y > x else b"" for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                pair = b[link_b] * wide + a[link_a]
                order = np.lexsort((pair, doc))
                doc, pair = doc[order], pair[order]
                new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1]))) if len(doc) else np.zeros(0, np.int64)
                many = np.diff(np.append(new, len(doc))).astype(np.uint32)
                doc, pair = doc[new], pair[new]
                cuts = np.searchsorted(doc, np.arange(n + 1))
                blobs = [planes(pair[x:y]) + planes(many[x:y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                shas = [hashlib.sha256(t).hexdigest() if t else "" for t in text_of]
                columns = [batch.column(0).slice(i, n), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(shas, pa.string())]
                labels = ["id", "n_a", "n_b", "n_groups", "groups_sha256"]
                if with_groups:
                    columns, labels = [*columns, pa.array([t.decode() for t in text_of], pa.string())], [*labels, "groups"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.binary())], [*labels, "pairs"])

    id_type = dict(docs.dtypes)["id"]
    counts = "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string"
    return docs.mapInArrow(trimmed(run), f"id {id_type}, {counts}, {group_type}pairs binary")


def packed(group: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(group, packed columns) for each run of equal groups."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    for x, y in zip(first.tolist(), [*first[1:].tolist(), len(group)]):
        yield int(group[x]), b"".join(planes(c[x:y]) for c in columns)


def unpacked(blob: bytes, types: tuple[str, ...]) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize for t in types]
    n = len(blob) // sum(sizes)
    return [from_planes(blob, t, n, n * sum(sizes[:k])) for k, t in enumerate(types)]


def summed(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and the sums of the values of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return [key[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)]


class Running:
    """Sums by key of records that come in parts; holds the distinct keys and ``FLUSH`` records."""

    def __init__(self, values: int) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.held, self.values = 0, values

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(list(columns))
        self.held += len(columns[0])
        if self.held > FLUSH + 2 * len(self.parts[0][0]):
            self.parts, self.held = [self.sums()], 0

    def sums(self) -> list[np.ndarray]:
        empty = [np.zeros(0, np.int64)] * (1 + self.values)
        return summed(*(np.concatenate(c) for c in zip(empty, *self.parts)))


PAIRS = ("<i8", "<u4")
COUNTS = ("<i8", "<i8", "<i8", "u1")
POSTINGS = ("<i8", "<i8", "<u4")
PARTS = ("<i8", "<i8", "<i8")


def pair_counts(aligned: DataFrame, wide: int, buckets: int) -> DataFrame:
    """(bucket, postings, blob) rows: pairs, counts, postings and whether the count is their B id's highest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Running(2)

        def rows() -> Iterator[pa.RecordBatch]:
            pair, n, postings = own.sums()
            bucket = bucket_of(pair // wide, buckets)
            order = np.argsort(bucket, kind="stable")
            made = list(packed(bucket[order], [pair[order], n[order], postings[order]]))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int32()), pa.array([b for _, b in made], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for blob in batch.column(0):
                pair, many = unpacked(blob.as_buffer().to_pybytes(), PAIRS)
                own.add(pair, many.astype(np.int64), np.ones(len(pair), np.int64))
            if len(own.parts) and len(own.parts[0][0]) > 2 * FLUSH:
                yield from rows()
                own = Running(2)
        yield from rows()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Running] = {}
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums.setdefault(bucket, Running(2)).add(*unpacked(blob, PARTS))
        for bucket, own in sums.items():
            pair, n, postings = own.sums()
            if not len(pair):
                continue
            first = np.flatnonzero(np.append(True, np.diff(pair // wide) != 0))
            best = np.maximum.reduceat(n, first)
            top = (n == np.repeat(best, np.diff(np.append(first, len(pair))))).astype(np.uint8)
            for x in range(0, len(pair), COUNT_ROWS):
                y = x + COUNT_ROWS
                blob = b"".join(planes(c[x:y]) for c in (pair, n, postings, top))
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([int(postings[x:y].sum())], pa.int64()), pa.array([blob], pa.binary())], ["bucket", "postings", "blob"])

    counted = aligned.select("pairs").mapInArrow(trimmed(count), "bucket int, blob binary")
    return counted.repartitionById(buckets, "bucket").mapInArrow(trimmed(settle), "bucket int, postings bigint, blob binary")


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def contributions(aligned: DataFrame, counts: DataFrame, units: list[int], wide: int, doc_buckets: int) -> DataFrame:
    """(key, n_best, count_sum) of each document with links.

    ``units`` has the number of units of each bucket; a task deals all of one flush to
    one unit of each bucket, the next flush to the next.
    """
    first = np.concatenate([[0], np.cumsum(units)])
    total = int(first[-1])
    parts = np.array(units)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = range(int(first[bucket]), int(first[bucket + 1]))
                for unit in own:
                    yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([0], pa.int32()), pa.array([blob.as_py()], pa.binary())], ["unit", "phase", "blob"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[list[np.ndarray]] = []
        held = turn = 0

        def rows() -> pa.RecordBatch:
            nonlocal turn
            pair, key, many = (np.concatenate(c) for c in zip(*gathered))
            if not turn:
                turn = int(key[0]) % 65_521  # the same at each run of the task
            order = np.argsort(pair, kind="stable")
            pair, key, many = pair[order], key[order], many[order]
            bucket = bucket_of(pair // wide, len(units))
            order = np.argsort(bucket, kind="stable")
            unit = (first[bucket] + turn % parts[bucket])[order]
            made = list(packed(unit, [pair[order], key[order], many[order]]))
            turn += 1
            phases = pa.array([1] * len(made), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int32()), phases, pa.array([b for _, b in made], pa.binary())], ["unit", "phase", "blob"])

        for batch in batches:
            for own, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                pair, many = unpacked(blob.as_buffer().to_pybytes(), PAIRS)
                if len(pair):
                    gathered.append([pair, np.full(len(pair), own, np.int64), many])
                    held += len(pair)
                if held > FLUSH:
                    yield rows()
                    gathered, held = [], 0
        if gathered:
            yield rows()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a unit come first, then its postings stream by."""
        unit, known, sums = None, [], Running(2)
        pairs = n = top = np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            key, best, count = sums.sums()
            bucket = bucket_of(key, doc_buckets)
            order = np.argsort(bucket, kind="stable")
            made = list(packed(bucket[order], [key[order], best[order], count[order]]))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int32()), pa.array([b for _, b in made], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for now, phase, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if now != unit:
                    unit, known, pairs = now, [], None
                raw = blob.as_buffer().to_pybytes()
                if phase == 0:
                    known.append(unpacked(raw, COUNTS))
                    continue
                if pairs is None:
                    known.sort(key=lambda c: int(c[0][0]))
                    pairs, n, _, top = (np.concatenate(c) for c in zip(*known))
                    top = top.astype(np.int64)
                    known = []
                pair, key, many = unpacked(raw, POSTINGS)
                at = np.searchsorted(pairs, pair)
                many = many.astype(np.int64)
                sums.add(key, many * top[at], many * n[at])
            if len(sums.parts) and len(sums.parts[0][0]) > 2 * FLUSH:
                yield rows()
                sums = Running(2)
        yield rows()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Running(2)
        for batch in batches:
            for blob in batch.column(1):
                sums.add(*unpacked(blob.as_buffer().to_pybytes(), PARTS))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in sums.sums()], ["key", "n_best", "count_sum"])

    schema = "unit int, phase int, blob binary"
    streams = counts.select("bucket", "blob").mapInArrow(copies, schema).unionByName(aligned.select("key", "pairs").mapInArrow(trimmed(post), schema))
    met = streams.repartitionById(total, "unit").sortWithinPartitions("unit", "phase").mapInArrow(trimmed(meet), "bucket int, blob binary")
    return met.repartitionById(doc_buckets, "bucket").mapInArrow(trimmed(gather), "key bigint, n_best bigint, count_sum bigint")


class Alignment:
    """Links of two tokenizers over ``docs``: ``documents()`` and ``pairs()``.

    A text that is null or empty, or that either tokenizer does not give back byte by
    byte, has no tokens: its numbers are 0 and its groups ''. Repeated rows and ids each
    get a row and each count. Ids may be null. Other columns are ignored; an empty table
    gives no rows. A very long text bounds the memory of the task that encodes it.
    """

    def __init__(
        self,
        docs: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        first: str = FIRST,
        second: str = SECOND,
        folder: str | None = None,
        with_groups: bool = False,
        unit: int = UNIT,
    ) -> None:
        spark = docs.sparkSession
        self.id_col, self.scratch = id_col, Scratch(spark)
        self.wide = len(encoder(vocabulary_path(first, folder)).token)
        self.buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
        rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        aligned = encode(rows, (first, second), folder, with_groups)
        # Numbers of rows are fixed as they are written.
        self.aligned = self.scratch.write(aligned.withColumn("key", F.monotonically_increasing_id()), "aligned")
        self.counts = self.scratch.write(pair_counts(self.aligned, self.wide, self.buckets), "counts")
        self.unit = unit

    def documents(self) -> DataFrame:
        """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) of every row."""
        sizes = dict(self.counts.groupBy("bucket").agg(F.sum("postings")).collect())  # MOST_BUCKETS rows
        units = [max(1, -(-sizes.get(k, 0) // self.unit)) for k in range(self.buckets)]
        sums = contributions(self.aligned, self.counts, units, self.wide, int(self.aligned.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = self.aligned.drop("pairs").join(sums, "key", "left")
        own = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_best", "count_sum")]
        groups = [c for c in ("groups",) if c in rows.columns]
        return rows.select(F.col("id").alias(self.id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *own, "groups_sha256", *groups)

    def pairs(self) -> DataFrame:
        """(a, b, links, best): every linked pair of ids, its count, and whether no A id has more with this B id."""
        wide = self.wide

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column(0):
                    pair, n, _, top = unpacked(blob.as_buffer().to_pybytes(), COUNTS)
                    yield pa.RecordBatch.from_arrays([pa.array(pair % wide), pa.array(pair // wide), pa.array(n), pa.array(top > 0)], ["a", "b", "links", "best"])

        return self.counts.select("blob").mapInArrow(run, "a bigint, b bigint, links bigint, best boolean")

    def release(self) -> None:
        """Delete the stored tables, once results have been written."""
        self.scratch.release()


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document under both tokenizers."""
    return Alignment(bounded_batches(documents(spark, sf_dir))).documents()
