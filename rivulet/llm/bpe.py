"""Byte-level BPE: exact encoding by backtracking over longest matches, and decoding.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over the vocabulary
finds every token in a piece. The encoder takes the longest token at each position
and goes on; a token may follow another only if merging the bytes of both gives just
these two (*compatible*). If none fits it steps back to a shorter token. A chain of
compatible neighbours is the one result of the merges, and a position that failed
once is never tried again, so the work is linear in the piece.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.storage import documents
from rivulet.llm.textscan import pieces, text_bytes, trimmed
from rivulet.llm.tokenizers import MARKS, Memo, load_ranks, piece_pattern, split_words, vocabulary_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes that the memos of one process may hold together.
MEMO_TOTAL = 160 << 20


class BytePairEncoder:
    """Encoder and decoder for one vocabulary of token bytes and ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str | None = None, memo_bytes: int = MEMO_TOTAL) -> None:
        self.ranks = ranks
        self.token_bytes = {r: t for t, r in ranks.items()}
        self.find = piece_pattern(pattern).findall
        #: rank -> the two ranks whose merge makes it; a single byte has itself twice.
        self.split: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        #: Whether two tokens may be neighbours, by left << 32 | right.
        self.compatible = Memo(lambda pair: self._compatible(pair >> 32, pair & 0xFFFFFFFF), memo_bytes * 2 // 5)
        self.automaton = ahocorasick.Automaton()
        #: rank -> the longest token that is a shorter prefix of it.
        self.shorter: dict[int, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.split[rank] = (rank, rank)
            elif len(parts := self._merge(token, rank)) == 2:
                self.split[rank] = parts
                self.joined[parts] = rank
            else:
                continue  # no merges lead to it; it only stands for a piece that equals it
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.automaton.make_automaton()
        for rank in self.split:
            token = self.token_bytes[rank]
            for end in range(len(token) - 1, 0, -1):
                if (r := ranks.get(token[:end])) in self.split:
                    self.shorter[rank] = r
                    break
        self.length = [len(self.token_bytes.get(r, b"")) for r in range(max(ranks.values(), default=-1) + 1)]
        self.packed = [r.to_bytes(4, "little") for r in range(len(self.length))]
        self.of_piece = Memo(self._piece, memo_bytes // 10)
        self.of_part = Memo(self._part, memo_bytes // 20)
        self.of_spaced = Memo(self._spaced, memo_bytes * 9 // 20)

    def _merge(self, token: bytes, below: int) -> tuple[int, ...]:
        """The ranks that merging with tokens of rank under ``below`` leaves."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1)))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ranks[p] for p in parts)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens merge to just these two.

        Undo the merges of both, the latest first, and look at the pair of tokens
        that met at the border at each moment: had their merge a lower rank than the
        merge undone before, it would have come first.
        """
        bound = len(self.token_bytes) + 1 << 1
        while True:
            made = self.joined.get((left, right))
            # Twice the rank, plus one for the right side: of equal ranks the left one merges first.
            if made is not None and 2 * made < bound:
                return False
            a, b = self.split[left], self.split[right]
            whole_a, whole_b = a[0] == left, b[0] == right
            if whole_a and whole_b:
                return True
            if not whole_a and (whole_b or left > right):
                bound, left = 2 * left, a[1]
            else:
                bound, right = 2 * right + 1, b[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ranks of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None or not piece:
            return [whole] if piece else []
        size = len(piece)
        longest: list[int] = [-1] * size
        length, shorter, compatible = self.length, self.shorter, self.compatible
        for end, (rank, back) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back] = rank  # ends ascend, so the longest comes last
        failed = bytearray(size + 1)
        out: list[int] = []
        at, before, token = 0, -1, longest[0]
        while True:
            end = at + length[token]
            if not failed[end] and (before < 0 or compatible[before << 32 | token]):
                out.append(token)
                if end == size:
                    return out
                at, before, token = end, token, longest[end]
                continue
            while (token := shorter.get(token, -1)) < 0:
                # No token fits here after the one before, which then gets shorter itself.
                failed[at] = 1
                token = out.pop()
                at -= length[token]
                before = out[-1] if out else -1

    def _piece(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode())
        return np.array(ids, "<u4").tobytes() if len(ids) > 64 else b"".join(map(self.packed.__getitem__, ids))

    def _part(self, part: str) -> bytes:
        return b"".join(map(self.of_piece.__getitem__, self.find(part)))

    def _spaced(self, word: str) -> bytes:
        """Ids of a space and the word; words of letters need no pattern."""
        if word.isalpha():
            return self._piece(" " + word)
        if word[-1:] in MARKS and word[:-1].isalpha():
            return self.of_spaced[word[:-1]] + self.of_piece[word[-1]]
        return self._part(" " + word)

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        parts, spaced = split_words(text)
        return b"".join(map(self.of_part.__getitem__, parts)) + b"".join(map(self.of_spaced.__getitem__, spaced))

    def decode(self, ids: bytes) -> bytes:
        """Bytes that the ids stand for; an id outside the vocabulary is an error."""
        return b"".join(map(self.token_bytes.__getitem__, memoryview(ids).cast("I")))


@functools.lru_cache(maxsize=1)
def encoder(path: str, pattern: str | None = None, memo_bytes: int = MEMO_TOTAL) -> BytePairEncoder:
    """The encoder of a rank file, built once in each process."""
    return BytePairEncoder(load_ranks(path), pattern, memo_bytes)


def bpe_round_trip(
    docs: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    vocabulary: str = VOCABULARY,
    folder: str | None = None,
    decode: bool = True,
    memo_bytes: int = MEMO_TOTAL,
) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns the ``keep`` columns, token_ids (binary: ids as little-endian unsigned
    32-bit integers), n_tokens and, with ``decode``, decoded (binary). One row for
    each input row, repeated rows too; a null or empty text has no ids. Columns not
    kept are ignored, so clashing names do no harm (a kept column must not bear one of
    the three names). An empty table gives no rows, and ties do not arise: the merges
    have one result. Rows are handled one by one without a shuffle; memory is
    bounded by the longest text and the memos, whose size ``memo_bytes`` trades for
    time and never changes a result. ``folder`` replaces the place of the
    vocabulary file on the executors.
    """
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "token_ids binary", "n_tokens bigint", *(["decoded binary"] if decode else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary_path(vocabulary, folder), None, memo_bytes)
        for batch in batches:
            texts = batch.column(len(keep))
            _, offs = text_bytes(texts)
            for i, j in pieces(offs):
                ids = [own.encode(t or "") for t in texts.slice(i, j - i).to_pylist()]
                columns = [*(batch.column(k).slice(i, j - i) for k in range(len(keep))), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decode:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*keep, "token_ids", "n_tokens", *(["decoded"] if decode else [])])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(trimmed(run), schema)


def bpe_decode(rows: DataFrame, ids_col: str = "token_ids", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """Decode binary id columns: the ``keep`` columns and decoded (binary).

    Null or empty ids give empty bytes.
    """
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary_path(vocabulary, folder))
        for batch in batches:
            out = pa.array([own.decode(x or b"") for x in batch.column(len(keep)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), out], [*keep, "decoded"])

    return rows.select(*keep, F.col(ids_col).alias("__ids")).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "decoded binary"]))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    return bpe_round_trip(documents(spark, sf_dir)).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
