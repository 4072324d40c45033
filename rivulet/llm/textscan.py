"""Vectorised scans of Arrow text columns: word spans, word hashes, window hashes.

Everything works on the UTF-8 bytes of many documents at once. Words are hashed eight
bytes at a time and windows of words by doubling, each step through ``mix``: unlike a
polynomial modulo 2**64 this has no fixed patterns that always collide. Hashes of
different seeds are independent. ``powers`` serves rolling hashes only, which choose
places and never decide that texts are equal.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 20

#: Longer spans are hashed by a library.
LANES = 32

_U = np.uint64
_MAX = (1 << 64) - 1
_SEED = 0xA0761D6478BD642F
_JOIN = _U(0xE7037ED1A0B428DB)
#: Masks that keep the first 0 to 8 bytes of a lane.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240125).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags that are true inside the given inclusive byte ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Space and \t \n \v \f \r.
WHITE_SPACE = separators((0x20, 0x20), (0x09, 0x0D))
#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes (splitmix64's constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept while small."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        made = np.full(max(n, 1 << 16), base, np.uint64)
        made[0] = 1
        have = np.multiply.accumulate(made)
        if len(have) <= CHUNK_BYTES + 1:
            _powers[base] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of the documents); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together, or of one document."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, index of each document's first word).

    Words are maximal runs of bytes that ``sep`` does not flag and never cross
    documents. The third array has one more entry than there are documents.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~sep[data]
    flags = np.empty(n, bool)
    flags[0], flags[1:] = False, inside[:-1]
    flags[offs[:-1][offs[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~flags)
    flags[-1], flags[:-1] = False, inside[1:]
    flags[offs[1:][offs[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~flags) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of the byte spans.

    Spans of one length up to eight bytes never collide: each step is a bijection of
    the lane it takes in.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    size = ends - starts
    out = mix(size.astype(np.uint64) + _U(seed * _SEED & _MAX))
    live = np.arange(len(starts))
    for at in range(0, LANES, 8):
        live = live[size[live] > at] if at else np.flatnonzero(size > 0)
        if not len(live):
            break
        lane = lanes[starts[live] + at].view(np.uint64).ravel() & _KEEP[np.minimum(size[live] - at, 8)]
        out[live] = mix(out[live] ^ lane)
    for k in np.flatnonzero(size > LANES).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, person=seed.to_bytes(8, "little"))
        out[k] = int.from_bytes(digest.digest(), "little")
    return out


def window_hashes(items: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hashes of every ``width`` consecutive items; one for each possible start.

    Hashes of 1, 2, 4 ... items are made from two of half the width, and the powers of
    two that make up the width are joined.
    """
    n = len(items)
    if n < width:
        return np.zeros(0, np.uint64)
    block, size = mix(items + _U(seed * _SEED & _MAX)), 1
    out, done = None, 0
    while True:
        if width & size:
            many = n - done - size + 1
            out = block if out is None else mix(out[:many] * _JOIN + block[done : done + many])
            done += size
        if done == width:
            return mix(out + _U(width))
        block, size = mix(block[:-size] * _JOIN + block[size:]), 2 * size


def trimmed(run):
    """``run`` for ``mapInArrow``, giving free memory back to the system at its end.

    Spark keeps Python workers for later tasks, also those of other operators, and
    allocators keep what arrays have left.
    """

    def give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass

    return give_back
