"""Removal of byte strings that occur again, by prefix-free parsing and suffix arrays.

A rolling hash of 12 bytes that hits a residue is a *trigger*; triggers cut every text
into phrases by content alone, so copies of a passage are parsed alike wherever they
stand. Windows of 200 bytes are told apart by the phrase that their first trigger
ends: the windows of one phrase are a *segment*. Segments replace positions as the
unit of work:

1. every trigger's *core*, the 50 bytes from it that all windows of its segment hold,
   is hashed; a core that occurs once settles its segment.
2. of the others the whole segment, up to the next core that occurs once, is
   fingerprinted, as a dictionary of phrases is; equal segments are one entry with a
   count, and all windows of one that is counted twice are repeated.
3. where a core has different segments (at the ends of a repeated passage) their bytes
   meet in the core's bucket and are put in corpus order (``repeated_runs``): a suffix
   array of the dictionary orders what stands before a trigger, a suffix array of the
   parse what follows it, both together order the windows, and neighbours with 200
   bytes in common are repeated.

Windows without a trigger near their start, and those of cores with very many
different segments, are fingerprinted one by one. Fingerprints are two polynomials
modulo the prime 2**61 - 1 with bases of their own; cores, which only choose what is
looked at, use the cheaper rolling hash.

Each round pre-aggregates in the task: of equal records in one flush one goes on, and
a core with many different segments in one flush is dealt by segment.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import blobs
from rivulet.llm.storage import documents
from rivulet.llm.textscan import _BYTE, _INVERSE, mix, pieces, powers, text_bytes

#: Fixed by the contract.
LENGTH = 200
#: Bytes of text handled at once; each has several tables of numbers beside it.
PIECE = 1 << 19
#: Bytes of a trigger, and one trigger in so many positions.
TRIGGER, EVERY = 12, 32
#: Bytes of a core; a window's first trigger may be LENGTH - CORE bytes in.
CORE = 50
REACH = LENGTH - CORE
#: Different segments of one core in one flush, or in all, that make it a hot one.
HOT, KINDS = 16, 256
_U = np.uint64
#: The modulus of fingerprints and their bases.
PRIME = (1 << 61) - 1
BASES = [int(b) for b in np.random.default_rng(20261).integers(1 << 40, PRIME, 2)]
_P, _LOW = _U(PRIME), _U((1 << 31) - 1)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

REMOVED, EXPAND, WINDOWS = 1, 2, 4
#: Bits of a segment record: known to repeat; its core is hot; its core is hot elsewhere.
AGAIN, DEALT, NOTICE = 1, 2, 4
_SEGMENT = np.dtype([("start", "<u4"), ("size", "<u2"), ("flags", "<u1"), ("check", "<u4")])
_WINDOW = np.dtype([("start", "<u4"), ("check", "<u4")])


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x * y modulo the prime."""
    x1, x0, y1, y0 = x >> _U(31), x & _LOW, y >> _U(31), y & _LOW
    mid = x1 * y0 + x0 * y1
    return reduced(_U(2) * x1 * y1 + (mid >> _U(30)) + ((mid & _U((1 << 30) - 1)) << _U(31)) + x0 * y0)


def reduced(v: np.ndarray) -> np.ndarray:
    v = (v & _P) + (v >> _U(61))
    return np.where(v >= _P, v - _P, v)


def prime_powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base**0 .. base**(n-1), the same of its inverse) modulo the prime."""
    have = _tables.get(k)
    if have is None or len(have[0]) < n:
        have = []
        for base in (BASES[k], pow(BASES[k], -1, PRIME)):
            made = np.ones(1, np.uint64)
            while len(made) < max(n, 1 << 16):
                made = np.concatenate([made, times(made, np.full(len(made), pow(base, len(made), PRIME), np.uint64))])
            have.append(made[: max(n, 1 << 16)].copy())
        have = (have[0], have[1])
        if len(have[0]) <= PIECE + 1:
            _tables[k] = have
    return have


class Hashes:
    """Rolling hashes of any span of some bytes, which choose places, and fingerprints,
    which tell that spans are equal; both from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @functools.cached_property
    def inverse(self) -> np.ndarray:
        return powers(len(self.data) + 1, _INVERSE)

    @functools.cached_property
    def sums(self) -> np.ndarray:
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * powers(len(self.data)), out=out[1:])
        return out

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def triggers(self) -> np.ndarray:
        """Where triggers start, whatever documents they cross."""
        if len(self.data) < TRIGGER:
            return np.zeros(0, np.int64)
        return np.flatnonzero(mix((self.sums[TRIGGER:] - self.sums[:-TRIGGER]) * self.inverse[: len(self.data) - TRIGGER + 1]) % _U(EVERY) == 0)

    def polynomial(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        have, inverse = prime_powers(k, len(self.data) + 1)
        if k not in self.parts:
            # Of halves of the powers, the sum over any 2**25 bytes is within 64 bits, and
            # so differences of sums are exact.
            value, own = self.data.astype(np.uint64) + _U(1), have[: len(self.data)]
            low, high = np.zeros(len(self.data) + 1, np.uint64), np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(value * (own & _LOW), out=low[1:])
            np.cumsum(value * (own >> _U(31)), out=high[1:])
            self.parts[k] = low, high
        low, high = (x[b] - x[a] for x in self.parts[k])
        total = reduced(low) + times(reduced(high), np.full(len(low), 1 << 31, np.uint64))
        return times(reduced(total), inverse[a])

    def fingerprint(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(self.polynomial(0, a, b) + (b - a).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def check(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix(self.polynomial(1, a, b)) >> _U(32)).astype(np.uint32)


def parse(h: Hashes, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments (trigger, first window, last window, document), windows without a near
    trigger (start, document), and all triggers that have a core."""
    n = len(h.data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none, none
    t = h.triggers()
    d = np.searchsorted(offs, t, "right") - 1
    whole = t + TRIGGER <= offs[d + 1]
    t, d = t[whole], d[whole]
    # Each document begins a gap, and so does each trigger; a gap ends before the next trigger.
    docs = np.arange(len(offs) - 1)
    begin, owner = np.concatenate([offs[:-1], t + 1]), np.concatenate([docs, d])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    following = np.full(len(begin), np.iinfo(np.int64).max >> 1)
    place = np.flatnonzero(order >= len(docs))
    following[place - 1] = begin[place] - 1
    last = offs[owner + 1] - LENGTH
    real = following < np.iinfo(np.int64).max >> 1
    a, b = np.maximum(begin, following - REACH)[real], np.minimum(following, last)[real]
    ok = a <= b
    trigger, first, final, segment_doc = following[real][ok], a[ok], b[ok], owner[real][ok]
    lo, hi = begin, np.minimum(following - REACH - 1, last)
    many = np.maximum(hi - lo + 1, 0)
    shift = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
    return trigger, first, final, segment_doc, np.arange(many.sum()) + shift, np.repeat(owner, many), t[t + CORE <= offs[d + 1]]


def batches_of(batches: Iterator[pa.RecordBatch], marks: int) -> Iterator[tuple]:
    """(ids, shifts, hashes, offsets, marks of each document) for pieces of a batch."""
    for batch in batches:
        ids, shift = blobs.places(batch)
        data, offs = text_bytes(batch.column(1))
        for i, j in pieces(offs, PIECE):
            own = [[x.as_py() or b"" for x in batch.column(3 + k).slice(i, j - i)] for k in range(marks)]
            yield ids[i:j], shift[i:j], Hashes(data[offs[i] : offs[j]]), offs[i : j + 1] - offs[i], own


class Gather:
    """Record columns of many pieces until a flush."""

    def __init__(self, flush) -> None:
        self.flush, self.held, self.size = flush, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.held.append(columns)
            self.size += len(columns[0])
        if self.size >= blobs.FLUSH:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            held, self.held, self.size = [np.concatenate(c) for c in zip(*self.held)], [], 0
            yield from self.flush(*held)


def classes(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stable order by the keys, number of each ordered row's class)."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def spread(number: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether any row of each row's class has the value."""
    return np.bincount(number, values)[number] > 0 if len(number) else np.zeros(0, bool)


def places_differ(number: np.ndarray, d: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether each row's class has rows at more than one place; rows in class order."""
    head = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else number
    other = (d != d[head][number]) | (p != p[head][number]) if len(number) else np.zeros(0, bool)
    return spread(number, other)


def find_cores(keyed: DataFrame, buckets: int) -> DataFrame:
    """Round 1: cores and lone windows; marks are 2 * position, plus 1 for a window."""

    def flush(h, d, p):
        order, number = classes(h)
        again = places_differ(number, d[order], p[order])
        yield blobs.pack_marks(d[order[again]], p[order[again]], buckets)
        go = np.sort(order[np.append(True, number[1:] != number[:-1])])
        low = h[go]
        yield blobs.pack(low, [low.astype(np.uint32), (low >> _U(32)).astype(np.uint8), d[go], p[go]], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gather(flush)
        for ids, shift, h, offs, _ in batches_of(batches, 0):
            *_, lone, lone_d, trigger = parse(h, offs)
            d = np.searchsorted(offs, trigger, "right") - 1
            yield from held.add(h.span(trigger, trigger + CORE), ids[d], (2 * (trigger - offs[d])).astype(np.uint32) + shift[d])
            yield from held.add(mix(h.span(lone, lone + LENGTH)), ids[lone_d], (2 * (lone - offs[lone_d]) + 1).astype(np.uint32) + shift[lone_d])
        yield from held.end()

    return keyed.mapInArrow(run, blobs.SCHEMA)


def repeated_cores(low, high, d, p):
    order, number = classes(low.astype(np.uint64) | high.astype(np.uint64) << _U(32))
    again = order[places_differ(number, d[order], p[order])]
    return d[again], p[again]


def find_segments(marked: DataFrame, buckets: int) -> DataFrame:
    """Round 2: whole segments of repeated cores, and repeated lone windows."""

    def flush(key, h, c, d, p, n):
        order, number = classes(key, h, c)
        again = places_differ(number, d[order], p[order])
        head = np.append(True, number[1:] != number[:-1])
        rest = order[~head & again]
        if len(rest):
            yield blobs.pack_marks(d[rest], segment_marks(p[rest], n[rest], np.full(len(rest), REMOVED), c[rest]), buckets)
        go, flags = order[head], np.where(again[head], AGAIN, 0).astype(np.uint8)
        back = np.argsort(go)
        go, flags = go[back], flags[back]
        # A core with many kinds of segments is dealt by kind, and one of them tells the core's bucket.
        core_order, core = classes(key[go])
        hot = np.zeros(len(go), bool)
        hot[core_order] = np.bincount(core)[core] > HOT
        notice = np.zeros(len(go), bool)
        notice[core_order[np.append(True, core[1:] != core[:-1])]] = True
        notice &= hot
        columns = [np.concatenate([x[go], x[go][notice]]) for x in (key, h, c, d, p, n)]
        flags = np.concatenate([np.where(hot, flags | DEALT, flags), flags[notice] | NOTICE]).astype(np.uint8)
        deal = np.where(flags & DEALT, mix(columns[0] ^ columns[1]), columns[0])
        yield blobs.pack(deal, [deal, *columns[1:], flags], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gather(flush)
        for ids, shift, h, offs, (marks,) in batches_of(batches, 1):
            trigger, first, final, d, lone, lone_d, every = parse(h, offs)
            own = [blobs.own_places(np.frombuffer(m, "<u4"), x).astype(np.int64) for m, x in zip(marks, shift)]
            # An id that other texts share may bring marks beyond this text.
            own = [m[m < 2 * (b - a)] + 2 * a for m, a, b in zip(own, offs[:-1], offs[1:])]
            found = np.concatenate([np.zeros(0, np.int64), *own])
            # A window that holds a core which occurs once is nowhere else: windows end before it.
            once = np.append(every[~np.isin(2 * every, found)], np.iinfo(np.int64).max >> 1)
            final = np.minimum(final, once[np.searchsorted(once, trigger)] + CORE - LENGTH - 1)
            use = np.isin(2 * trigger, found) & (first <= final)
            trigger, first, final, d = trigger[use], first[use], final[use], d[use]
            core = mix(h.span(trigger, trigger + CORE) + _U(5))
            yield from held.add(
                core, mix(h.fingerprint(first, final + LENGTH) + (trigger - first).astype(np.uint64)), h.check(first, final + LENGTH),
                ids[d], (first - offs[d]).astype(np.uint32) + shift[d], (final + LENGTH - first).astype(np.uint16),
            )
            use = np.isin(2 * lone + 1, found)
            lone, lone_d = lone[use], lone_d[use]
            own = h.fingerprint(lone, lone + LENGTH)
            at = (lone - offs[lone_d]).astype(np.uint32) + shift[lone_d]
            yield from held.add(own, own, h.check(lone, lone + LENGTH), ids[lone_d], at, np.full(len(lone), LENGTH, np.uint16))
        yield from held.end()

    return marked.mapInArrow(run, blobs.SCHEMA)


def segment_marks(start, size, flags, check) -> np.ndarray:
    out = np.empty(len(start), _SEGMENT)
    out["start"], out["size"], out["flags"], out["check"] = start, size, flags, check
    return out


def settle_segments(key, h, c, d, p, n, flags):
    """Which segments repeat as a whole, and which must be taken apart."""
    order = np.lexsort((p, d, c, h, key))
    key, h, c, d, p, n, flags = (x[order] for x in (key, h, c, d, p, n, flags))
    if not len(key):
        return d, segment_marks(p, n, flags, c)
    new_core = np.append(True, key[1:] != key[:-1])
    new_class = new_core | np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
    core, kind = np.cumsum(new_core) - 1, np.cumsum(new_class) - 1
    again = places_differ(kind, d, p) | spread(kind, flags & AGAIN > 0)
    crowd = places_differ(core, d, p) | spread(core, flags & AGAIN > 0)
    hot = spread(core, flags & (DEALT | NOTICE) > 0) | (np.bincount(core, new_class)[core] > KINDS)
    mixed = hot | crowd & spread(core, ~again)
    # Of equal segments one speaks for all.
    expand = mixed & (~again | new_class)
    out = np.where(again, REMOVED, 0) | np.where(expand, np.where(hot, WINDOWS, EXPAND), 0)
    use = out > 0
    return d[use], segment_marks(p[use], n[use], out[use], c[use])


def find_contents(marked: DataFrame, buckets: int) -> DataFrame:
    """Round 3: the bytes of segments that share a core with others."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        core, d, p, t, n, raw = map(np.concatenate, zip(*held))
        return blobs.pack_spans(core, [d, p, t], n, raw, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for ids, shift, h, offs, (marks,) in batches_of(batches, 1):
            trigger = h.triggers()
            for k, raw in enumerate(marks):
                m = np.frombuffer(raw, _SEGMENT)
                m = np.unique(valid_segments(h, m[m["flags"] & EXPAND > 0], offs[k], offs[k + 1], shift[k]))
                if not len(m):
                    continue
                a, n = m["start"].astype(np.int64) + offs[k], m["size"].astype(np.int64)
                first = trigger[np.searchsorted(trigger, a)]
                own = (h.span(first, first + CORE), np.full(len(m), ids[k]), m["start"] + shift[k], (first - a).astype(np.uint16), n)
                held.append((*own, h.data[blobs.spread_ranges(a, n)]))
                size += len(own[0]) + len(held[-1][-1]) // 32
            if size >= blobs.FLUSH:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return marked.mapInArrow(run, blobs.SCHEMA)


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling: the rank of the suffix at each position among all
    suffixes of all strings. ``ends`` has the end of the string that a position is in;
    equal suffixes have equal ranks, from 1 on, and a prefix comes first."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    step, at = 1, np.arange(len(symbols))
    longest = int((ends - at).max(initial=0))
    while step < longest:
        after = np.where(at + step < ends, rank[np.minimum(at + step, len(rank) - 1)], 0)
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    return rank


def byte_strings(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.DictionaryArray:
    """The spans as Arrow strings, equal ones by one code; compared byte by byte."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    raw = np.ascontiguousarray(data[blobs.spread_ranges(first, size)])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()


def common_prefixes(data: np.ndarray, x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Bytes that the spans at x and y (of nx and ny bytes) begin with in common."""
    padded, column = np.concatenate([data, np.zeros(LENGTH, np.uint8)]), np.arange(LENGTH)
    out = np.zeros(len(x), np.int64)
    for a in range(0, len(x), 1 << 14):
        part = slice(a, a + (1 << 14))
        same = padded[x[part, None] + column] == padded[y[part, None] + column]
        same &= column < np.minimum(nx[part], ny[part])[:, None]
        out[part] = np.where(same.all(axis=1), LENGTH, same.argmin(axis=1))
    return out


def range_minima(values: np.ndarray) -> list[np.ndarray]:
    """Minima of every 1, 2, 4, ... consecutive values."""
    out = [values]
    while len(out[-1]) > 1 << len(out) - 1:
        half = 1 << len(out) - 1
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def repeated_runs(data: np.ndarray, offs: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first byte, bytes) of runs of windows that other segments hold, too.

    Segment k is data[offs[k]:offs[k + 1]] with its windows' first trigger at t[k]. No
    two segments may be the same place.
    """
    n = len(t)
    begin, end, cut = offs[:-1], offs[1:], offs[:-1] + t
    if not n:
        return begin, begin, begin
    # The parse: phrases from trigger to trigger, the last one to the segment's end.
    trigger = Hashes(data).triggers()
    owner = np.searchsorted(offs, trigger, "right") - 1
    use = (trigger >= cut[owner]) & (trigger + TRIGGER <= end[owner])
    trigger, owner = trigger[use], owner[use]
    first = np.searchsorted(owner, np.arange(n + 1))
    phrase_end = np.append(trigger[1:] + TRIGGER, 0)
    phrase_end[first[1:] - 1] = end
    phrases = byte_strings(data, trigger, phrase_end - trigger)
    # Phrases end in a trigger and hold no other, so none begins another and the order
    # of their ranks is that of the texts.
    words = phrases.dictionary
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    after = suffix_ranks(rank[phrases.indices.to_numpy()], first[1:][owner])[first[:-1]]
    order = np.argsort(after, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    x, y = order[:-1], order[1:]
    minima = range_minima(common_prefixes(data, cut[x], (end - cut)[x], cut[y], (end - cut)[y]))

    # The dictionary: what stands before the first trigger, each suffix of it ranked.
    lefts = byte_strings(data, begin, t)
    distinct = lefts.dictionary
    left_offs = np.concatenate([[0], np.cumsum(pc.binary_length(distinct).to_numpy())]).astype(np.int64)
    left_bytes = np.frombuffer(b"".join(distinct.to_pylist()), np.uint8)
    before = np.append(suffix_ranks(left_bytes, np.repeat(left_offs[1:], np.diff(left_offs))), 0)

    # Corpus order of the windows: by what stands before the trigger, then by what follows.
    many = end - begin - LENGTH + 1
    k = np.repeat(np.arange(n), many)
    s = blobs.spread_ranges(np.zeros(n, np.int64), many)
    left = left_offs[lefts.indices.to_numpy()[k]] + s
    alpha = np.where(s < t[k], before[np.minimum(left, len(before) - 1)], 0)
    sorted_windows = np.lexsort((place[k], alpha))
    u, v = sorted_windows[:-1], sorted_windows[1:]
    low, high = place[k[u]], place[k[v]]
    near = (alpha[u] == alpha[v]) & (low < high)
    u, v, low, high = u[near], v[near], low[near], high[near]
    level = np.frexp((high - low).astype(float))[1] - 1
    most = np.zeros(len(u), np.int64)
    for j, table in enumerate(minima):
        at = np.flatnonzero(level == j)
        most[at] = np.minimum(table[low[at]], table[high[at] - (1 << j)])
    equal = most >= LENGTH - (t[k[u]] - s[u])
    again = np.zeros(len(k), bool)
    again[u[equal]] = again[v[equal]] = True
    # Runs of consecutive windows of one segment.
    starts = np.flatnonzero(again & ~np.append(False, again[:-1] & (k[1:] == k[:-1])))
    stops = np.flatnonzero(again & ~np.append(again[1:] & (k[1:] == k[:-1]), False))
    return k[starts], s[starts], s[stops] - s[starts] + LENGTH


def settle_contents(d, p, t, n, raw):
    """Repeated windows of the segments of a bucket, as segments that repeat."""
    n, t = n.astype(np.int64), t.astype(np.int64)
    begin = np.cumsum(n) - n
    # One record for each place: rows that repeat an id and a text send several.
    code = byte_strings(raw, begin, n).indices.to_numpy() if len(n) else n
    order = np.lexsort((code, p, d))
    same = (d[order][1:] == d[order][:-1]) & (p[order][1:] == p[order][:-1]) & (code[order][1:] == code[order][:-1])
    use = np.sort(order[~np.append(False, same)]) if len(order) else order
    data = raw[blobs.spread_ranges(begin[use], n[use])]
    offs = np.concatenate([[0], np.cumsum(n[use])]).astype(np.int64)
    k, s, size = repeated_runs(data, offs, t[use])
    at = offs[k] + s
    return d[use][k], segment_marks(p[use][k] + s.astype(np.uint32), size, np.full(len(k), REMOVED), Hashes(data).check(at, at + size))


def find_windows(marked: DataFrame, buckets: int) -> DataFrame:
    """Round 3 of hot cores: single windows of their segments."""

    def flush(h, c, d, p):
        order = np.lexsort((p, d, c, h))
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1]))
        number = np.cumsum(new) - 1
        again = places_differ(number, d[order], p[order])
        rest = order[~new & again]
        if len(rest):
            yield blobs.pack_marks(d[rest], window_marks(p[rest], c[rest]), buckets)
        go = order[new]
        back = np.argsort(go)
        go, flags = go[back], again[new][back].astype(np.uint8)
        yield blobs.pack(h[go], [h[go], c[go], d[go], p[go], flags], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gather(flush)
        for ids, shift, h, offs, (marks,) in batches_of(batches, 1):
            for k, raw in enumerate(marks):
                m = np.frombuffer(raw, _SEGMENT)
                m = np.unique(valid_segments(h, m[m["flags"] & WINDOWS > 0], offs[k], offs[k + 1], shift[k]))
                many = m["size"].astype(np.int64) - LENGTH + 1
                if not len(many):
                    continue
                s = blobs.spread_ranges(m["start"].astype(np.int64), many)
                at = s + offs[k]
                yield from held.add(h.fingerprint(at, at + LENGTH), h.check(at, at + LENGTH), np.full(len(s), ids[k]), s.astype(np.uint32) + shift[k])
        yield from held.end()

    return marked.mapInArrow(run, blobs.SCHEMA)


def window_marks(start, check) -> np.ndarray:
    out = np.empty(len(start), _WINDOW)
    out["start"], out["check"] = start, check
    return out


def settle_windows(h, c, d, p, flags):
    order = np.lexsort((p, d, c, h))
    h, c, d, p, flags = (x[order] for x in (h, c, d, p, flags))
    if not len(h):
        return d, window_marks(p, c)
    number = np.cumsum(np.append(False, (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
    again = places_differ(number, d, p) | spread(number, flags > 0)
    return d[again], window_marks(p[again], c[again])


def valid_segments(h: Hashes, m: np.ndarray, begin: int, end: int, shift: np.uint32) -> np.ndarray:
    """Marks that fit this text: an id that other texts share brings theirs as well."""
    m = m[blobs.is_own(m["start"], shift)]
    m["start"] -= shift
    a = m["start"].astype(np.int64) + begin
    b = a + m["size"]
    m, a, b = m[b <= end], a[b <= end], b[b <= end]
    return m[h.check(a, b) == m["check"]]


def drop_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte that a 200-byte string covers which also starts elsewhere.

    Returns one row for each input row: (id, n_bytes, n_removed, n_spans, spans,
    kept): spans are half-open ranges of removed bytes, kept (binary) the others,
    which need not be whole characters. All occurrences go, the first included; the
    same document and overlapping places count; strings are judged on the input and
    never cross documents. A null text is empty; a text under 200 bytes stays. Rows
    that repeat an id and a text are one place; an id with several texts has each
    judged by itself. Rows without an id count as one document after all others.
    Other columns are ignored. An empty table gives no rows; ties do not arise, since all
    equal strings go; a very long text bounds the memory of its task, and must be shorter
    than 2**30 bytes.
    """
    keyed = blobs.keyed(docs, id_col, text_col)
    buckets = blobs.bucket_count(docs, text_col)

    def marked(found: DataFrame) -> DataFrame:
        return keyed.join(found, "id").select("id", "text", "missing", F.col("blob").alias("marks"))

    cores = blobs.settle_buckets(find_cores(keyed, buckets), repeated_cores, ["<u4", "<u1", "<i8", "<u4"], "<u4", buckets)
    segments = blobs.settle_buckets(
        find_segments(marked(cores), buckets), settle_segments, ["<u8", "<u8", "<u4", "<i8", "<u4", "<u2", "<u1"], _SEGMENT, buckets
    )
    apart = marked(segments)
    contents = blobs.settle_buckets(find_contents(apart, buckets), settle_contents, ["<i8", "<u4", "<u2"], _SEGMENT, buckets, blobs.unpack_spans)
    windows = blobs.settle_buckets(find_windows(apart, buckets), settle_windows, ["<u8", "<u4", "<i8", "<u4", "<u1"], _WINDOW, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            _, shift = blobs.places(batch)
            data, offs = text_bytes(batch.column(1))
            for i, j in pieces(offs, PIECE):
                rows = []
                h = Hashes(data[offs[i] : offs[j]])
                for k in range(i, j):
                    begin, end = offs[k] - offs[i], offs[k + 1] - offs[i]
                    text = h.data[begin:end]
                    wholes, partly, singles = (np.frombuffer(batch.column(c)[k].as_py() or b"", t) for c, t in ((3, _SEGMENT), (4, _SEGMENT), (5, _WINDOW)))
                    wholes = wholes[wholes["flags"] & REMOVED > 0]
                    spans: list[tuple[int, int]] = []
                    if len(wholes) or len(partly) or len(singles):
                        more = segment_marks(singles["start"], np.full(len(singles), LENGTH), np.full(len(singles), REMOVED), singles["check"])
                        m = valid_segments(h, np.concatenate([wholes, partly, more]), begin, end, shift[k])
                        edge = np.zeros(len(text) + 1, np.int64)
                        np.add.at(edge, m["start"].astype(np.int64), 1)
                        np.add.at(edge, m["start"].astype(np.int64) + m["size"], -1)
                        gone = np.cumsum(edge)[:-1] > 0
                        turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                        spans = list(zip(turn[::2].tolist(), turn[1::2].tolist()))
                        kept = text[~gone].tobytes()
                    else:
                        kept = text.tobytes()
                    rows.append((len(text), len(text) - len(kept), len(spans), [{"first": a, "last": b} for a, b in spans], kept))
                n, removed, many, spans, kept = zip(*rows)
                own = [batch.column(c).slice(i, j - i) for c in (0, 2)]
                found = [*(pa.array(x, pa.int64()) for x in (n, removed, many)), pa.array(spans, span_type), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *found], ["id", "missing", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    out = (
        keyed.join(segments.withColumnRenamed("blob", "wholes"), "id", "left")
        .join(contents.withColumnRenamed("blob", "partly"), "id", "left")
        .join(windows.withColumnRenamed("blob", "singles"), "id", "left")
        .select("id", "text", "missing", "wholes", "partly", "singles")
    )
    return out.mapInArrow(run, "id bigint, missing boolean, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<first:bigint,last:bigint>>, kept binary").select(
        F.when(~F.col("missing"), F.col("id")).alias(id_col), "n_bytes", "n_removed", "n_spans", "spans", "kept"
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed bytes of every document."""
    return drop_repeated_strings(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
  SELECT doc_id, 500 * k AS a, substr(h, 1000 * k + 1, 1398) AS part FROM docs, unnest(generate_series(0, (length(h) // 2 - 200) // 500)) AS g(k) WHERE length(h) >= 400
), windows AS MATERIALIZED (
  SELECT doc_id, a + i AS i, md5_number(substr(part, 2 * i + 1, 400)) AS key FROM blocks, unnest(generate_series(0, length(part) // 2 - 200)) AS g(i)
), again AS (
  SELECT doc_id, i FROM windows WHERE key IN (SELECT key FROM windows GROUP BY key HAVING count(*) > 1)
), marked AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, TRUE) AS fresh FROM again
), numbered AS (
  SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
), spans AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q FROM spans
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), length(any_value(h)) // 2 FROM docs d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2 * (q - p)), '' ORDER BY p) AS k FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id
), counted AS (SELECT doc_id, count(*) AS n, sum(b - a) AS removed FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(k)) AS kept_sha256
FROM docs d JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
"""
