"""Near-duplicate detection by HyperMinHash.

Each document's set of word shingles is hashed into buckets; a register keeps the
least value of its bucket as a leading-zero count and ten mantissa bits. An empty
bucket borrows from one that a fixed random order names, which keeps the chance of
agreement at the Jaccard similarity. Bands of registers find candidates; registers
give a collision-corrected estimate of similarity; what passes is compared on the full
sets, and a link is confirmed on the words themselves.

Texts with equal sets are one class from the start, told by 128 bits a shingle. A band bucket is not expanded into
pairs: its members are compared with two hubs first, and only members that are not
then in one component are compared further. For those two exact bounds prune first.
Shingles that no other candidate has can be in no intersection. And in a crowded
bucket each member's common part with the hub is kept as a bitmap, so what two members
have in common is known up to the few shared shingles outside the hub. A large family
of near copies so costs a few comparisons a member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import blobs
from rivulet.llm.filters import with_keys, without_keys
from rivulet.llm.storage import Scratch, documents, named_again, numbered_columns
from rivulet.llm.textscan import LOWER, WHITE_SPACE, mix, pieces, span_hashes, text_bytes, trimmed, window_hashes, word_spans

#: Fixed by the contract: words in a shingle, and similarity in percent.
SHINGLE, PERCENT = 4, 80
#: At similarity 0.8 all of 40 bands of 6 registers differ with probability 5e-6.
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Deviations that an estimate may lie under the threshold.
SLACK = 5.0
#: Members that are compared with one copy of a hub.
GROUP = 48
#: Members of a bucket that a task compares with others of it.
SALT = 4096
_PROBES = 512
_U = np.uint64

_borrow = (mix(np.arange(_PROBES * REGISTERS, dtype=np.uint64) + _U(77)) % _U(REGISTERS)).astype(np.int64).reshape(_PROBES, REGISTERS)


def shingles(data: np.ndarray, offs: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingle hashes, first one of each document), repeats included."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offs, WHITE_SPACE)
    words = span_hashes(data, starts, ends, seed)
    lengths = np.diff(first)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    out, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if len(words) >= SHINGLE:
        whole = doc[: len(words) - SHINGLE + 1] == doc[SHINGLE - 1 :]
        out.append(window_hashes(words, SHINGLE, seed)[whole])
        owner.append(doc[: len(whole)][whole])
    for size in range(1, SHINGLE):
        short = np.flatnonzero(lengths == size)
        if len(short):
            # Bit patterns of other widths never meet: the width is part of the hash.
            out.append(window_hashes(words, size, seed)[first[short]])
            owner.append(short)
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    return np.concatenate(out)[order], np.searchsorted(owner_all[order], np.arange(len(lengths) + 1))


def sets_of(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingles of each document."""
    return [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers (uint16), one row for each set; empty sets give zeros."""
    sizes = np.array([len(s) for s in sets])
    h = np.concatenate([np.zeros(0, np.uint64), *sets])
    doc = np.repeat(np.arange(len(sets)), sizes)
    bucket = ((h >> _U(32)) * _U(REGISTERS) >> _U(32)).astype(np.int64)
    value = (h & _U(0xFFFFFFFF)).astype(np.int64)
    least = np.full(len(sets) * REGISTERS, 1 << 32, np.int64)
    np.minimum.at(least, doc * REGISTERS + bucket, value)
    full = (least < 1 << 32).reshape(len(sets), REGISTERS)
    bits = np.zeros(len(least), np.int64)
    some = least > 0
    bits[some] = np.floor(np.log2(least[some])).astype(np.int64) + 1  # exact: the values are below 2**33
    zeros = 32 - np.minimum(bits, 32)
    rest = np.where(bits > 0, least - (1 << np.maximum(bits - 1, 0)), 0)
    mantissa = np.where(bits - 1 >= MANTISSA, rest >> np.maximum(bits - 1 - MANTISSA, 0), rest << np.maximum(MANTISSA - bits + 1, 0))
    registers = (zeros << MANTISSA | mantissa & (1 << MANTISSA) - 1).reshape(len(sets), REGISTERS)
    row, column = np.nonzero(~full & (sizes > 0)[:, None])
    for k in range(_PROBES):
        if not len(row):
            break
        lender = _borrow[k][column]
        found = full[row, lender]
        registers[row[found], column[found]] = registers[row[found], lender[found]]
        row, column = row[~found], column[~found]
    if len(row):
        registers[row, column] = registers[row, full.argmax(axis=1)[row]]
    registers[sizes == 0] = 0
    return registers.astype(np.uint16)


def chance_collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of unrelated sets of n and m shingles agree."""
    level = 2.0 ** -np.arange(33)

    def zeros(size):
        per = np.maximum(size / REGISTERS, 1.0)[:, None]
        below = 1 - (1 - level[None, :]) ** per
        return below - np.append(below[:, 1:], np.zeros((len(size), 1)), axis=1)

    return (zeros(n) * zeros(m)).sum(axis=1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates for rows of registers."""
    c = chance_collision(n.astype(float), m.astype(float))
    return np.maximum(((a == b).mean(axis=1) - c) / (1 - c), 0)


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Pairs that sizes allow and whose estimate is not clearly under the threshold."""
    t = PERCENT / 100
    fits = 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
    slack = SLACK * np.sqrt(t * (1 - t) / np.minimum(np.minimum(n, m), REGISTERS))
    return fits & (estimate(a, b, n, m) >= t - slack)


def alike(both: int, n: int, m: int) -> bool:
    """The contract's test."""
    return both > 0 and 100 * both >= PERCENT * (n + m - both)


class Member:
    """A document's set as hashes and, where asked for, as words."""

    def __init__(self, own: np.ndarray, text: bytes) -> None:
        self.own, self.text, self.sets = own, text, None

    def words(self) -> set[tuple[bytes, ...]]:
        if self.sets is None:
            w = self.text.lower().split()  # of bytes: ASCII letters and white space only
            self.sets = set(zip(*(w[k:] for k in range(SHINGLE)))) if len(w) >= SHINGLE else {tuple(w)} if w else set()
        return self.sets

    def linked(self, other: Member) -> bool:
        """Hashes can only make sets more alike, so they decide against a link; for one
        the words do."""
        if not alike(len(np.intersect1d(self.own, other.own, assume_unique=True)), len(self.own), len(other.own)):
            return False
        a, b = self.words(), other.words()
        return alike(len(a & b), len(a), len(b))


def describe(docs: DataFrame) -> DataFrame:
    """(id, n, digest, sketch) of (id, text) rows; digest and sketch are null for no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            for i, j in pieces(offs):
                part, own = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                (one, first), (two, _) = (shingles(part, own, seed) for seed in (1, 2))
                sets, digests = [], []
                for a, b in zip(first[:-1], first[1:]):
                    found, at = np.unique(one[a:b], return_index=True)
                    sets.append(found)
                    digests.append(hashlib.blake2b(found.tobytes() + two[a:b][at].tobytes(), digest_size=16).digest() if b > a else None)
                registers = sketches(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([r.tobytes() if len(s) else None for r, s in zip(registers, sets)], pa.binary()),
                    ],
                    ["id", "n", "digest", "sketch"],
                )

    return docs.select("id", "text").mapInArrow(trimmed(run), "id bigint, n bigint, digest binary, sketch binary")


def estimated(pairs: DataFrame, reps: DataFrame, crowded: bool = False) -> DataFrame:
    """(x, y, size) pairs that pass the estimate, or (``crowded``) are from a bucket of
    over ``GROUP`` members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (5, 6))
            keep = may_link(a, b, batch.column(3).to_numpy(), batch.column(4).to_numpy())
            if crowded:
                keep |= batch.column(2).to_numpy() > GROUP
            yield batch.select(["x", "y", "size"]).filter(pa.array(keep))

    x = reps.select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))
    y = reps.select(F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy"))
    fits = f"100 * least(nx, ny) >= {PERCENT} * greatest(nx, ny)"
    full = pairs.join(y, "y").join(x, "x").filter(f"size > {GROUP} or {fits}" if crowded else fits)
    return full.select("x", "y", "size", "nx", "ny", "sx", "sy").mapInArrow(trimmed(run), "x bigint, y bigint, size bigint")


def bitmap(hub: np.ndarray, own: np.ndarray) -> list[int]:
    """Which of the hub's sorted shingles a set has, 64 to a number."""
    bits = np.packbits(np.isin(hub, own, assume_unique=True))
    return np.append(bits, np.zeros(-len(bits) % 8, np.uint8)).view("<i8").tolist()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(x, y, linked, bits) for (x, y, size) pairs: whether their full sets link.

    Pairs that do not link are left out, but for those of crowded buckets; these have
    bits, the part of x's set that y shares. Members meet a copy of x's text in groups
    of about ``GROUP``; a large star has many copies of its hub, so no task holds a
    whole star.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        hub: list[Member] = []
        for batch in batches:
            x, salt, y, size = (batch.column(k).to_pylist() for k in range(4))
            data, offs = text_bytes(batch.column(4))
            out: list[tuple] = []
            for i, j in pieces(offs):
                for k, own in zip(range(i, j), sets_of(*shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))):
                    member = Member(own, data[offs[k] : offs[k + 1]].tobytes())
                    if group != (x[k], salt[k]):
                        group, hub = (x[k], salt[k]), []
                    if y[k] is None:
                        hub.append(member)
                        continue
                    link = any(h.linked(member) for h in hub)
                    if link or size[k] > GROUP:
                        out.append((x[k], y[k], link, bitmap(hub[0].own, own) if size[k] > GROUP and len(hub) == 1 else None))
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([p[n] for p in out], t) for n, t in enumerate(types)], ["x", "y", "linked", "bits"])

    spark = pairs.sparkSession
    salted = pairs.select("x", "y", "size", F.pmod(F.xxhash64("y"), F.ceil(F.col("size") / GROUP)).alias("salt"))
    members = salted.join(texts.select(F.col("id").alias("y"), "text"), "y").select("x", "salt", "y", "size", "text")
    hubs = salted.select("x", "salt").distinct().join(texts.select(F.col("id").alias("x"), "text"), "x")
    hubs = hubs.select("x", "salt", F.lit(None).cast("bigint").alias("y"), F.lit(None).cast("bigint").alias("size"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        hubs.unionByName(members)
        .repartition(parts, "x", "salt")
        .sortWithinPartitions("x", "salt", F.col("y").asc_nulls_first())
        .mapInArrow(trimmed(run), "x bigint, y bigint, linked boolean, bits array<bigint>")
    )


def shared_sizes(texts: DataFrame, buckets: int) -> DataFrame:
    """(id, shared): how many of a document's shingles any other document here has, too.

    Shingles go packed by hash bucket; of those that several documents of one flush
    have, one record goes on.
    """

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, d = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        new = np.append(True, h[order][1:] != h[order][:-1])
        several = shared_rows(np.cumsum(new) - 1, d[order])
        mine, head = order[several], order[new]
        back = np.argsort(head)
        go, shared = head[back], several[new][back]
        if len(mine):
            ids, n = np.unique(d[mine], return_counts=True)
            yield blobs.pack_marks(ids, n.astype(np.uint32), buckets)
        low = h[go]
        yield blobs.pack(low, [low.astype(np.uint32), (low >> _U(32)).astype(np.uint8), d[go], shared.astype(np.uint8)], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offs = text_bytes(batch.column(1))
            for i, j in pieces(offs):
                sets = sets_of(*shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                h = np.concatenate([np.zeros(0, np.uint64), *sets])
                held.append((h, np.repeat(ids[i:j], [len(s) for s in sets])))
                size += len(h)
                if size >= blobs.FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    def settle(low, high, d, local):
        h = low.astype(np.uint64) | high.astype(np.uint64) << _U(32)
        order = np.argsort(h, kind="stable")
        group = np.cumsum(np.append(False, h[order][1:] != h[order][:-1])) if len(h) else order
        known = np.bincount(group, local[order])[group] > 0 if len(h) else np.zeros(0, bool)
        # Rows that a flush has counted as shared itself are not counted again.
        mine = order[(known | shared_rows(group, d[order])) & (local[order] == 0)]
        ids, n = np.unique(d[mine], return_counts=True)
        return ids, n.astype(np.uint32)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(np.frombuffer(b, "<u4").sum()) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["id", "shared"])

    counted = blobs.settle_buckets(texts.select("id", "text").mapInArrow(trimmed(run), blobs.SCHEMA), settle, ["<u4", "<u1", "<i8", "<u1"], "<u4", buckets)
    return counted.mapInArrow(total, "id bigint, shared bigint")


def shared_rows(group: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Rows whose group has rows of several documents; rows in group order."""
    if not len(group):
        return np.zeros(0, bool)
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return np.bincount(group, d != d[head][group])[group] > 0


def components(edges: DataFrame, scratch: Scratch, labels: DataFrame | None = None) -> DataFrame:
    """(id, label): the least id that (x, y) edges lead to, for all ids with an edge.

    Labels of neighbours and of labels are taken until nothing changes; each round is
    written to the shared folder and replaces the one before. ``labels`` of an earlier
    call speed up the start.
    """
    both = scratch.write(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    now = both.select(F.col("x").alias("id")).distinct().withColumn("label", F.col("id"))
    if labels is not None:
        now = now.unionByName(labels).groupBy("id").agg(F.min("label").alias("label"))
        both = both.unionByName(labels.filter("id != label").select(F.col("id").alias("x"), F.col("label").alias("y")))
    run, k = len(scratch.paths), 0
    now = scratch.write(now, f"labels-{run}-{k}")
    while True:
        heard = both.join(now, both.x == now.id).select(F.col("y").alias("id"), "label", F.lit(None).cast("bigint").alias("old"))
        own = now.select("id", "label", F.col("label").alias("old"))
        step = scratch.write(own.unionByName(heard).groupBy("id").agg(F.min("label").alias("label"), F.max("old").alias("old")), f"step-{run}-{k}")
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("further"))
        moved = (F.col("further") != F.col("old")).alias("moved")
        now = scratch.write(step.join(jump, "label").select("id", F.col("further").alias("label"), moved), f"labels-{run}-{k + 1}")
        scratch.release(f"step-{run}-{k}", f"labels-{run}-{k}")
        if now.filter("moved").isEmpty():
            return now.select("id", "label")
        now, k = now.select("id", "label"), k + 1


def size_class(n) -> Column:
    """Sizes within a tenth of each other, about."""
    return F.floor(F.log(n) / F.log(F.lit(1.1)))


def cross_pairs(able: DataFrame) -> DataFrame:
    """(x, y, size) pairs of one bucket in different components that may still link.

    ``able`` has (key, rep, label, main, size, n, shared, bits, outside). Sets of n and
    m shingles link only with (n + m) * PERCENT / (100 + PERCENT) of them in common, so
    from ``shared`` follows how large a partner can be at most; members meet by classes
    of size in that range. In a large bucket one side is dealt by salt and the other
    copied to each, so a task has a part of a bucket.
    """
    factor = (100 + PERCENT) / PERCENT
    able = (
        able.withColumn("most", F.least(F.floor(F.col("n") * (100 / PERCENT)), F.floor(F.col("shared") * factor - F.col("n") + 1e-6)))
        .withColumn("least", F.ceil(F.col("n") * (PERCENT / 100) - 1e-6))
        .filter("least <= most")
        .withColumn("salts", F.ceil(F.col("size") / SALT))
    )
    minor = able.filter("label != main").select(
        "key", F.col("rep").alias("x"), *(F.col(c).alias(f"{c}_x") for c in ("label", "n", "bits", "outside", "least", "most")),
        F.explode(F.sequence(size_class(F.col("least")), size_class(F.col("most")))).alias("class"), "salts",
    ).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    other = able.select(
        "key", F.col("rep").alias("y"), *(F.col(c).alias(f"{c}_y") for c in ("label", "n", "bits", "outside", "least", "most")),
        size_class(F.col("n")).alias("class"), F.pmod(F.xxhash64("rep"), F.col("salts")).alias("salt"), "main", "size",
    )
    both = F.aggregate(F.zip_with("bits_x", "bits_y", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0).cast("bigint"), lambda n, b: n + b)
    enough = (100 + PERCENT) * (both + F.least("outside_x", "outside_y")) >= PERCENT * (F.col("n_x") + F.col("n_y"))
    return (
        minor.join(other, ["key", "class", "salt"])
        .filter("label_x != label_y and (label_y = main or x < y) and n_y between least_x and most_x and n_x between least_y and most_y")
        .filter(F.coalesce(enough, F.lit(True)))
        .groupBy("x", "y").agg(F.max("size").alias("size"))
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets are alike.

    Returns one row for each input row: (id, n_shingles, component_id, kept).
    component_id is the least id that links lead to; that document is kept. A text
    without words, null included, has no shingles and is linked with nothing; so is a
    row without an id, whose component_id is null and which is kept. Rows that repeat
    an id are one document to links. Other columns are ignored. An empty table gives no
    rows; ties do not arise, since ids decide; a very long text bounds the memory of
    its task. The result is written to the shared folder and all else deleted there.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = rows.filter("id is not null")
    described = scratch.write(describe(rows), "sketches")
    inside = described.filter("id is not null and digest is not null")
    # Rows of one class share n and sketch, so any value does; large classes combine on the map side.
    reps = scratch.write(inside.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")

    def part(band):
        return F.substring(F.col("sketch"), band * (2 * ROWS) + 1, F.lit(2 * ROWS))

    bands = reps.select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), part)).alias("band", "part")).select(F.xxhash64("band", "part").alias("key"), "rep")
    buckets = scratch.write(
        bands.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("size")).filter("low < high"), "buckets"
    )
    members = scratch.write(bands.join(buckets, "key"), "members")
    a, b = F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")
    star = (
        members.select("rep", F.explode(F.array("low", "high")).alias("hub"), "size")
        .filter("rep != hub")
        .groupBy(a, b, (F.col("rep") > F.col("hub")).alias("up"))
        .agg(F.max("size").alias("size"))
        .select(F.when(F.col("up"), F.col("a")).otherwise(F.col("b")).alias("x"), F.when(F.col("up"), F.col("b")).otherwise(F.col("a")).alias("y"), "size")
    )
    tested = scratch.write(star, "pairs")
    # The texts of all candidates are fetched once; a filter keeps the others where they are.
    some = scratch.write(with_keys(texts, members.select("rep").distinct(), F.col("id"), "rep", scratch), "candidates")
    compared = scratch.write(verified(scratch.write(estimated(tested, reps, crowded=True), "estimated"), some), "links")
    labels = components(compared.filter("linked").select("x", "y"), scratch)

    # What is left: candidates in one bucket but in different components.
    own_label = labels.select(F.col("id").alias("rep"), "label")
    marked = members.select("key", "rep", "low").join(own_label, "rep", "left").select("key", "rep", "low", F.coalesce("label", "rep").alias("label"))
    shares = scratch.write(marked.groupBy("key", "label").agg(F.count("*").alias("n")), "shares")
    main = F.max_by("label", F.struct("n", "label")).alias("main")
    mixed = scratch.write(
        shares.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("size"), main).filter("labels > 1").select("key", "size", "main"), "mixed"
    )
    if not mixed.isEmpty():
        left = scratch.write(marked.join(mixed, "key"), "left")
        asked = some.join(left.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
        sizes = shared_sizes(asked, blobs.bucket_count(some, "text")).join(reps.select(F.col("rep").alias("id"), "n"), "id")
        able = left.join(sizes.filter(f"100 * shared >= {PERCENT} * n").select(F.col("id").alias("rep"), "shared", "n"), "rep")
        bits = compared.filter("bits is not null").select(F.col("x").alias("low"), F.col("y").alias("rep"), "bits")
        count = F.aggregate("bits", F.lit(0).cast("bigint"), lambda n, b: n + F.bit_count(b))
        # shared - inside: shingles outside the hub that some other candidate has.
        able = scratch.write(able.join(bits, ["low", "rep"], "left").withColumn("outside", F.col("shared") - count), "able")
        cross = (
            cross_pairs(able)
            .join(tested.select("x", "y"), ["x", "y"], "left_anti")
            .join(tested.select(F.col("y").alias("x"), F.col("x").alias("y")), ["x", "y"], "left_anti")
        )
        more = scratch.write(verified(scratch.write(estimated(cross, reps), "estimated"), some).filter("linked").select("x", "y"), "links")
        if not more.isEmpty():
            labels = components(more, scratch, labels)

    named = inside.select("id", "n", "digest").join(reps.select("digest", "rep"), "digest").join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left")
    lone = described.filter("id is null or digest is null").select("id", "n", F.col("id").alias("component"))
    found = named.select("id", "n", F.coalesce("label", "rep").alias("component")).unionByName(lone)
    kept = F.col("id").eqNullSafe(F.col("component")).alias("kept")
    return scratch.finish(found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept), "components")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all columns of ``docs`` whatever their names.

    Rows without an id, without words or alone stay; rows that repeat an id stay or go
    together.
    """
    own = numbered_columns(docs)
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    gone = near_duplicates(own, key, text).filter("not kept").select(F.col(key).alias("gone")).distinct()
    return named_again(without_keys(own, gone, F.col(key).cast("bigint"), "gone", Scratch(docs.sparkSession)), docs.columns)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document."""
    return near_duplicates(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM words, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS g(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), least_id AS (SELECT x, min(y) AS low FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_id l ON l.x = d.doc_id
"""
