"""Nearest vectors by largest inner product: robust-pruned directed graphs, one a shard.

Vectors are dealt to shards by length class and id. In a shard a graph grows by insertion: greedy
beam searches over the graph so far propose neighbours for a batch of new vectors,
relaxed distance pruning keeps of those the near and diverse ones, and edges back are
pruned alike when a vector has too many. Every query is searched in each shard by beam
search, the beam is scored again with the original vectors, and the shards' best meet.

Inner products become distances on a sphere: vectors are scaled by the greatest norm of
their class and get one more coordinate that fills their length up to 1, queries are
scaled to length 1 and get 0. Nearer is then exactly a larger inner product. Where norms
differ much, such a graph is a poor guide, so a class spans a quarter of an octave.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm.storage import Scratch, bounded_batches
from rivulet.llm.textscan import mix, trimmed

#: Edges of a vector, beam while a graph grows and in searches, and how much farther a
#: neighbour may be than by way of another before it is cut.
DEGREE, GROW_BEAM, BEAM, RELAX = 32, 64, 96, 1.2
#: Fewest shards, vectors and bytes of vectors a shard at most, queries that one task
#: searches in a shard, and bytes of a row that carries a part of a shard.
SHARDS, SHARD_ROWS, SHARD_BYTES, QUERY_UNIT, ROW_BYTES = 12, 1 << 16, 64 << 20, 1 << 15, 4 << 20
#: Classes of length in an octave.
CLASSES = 4
#: Vectors inserted or searched at once.
STEP = 256
#: Nearest vectors of a query, and the divisor that makes a row a query: fixed by the contract.
NEAREST, EVERY = 20, 20


class Graph:
    """A robust-pruned directed graph over the rows of ``points`` (float32, of length 1)."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, beam: int = GROW_BEAM, relax: float = RELAX) -> None:
        self.points, self.degree, self.relax = points, degree, np.float32(relax * relax)
        n = len(points)
        self.edges = np.full((n, degree), -1, np.int32)
        self.entry = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
        order = np.random.default_rng(n).permutation(n).astype(np.int32)
        order = np.concatenate([[self.entry], order[order != self.entry]]).astype(np.int32)
        at, some = 1, min(n, 1 + degree)
        if some > 1:  # the first few are all candidates of each other
            self._link(order[:some], np.tile(order[:some], (some, 1)), back=False)
            at = some
        while at < n:
            new = order[at : at + min(at, STEP)]
            ids, _, passed = self.search(points[new], beam, trace=True)
            self._link(new, np.concatenate([ids, passed], 1))
            at += len(new)
        self._reach()

    def search(self, queries: np.ndarray, beam: int, trace: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest found, squared distances, vectors passed) of each query; -1 fills up."""
        points, many = self.points, len(queries)
        ids, dist = np.full((many, beam), -1, np.int32), np.full((many, beam), np.inf, np.float32)
        done, seen = np.ones((many, beam), bool), np.zeros((many, len(points)), bool)
        ids[:, 0], done[:, 0], seen[:, self.entry] = self.entry, False, True
        dist[:, 0] = ((points[self.entry] - queries) ** 2).sum(1)
        passed = [np.full((many, 0), -1, np.int32)]
        while True:
            live = np.flatnonzero(~done.all(1))
            if not len(live):
                return ids, dist, np.concatenate(passed, 1)
            at = (~done[live]).argmax(1)  # the nearest that has not been followed
            done[live, at] = True
            node = ids[live, at]
            if trace:
                passed.append(np.full((many, 1), -1, np.int32))
                passed[-1][live, 0] = node
            near = self.edges[node]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            row, column = np.nonzero(fresh)
            found, query = near[row, column], live[row]
            seen[query, found] = True
            apart = points[found]
            apart -= queries[query]
            away = np.full(near.shape, np.inf, np.float32)
            away[row, column] = np.einsum("ij,ij->i", apart, apart)
            better = (away < dist[live, -1:]).any(1)
            if not better.any():
                continue
            live, near, away = live[better], near[better], away[better]
            all_dist = np.concatenate([dist[live], away], 1)
            best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
            dist[live] = np.take_along_axis(all_dist, best, 1)
            ids[live] = np.where(np.isinf(dist[live]), -1, np.take_along_axis(np.concatenate([ids[live], near], 1), best, 1))
            done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros_like(near, bool)], 1), best, 1) | np.isinf(dist[live])

    def _prune(self, own: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Robust pruning: the nearest candidate stays and cuts those much nearer to it, again and again."""
        candidates = np.sort(candidates, 1)
        useless = (candidates < 0) | (candidates == own[:, None])
        useless[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
        apart = self.points[candidates] - self.points[own][:, None]
        away = np.einsum("ijk,ijk->ij", apart, apart)
        away[useless] = np.inf
        order = np.argsort(away, axis=1, kind="stable")
        candidates, away = np.take_along_axis(candidates, order, 1), np.take_along_axis(away, order, 1)
        apart = np.take_along_axis(apart, order[:, :, None], 1)
        length = np.where(np.isinf(away), 0, away)
        # Relative to the vector itself, so that near copies keep their digits.
        between = length[:, :, None] + length[:, None, :] - 2 * np.matmul(apart, apart.transpose(0, 2, 1))
        left, out, rows = ~np.isinf(away), np.full((len(own), self.degree), -1, np.int32), np.arange(len(own))
        for k in range(self.degree):
            pick = left.argmax(1)
            some = left[rows, pick]
            if not some.any():
                break
            out[some, k] = candidates[some, pick[some]]
            left &= self.relax * between[rows, pick] > away
            left[rows, pick] = False
        return out

    def _pruned(self, own: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """``_prune`` a few rows at a time: its tables grow with the square of the candidates."""
        step = max(1, (4 << 20) // candidates.shape[1] ** 2)
        return np.concatenate([self._prune(own[k : k + step], candidates[k : k + step]) for k in range(0, len(own), step)])

    def _link(self, own: np.ndarray, candidates: np.ndarray, back: bool = True) -> None:
        self.edges[own] = self._pruned(own, candidates)
        if not back:
            return
        to, source = self.edges[own].ravel(), np.repeat(own, self.degree)
        to, source = to[to >= 0], source[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        target, first, many = np.unique(to, return_index=True, return_counts=True)
        have = (self.edges[target] >= 0).sum(1)
        column = np.arange(len(to)) - np.repeat(first, many)
        fits = np.repeat(have + many <= self.degree, many)
        self.edges[to[fits], np.repeat(have, many)[fits] + column[fits]] = source[fits]
        full = np.flatnonzero(have + many > self.degree)
        for part in np.array_split(full[np.argsort(many[full], kind="stable")], max(1, len(full) // STEP)):
            if len(part):
                wide = np.full((len(part), self.degree + int(many[part].max())), -1, np.int32)
                wide[:, : self.degree] = self.edges[target[part]]
                for k, t in enumerate(part.tolist()):
                    wide[k, self.degree : self.degree + many[t]] = source[first[t] : first[t] + many[t]]
                self.edges[target[part]] = self._pruned(target[part], wide)

    def _reach(self) -> None:
        """Gives every vector that no path leads to from the entry an edge from the nearest found one."""
        reached = np.zeros(len(self.points), bool)
        front = np.array([self.entry])
        while True:
            reached[front] = True
            while len(front):
                near = np.unique(self.edges[front])
                front = near[(near >= 0) & ~reached[np.maximum(near, 0)]]
                reached[front] = True
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return
            lost = lost[:1]
            at = int(self.search(self.points[lost], GROW_BEAM)[0][0, 0])
            free = np.flatnonzero(self.edges[at] < 0)
            if not len(free):
                self.edges = np.pad(self.edges, ((0, 0), (0, 1)), constant_values=-1)
                free = [self.edges.shape[1] - 1]
            self.edges[at, free[0]] = lost[0]
            front = lost


class Shard:
    """The vectors of a shard, equal ones once, with their ids and the graph over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, greatest: float) -> None:
        # An id counts once: of its rows the one with the greatest bytes.
        order = sorted(range(len(ids)), key=lambda k: (int(ids[k]), vectors[k].tobytes()))
        last = [k for k, after in zip(order, [*order[1:], None]) if after is None or ids[k] != ids[after]]
        ids, vectors = ids[last], vectors[last]
        kinds = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
        _, first, kind = np.unique(kinds, return_index=True, return_inverse=True)
        order = np.argsort(kind, kind="stable")  # ids stay in order
        self.ids, self.bounds, self.vectors = ids[order], np.concatenate([[0], np.cumsum(np.bincount(kind))]), vectors[first]
        self.graph = Graph(lengthened(self.vectors / greatest))

    def nearest(self, own: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, ids, inner products): at least the best ``k`` found for each query, but itself."""
        scaled = queries / norms(queries)[:, None]
        scaled = np.concatenate([scaled, np.zeros((len(queries), 1))], 1).astype(np.float32)
        nodes = self.graph.search(scaled, max(beam, k + 1))[0]
        score = np.zeros(nodes.shape)
        for d in range(queries.shape[1]):  # from left to right, as a plain sum is
            score += self.vectors[np.maximum(nodes, 0), d].astype(np.float64) * queries[:, d, None].astype(np.float64)
        score[nodes < 0] = -np.inf
        smallest = self.ids[self.bounds[np.maximum(nodes, 0)]]
        best = np.lexsort((smallest, -score), axis=1)[:, : k + 1]
        nodes, score = np.take_along_axis(nodes, best, 1), np.take_along_axis(score, best, 1)
        query = np.repeat(np.arange(len(own)), nodes.shape[1])
        nodes, score = nodes.ravel(), score.ravel()
        query, score, nodes = query[nodes >= 0], score[nodes >= 0], nodes[nodes >= 0]
        many = np.minimum(np.diff(self.bounds)[nodes], k + 1)
        at = np.repeat(self.bounds[nodes] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        ids, query, score = self.ids[at], np.repeat(query, many), np.repeat(score, many)
        other = ids != own[query]
        ids, query, score = ids[other], query[other], score[other]
        order = np.lexsort((ids, -score, query))
        ids, query, score = ids[order], query[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, "left")
        keep = place < k
        return own[query[keep]], ids[keep], score[keep]


def norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths in double precision; no square overflows."""
    most = np.abs(vectors).max(1, initial=0).astype(np.float64)
    safe = np.where(most > 0, most, 1.0)
    return safe * np.sqrt(((vectors / safe[:, None]) ** 2).sum(1))


def lengthened(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length at most 1, with the coordinate that makes it 1."""
    rest = np.sqrt(np.maximum(0.0, 1.0 - (vectors.astype(np.float64) ** 2).sum(1)))
    return np.concatenate([vectors, rest[:, None]], 1).astype(np.float32)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, vector, norm, level): rows with an id and a finite vector other than zero, as bytes, and its class of length."""
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "float" if kind == "float" else "double"
    code = "<f4" if kind == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            values = np.asarray(column.values.to_numpy(zero_copy_only=False), code)  # null becomes NaN
            ends = column.offsets.to_numpy().astype(np.int64)
            good = np.isfinite(values)
            bad = np.concatenate([[0], np.cumsum(~good)])
            some = np.concatenate([[0], np.cumsum(good & (values != 0))])
            low, high = ends[:-1], ends[1:]
            keep = np.asarray(column.is_valid()) & np.asarray(batch.column(0).is_valid()) & (bad[high] == bad[low]) & (some[high] > some[low])
            low, high = low[keep], high[keep]
            dim = high - low
            norm = np.zeros(len(dim))
            for d in np.unique(dim).tolist():
                own = np.flatnonzero(dim == d)
                norm[own] = norms(values[low[own][:, None] + np.arange(d)])
            raw = [values[x:y].tobytes() for x, y in zip(low.tolist(), high.tolist())]
            ids = batch.column(0).filter(pa.array(keep))
            # Half a class off, so that length 1 is inside of one.
            level = np.floor(np.log2(np.clip(norm, 1e-320, 1e308)) * CLASSES + 0.5).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array(dim, pa.int32()), pa.array(raw, pa.binary()), pa.array(norm), pa.array(level)], ["id", "dim", "vector", "norm", "level"])

    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast(f"array<{kind}>").alias("vector"))
    return rows.mapInArrow(run, "id bigint, dim int, vector binary, norm double, level int")


class Plan:
    """Which shards vectors of a length and class belong to.

    Classes are taken together while all their vectors fit in a beam, which finds them
    exactly. ``sizes`` has (dim, level, vectors, greatest norm) rows, of which there are
    some thousands at most for a length.
    """

    def __init__(self, sizes: list[tuple[int, int, int, float]], kind: str) -> None:
        #: (dim, level) to first shard and number of shards; dim to range of shards; greatest norm of a shard.
        self.of, self.shards, self.greatest, self.dim = {}, {}, [], []
        for dim in sorted({s[0] for s in sizes}):
            own = sorted(s for s in sizes if s[0] == dim)
            total, first = sum(s[2] for s in own), len(self.greatest)
            rows = max(1, min(SHARD_ROWS, SHARD_BYTES // (np.dtype(kind).itemsize * dim)))
            while own:
                some = 1
                while some < len(own) and sum(s[2] for s in own[: some + 1]) <= BEAM:
                    some += 1
                many = sum(s[2] for s in own[:some])
                count = max(1, -(-SHARDS * many // total) if many > BEAM else 1, -(-many // rows))
                self.of |= {(dim, s[1]): (len(self.greatest), count) for s in own[:some]}
                self.greatest += [max(s[3] for s in own[:some])] * count
                self.dim += [dim] * count
                own = own[some:]
            self.shards[dim] = range(first, len(self.greatest))


def in_rows(key: str, number: int, raw: bytes) -> Iterator[pa.RecordBatch]:
    """A long byte string in rows of bounded size."""
    for part, at in enumerate(range(0, len(raw), ROW_BYTES)):
        numbers = [pa.array([x], pa.int32()) for x in (number, 0, part)]
        yield pa.RecordBatch.from_arrays([*numbers, pa.array([raw[at : at + ROW_BYTES]], pa.binary())], [key, "phase", "part", "blob"])


def build(rows: DataFrame, plan: Plan, kind: str) -> DataFrame:
    """(shard, phase, part, blob): each shard with its graph."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array([plan.of[key] for key in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())], np.int64).reshape(-1, 2)
            shard = of[:, 0] + (mix(batch.column(0).to_numpy().astype(np.uint64)) % of[:, 1].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), batch.column(0), batch.column(2)], ["shard", "id", "vector"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw, number = [], [], None
        for batch in batches:
            if batch.num_rows:
                number = batch.column(0)[0].as_py()
                ids.append(batch.column(1).to_numpy())
                raw.append(b"".join(batch.column(2).to_pylist()))
        if number is not None:
            vectors = np.frombuffer(b"".join(raw), kind).reshape(-1, plan.dim[number])
            yield from in_rows("shard", number, pickle.dumps(Shard(np.concatenate(ids), vectors, plan.greatest[number]), protocol=5))

    dealt = rows.select("id", "dim", "vector", "level").mapInArrow(deal, "shard int, id bigint, vector binary")
    return dealt.repartitionById(len(plan.greatest), "shard").mapInArrow(trimmed(run), "shard int, phase int, part int, blob binary")


def nearest_vectors(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = NEAREST,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    beam: int = BEAM,
    query_unit: int = QUERY_UNIT,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query, nearest first.

    ``queries`` has the columns of ``vectors``; a query does not find its own id. Rows
    without an id, and vectors that are null, zero or have null or non-finite components
    take no part, neither as query nor as candidate; nor do empty ones. Vectors meet those
    of their own length only. Equal vectors are one point of a graph with all their ids, so
    any number of copies can be found; ties go to the smaller id. Of rows that repeat an
    id, the vector with the greatest bytes counts. Other columns are ignored. An empty
    table gives no rows, and a query with fewer than ``k`` candidates gets all of them.

    A shard holds about ``SHARD_ROWS`` vectors at most; the work is queries times shards, in
    blocks of ``query_unit`` queries a task.
    """
    scratch = Scratch(vectors.sparkSession)
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    rows = scratch.write(usable(vectors, id_col, vector_col), "vectors")
    asked = usable(queries.select(F.col(f"`{id_col}`"), F.col(f"`{vector_col}`").cast(vectors.schema[vector_col].dataType).alias(vector_col)), id_col, vector_col)
    asked = scratch.write(asked.groupBy("id").agg(F.max(F.struct("dim", "vector")).alias("v")).select("id", "v.dim", "v.vector"), "queries")
    plan = Plan([tuple(r) for r in rows.groupBy("dim", "level").agg(F.count("*"), F.max("norm")).collect()], kind)
    result = "query_id bigint, vec_id bigint, score double"
    if not plan.greatest:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    many = dict(asked.groupBy("dim").count().collect())
    groups = {dim: max(1, -(-many.get(dim, 0) // query_unit)) for dim in plan.shards}
    shards = scratch.write(build(rows, plan, kind), "shards")
    units, first, of_shard = 0, {}, {}
    for dim, own in plan.shards.items():
        first[dim] = units
        of_shard |= {shard: (units + k * groups[dim], groups[dim]) for k, shard in enumerate(own)}
        units += len(own) * groups[dim]

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                start, count = of_shard[r["shard"]]
                for unit in range(start, start + count):
                    yield pa.RecordBatch.from_pylist([{"unit": unit, "phase": 0, "part": r["part"], "blob": r["blob"]}], schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries, one for each shard of their length."""
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in plan.shards:
                    continue
                own = batch.filter(pa.array(dims == dim))
                group = np.abs(own.column(0).to_numpy() // 7) % groups[dim]
                for g in np.unique(group).tolist():
                    part = own.filter(pa.array(group == g))
                    raw = pickle.dumps((part.column(0).to_numpy(), b"".join(part.column(2).to_pylist())), protocol=5)
                    for s in range(len(plan.shards[dim])):
                        yield pa.RecordBatch.from_pylist([{"unit": first[dim] + s * groups[dim] + g, "phase": 1, "part": 0, "blob": raw}], schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], None
        for batch in batches:
            for phase, part, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if phase == 0:
                    held, shard = ([] if part == 0 else held), None
                    held.append(blob.as_buffer().to_pybytes())
                    continue
                if shard is None and not held:
                    continue  # no vector has been dealt to the shard
                if shard is None:
                    shard, held = pickle.loads(b"".join(held)), []
                ids, raw = pickle.loads(blob.as_buffer())
                asked = np.frombuffer(raw, kind).reshape(len(ids), -1)
                for at in range(0, len(ids), STEP):
                    found = shard.nearest(ids[at : at + STEP], asked[at : at + STEP], k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    schema = pa.schema([("unit", pa.int32()), ("phase", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])
    types = "unit int, phase int, part int, blob binary"
    streams = shards.mapInArrow(copies, types).unionByName(asked.mapInArrow(blocks, types))
    found = streams.repartitionById(units, "unit").sortWithinPartitions("unit", "phase", "part").mapInArrow(trimmed(search), result)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op11_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every twentieth vector."""
    vectors = bounded_batches(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest_vectors(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


#: Exact search. A graph whose vectors all fit in a beam finds the same: so it is with
#: the shards of a table of up to ``SHARDS * BEAM`` vectors.
ORACLE = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""
