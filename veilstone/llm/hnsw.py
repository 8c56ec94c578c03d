"""Approximate nearest neighbours: one navigable small-world graph per shard.

Rows are dealt to shards by a hash of their id.  A shard's graph is kept as flat arrays (vectors,
neighbours of each layer, ids) in one row of a table; blocks of queries stream past each shard's
graph, and the shards' results are merged by exact score.  Shards grow with the square root of the
table, within what a row of a table and a task can hold.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstone.llm.store import batches as arrow_batches
from veilstone.llm.store import quoted, written

#: Rows of a shard on average, at least; links of a node (twice as many on the lowest layer); breadth of searches.
SHARD_ROWS, LINKS, BUILD_BREADTH, SEARCH_BREADTH, SEED = 8192, 14, 64, 96, 7
#: Most bytes of a shard's vectors in double precision; queries that travel in one row.
SHARD_BYTES, BLOCK = 256 << 20, 256
#: Steps of a unit vector's component: vectors with the same rounded components are one node.
GRID = 2.0**22


def shard_rows(rows: int, width: int) -> int:
    """Rows of a shard for a table of so many: each query meets each shard, so shards grow as the table does."""
    return max(1, min(max(SHARD_ROWS, 8 * math.isqrt(rows)), SHARD_BYTES // (8 * max(1, width))))


class Hnsw:
    """The graph over distinct unit vectors.  ``near[l]`` holds the neighbours on layer l, -1 where none.

    A row that fills up is pruned to the neighbours that no closer neighbour stands before; until then
    it may hold ``slack`` more, so that few insertions prune.
    """

    def __init__(self, vectors: np.ndarray, links: int = LINKS, breadth: int = BUILD_BREADTH, seed: int = SEED):
        self.v, self.links, n = np.ascontiguousarray(vectors, dtype=np.float32), links, len(vectors)
        draw = np.random.default_rng(seed).random(n)
        self.levels = np.minimum((-np.log(np.maximum(draw, 1e-12)) / math.log(links)).astype(np.int64), 12)
        tops = range(int(self.levels.max(initial=0)) + 1)
        self.where = [np.cumsum(self.levels >= x) - 1 if x else np.arange(n) for x in tops]
        self.most = [links * 2 if not x else links for x in tops]
        self.near = [np.full((int((self.levels >= x).sum()), m + m // 2), -1, dtype=np.int32) for x, m in zip(tops, self.most, strict=True)]
        self.filled = [[0] * len(a) for a in self.near]
        self.seen = np.zeros(n, dtype=np.int32)
        self.turn = 0
        self.entry = -1
        for i in range(n):
            self._insert(i, breadth)
        for layer, most in enumerate(self.most):
            for i in np.flatnonzero(self.levels >= layer).tolist():
                if self.filled[layer][self.where[layer][i]] > most:
                    self._prune(i, layer)
            self.near[layer] = np.ascontiguousarray(self.near[layer][:, :most])

    def flat(self) -> dict[str, bytes]:
        """The arrays of the graph as bytes."""
        return {
            "vectors": self.v.tobytes(),
            "levels": self.levels.astype(np.int8).tobytes(),
            "near": b"".join(a.tobytes() for a in self.near),
            "shape": np.array([self.v.shape[1] if self.v.ndim > 1 else 0, self.links, self.entry], dtype=np.int64).tobytes(),
        }

    @classmethod
    def open(cls, vectors: bytes, levels: bytes, near: bytes, shape: bytes) -> Hnsw:
        self = cls.__new__(cls)
        dim, self.links, self.entry = np.frombuffer(shape, dtype=np.int64).tolist()
        self.v = np.frombuffer(vectors, dtype=np.float32).reshape(-1, dim)
        self.levels = np.frombuffer(levels, dtype=np.int8).astype(np.int64)
        flat, at = np.frombuffer(near, dtype=np.int32), 0
        self.near, self.where, self.filled = [], [], []
        for x in range(int(self.levels.max(initial=0)) + 1):
            rows, m = int((self.levels >= x).sum()), self.links if x else self.links * 2
            self.near.append(flat[at : at + rows * m].reshape(rows, m))
            self.filled.append((self.near[-1] >= 0).sum(axis=1).tolist())
            self.where.append(np.cumsum(self.levels >= x) - 1)
            at += rows * m
        self.seen, self.turn = np.zeros(len(self.v), dtype=np.int32), 0
        return self

    def _walk(self, q: np.ndarray, starts: list[tuple[float, int]], breadth: int, layer: int) -> list[tuple[float, int]]:
        """The ``breadth`` nearest (similarity, node) that a best-first walk meets, in no order."""
        self.turn += 1
        seen, turn, v, near, filled, where = self.seen, self.turn, self.v, self.near[layer], self.filled[layer], self.where[layer]
        todo = [(-s, i) for s, i in starts]
        found = list(starts)
        heapq.heapify(todo)
        heapq.heapify(found)
        for _, i in starts:
            seen[i] = turn
        push, pop, swap = heapq.heappush, heapq.heappop, heapq.heappushpop
        while todo:
            s, i = pop(todo)
            if len(found) >= breadth and -s < found[0][0]:
                break
            row = where[i]
            ns = near[row, : filled[row]]
            ns = ns[seen[ns] != turn]
            if not len(ns):
                continue
            seen[ns] = turn
            for t, j in zip((v[ns] @ q).tolist(), ns.tolist(), strict=True):
                if len(found) < breadth:
                    push(found, (t, j))
                    push(todo, (-t, j))
                elif t > found[0][0]:
                    swap(found, (t, j))
                    push(todo, (-t, j))
        return found

    def _choose(self, sims: list[float], nodes: list[int], most: int) -> list[int]:
        """Of nodes with their similarities, at most ``most``: those nearer to the centre than to one chosen before."""
        order = sorted(range(len(nodes)), key=lambda k: -sims[k])
        if len(order) <= most // 2:
            return [nodes[k] for k in order]
        w = self.v[nodes]
        each = (w @ w.T).tolist()
        chosen: list[int] = []
        left: list[int] = []
        for k in order:
            row, s = each[k], sims[k]
            if any(row[c] > s for c in chosen):
                left.append(k)
                continue
            chosen.append(k)
            if len(chosen) >= most:
                break
        chosen += left[: most - len(chosen)]
        return [nodes[k] for k in chosen]

    def _prune(self, i: int, layer: int) -> None:
        row, most = self.where[layer][i], self.most[layer]
        ns = self.near[layer][row, : self.filled[layer][row]]
        keep = self._choose((self.v[ns] @ self.v[i]).tolist(), ns.tolist(), most)
        self.near[layer][row, : len(keep)] = keep
        self.near[layer][row, len(keep) :] = -1
        self.filled[layer][row] = len(keep)

    def _insert(self, i: int, breadth: int) -> None:
        level, q = int(self.levels[i]), self.v[i]
        if self.entry < 0:
            self.entry = i
            return
        at = [(float(self.v[self.entry] @ q), self.entry)]
        top = int(self.levels[self.entry])
        for layer in range(top, level, -1):
            at = [max(self._walk(q, at, 1, layer))]
        for layer in range(min(level, top), -1, -1):
            at = self._walk(q, at, breadth, layer)
            keep = self._choose([s for s, _ in at], [j for _, j in at], self.links)
            near, filled, where = self.near[layer], self.filled[layer], self.where[layer]
            near[where[i], : len(keep)] = keep
            filled[where[i]] = len(keep)
            for j in keep:
                row = where[j]
                if filled[row] == near.shape[1]:
                    self._prune(j, layer)
                near[row, filled[row]] = i
                filled[row] += 1
        if level > top:
            self.entry = i

    def search(self, q: np.ndarray, breadth: int = SEARCH_BREADTH) -> list[int]:
        """The nodes that a search finds, in no order."""
        if self.entry < 0:
            return []
        at = [(float(self.v[self.entry] @ q), self.entry)]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            at = [max(self._walk(q, at, 1, layer))]
        return [j for _, j in self._walk(q, at, breadth, 0)]


def usable(vector: Column, vec_id: Column) -> Column:
    """Whether a row takes part: id and vector there, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec_id.isNotNull() & vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


INDEX = "shard LONG, width INT, ids BINARY, starts BINARY, spans BINARY, vectors BINARY, levels BINARY, near BINARY, shape BINARY, originals BINARY"


def build(rows: DataFrame, shards: int) -> DataFrame:
    """(vec_id LONG, vector ARRAY<DOUBLE>) -> a row for each shard and width of vectors, as INDEX says.

    A node is a direction: vectors that point the same way but for rounding (GRID) are one node, so that many
    copies or multiples don't fill each other's links.  A node has a span of distinct original vectors, and
    each of those its ids.
    """

    def one(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids = table.column("vec_id").to_numpy()
        flat = table.column("vector").combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        x = flat.flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order] + 0.0
        _, first, node = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        own = np.ascontiguousarray(x[first])
        unit = own / np.abs(own).max(axis=1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        grid = np.ascontiguousarray(np.rint(unit * GRID).astype(np.int32))
        _, leader, way = np.unique(grid.view(np.dtype((np.void, grid.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
        order = np.argsort(way, kind="stable")
        spans = np.concatenate([[0], np.cumsum(np.bincount(way, minlength=len(leader)))])
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        own, node = own[order], place[node]
        by_node = np.argsort(node, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(own)))])
        graph = Hnsw(unit[leader]).flat()
        row = {"ids": ids[by_node].astype(np.int64).tobytes(), "starts": starts.astype(np.int64).tobytes(), "spans": spans.astype(np.int64).tobytes(), **graph, "originals": own.tobytes()}
        return pa.table({"shard": pa.array([shard], pa.int64()), "width": pa.array([x.shape[1]], pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in row.items()}})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("width", F.size("vector"))
    dealt = dealt.repartition(4 * shards, "shard")
    return dealt.groupBy("shard", "width").applyInArrow(one, INDEX)


def cosine(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row with q in double precision; a row's value depends on its own numbers only."""
    return (rows * q).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((q * q).sum()))


def _best(ids: np.ndarray, starts: np.ndarray, spans: np.ndarray, own: np.ndarray, nodes: list[int], q: np.ndarray, query_id: int, k: int) -> list[tuple[float, int]]:
    """The k best (score, id) of the rows of some nodes: largest score first, ties to the smaller id."""
    if not nodes:
        return []
    at = np.concatenate([np.arange(spans[n], spans[n + 1]) for n in nodes])
    scores = cosine(own[at], q)
    if len(at) > k + 1:
        keep = scores >= np.partition(scores, -(k + 1))[-(k + 1)]
        at, scores = at[keep], scores[keep]
    pairs = []
    for s, n in zip(scores.tolist(), at.tolist(), strict=True):
        same = ids[starts[n] : starts[n + 1]]  # in order, so that the query's own id, however often, is one piece
        low, high = np.searchsorted(same, query_id, "left"), np.searchsorted(same, query_id, "right")
        pairs += [(-s, i) for i in [*same[: min(low, k)].tolist(), *same[high : high + k].tolist()]]
    return [(-s, i) for s, i in sorted(pairs)[:k]]


def blocks(queries: DataFrame, size: int = BLOCK) -> DataFrame:
    """(query_id, vector) -> (width, ids, vectors): up to ``size`` queries of one width in a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vectors = b.column("query_id").to_numpy(), b.column("vector")
            by_width: dict[int, list[int]] = {}
            for i in range(b.num_rows):
                by_width.setdefault(len(vectors[i].values), []).append(i)
            for width, rows in by_width.items():
                flat = np.concatenate([vectors[i].values.to_numpy() for i in rows])
                yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([ids[rows].tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], ["width", "asked", "asked_vectors"])

    with arrow_batches(queries.sparkSession, size):
        return written(queries.mapInArrow(pack, "width INT, asked BINARY, asked_vectors BINARY"), "hnsw-queries")


def search(index: DataFrame, asked: DataFrame, shards: int, k: int, breadth: int = SEARCH_BREADTH) -> DataFrame:
    """Blocks of queries against every shard -> (query_id, query_key, vec_id, score): up to k of each shard.

    In each partition a shard's graph comes first and the blocks stream past it, so that a task holds
    one graph and a few blocks.  query_key tells apart the vectors of a repeated id.
    """
    graph = [c.split()[0] for c in INDEX.split(", ")[2:]]
    none = [F.lit(None).cast("binary").alias(c) for c in graph]
    cells = index.select("shard", "width", F.lit(None).cast("binary").alias("asked"), F.lit(None).cast("binary").alias("asked_vectors"), *graph)
    sent = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "width", "asked", "asked_vectors", *none)
    both = cells.unionByName(sent).repartitionByRange(shards, "shard").sortWithinPartitions(F.col("shard"), F.col("width"), F.col("asked").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for b in batches:
            out: list[tuple[int, int, int, float]] = []
            for r in range(b.num_rows):
                at = (b.column("shard")[r].as_py(), b.column("width")[r].as_py())
                if (ids := b.column("asked")[r].as_py()) is None:
                    got = {c: b.column(c)[r].as_py() for c in graph}
                    g = Hnsw.open(got["vectors"], got["levels"], got["near"], got["shape"])
                    key, now = at, (g, np.frombuffer(got["ids"], dtype=np.int64), np.frombuffer(got["starts"], dtype=np.int64), np.frombuffer(got["spans"], dtype=np.int64), np.frombuffer(got["originals"]).reshape(-1, at[1]))
                elif at == key:
                    g, own_ids, starts, spans, own = now
                    vectors = np.frombuffer(b.column("asked_vectors")[r].as_py()).reshape(-1, at[1])
                    for query_id, q in zip(np.frombuffer(ids, dtype=np.int64).tolist(), vectors, strict=True):
                        unit = q / np.abs(q).max()
                        nodes = g.search((unit / np.sqrt((unit * unit).sum())).astype(np.float32), breadth)
                        which = xxhash.xxh64_intdigest(q.tobytes()) >> 1
                        out += [(query_id, which, i, s) for s, i in _best(own_ids, starts, spans, own, nodes, q, query_id, k)]
            parts = zip(*out, strict=True) if out else ((), (), (), ())
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(parts, types, strict=True)], ["query_id", "query_key", "vec_id", "score"])

    with arrow_batches(index.sparkSession, 16):
        return written(both.mapInArrow(run, "query_id LONG, query_key LONG, vec_id LONG, score DOUBLE"), "hnsw-found")


def nearest(table: DataFrame, k: int = 5, every: int = 50, rows_of_shard: int | None = None, breadth: int = SEARCH_BREADTH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``.

    Nearness is the cosine of the original vectors in double precision; ties go to the smaller id; a
    row's own id is no candidate.  Rows without an id, and null, zero or not finite vectors, take no
    part; vectors meet vectors of their own width only; other columns aren't read.  Repeated rows are
    candidates each, and one query; an id with several vectors is a query for each, with ranks of its
    own.  Queries without candidates, and empty tables, give no rows.
    """
    spark = table.sparkSession
    vector, vec_id = F.col(quoted(vector_col)), F.col(quoted(id_col))
    rows = table.where(usable(vector, vec_id)).select(vec_id.cast("long").alias("vec_id"), vector.cast("array<double>").alias("vector"))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    shards = max(1, math.ceil(n / (rows_of_shard or shard_rows(n, width or 1))))
    index = written(build(rows, shards), "hnsw-index")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    found = search(index, blocks(queries), shards, k, breadth)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
