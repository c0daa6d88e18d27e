"""Approximate nearest neighbours: one navigable small-world graph per shard, results merged.

Index. Equal vectors are one node, which carries its ``k + 1`` smallest ids
(enough for any top k, as equal vectors tie and ties go to the smaller id), so
a vector that a third of the rows share is one node too. Nodes are dealt to
shards of about ``shard_rows`` by a hash of the vector. Each shard builds a
hierarchical graph (Malkov and Yashunin): a node's level is geometric, drawn
from its vector's hash; insertion descends greedily, then gathers ``ef_build``
candidates on each level by best-first search and links up to ``m`` of them,
preferring diverse directions. Inner products become distances by one added
coordinate, sqrt(longest² - |x|²), so the nearest point has the largest inner
product. A shard is stored as one row of flat arrays (vectors, ids, and a
fixed-width neighbour array per level) in the shared folder.

Search. Queries meet every shard in blocks of at most ``query_block``; each
shard returns its best k, in double precision on the original vectors, and the
k best of all shards are kept by a top-k window, which Spark also limits
before the shuffle. Memory: one shard and one block of queries a task.

Cases. Vectors that are null, zero, or hold null or non-finite components take
no part, nor do null ids. Vectors are compared only with those of the same
length. Several rows with one id are candidates together; the best counts. A
query's own id is never its answer. Fewer candidates than k: all are returned.
Empty tables give no rows. Extra columns are dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._run import map_arrow, runs, sorted_groups, written


class Graph:
    """The graph of one shard; ``near[l]`` is a flat (nodes x width) array padded with -1."""

    def __init__(self, x: np.ndarray, keys: np.ndarray, m: int = 16, ef_build: int = 64):
        n = len(x)
        self.m, self.ef = m, ef_build
        norms = (x * x).sum(1)
        self.x = np.hstack([x, np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))[:, None]]).astype(np.float32)
        u = ((keys >> np.uint64(11)).astype(np.float64) + 1.0) / 2.0**53
        self.level = np.minimum((-np.log(np.minimum(u, 1.0)) / np.log(m)).astype(int), 12)
        self.top = int(self.level[0]) if n else 0
        self.near = [np.full((n, 2 * m if lev == 0 else m), -1, np.int32) for lev in range(int(self.level.max(initial=0)) + 1)]
        self.entry = 0
        self.seen = np.zeros(n, np.int32)
        self.stamp = 0
        for i in range(1, n):
            self._insert(i)

    def _far(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        d = self.x[ids] - q
        return np.einsum("ij,ij->i", d, d)

    def _descend(self, q: np.ndarray, top: int, bottom: int) -> int:
        at = self.entry
        best = float(self._far(q, np.array([at]))[0])
        for lev in range(top, bottom, -1):
            while True:
                ids = self.near[lev][at]
                ids = ids[ids >= 0]
                if not len(ids):
                    break
                d = self._far(q, ids)
                j = int(d.argmin())
                if d[j] >= best:
                    break
                best, at = float(d[j]), int(ids[j])
        return at

    def _beam(self, q: np.ndarray, starts: list[int], lev: int, ef: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest found by best-first search, nearest first."""
        self.stamp += 1
        self.seen[starts] = self.stamp
        first = [(float(d), s) for d, s in zip(self._far(q, np.array(starts)), starts)]
        todo = list(first)
        heapq.heapify(todo)
        found = [(-d, s) for d, s in first]
        heapq.heapify(found)
        while todo:
            d, i = heapq.heappop(todo)
            if len(found) >= ef and d > -found[0][0]:
                break
            ids = self.near[lev][i]
            ids = ids[ids >= 0]
            ids = ids[self.seen[ids] != self.stamp]
            if not len(ids):
                continue
            self.seen[ids] = self.stamp
            far = self._far(q, ids)
            if len(found) >= ef:
                close = far < -found[0][0]
                far, ids = far[close], ids[close]
            for dd, j in zip(far.tolist(), ids.tolist()):
                if len(found) < ef:
                    heapq.heappush(found, (-dd, j))
                elif dd < -found[0][0]:
                    heapq.heapreplace(found, (-dd, j))
                else:
                    continue
                heapq.heappush(todo, (dd, j))
        return sorted((-d, i) for d, i in found)

    def _choose(self, cand: list[tuple[float, int]], width: int) -> list[int]:
        """Candidates nearer to the node than to any one chosen before; then the nearest others."""
        if len(cand) <= width:
            return [i for _, i in cand]
        ids = np.array([i for _, i in cand])
        x = self.x[ids]
        sq = np.einsum("ij,ij->i", x, x)
        between = sq[:, None] + sq[None, :] - 2.0 * (x @ x.T)
        chosen, passed = [], []
        nearest = np.full(len(ids), np.inf, np.float32)
        for j, (d, _) in enumerate(cand):
            if d < nearest[j]:
                chosen.append(j)
                if len(chosen) == width:
                    break
                np.minimum(nearest, between[j], out=nearest)
            else:
                passed.append(j)
        return ids[(chosen + passed)[:width]].tolist()

    def _insert(self, i: int) -> None:
        q, lev_i = self.x[i], int(self.level[i])
        starts = [self._descend(q, self.top, min(lev_i, self.top))]
        for lev in range(min(lev_i, self.top), -1, -1):
            cand = self._beam(q, starts, lev, self.ef)
            near, width = self.near[lev], self.near[lev].shape[1]
            linked = self._choose(cand, self.m)
            near[i, : len(linked)] = linked
            for j in linked:
                row = near[j]
                free = int((row >= 0).sum())
                if free < width:
                    row[free] = i
                else:
                    ids = np.append(row, i)
                    d = self._far(self.x[j], ids)
                    o = np.argsort(d, kind="stable")
                    keep = self._choose(list(zip(d[o].tolist(), ids[o].tolist())), width)
                    row[:] = -1
                    row[: len(keep)] = keep
            starts = [s for _, s in cand]
        if lev_i > self.top:
            self.top, self.entry = lev_i, i

    def search(self, q: np.ndarray, ef: int) -> list[int]:
        """Nodes near ``q`` (an original vector), nearest first."""
        q = np.append(q, 0.0).astype(np.float32)
        return [i for _, i in self._beam(q, [self._descend(q, self.top, 0)], 0, ef)]

    def arrays(self) -> dict[str, bytes]:
        head = np.array([len(self.x), self.m, self.ef, self.top, self.entry, len(self.near)], np.int64)
        return {"head": head.tobytes(), "points": self.x.tobytes(), "near": b"".join(a.tobytes() for a in self.near)}

    @classmethod
    def of(cls, head: bytes, points: bytes, near: bytes) -> Graph:
        g = cls.__new__(cls)
        n, g.m, g.ef, g.top, g.entry, levels = np.frombuffer(head, np.int64).tolist()
        g.x = np.frombuffer(points, np.float32).reshape(n, -1)
        flat, g.near = np.frombuffer(near, np.int32), []
        for lev in range(levels):
            width = g.m if lev else 2 * g.m
            g.near.append(flat[: n * width].reshape(n, width))
            flat = flat[n * width :]
        g.seen, g.stamp = np.zeros(n, np.int32), 0
        return g


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(v, lambda x: x != 0.0), F.lit(False))


def _matrix(column: pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(arr.flatten(), kind).reshape(len(arr), -1)


def build_index(vectors: DataFrame, k: int, shard_rows: int, m: int, ef_build: int) -> DataFrame:
    """One row a shard: dim, shard, head, points, near (the graph), ids and vectors; ``vectors`` is (vec_id, v)."""
    per = Window.partitionBy("v").orderBy("vec_id")
    nodes = (
        vectors.distinct()
        .withColumn("nth", F.row_number().over(per))
        .filter(F.col("nth") <= k + 1)  # a top-k: the smallest ids of equal vectors
        .groupBy("v")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .withColumns({"dim": F.size("v"), "key": F.xxhash64("v")})
    )
    nodes = written(nodes)
    shards = max(1, -(-nodes.count() // shard_rows))
    nodes = nodes.withColumn("shard", F.pmod(F.shiftrightunsigned("key", 7), F.lit(shards)).cast("int"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["dim", "shard"]):
            x = _matrix(t["v"])
            keys = t["key"].to_numpy().astype(np.int64).view(np.uint64)
            g = Graph(x, keys * np.uint64(0x9E3779B97F4A7C15), m, ef_build).arrays()
            ids = t["ids"].combine_chunks()
            yield pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array([t["dim"][0].as_py()], pa.int32()), "shard": pa.array([t["shard"][0].as_py()], pa.int32()),
                    "head": [g["head"]], "points": [g["points"]], "near": [g["near"]], "vectors": [x.tobytes()],
                    "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))),
                }
            )

    schema = "dim int, shard int, head binary, points binary, near binary, vectors binary, ids array<array<long>>"
    return written(map_arrow(sorted_groups(nodes.select("dim", "shard", "key", "v", "ids"), ["dim", "shard"], ["key"]), build, schema))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = 8192,
    m: int = 16,
    ef_build: int = 64,
    ef_search: int = 128,
    query_block: int = 65536,
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` nearest by inner product."""
    pick = lambda df: (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    )
    index = build_index(pick(vectors), k, shard_rows, m, ef_build)
    asked = pick(queries).distinct().withColumn("dim", F.size("v"))
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    shards = F.broadcast(index.select("dim", "shard")) if index.count() <= 100_000 else index.select("dim", "shard")
    asked = asked.join(shards, "dim").select("dim", "shard", "block", F.lit(1).alias("part"), "vec_id", "v", *_empty_index())
    held = index.select(
        "dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("part"),
        F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("v"),
        "head", "points", "near", "vectors", "ids",
    )
    # a shard's row comes first in its group and the queries stream past it
    met = sorted_groups(held.unionByName(asked), ["dim", "shard", "block"], ["part"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["dim", "shard", "block"]):
            if t["part"][0].as_py() != 0 or t.num_rows < 2:
                continue
            g = Graph.of(*(t[c][0].as_py() for c in ("head", "points", "near")))
            x = np.frombuffer(t["vectors"][0].as_py(), np.float64).reshape(len(g.x), -1)
            ids = t["ids"][0].as_py()
            rest = t.slice(1)
            q_ids, qs = rest["vec_id"].to_pylist(), _matrix(rest["v"])
            out: tuple[list, list, list] = ([], [], [])
            for q_id, q in zip(q_ids, qs):
                near = np.array(g.search(q, max(ef_search, k + 1)))
                score = np.einsum("ij,j->i", x[near], q)
                hits = {}
                for s, i in zip(score.tolist(), near.tolist()):
                    for v in ids[i]:
                        if v != q_id and s > hits.get(v, -np.inf):
                            hits[v] = s
                best = heapq.nsmallest(k, ((-s, v) for v, s in hits.items()))
                out[0].extend([q_id] * len(best))
                out[1].extend(v for _, v in best)
                out[2].extend(-s for s, _ in best)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                names=["query_id", "vec_id", "score"],
            )

    hits = map_arrow(met, search, "query_id long, vec_id long, score double")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(order).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _empty_index() -> list[Column]:
    blank = [F.lit(None).cast("binary").alias(c) for c in ("head", "points", "near", "vectors")]
    return [*blank, F.lit(None).cast("array<array<long>>").alias("ids")]
