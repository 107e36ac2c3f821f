"""Approximate nearest neighbours by inner product over robust-pruned directed graphs, one per shard of the vectors.

Equal vectors are one node (with the `k + 1` smallest ids, which is all that a top-k answer can show), so copies neither
crowd a shard nor a node's edges. Nodes are dealt to shards of about SHARD nodes by a hash of the vector. A shard's graph
is built in batches: a greedy beam search proposes neighbours, robust pruning drops a candidate that is `alpha` times
closer to a kept neighbour than to the node, and back edges are added and pruned alike. Vectors get one more coordinate
that makes their norms equal, so that Euclidean edges serve the inner product.
Queries are packed into blocks, SLICE blocks make a slice. A task has one shard's graph at a time and streams the blocks of
a slice through it; each block is searched by a beam of `beam` nodes (2 * k at least), in lock step for all its queries,
and the shards' answers are merged. Scores are inner products of the original vectors in double precision.
Null, empty, zero and non-finite vectors and rows of a null id take no part; vectors of another length than the query's
are no candidates; of rows of equal id and vector one counts. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.llm.common import discard, materialize, tidy

SHARD = 4096
DEGREE = 32
BEAM = 128
ALPHA = 1.2
BLOCK = 256
WIDTH = 4
PIVOTS = 256
SLICE = 64
MAX_TASKS = 20_000


class Graph:
    """edges: (nodes, degree) with -1 where a node has fewer; points are unit-extended float32 rows.

    A node has two places: its point, and the point that it is as a query (its vector with a last coordinate of 0). The
    first `degree` edges lead to the neighbours of its point, robust-pruned, with pruned back edges. Where norms differ,
    `degree` further edges lead to the robust-pruned neighbours of its query place, without which long vectors, the best
    answers by inner product, are seldom reached. Every search starts from the nearest of the pivots: the longest vectors
    and a random sample of PIVOTS each.
    """

    def __init__(self, points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, edges: np.ndarray | None = None):
        norms = np.einsum("ij,ij->i", points, points, dtype=np.float64)
        n = len(points)
        self.norms = norms.astype(np.float32)
        self.points = np.column_stack((points, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0)))).astype(np.float32)
        self.degree, self.alpha = degree, alpha
        self.scale = float(norms.max(initial=0))
        order = np.random.default_rng(7).permutation(n)
        self.pivots = np.unique(np.concatenate((np.argsort(-norms, kind="stable")[:PIVOTS], order[:PIVOTS]))).astype(np.int32)
        if edges is not None:
            self.edges = edges
            return
        self.edges = np.full((n, degree), -1, np.int32)
        placed, size = 0, 1
        self.inserted = np.zeros(n, bool)
        while placed < n:
            batch = order[placed : placed + size]
            self._insert(batch, beam)
            self.inserted[batch] = True
            placed, size = placed + size, min(2 * size, BLOCK)
        if n and norms.min() < (1 - 1e-3) * norms.max():
            far = np.full((n, degree), -1, np.int32)
            for at in range(0, n, BLOCK):
                batch = np.arange(at, min(at + BLOCK, n))
                asked = self.points[batch]
                asked[:, -1] = 0
                found = self.search(asked, beam)
                found = np.where(found == batch[:, None], -1, found)
                far[batch] = self._prune(batch, found, asked)
            self.edges = np.concatenate((self.edges, far), 1)

    def _insert(self, batch: np.ndarray, beam: int) -> None:
        found = self.search(self.points[batch], beam)
        found = np.where(found == batch[:, None], -1, found)
        self.edges[batch] = self._prune(batch, found)
        source = np.repeat(batch, self.degree)
        target = self.edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), BLOCK):
            part = slice(lo, lo + BLOCK)
            width = int(count[part].max())
            more = np.full((len(nodes[part]), width), -1, np.int32)
            for r, (f, c) in enumerate(zip(first[part], count[part], strict=True)):
                more[r, :c] = source[f : f + c]
            old = self.edges[nodes[part]]
            more[(more[:, :, None] == old[:, None, :]).any(2)] = -1
            both = np.concatenate((old, more), 1)
            used = (both >= 0).sum(1)
            fits = used <= self.degree
            packed = np.take_along_axis(both, np.argsort(both < 0, 1, kind="stable"), 1)[:, : self.degree]
            self.edges[nodes[part][fits]] = packed[fits]
            if (~fits).any():
                self.edges[nodes[part][~fits]] = self._prune(nodes[part][~fits], both[~fits])

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray, asked: np.ndarray | None = None) -> np.ndarray:
        """Robust pruning of every node's candidates (-1: none) to `degree` diverse ones, by distance from the nodes or `asked`."""
        own = self.points[candidates]
        base = self.points[nodes] if asked is None else asked
        length = self.scale if asked is None else self.norms[nodes][:, None]
        to_node = np.where(candidates >= 0, length + self.scale - 2 * np.einsum("bd,bcd->bc", base, own), np.inf)
        between = 2 * (self.scale - own @ own.transpose(0, 2, 1))
        rows = np.arange(len(nodes))
        out = np.full((len(nodes), self.degree), -1, np.int32)
        limit = self.alpha * self.alpha  # distances are squared
        left = to_node.copy()
        for j in range(min(self.degree, candidates.shape[1])):
            best = left.argmin(1)
            live = np.isfinite(left[rows, best])
            if not live.any():
                break
            out[live, j] = candidates[rows, best][live]
            near = limit * between[rows, best] <= to_node
            left[near & live[:, None]] = np.inf
            left[rows, best] = np.inf
        return out

    def search(self, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The `beam` nearest nodes that greedy search reaches for each query, nearest first (-1: none)."""
        n, b = len(self.points), len(queries)
        rows = np.arange(b)[:, None]
        ids = np.full((b, beam), -1, np.int32)
        dist = np.full((b, beam), np.inf, np.float32)
        done = np.ones((b, beam), bool)
        starts = self.pivots if not hasattr(self, "inserted") or self.inserted.all() else self.pivots[self.inserted[self.pivots]]
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True
        if len(starts):
            gap = -(queries @ self.points[starts].T)
            best = np.argsort(gap, 1, kind="stable")[:, :beam]
            k = best.shape[1]
            ids[:, :k], dist[:, :k], done[:, :k] = starts[best], np.take_along_axis(gap, best, 1), False
            seen[:, starts] = True
        while True:
            open_dist = np.where(done, np.inf, dist)
            pick = np.argpartition(open_dist, WIDTH - 1, 1)[:, :WIDTH]
            live = np.isfinite(np.take_along_axis(open_dist, pick, 1))
            active = live.any(1)
            if not active.any():
                return ids
            np.put_along_axis(done, pick, True, 1)
            nodes = np.where(live, np.take_along_axis(ids, pick, 1), -1)
            near = np.where(nodes[:, :, None] >= 0, self.edges[nodes], -1).reshape(b, -1)
            near = np.sort(np.where(near < 0, n, near), 1)
            fresh = ~seen[rows, near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[rows, near] = True
            width = int(fresh.sum(1).max())
            if not width:
                continue
            front = np.argsort(~fresh, 1, kind="stable")[:, :width]
            near = np.where(np.take_along_axis(fresh, front, 1), np.take_along_axis(near, front, 1), -1).astype(np.int32)
            gap = np.where(near >= 0, -np.matmul(self.points[near], queries[:, :, None])[:, :, 0], np.inf).astype(np.float32)
            all_ids, all_dist = np.concatenate((ids, near), 1), np.concatenate((dist, gap), 1)
            all_done = np.concatenate((done, near < 0), 1)
            order = np.argsort(all_dist, 1, kind="stable")[:, :beam]
            ids, dist, done = (np.take_along_axis(x, order, 1) for x in (all_ids, all_dist, all_done))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def valid(vectors: DataFrame, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & fine)


def _numbers(vectors: DataFrame, vec_col: str) -> str:
    """float where the vectors hold floats, else double."""
    kind = vectors.schema[vec_col].dataType
    return "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"


def build(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(dim, shard, width, points, ids, edges): one row per shard; ids holds each node's k + 1 smallest ids, points the vectors
    in their own precision (`width` bytes a number)."""
    kind = _numbers(vectors, vec_col)
    dtype = np.float32 if kind == "float" else np.float64
    rows = valid(vectors.where(F.col(id_col).isNotNull()), vec_col).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v"))
    same = Window.partitionBy("v").orderBy("id")
    # The rank limit is pushed below the shuffle, so a vector that a third of the rows share arrives as k + 1 rows a task.
    nodes = rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    nodes = materialize(nodes.withColumn("h", F.xxhash64("v")).withColumn("dim", F.size("v")), "nodes")
    shards = max(1, -(-nodes.count() // SHARD))

    def make(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("h")  # about SHARD rows
        points = _matrix(table.column("v")).astype(dtype)
        graph = Graph(points.astype(np.float32))
        columns = [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([points.itemsize], pa.int32()), pa.array([points.tobytes()], pa.binary()), pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))), pa.array([graph.edges.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["dim", "shard", "width", "points", "ids", "edges"])

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    graphs = materialize(dealt.groupBy("dim", "shard").applyInArrow(tidy(make), "dim int, shard int, width int, points binary, ids array<array<long>>, edges binary"), "graphs")
    discard(nodes)
    return graphs


def search(graphs: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for each query but its own id, ties to the smaller id."""
    q = valid(queries.where(F.col(id_col).isNotNull()), vec_col).select(F.col(id_col).cast("long").alias("q"), F.col(vec_col).cast("array<double>").alias("v"))
    q = q.groupBy("q").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    blocks = max(1, -(-q.count() // BLOCK))
    shards = (graphs.agg(F.max("shard")).first()[0] or 0) + 1
    slices = -(-blocks // SLICE)
    width = max(beam, 2 * k)
    packed = q.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks))).groupBy("dim", "block").agg(F.collect_list(F.struct("q", "v")).alias("qv"))

    def run(batches):
        graph = points = ids = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("dim", "width", "points", "edges", "ids", "qs", "vs")}
                dim = row["dim"].as_py()
                if row["qs"].as_py() is None:  # a shard's graph, which the blocks of queries follow
                    points = np.frombuffer(row["points"].as_py(), np.float32 if row["width"].as_py() == 4 else np.float64).reshape(-1, dim)
                    graph = Graph(points.astype(np.float32), edges=np.frombuffer(row["edges"].as_py(), np.int32).reshape(len(points), -1))
                    ids, own_dim = row["ids"].as_py(), dim
                    place = (batch.column("shard")[i].as_py(), batch.column("slice")[i].as_py())
                    continue
                if graph is None or (own_dim, *place) != (dim, batch.column("shard")[i].as_py(), batch.column("slice")[i].as_py()):
                    continue  # no vector of the queries' length is in that shard
                qs = row["qs"].as_py()
                vs = _matrix(row["vs"].values)
                found = graph.search(np.column_stack((vs, np.zeros(len(vs)))).astype(np.float32), width)
                exact = np.einsum("bd,bcd->bc", vs, points[found].astype(np.float64))
                out: list[tuple] = []
                for r, own in enumerate(qs):
                    near = [(-s, x) for s, node in zip(exact[r].tolist(), found[r].tolist(), strict=True) if node >= 0 for x in ids[node] if x != own]
                    out += [(own, x, -s) for s, x in sorted(near)[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=["query_id", "vec_id", "score"])

    # Each block of queries meets each shard: the stated query set against all rows, in blocks. A shard's graph is sent once
    # for each slice of SLICE blocks.
    none = lambda kind: F.lit(None).cast(kind)
    held = graphs.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("dim", "shard", "slice", F.lit(-1).cast("long").alias("block"), "width", "points", "edges", "ids", none("array<long>").alias("qs"), none("array<array<double>>").alias("vs"))
    asked = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("dim", "shard", (F.col("block") / SLICE).cast("int").alias("slice"), "block", none("int").alias("width"), none("binary").alias("points"), none("binary").alias("edges"), none("array<array<long>>").alias("ids"), F.col("qv.q").alias("qs"), F.col("qv.v").alias("vs"))
    dealt = held.unionByName(asked).repartition(min(shards * slices, MAX_TASKS), "dim", "shard", "slice").sortWithinPartitions("dim", "shard", "slice", "block")
    near = dealt.mapInArrow(tidy(run), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = BEAM) -> DataFrame:
    return search(build(vectors, k, id_col, vec_col), queries, k, beam, id_col, vec_col)
