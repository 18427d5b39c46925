"""Exact top-k inner products by ball trees, one per shard.

Every task of the scan turns what it reads into trees of at most ``SHARD`` vectors; no row
is shuffled for that, so no key can make a shard large. Trees are dealt to G groups and
queries to H groups, and each of the G x H cells is one bounded piece of work. Within a
cell the nodes of all trees are visited level by level with the bound q.c + |q| r, leaves
in falling order of their bound, and a query stops when the next bound is below its k-th
score. A first round searches each query group in one tree group; its k-th scores are what
the other cells start from.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARD, LEAF, TREES_PER_CELL, QUERIES_PER_CELL, CHUNK = 16_384, 128, 4, 8192, 256


class BallTree:
    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.arange(len(ids))
        data = rows.astype(np.float64)
        levels: list[list[tuple[int, int]]] = [[(0, len(ids))]]
        self.levels = []  # of each: centres, radii, first child in the next level (-1: leaf), rows
        while levels[-1]:
            below: list[tuple[int, int]] = []
            centre, radius, child, span = [], [], [], []
            for lo, hi in levels[-1]:
                x = data[order[lo:hi]]
                c = x.mean(axis=0) if hi > lo else np.zeros(data.shape[1])
                away = np.sqrt(((x - c) ** 2).sum(axis=1))
                centre.append(c)
                radius.append(away.max(initial=0))
                span.append((lo, hi))
                if hi - lo > LEAF and radius[-1] > 0:
                    far = x[away.argmax()]
                    other = x[((x - far) ** 2).sum(axis=1).argmax()]
                    order[lo:hi] = order[lo:hi][np.argsort(x @ (far - other), kind="stable")]
                    mid = (lo + hi) // 2
                    child.append(len(below))
                    below += [(lo, mid), (mid, hi)]
                else:
                    child.append(-1)
            self.levels.append((np.array(centre), np.array(radius), np.array(child), np.array(span)))
            levels.append(below)
        self.ids, self.rows = ids[order], rows[order]

    def leaves(self, q: np.ndarray, norm: np.ndarray, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(level, nodes, bounds by query) of the leaves that some query may need."""
        nodes = np.array([0])
        for depth, (centre, radius, child, _) in enumerate(self.levels):
            if not len(nodes):
                return
            bound = q @ centre[nodes].T + norm[:, None] * radius[nodes]
            bound += 1e-6 * (1 + np.abs(bound)) + 1e-9 * norm[:, None] * (np.sqrt((centre[nodes] ** 2).sum(axis=1)) + radius[nodes])
            alive = (bound >= floor[:, None]).any(axis=0)
            leaf = child[nodes] < 0
            if (alive & leaf).any():
                yield depth, nodes[alive & leaf], bound[:, alive & leaf]
            first = child[nodes[alive & ~leaf]]
            nodes = np.concatenate([first, first + 1])


def search(trees: list[BallTree], ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, vec_ids, scores) of the best k over all trees, own id left out. floor: what a
    score must reach to matter (k scores as high are known elsewhere)."""
    most = max([int(np.abs(t.rows).max(initial=0)) for t in trees], default=0)
    exact = most * int(np.abs(q).max(initial=0)) * q.shape[1] < 1 << 53
    work = [t.rows.astype(np.float64 if exact else np.int64) for t in trees]
    for at in range(0, len(q), CHUNK):
        part = q[at : at + CHUNK].astype(np.float64)
        norm, low = np.sqrt((part**2).sum(axis=1)), floor[at : at + CHUNK].astype(np.float64)
        found = [(t, d, n, b) for t, tree in enumerate(trees) for d, nodes, bounds in tree.leaves(part, norm, low) for n, b in zip(nodes.tolist(), bounds.T, strict=True)]
        if not found:
            continue
        bounds = np.stack([f[3] for f in found], axis=1)
        for i in range(len(part)):
            own, query = ids[at + i], (part[i] if exact else q[at + i].astype(np.int64))
            best_s, best_v, kth = np.zeros(0, np.int64), np.zeros(0, np.int64), low[i]
            for j in np.argsort(-bounds[i], kind="stable").tolist():
                if bounds[i, j] < kth:
                    break
                t, d, n, _ = found[j]
                lo, hi = trees[t].levels[d][3][n]
                s = (work[t][lo:hi] @ query).astype(np.int64)
                v = trees[t].ids[lo:hi]
                take = (s >= kth) & (v != own)
                if not take.any():
                    continue
                best_s, best_v = np.concatenate([best_s, s[take]]), np.concatenate([best_v, v[take]])
                order = np.lexsort((best_v, -best_s))[:k]
                best_s, best_v = best_s[order], best_v[order]
                if len(best_s) == k:
                    kth = max(kth, float(best_s[-1]))
            yield at + i, best_v, best_s


def _vectors(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Whole-number vectors of a batch; rows that take no part are left out."""
    for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding"), strict=True):
        x = v.values
        if i is None or x is None or x.null_count:
            continue
        x = np.floor(1024 * x.to_numpy(zero_copy_only=False).astype(np.float64))
        if np.isfinite(x).all():
            if np.abs(x).max(initial=0) >= 1 << 31:
                raise ValueError(f"vec_id {i}: a component is too large for whole-number scores")
            yield i, x.astype(np.int32)


def _trees(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def emit(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            tree = BallTree(np.array([r[0] for r in rows], np.int64), np.stack([r[1] for r in rows]))
            return pa.record_batch([pa.array([dim]), pa.array([len(rows)]), pa.array([pickle.dumps(tree)], pa.binary())], names=["dim", "n", "tree"])

        for b in batches:
            for i, x in _vectors(b):
                held.setdefault(len(x), []).append((i, x))
                if len(held[len(x)]) >= SHARD:
                    yield emit(len(x))
        for dim in list(held):
            yield emit(dim)

    return vectors.mapInArrow(run, "dim long, n long, tree binary")


def _queries(vectors: DataFrame, every: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, len(x), x.tobytes()) for i, x in _vectors(b)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["query_id", "dim", "q"])

    return vectors.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(run, "query_id long, dim long, q binary").distinct()


def _cell(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        trees = [pickle.loads(t.as_py()) for t in left.column("tree")]  # noqa: S301  written by _trees
        for dim in {t.rows.shape[1] for t in trees}:
            rows = right.filter(pa.compute.equal(right.column("dim"), dim))
            if not rows.num_rows:
                continue
            q = np.frombuffer(b"".join(rows.column("q").to_pylist()), np.int32).reshape(rows.num_rows, dim)
            ids = rows.column("query_id").to_numpy()
            floor = np.array([-np.inf if x is None else x for x in rows.column("floor").to_pylist()], np.float64)
            uid = rows.column("uid").to_numpy()
            for i, v, s in search([t for t in trees if t.rows.shape[1] == dim], ids, q, floor, k):
                out += [(int(uid[i]), int(ids[i]), a, b) for a, b in zip(v.tolist(), s.tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["uid", "query_id", "vec_id", "score"])

    return run


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``embeddings(vec_id, embedding)``
    whose id is divisible by ``every`` the k rows of highest integer inner product.

    Components become floor(1024 * x). Ties go to the smaller vec_id; with fewer candidates
    all are returned. Rows with a null id, and vectors that are null or hold a null or
    non-finite component, take no part; vectors of different lengths are never compared.
    Rows that carry the query's own id are no candidates; a query row that repeats counts
    once, other repeated rows are candidates each. Further columns are ignored; an empty
    table gives an empty result.
    """
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    trees = materialize(_trees(vectors), "trees")
    size = trees.agg(F.count("*"), F.sum("n")).first()
    queries = materialize(_queries(vectors, every).withColumn("uid", F.xxhash64("query_id", "q")), "queries")
    groups = max(1, -(-int(size[0]) // TREES_PER_CELL))
    parts = max(1, -(-queries.count() // QUERIES_PER_CELL))
    trees = trees.withColumn("g", F.pmod(F.xxhash64("tree"), F.lit(groups)).cast("int"))
    queries = queries.withColumn("h", F.pmod("uid", F.lit(parts)).cast("int")).withColumn("seed", F.pmod("h", F.lit(groups)).cast("int"))
    spread = trees.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = "uid long, query_id long, vec_id long, score long"

    def cells(left: DataFrame, right: DataFrame) -> DataFrame:
        left, right = left.select("g", "h", "tree"), right.select("g", "h", "uid", "query_id", "dim", "q", "floor")
        return left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(_cell(k), schema)

    first = queries.withColumn("g", F.col("seed")).withColumn("floor", F.lit(None).cast("long"))
    found = materialize(cells(spread.where(F.col("g") == F.pmod("h", F.lit(groups))), first), "found")
    if groups > 1:
        floors = found.groupBy("uid").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).drop("n")
        rest = queries.join(floors, "uid", "left").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).where("g <> seed")
        found = found.unionByName(cells(spread.where(F.col("g") != F.pmod("h", F.lit(groups))), rest))
    w = Window.partitionBy("uid", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
