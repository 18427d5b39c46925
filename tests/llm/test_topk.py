"""op2 against brute force, with ties, odd vectors and several shards."""

import math

import numpy as np
import pytest

from lodestone.llm import queries, topk
from tests.conftest import DATA
from tests.oracle import assert_same

KIND = "vec_id long, embedding array<double>, score string, rank int"


def brute(rows, k, every):
    vectors = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, x in set((i, v) for i, v in vectors if i % every == 0):
        found = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in vectors if j != q and len(y) == len(x))
        out |= {(q, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])}
    return out


def got(spark, rows, k, every):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, k, every).collect()}


def test_whole_table(spark):
    assert_same(spark, "op2", queries.op2_exact_topk, queries.oracle_sql()["op2_exact_topk"], DATA)


def test_ties_odd_rows_and_few_candidates(spark):
    rows = [(i, [0.5, -0.25 * (i % 3)], "x", 9) for i in range(24)]
    rows += [(None, [1.0, 1.0], "", 1), (30, None, "", 1), (40, [1.0, None], "", 1), (50, [float("nan"), 1.0], "", 1), (60, [float("inf"), 1.0], "", 1), (70, [1.0], "", 1), (80, [], "", 1)]
    assert got(spark, rows, 5, 10) == brute(rows, 5, 10)
    assert got(spark, rows[:3], 10, 1) == brute(rows[:3], 10, 1)
    assert got(spark, [], 10, 1) == set()


def test_repeated_rows_are_candidates_each(spark):
    rows = [(0, [1.0], "", 1), (0, [1.0], "", 1), (1, [0.5], "", 1), (1, [0.5], "", 1)]
    df = spark.createDataFrame(rows, KIND)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, 3, 100).collect()) == [(0, 1, 1, 1024 * 512), (0, 2, 1, 1024 * 512)]


@pytest.mark.parametrize("seed", [1, 2])
def test_many_shards(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "TREES_PER_CELL", 2)
    monkeypatch.setattr(topk, "QUERIES_PER_CELL", 7)
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(2)], "", 1) for i in range(300)]
    assert got(spark, rows, 4, 10) == brute(rows, 4, 10)


def test_trees_prune():
    rng = np.random.default_rng(3)
    rows = np.floor(1024 * np.concatenate([rng.normal(c, 0.05, size=(500, 8)) for c in (-2, 0, 2)])).astype(np.int32)
    tree = topk.BallTree(np.arange(1500), rows)
    q = rows[:1].astype(float)
    kth = np.sort(rows.astype(np.int64) @ rows[0].astype(np.int64))[-10]
    leaves = sum(len(n) for _, n, _ in tree.leaves(q, np.sqrt((q**2).sum(axis=1)), np.array([float(kth)])))
    assert leaves <= 8  # of sixteen or more
