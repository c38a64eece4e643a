"""Exact top-k search against all products, over odd vectors, ties and small blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import knn_join as N


def brute(rows, asks, k=10):
    usable = [(i, [math.floor(1024.0 * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = [], {}
    for i, v in usable:
        if asks(i) and v not in asked.setdefault(i, []):
            asked[i].append(v)
    for i, vectors in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for v in vectors for j, w in usable if j != i and len(w) == len(v))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, modulus, kind="float", **more):
    table = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], f"vec_id long, embedding array<{kind}>, rank int, score double")
    return sorted(tuple(r) for r in N.nearest(table, F.col("vec_id") % modulus == 0, **more).collect())


@pytest.mark.parametrize("pivots", [1, 7])
def test_clustered_vectors(spark, monkeypatch, pivots):
    monkeypatch.setattr(N, "SMALLEST_BLOCK", 30)
    monkeypatch.setattr(N, "CHUNK", 3)
    random = np.random.default_rng(2)
    centres = random.normal(0, 1, (6, 8))
    rows = [(int(i), (centres[i % 6 if i % 3 else 0] * random.uniform(0.2, 2) + random.normal(0, 0.05, 8)).astype(np.float32).tolist()) for i in range(500)]
    rows += [(500 + i, rows[7][1]) for i in range(40)]  # ties
    assert run(spark, rows, 20, pivots=pivots) == brute(rows, lambda i: i % 20 == 0)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [-0.5, 0.0005]),
            (6, [0.5, 0.5]), (6, [0.5, 0.5]), (7, [1.0, 2.0, 3.0]), (8, [1.0, -2.0, 3.0]), (9, []), (10, []), (11, [1e9, 1e9]), (12, [3.0]), (0, [1.0, 2.0]), (8, [2.0, 2.0])]
    for modulus in (1, 2):
        assert run(spark, rows, modulus, "double") == brute(rows, lambda i: i % modulus == 0)
    assert run(spark, [(1, None)], 1) == [] and run(spark, [], 1) == []


def test_fewer_than_k(spark):
    rows = [(i, [float(i), 1.0]) for i in range(4)]
    assert run(spark, rows, 2) == brute(rows, lambda i: i % 2 == 0)


def test_bounds_hold():
    random = np.random.default_rng(1)
    x = random.integers(-900, 900, (400, 5)).astype(float)
    pivots = [[int(c) for c in x[i]] for i in range(9)]
    cell, distance = N.Cells(pivots, [0] * 9, [0] * 9, 10).nearest(x)
    cells = N.Cells(pivots, np.bincount(cell, minlength=9).tolist(), [distance[cell == c].max() for c in range(9)], 10)
    which, most = cells.bounds(x[:50])
    for c in range(9):
        assert (most[:, which.tolist().index(c)][:, None] >= x[:50] @ x[cell == c].T).all()
