"""Whitening: QDWH divide-and-conquer against a direct eigen-decomposition, sums against plain integers."""

import numpy as np
import pytest

from riskloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, x string, component int, n string"


def plain(vectors, components=4):
    """{row index: (n, deviation, whitened, explained)} by direct means."""
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [sum(c) for c in zip(*fit.tolist())]
    centred = fit - np.array(sums) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    keep = [k for k in range(min(components, len(values))) if values[k] > 1e-12 * values.sum()]
    out = []
    for row in x.tolist():
        deviation = sum((n * c - s) ** 2 for c, s in zip(row, sums))
        out.append((n, deviation, (np.array(row) - np.array(sums) / n) @ basis[:, keep] / np.sqrt(values[keep]), values[keep] / values.sum()))
    return out


def check(rows, ids, vectors, tolerance=1e-8):
    found = {}
    for r in rows:
        assert r.identity_error < 1e-9
        found.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    signs = None
    for vec_id, (n, deviation, whitened, explained) in zip(ids, plain(vectors)):
        own = found[vec_id, deviation]
        assert sorted(own) == list(range(1, len(whitened) + 1))
        assert all(own[k].n == n for k in own)
        got = np.array([own[k + 1].whitened for k in range(len(whitened))])
        if signs is None or (np.abs(signs) < 1e-3).any():
            signs = whitened * got
        assert np.allclose(got * np.sign(signs), whitened, atol=tolerance)
        assert np.allclose([own[k + 1].explained for k in range(len(whitened))], explained, rtol=1e-9)


def whitened(spark, ids, vectors):
    return W.whiten(spark.createDataFrame([(i, v, "a", 9, "b") for i, v in zip(ids, vectors)], SCHEMA)).collect()


@pytest.mark.parametrize("kind", ["random", "graded", "close", "equal", "low rank", "zero"])
def test_eigenvectors(kind):
    random = np.random.default_rng(7)
    for n in (1, 2, 3, 17, 64):
        q, _ = np.linalg.qr(random.standard_normal((n, n)))
        values = {
            "random": random.random(n), "graded": 10.0 ** -np.arange(n), "close": 1 + 1e-9 * np.arange(n), "equal": np.ones(n),
            "low rank": np.where(np.arange(n) < 2, 1.0 + np.arange(n), 0), "zero": np.zeros(n),
        }[kind]
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        found, vectors = W.leading_eigenvectors(a, min(n, 6))
        scale = max(np.linalg.norm(a), 1e-300)
        assert np.allclose(found, np.sort(values)[::-1][:6], atol=1e-13 * scale * n)
        assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-13 * n)
        assert np.abs(a @ vectors - vectors * found).max() <= 1e-13 * scale * n


def test_polar_factor_of_an_ill_conditioned_matrix():
    random = np.random.default_rng(2)
    q, _ = np.linalg.qr(random.standard_normal((20, 20)))
    a = (q * np.concatenate([10.0 ** -np.arange(10), -(10.0 ** -np.arange(10))])) @ q.T
    u = W.polar_factor(a)
    assert np.allclose(u.T @ u, np.eye(20), atol=1e-13) and np.allclose(u @ u, np.eye(20), atol=1e-6)
    assert np.allclose(W.polar_factor(np.zeros((3, 3))), np.eye(3))


def test_any_vectors(spark):
    random = np.random.default_rng(1)
    vectors = (random.standard_normal((120, 6)) * [3, 2, 1.5, 1, 0.5, 0.2]).tolist()
    vectors += vectors[:20] + [vectors[0]] * 50  # repeated vectors count once
    ids = [None if k == 5 else k % 90 for k in range(len(vectors))]
    odd = [(1, None), (2, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (3, [float("nan")] * 6), (4, [float("inf")] * 6), (5, [])]
    table = spark.createDataFrame([(i, v, "a", 9, "b") for i, v in [*zip(ids, vectors), *odd]], SCHEMA)
    rows = W.whiten(table).collect()
    assert len(rows) == 4 * len(vectors)
    check(rows, ids, vectors)


def test_lengths_are_fitted_apart(spark):
    random = np.random.default_rng(3)
    two, three = random.standard_normal((30, 2)).tolist(), random.standard_normal((40, 3)).tolist()
    rows = whitened(spark, list(range(70)), two + three)
    check([r for r in rows if r.vec_id < 30], range(30), two)
    check([r for r in rows if r.vec_id >= 30], range(30, 70), three)


def test_no_spread_and_empty(spark):
    assert whitened(spark, [1, 2], [[1.0, 2.0]] * 2) == []
    assert whitened(spark, [], []) == []
    line = [[float(k), 2.0 * k] for k in range(9)]
    rows = whitened(spark, list(range(9)), line)
    assert {r.component for r in rows} == {1}
    check(rows, range(9), line)


def test_very_large_numbers(spark):
    rows = whitened(spark, [0, 1, 2], [[1e300, 0.0], [0.0, 1e17], [-1e16, 5.0]])
    assert {r.deviation for r in rows} <= {W.LARGEST} and len(rows) == 6


def test_full_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(W.op11_whitening(spark, sf_dir).collect(), [r.vec_id for r in table], [r.embedding for r in table])
