"""Embedding whitening by spectral divide-and-conquer over QDWH polar decompositions.

Vectors are scaled and floored to integers. Counts, sums and the covariance are taken over each
distinct vector once: every task adds up its own vectors, row by row of the matrix, and these
rows are added by their number. Sums are exact; products are of centred numbers.

The driver sees one matrix of dimension x dimension. To find its leading eigenvectors, the
matrix is shifted by a number inside its spectrum and the polar factor of the shifted matrix is
computed by the dynamically weighted Halley iteration in its QR form (QDWH). Since the matrix is symmetric,
(factor + 1) / 2 projects onto the eigenvectors above the shift. An orthonormal basis
of that subspace and one of its complement split the matrix in two, and both are
split again until a subspace holds one component or equal eigenvalues only. Subspaces that
cannot hold a wanted component are left alone. Mean and components (numbers, bounded by
dimension x components) are then broadcast and every row is projected in its own task.

Defined results: vectors that are null or hold a null or non-finite component take no part;
vectors of different lengths are fitted apart, each length with its own n; repeated rows and ids
are projected one by one but counted once if their vectors are equal; components without spread
(eigenvalue within rounding of zero) are not returned, so one distinct vector gives no rows;
equal eigenvalues give some orthonormal basis of their space; an empty vector or table gives no
rows; a deviation beyond 64 bits counts as the largest such number; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.session import materialize

SCALE, COMPONENTS = 256, 4
EPSILON = np.finfo(float).eps
#: Numbers of a matrix handled at a time in a task.
CHUNK_NUMBERS = 1 << 20
LARGEST = (1 << 63) - 1


def integer_vectors(table: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x) with floor(scale * component) for the vectors that take part."""
    whole = F.col(vector).cast("array<double>")
    usable = F.forall(whole, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(whole, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return table.where(F.col(vector).isNotNull() & usable & (F.size(vector) > 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")
    )


# --- eigenvectors on the driver --------------------------------------------------------------


def polar_factor(a: np.ndarray, steps: int = 60) -> np.ndarray:
    """Orthogonal polar factor of a square matrix by QDWH iterations in QR form."""
    n = len(a)
    scale = np.linalg.norm(a)
    if scale == 0:
        return np.eye(n)
    x = a / scale
    # A lower bound of the smallest singular value; one too small costs an iteration or two.
    low = max(1 / (np.linalg.norm(np.linalg.inv(x)) if np.linalg.matrix_rank(x) == n else np.inf), EPSILON) * 0.9
    eye = np.eye(n)
    for _ in range(steps):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        root = np.sqrt(1 + d)
        weight = root + np.sqrt(max(8 - 4 * d + 8 * (2 - low * low) / (low * low * root), 0.0)) / 2
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.concatenate([np.sqrt(c) * x, eye]))
        new = b / c * x + (weight - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        low = min(low * (weight + b * low * low) / (1 + c * low * low), 1.0)
        change = np.linalg.norm(new - x)
        x = new
        if change < np.cbrt(4 * EPSILON) and 1 - low < 10 * EPSILON:
            break
    return x


def _bases(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the projector's range and of its complement."""
    n = len(projector)
    random = np.random.default_rng(n)
    q, _ = np.linalg.qr(projector @ random.standard_normal((n, rank)))
    q, _ = np.linalg.qr(projector @ q)
    rest = random.standard_normal((n, n - rank))
    for _ in range(2):
        rest, _ = np.linalg.qr(rest - q @ (q.T @ rest))
    return q, rest


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None if all eigenvalues are equal."""
    n = len(a)
    mean = np.trace(a) / n
    if np.linalg.norm(a - mean * np.eye(n)) <= 4 * n * EPSILON * scale:
        return None
    diagonal = np.sort(np.diag(a))
    # The mean lies between eigenvalues unless all are equal; the median splits more evenly.
    shifts = [np.median(diagonal), mean, *[mean + (diagonal[-1] - mean) * t for t in (0.5, -0.5, 0.25, 0.1)]]
    found = None
    for shift in shifts:
        projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
        projector = (projector + projector.T) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n:
            continue
        above, below = _bases(projector, rank)
        error = np.linalg.norm(above.T @ a @ below)
        if found is None or error < found[0]:
            found = (error, above, below)
        if error <= 8 * n * EPSILON * scale:
            break
    return found and found[1:]


def leading_eigenvectors(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and their vectors as columns."""
    scale = np.linalg.norm(a)
    values: list[float] = []
    vectors: list[np.ndarray] = []

    def divide(basis: np.ndarray) -> None:
        # Every subspace met later lies below those done, so the walk ends once enough are found.
        if len(values) >= count:
            return
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        halves = _split(part, scale) if len(part) > 1 else None
        if halves is None:
            for k in range(len(part)):
                values.append(float(part[k, k]))
                vectors.append(basis[:, k])
            return
        for half in halves:
            divide(np.linalg.qr(basis @ half)[0])

    divide(np.eye(len(a)))
    order = np.argsort(-np.array(values), kind="stable")[:count]
    return np.array(values)[order], np.array(vectors).T[:, order]


# --- sums over distinct vectors -----------------------------------------------------------------


def _matrices(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row positions and integer matrix of the vectors of one length, in chunks."""
    for batch in batches:
        lists = batch.column(column)
        sizes = np.asarray(lists.value_lengths())
        flat = np.asarray(lists.flatten())
        starts = np.cumsum(sizes) - sizes
        for d in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == d)
            step = max(1, CHUNK_NUMBERS // d)
            for k in range(0, len(rows), step):
                at = rows[k : k + step]
                yield batch, at, flat[starts[at][:, None] + np.arange(d)]


def _add_rows(parts: DataFrame) -> DataFrame:
    """Adds up (dims, row, values) by dims and row; a task holds one running row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for dims, row, exact, inexact in zip(*(batch.column(k).to_pylist() for k in range(4))):
                own = total.get((dims, row))
                exact = [int(v) for v in exact]
                total[dims, row] = [exact, np.array(inexact)] if own is None else [
                    [a + b for a, b in zip(own[0], exact)], own[1] + np.array(inexact)
                ]
        if total:
            yield _rows([(d, r, [str(v) for v in e], i.tolist()) for (d, r), (e, i) in total.items()])

    return parts.repartition("dims", "row").mapInArrow(run, _PARTS)


#: Exact numbers travel as text: sums of large tables may pass 64 bits.
_PARTS = "dims int, row int, exact array<string>, inexact array<double>"
_ARROW = pa.schema([("dims", pa.int32()), ("row", pa.int32()), ("exact", pa.list_(pa.string())), ("inexact", pa.list_(pa.float64()))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r)) for r in rows], schema=_ARROW)


def _exact_sum(x: np.ndarray) -> list[int]:
    if len(x) and int(np.abs(x.astype(float)).max()) < LARGEST // max(len(x), 1) // 2:
        return x.sum(0).tolist()
    return x.astype(object).sum(0).tolist()


def _counts(vectors: DataFrame) -> DataFrame:
    """(dims, row 0, [n, sums...]) of the vectors of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for _, at, x in _matrices(batches):
            found = [len(at), *_exact_sum(x)]
            own = total.get(x.shape[1])
            total[x.shape[1]] = found if own is None else [a + b for a, b in zip(own, found)]
        if total:
            yield _rows([(d, 0, [str(v) for v in t], []) for d, t in total.items()])

    return _add_rows(vectors.mapInArrow(run, _PARTS))


def _products(vectors: DataFrame, centred) -> DataFrame:
    """(dims, row, row of the sum of outer products) of what ``centred`` makes of a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for _, _, x in _matrices(batches):
            y = centred(x)
            if y is not None:
                total[x.shape[1]] = total.get(x.shape[1], 0.0) + y.T @ y
        for d, t in total.items():
            step = max(1, CHUNK_NUMBERS // len(t))
            for k in range(0, len(t), step):
                yield _rows([(d, r, [], t[r].tolist()) for r in range(k, min(k + step, len(t)))])

    return _add_rows(vectors.mapInArrow(run, _PARTS))


@dataclass
class Whitening:
    """What is fitted for vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sums of (n x - S)^2, exact."""
        most = np.abs(x.astype(float)).max(initial=0) * self.n + max(map(abs, self.sums))
        if most * most * x.shape[1] < LARGEST / 2:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        return [min(sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)), LARGEST) for row in x.tolist()]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """Whitening of each vector length over the distinct vectors of (vec_id, x)."""
    distinct = materialize(vectors.select("x").distinct(), "vectors")
    fitted: dict[int, Whitening] = {}
    for r in _counts(distinct).collect():  # one row per vector length
        n, *sums = [int(v) for v in r["exact"]]
        fitted[r["dims"]] = Whitening(n, sums, np.empty(0), np.empty((r["dims"], 0)), 0.0)
    means = {d: w.mean for d, w in fitted.items()}
    for d, matrix in _collected(_products(distinct, lambda x: x - means[x.shape[1]])).items():
        covariance = matrix / fitted[d].n
        trace = float(np.trace(covariance))
        values, vectors_ = leading_eigenvectors(covariance, min(components, d))
        spread = values > d * EPSILON * max(trace, 0.0)
        fitted[d].values, fitted[d].vectors, fitted[d].trace = values[spread], vectors_[:, spread], trace
    known = dict(fitted)
    for d, matrix in _collected(_products(distinct, lambda x: known[x.shape[1]].project(x) if len(known[x.shape[1]].values) else None)).items():
        fitted[d].identity_error = float(np.abs(matrix / fitted[d].n - np.eye(len(matrix))).max())
    return fitted


def _collected(products: DataFrame) -> dict[int, np.ndarray]:
    rows: dict[int, list] = {}
    for r in products.collect():
        rows.setdefault(r["dims"], []).append((r["row"], r["inexact"]))
    return {d: np.array([v for _, v in sorted(found)]) for d, found in rows.items()}


def whiten(table: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """One row per vector and component: exact deviation, whitened coordinate, explained share, identity error."""
    vectors = integer_vectors(table, vector)
    fitted = table.sparkSession.sparkContext.broadcast(fit(vectors, components))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, x in _matrices(batches):
            model = fitted.value[x.shape[1]]
            k = len(model.values)
            if not k:
                continue
            rows, total = len(at), len(at) * k
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(at, k))),
                "component": pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                "n": pa.array(np.full(total, model.n), pa.int64()),
                "deviation": pa.array(np.repeat(np.array(model.deviation(x), np.int64), k), pa.int64()),
                "whitened": pa.array(model.project(x).ravel(), pa.float64()),
                "explained": pa.array(np.tile(model.values / model.trace, rows), pa.float64()),
                "identity_error": pa.array(np.full(total, model.identity_error), pa.float64()),
            })

    return vectors.mapInArrow(run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
