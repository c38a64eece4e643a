"""Exact top-k search by a Voronoi join on inner products of integer vectors.

Vectors are scaled and floored to integers. Every vector belongs to the cell of its nearest
pivot; pivots are vectors of the table, the first by a hash of their id. From one summary
row per cell (number of vectors, radius) follow bounds: a vector x within radius r of pivot
c cannot score more than q.c + |q| r with a query q. Each query first meets its own cell and
as many cells with the best bounds as it needs for k vectors, which gives it a k-th score to
beat; then it is copied to those other cells only whose bound reaches that score.
Queries are copied rather than vectors, because they are the smaller side. In its cell a
query meets all vectors of one block as a matrix product, and keeps the best k. Large cells
are split into blocks by a hash of the id, so a cell that holds a third of all vectors is
searched by many tasks.

Bounds are floating-point with a margin above any rounding error; scores are exact.

Defined results: vectors that are null or hold a null or non-finite component take no part,
nor do rows with a null id; vectors of different lengths never meet; a vector never
meets one with its own id; repeated rows count as candidates each, but ask once; rows that
share an id but not a vector ask together, for the best scores of them all; an empty vector
scores 0; a score beyond 64 bits counts as the largest or smallest such number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskloom.session import materialize

K, SCALE, PIVOTS = 10, 1024, 64
#: Rows of a block: enough to fill the cores a few times, within these limits.
SMALLEST_BLOCK, LARGEST_BLOCK = 256, 65_536
#: Queries multiplied with a block at a time.
CHUNK = 256


def integer_vectors(table: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v) with floor(scale * component) for the vectors that take part."""
    whole = F.col(vector).cast("array<double>")
    usable = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(whole, lambda x: F.floor(x * F.lit(float(scale))))
    return table.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), scaled.cast("array<long>").alias("v")
    )


class Cells:
    """Pivots of one vector length each, and the summaries of their cells."""

    def __init__(self, pivots: list[list[int]], counts: list[int], radii: list[float], block_rows: int):
        self.dims = np.array([len(p) for p in pivots], np.int64)
        self.pivots = pivots
        self.counts, self.radii = np.array(counts, np.int64), np.array(radii, float)
        self.blocks = np.maximum(1, -(-self.counts // block_rows))
        self.matrices = {
            d: (np.flatnonzero(self.dims == d), np.array([p for p in pivots if len(p) == d], float).reshape((self.dims == d).sum(), d))
            for d in sorted(set(self.dims.tolist()))
        }

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot for vectors of one length."""
        which, pivots = self.matrices[vectors.shape[1]]
        square = (vectors**2).sum(1)[:, None] - 2 * vectors @ pivots.T + (pivots**2).sum(1)
        k = square.argmin(1)
        return which[k], np.sqrt(((vectors - pivots[k]) ** 2).sum(1))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of the queries' length, and the most a vector of each cell may score (q x cells)."""
        which, pivots = self.matrices[queries.shape[1]]
        norms = np.sqrt((queries**2).sum(1))[:, None]
        most = queries @ pivots.T + norms * self.radii[which]
        return which, most + 1e-9 * (np.abs(most) + norms * (np.sqrt((pivots**2).sum(1)) + self.radii[which])) + 1e-6


def _by_length(vectors) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row positions and float matrix for each vector length in a column."""
    lengths = np.array([len(v) for v in vectors])
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, np.array([vectors[k] for k in at], float).reshape(len(at), d)


def _place(vectors: DataFrame, cells: Cells) -> DataFrame:
    """Adds cell and distance to every vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cell, distance = np.zeros(len(frame), np.int32), np.zeros(len(frame))
            for at, matrix in _by_length(frame["v"].to_numpy()):
                cell[at], distance[at] = cells.nearest(matrix)
            yield frame.assign(cell=cell, distance=distance)

    return vectors.mapInPandas(run, "vec_id long, v array<long>, cell int, distance double")


def _copies(queries: DataFrame, cells: Cells, k: int, first: bool) -> DataFrame:
    """Queries copied to blocks: the first round's cells, or those of the rest that may hold better vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, matrix in _by_length(frame["v"].to_numpy()):
                which, most = cells.bounds(matrix)
                # Own cell first, then by bound, until k vectors besides the query are sure to be there.
                column = {c: i for i, c in enumerate(which.tolist())}
                most_own = most.copy()
                most_own[np.arange(len(at)), [column[c] for c in frame["cell"].to_numpy()[at]]] = np.inf
                order = np.argsort(-most_own, axis=1, kind="stable")
                held = np.cumsum(cells.counts[which][order], axis=1) - cells.counts[which][order]
                early = np.zeros_like(most, dtype=bool)
                np.put_along_axis(early, order, held <= k, axis=1)
                if first:
                    wanted = early
                else:
                    wanted = ~early & (most >= frame["to_beat"].to_numpy(float, na_value=-np.inf)[at][:, None])
                row, col = np.nonzero(wanted)
                blocks = cells.blocks[which[col]]
                copy = np.repeat(np.arange(len(row)), blocks)
                salt = np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                for low in range(0, len(copy), 5_000):
                    some = copy[low : low + 5_000]
                    yield pd.DataFrame({
                        "vec_id": frame["vec_id"].to_numpy()[at[row[some]]], "v": frame["v"].to_numpy()[at[row[some]]],
                        "cell": which[col[some]].astype(np.int32), "salt": salt[low : low + 5_000],
                    })

    return queries.mapInPandas(run, "vec_id long, v array<long>, cell int, salt long")


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products, by floating point where all sums stay below 2^53."""
    reach = max(1, queries.shape[1]) * float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0))
    if reach < 2**53:
        return (queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    if reach < 2**63:
        return queries @ vectors.T
    return np.clip(queries.astype(object) @ vectors.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(ids) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))


def _search(data: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Best k of each block for each query copied to it."""
    both = data.select("cell", "salt", F.lit(False).alias("asks"), "vec_id", "v").union(
        copies.select("cell", "salt", F.lit(True).alias("asks"), "vec_id", "v")
    )
    # A block's vectors come before its queries; only the vectors of one block are held.
    both = both.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "asks")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, ids, rows, matrix = None, [], [], None
        for frame in frames:
            if not len(frame):
                continue
            key = list(zip(frame["cell"], frame["salt"], frame["asks"]))
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            out = []
            for low, high in zip(cuts, cuts[1:]):
                cell, salt, asks = key[low]
                if (cell, salt) != block:
                    block, ids, rows, matrix = (cell, salt), [], [], None
                own = frame["vec_id"].to_numpy()[low:high]
                vectors = np.stack([np.asarray(v, np.int64) for v in frame["v"].to_numpy()[low:high]])
                if not asks:
                    ids.append(own), rows.append(vectors)
                    continue
                if not rows:
                    continue
                if matrix is None:
                    matrix, names = np.concatenate(rows), np.concatenate(ids)
                for start in range(0, len(own), CHUNK):
                    scores = _products(vectors[start : start + CHUNK], matrix)
                    for q, line in zip(own[start : start + CHUNK], scores):
                        other = names != q
                        best = best_of(names[other], line[other], k)
                        out.append(pd.DataFrame({"query_id": q, "vec_id": names[other][best], "score": line[other][best]}))
            if out:
                yield pd.concat(out)

    return both.mapInPandas(run, "query_id long, vec_id long, score long")


def nearest(table: DataFrame, asks: Column, vector: str = "embedding", k: int = K, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other vectors for each row where ``asks`` holds."""
    spark = table.sparkSession
    vectors = integer_vectors(table, vector, scale)
    # As many pivots for every vector length; tables of vectors have one length, or a few.
    lengths = vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()
    chosen: list[list[int]] = []
    for row in lengths:
        some = vectors.where(F.size("v") == row["dim"]).orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(pivots)
        chosen += [list(r["v"]) for r in some.select("v").collect()]
    total = sum(r["n"] for r in lengths)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block_rows = min(max(SMALLEST_BLOCK, -(-total // (2 * width))), LARGEST_BLOCK)

    placed = materialize(_place(vectors, Cells(chosen, [0] * len(chosen), [0.0] * len(chosen), block_rows)), "cells")
    summary = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("r")).collect()}
    found = [summary.get(c) for c in range(len(chosen))]
    cells = Cells(chosen, [r["n"] if r else 0 for r in found], [r["r"] if r else 0.0 for r in found], block_rows)
    blocks = F.create_map(*(F.lit(x) for c, b in enumerate(cells.blocks.tolist()) for x in (c, b))) if chosen else F.create_map(F.lit(0), F.lit(1))
    data = placed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), blocks[F.col("cell")].cast("long")))

    queries = placed.where(asks).select("vec_id", "v", "cell").distinct()
    near = materialize(_search(data, _copies(queries, cells, k, True), k), "near")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select(
        F.col("query_id").alias("vec_id"), F.col("score").alias("to_beat")
    )
    rest = _copies(queries.join(kth, "vec_id", "left").select("vec_id", "v", "cell", "to_beat"), cells, k, False)
    found = near.union(_search(data, rest, k)).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op1_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP1_SQL = """
WITH parts AS (
  SELECT vec_id, i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings
        WHERE vec_id IS NOT NULL AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY ALL
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""
