"""Fitting candidates on shards: one task for each candidate and share of the labelled rows; every labelled row is in one."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows of a shard, and those up to which more rows are more shards where the number of shards is ``bounded``.
FIT_ROWS, SHARD_ROWS = 3_000_000, 32_768


def code_matrix(batches: Sequence[pa.RecordBatch], features: int, kind: type = np.int64) -> np.ndarray:
    """(features x rows) of the codes in some batches."""
    flat = [np.asarray(b.column("codes").flatten()) for b in batches]
    return np.concatenate(flat).reshape(-1, features).T.astype(kind) if flat else np.empty((features, 0), kind)


def shards_of(rows: int, bounded: bool = False) -> int:
    """Number of shards. Scoring with trees walks those of every shard, so theirs are bounded and hold more rows instead."""
    wanted = -(-rows // SHARD_ROWS)
    return max(1, min(wanted, -(-FIT_ROWS // SHARD_ROWS)) if bounded else wanted)


def base_margin(label: np.ndarray) -> float:
    """Log-odds of the positive share, kept away from infinity."""
    rate = min(max(float(label.mean()), 1e-6), 1 - 1e-6)
    return float(np.log(rate / (1 - rate)))


def fit_in_shards(
    binned: DataFrame, features: int, labels: Mapping[str, str], key: str, schema: str, offsets: Mapping[str, str],
    grow: Callable[[str, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[dict]], bounded: bool = False,
) -> DataFrame:
    """Rows that ``grow`` yields for every candidate (a key of ``labels``, naming its label column) and shard.

    Rows with ``codes`` are dealt by a hash of their key, and a shard is sorted by that hash and
    then by content, so a fit depends on neither layout nor number of executors. ``grow`` gets
    candidate, shard, codes (features x rows), labels, hashes and offset margins (the column in
    ``offsets``, or zeros), and yields columns of one output batch each. Shards hold SHARD_ROWS rows;
    if ``bounded``, there are at most FIT_ROWS / SHARD_ROWS of them and more rows make them larger.
    """
    names = list(labels)
    wanted = sorted({*labels.values(), *offsets.values()})
    rows = binned.select(F.col(key).alias("_key"), *[F.col(c).cast("double") for c in wanted], "codes")
    shards = shards_of(rows.count(), bounded)
    rows = rows.withColumn("hash", F.xxhash64("_key"))
    own = F.array(*[
        F.struct((k * shards + F.pmod("hash", F.lit(shards))).cast("int").alias("task"), F.col(labels[c]).alias("label"),
                 (F.col(offsets[c]) if c in offsets else F.lit(0.0)).alias("offset"))
        for k, c in enumerate(names)
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]  # one shard of one candidate
        if not held:
            return
        table = pa.Table.from_batches(held)
        task, hashes = int(table.column("task")[0].as_py()), table.column("hash").to_numpy()
        label, offset = table.column("label").to_numpy(), table.column("offset").to_numpy()
        codes = code_matrix(held, features, np.int16)
        order = np.lexsort([*codes[::-1], offset, label, hashes])
        for columns in grow(names[task // shards], task % shards, np.ascontiguousarray(codes[:, order]), label[order], hashes[order], offset[order]):
            yield pa.RecordBatch.from_pydict(columns)

    placed = rows.select("hash", "codes", F.inline(own)).where(F.col("label").isNotNull())
    return placed.repartitionById(len(names) * shards, F.col("task")).mapInArrow(run, schema)
