"""Features as small bin codes, stored once and shared by trees, screening and pair search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, ShortType

from riskloom.catalog import RARE_LEVEL_ROWS
from riskloom.operators.joins import broadcast_if_small
from riskloom.operators.ordering import exact_quantiles
from riskloom.session import materialize

#: Level that stands for all levels rare in training, and text of a missing category.
POOLED, MISSING = "infrequent", "Missing"


@dataclass
class Bins:
    """Codes fitted on training rows.

    A category's levels have codes from 1 in alphabetical order, those rare in training share
    one, and a level unseen there has code 0. A number's codes count the edges not above it,
    from 1; a missing number has code 0.
    """

    categorical: list[str]
    numeric: list[str]
    names: dict[str, list[str]]
    edges: dict[str, list[float]]
    levels: DataFrame

    @property
    def features(self) -> list[str]:
        return [*self.categorical, *self.numeric]

    def widths(self) -> np.ndarray:
        """Number of codes of each feature, code 0 included."""
        return np.array([len(self.names[c]) + 1 for c in self.categorical] + [len(self.edges[c]) + 2 for c in self.numeric], np.int64)

    def encode(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The columns of ``keep`` and ``codes``, one small number per feature in their order."""
        for k, c in enumerate(self.categorical):
            own = self.levels.where(F.col("feature") == c).select(F.col("level").alias(f"_level{k}"), F.col("code").alias(f"_code{k}"))
            df = df.join(broadcast_if_small(own), _text(c) == F.col(f"_level{k}"), "left")
        codes = F.array(*[F.coalesce(f"_code{k}", F.lit(0)).cast("smallint") for k in range(len(self.categorical))]).cast("array<smallint>")
        if not self.numeric:
            return df.select(*keep, codes.alias("codes"))
        numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.numeric])
        return self._with_places(df.select(*keep, codes.alias("codes"), numbers.alias("_numbers")))

    def _with_places(self, df: DataFrame) -> DataFrame:
        """Puts the places of ``_numbers`` between their edges behind ``codes``, a batch of rows at a time."""
        edges, categories = [np.array(self.edges[c], float) for c in self.numeric], len(self.categorical)
        kept = [c for c in df.columns if c not in ("codes", "_numbers")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = np.zeros((batch.num_rows, categories + len(edges)), np.int16)
                out[:, :categories] = np.asarray(batch.column("codes").flatten()).reshape(batch.num_rows, categories)
                for k, numbers in enumerate(np.asarray(batch.column("_numbers").flatten()).reshape(batch.num_rows, len(edges)).T):
                    out[:, categories + k] = np.where(np.isnan(numbers), 0, 1 + np.searchsorted(edges[k], numbers, "right"))
                starts = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
                codes = pa.ListArray.from_arrays(pa.array(starts), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], codes], [*kept, "codes"])

        schema = df.drop("codes", "_numbers").schema.add("codes", ArrayType(ShortType()))
        return df.mapInArrow(run, schema)


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def fit_bins(
    train: DataFrame, categorical: Sequence[str], numeric: Sequence[str], max_bins: int = 256, min_rows: int = RARE_LEVEL_ROWS
) -> Bins:
    """Levels of all categories from one pass, edges of all numbers from another; both exact."""
    levels, names = None, {c: [] for c in categorical}
    if categorical:
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), _text(c).alias("level")) for c in categorical])
        counts = train.select(F.inline(pairs)).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
        named = F.when(F.col("n") < min_rows, F.lit(POOLED)).otherwise(F.col("level"))
        levels = materialize(counts.withColumn("name", named), "levels")
        # At most rows / min_rows names for a feature, besides the pooled one.
        for r in levels.select("feature", "name").distinct().collect():
            names[r["feature"]].append(r["name"])
        names = {c: sorted(v) for c, v in names.items()}
        code = F.lit(None).cast("int")
        if any(names.values()):
            known = train.sparkSession.createDataFrame(
                [(c, n, k) for c, v in names.items() for k, n in enumerate(v, 1)], "feature string, name string, code int"
            )
            levels = materialize(levels.join(broadcast_if_small(known), ["feature", "name"]), "levels")
        else:
            levels = levels.withColumn("code", code)
    edges = {c: [] for c in numeric}
    if numeric:
        number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), number(c).alias("value")) for c in numeric])
        inner = [k / max_bins for k in range(1, max_bins)]
        for r in exact_quantiles(train.select(F.inline(pairs)), "value", inner, ["feature"]).select("feature", "quantile").distinct().collect():
            edges[r["feature"]].append(r["quantile"])
        edges = {c: sorted(v) for c, v in edges.items()}
    return Bins(list(categorical), list(numeric), names, edges, levels)


def sum_by_code(binned: DataFrame, features: Sequence[str], values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sums of ``values`` and row counts by ``by``, feature and code: the histogram a split is searched in."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.element_at("codes", k + 1).alias("code")) for k, f in enumerate(features)])
    long = binned.select(*by, *values, F.inline(pairs))
    return long.groupBy(*by, "feature", "code").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(v).alias(v) for v in values])
