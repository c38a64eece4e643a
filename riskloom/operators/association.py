"""Association and collinearity audit over numeric and categorical columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from riskloom.operators.ordering import average_ranks, pick_quantiles, running_totals
from riskloom.session import materialize


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.inline(pairs))


def fill_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace missing numbers by the exact median of their column."""
    return _fill(df, columns, _medians(_value_counts(df, columns), columns))


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return materialize(_long(df, columns).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), "values")


def _medians(counts: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    totals = running_totals(counts.where("value IS NOT NULL"), [F.col("value")], ["n"], ["feature"])
    found = pick_quantiles(totals, "value", "n", [0.5], ["feature"]).collect()
    return {r["feature"]: r["quantile"] for r in found}


def _fill(df: DataFrame, columns: Sequence[str], medians: dict[str, float]) -> DataFrame:
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in columns if c in medians}
    return df.withColumns(filled)


def spearman_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank correlation of every pair of columns after median fill, ties averaged.

    Ranks come from value counts of all columns in one scan. Each rank table is
    stored, so its real size decides between a broadcast and a shuffled join.
    """
    counts = _value_counts(df, columns)
    medians = _medians(counts, columns)
    at_median = F.coalesce(F.col("value"), F.try_element_at(_literal_map(medians), F.col("feature")))
    filled_counts = counts.select("feature", at_median.alias("value"), "n").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    ranks = materialize(average_ranks(filled_counts, "value", "n", ["feature"]).drop("n"), "ranks")
    ranked = _fill(df.select(*columns), columns, medians)
    for i, c in enumerate(columns):
        table = ranks.where(F.col("feature") == c).select(
            F.col("value").alias("_value"), F.col("average_rank").alias(f"_rank{i}")
        )
        # A column without any value has no ranks; only its own pairs are NULL then.
        ranked = ranked.join(table, F.col(c) == F.col("_value"), "left").drop("_value")
    return _pairs(ranked, columns, [f"_rank{i}" for i in range(len(columns))], "spearman_correlation")


def _literal_map(values: dict[str, float]):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _pairs(df: DataFrame, names: Sequence[str], columns: Sequence[str], out: str) -> DataFrame:
    """Correlations of all pairs from one aggregation; NULL when a column is constant."""
    pairs = list(combinations(range(len(names)), 2))
    stats = df.agg(
        # A constant column may show a rounding-size spread, so it is told by its ends.
        *[F.when(F.min(c) < F.max(c), F.stddev_pop(c)).alias(f"_s{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"_c{i}_{j}") for i, j in pairs],
    )
    correlation = lambda i, j: F.try_divide(F.col(f"_c{i}_{j}"), F.col(f"_s{i}") * F.col(f"_s{j}"))
    lines = [
        F.struct(F.lit(names[i]).alias("feature_1"), F.lit(names[j]).alias("feature_2"), correlation(i, j).alias(out))
        for i, j in pairs
    ]
    return stats.select(F.inline(F.array(*lines))).withColumn("absolute_correlation", F.abs(out))


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _pairs(df, columns, columns, "pearson_correlation")


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Diagonal of the pseudo-inverse of the correlation matrix.

    The matrix is aggregated in Spark; only its k x k entries reach the driver.
    """
    order = {c: i for i, c in enumerate(columns)}
    matrix = np.eye(len(columns))
    for row in pearson_pairs(df, columns).collect():
        i, j = order[row["feature_1"]], order[row["feature_2"]]
        matrix[i, j] = matrix[j, i] = row["pearson_correlation"]
    factors = np.diag(np.linalg.pinv(matrix))
    rows = [(c, float(v)) for c, v in zip(columns, factors)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def contingency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long contingency tables of all column pairs from one scan; missing values are left out."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"),
                F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"),
            )
            for a, b in combinations(columns, 2)
        ]
    )
    cells = df.select(F.inline(pairs)).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return cells.groupBy("feature_1", "feature_2", "x", "y").agg(F.count(F.lit(1)).alias("observed"))


def cramers_v(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bias-corrected Cramér's V of every pair of categorical columns.

    The statistic only needs the cells that occur. The contingency table is
    stored once, as its margins read it again.
    """
    key = ["feature_1", "feature_2"]
    cells = materialize(contingency(df, columns), "contingency")
    by_x = cells.groupBy(*key, "x").agg(F.sum("observed").alias("row_total"))
    by_y = cells.groupBy(*key, "y").agg(F.sum("observed").alias("column_total"))
    share = F.col("observed") * F.col("observed") / (F.col("row_total").cast("double") * F.col("column_total"))
    joined = cells.join(by_x, [*key, "x"]).join(by_y, [*key, "y"])
    sums = joined.groupBy(*key).agg(
        F.sum(share).alias("s"), F.sum("observed").cast("double").alias("n"),
        F.count_distinct("x").alias("r"), F.count_distinct("y").alias("c"),
    )
    n, r, c = F.col("n"), F.col("r"), F.col("c")
    past_one = F.greatest(n - 1, F.lit(1.0))
    phi2 = F.greatest(F.lit(0.0), F.col("s") - 1 - (r - 1) * (c - 1) / past_one)
    rows, cols = r - (r - 1) * (r - 1) / past_one, c - (c - 1) * (c - 1) / past_one
    room = F.least(rows - 1, cols - 1)
    return sums.select(*key, F.when(room > 0, F.sqrt(phi2 / room)).otherwise(0.0).alias("corrected_cramers_v"))


def correlation_ratio(df: DataFrame, categories: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Share of a number's spread that a category explains, as eta, for all pairs.

    Missing categories are a level of their own and missing numbers are left
    out. One scan reduces the rows to one line per level.
    """
    levels = F.array(
        *[
            F.struct(F.lit(c).alias("categorical_feature"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("level"))
            for c in categories
        ]
    )
    wide = df.select(*[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(numbers)], F.inline(levels))
    stats = wide.groupBy("categorical_feature", "level").agg(
        *[F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(numbers))],
        *[F.avg(f"_v{i}").alias(f"_m{i}") for i in range(len(numbers))],
        *[F.var_pop(f"_v{i}").alias(f"_q{i}") for i in range(len(numbers))],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(c).alias("numeric_feature"), F.col(f"_n{i}").alias("n"), F.col(f"_m{i}").alias("mean"),
                F.col(f"_q{i}").alias("spread"),
            )
            for i, c in enumerate(numbers)
        ]
    )
    key = ["categorical_feature", "numeric_feature"]
    groups = stats.select("categorical_feature", F.inline(lines)).where("n > 0")
    n, mean = F.col("n"), F.col("mean")
    sums = groups.groupBy(*key).agg(
        F.sum(n).alias("rows"), F.sum(n * F.col("spread")).alias("within"), F.sum(n * mean).alias("weighted")
    )
    grand = sums.select(
        *[F.col(k).alias(f"_{k}") for k in key], "within", (F.col("weighted") / F.col("rows")).alias("grand")
    )
    # One row per pair of columns.
    joined = groups.join(F.broadcast(grand), [F.col(k) == F.col(f"_{k}") for k in key])
    gap = F.col("mean") - F.col("grand")
    out = joined.groupBy(*key).agg(F.sum(n * gap * gap).alias("between"), F.max("within").alias("within"))
    total = F.col("between") + F.col("within")
    return out.select(
        *key, F.when(total > 0, F.sqrt(F.col("between") / total)).otherwise(0.0).alias("correlation_ratio_eta")
    )


def audit_summary(vif: DataFrame, correlations: DataFrame, cramers: DataFrame) -> DataFrame:
    """One row with the extremes of the three audits and how often they pass the limits."""
    a = vif.agg(F.max("vif").alias("maximum_numeric_vif"), F.count_if(F.col("vif") >= 5).alias("vif_above_5"))
    b = correlations.agg(
        F.max("absolute_correlation").alias("maximum_absolute_numeric_spearman"),
        F.count_if(F.col("absolute_correlation") >= 0.7).alias("numeric_pairs_above_0_7"),
    )
    c = cramers.agg(F.max("corrected_cramers_v").alias("maximum_corrected_cramers_v"))
    as_struct = lambda one: one.agg(F.first(F.struct(*one.columns))).scalar()
    top, pairs = as_struct(a), as_struct(b)
    return c.select(
        top.getField("maximum_numeric_vif").alias("maximum_numeric_vif"),
        pairs.getField("maximum_absolute_numeric_spearman").alias("maximum_absolute_numeric_spearman"),
        "maximum_corrected_cramers_v",
        pairs.getField("numeric_pairs_above_0_7").alias("numeric_pairs_above_0_7"),
        top.getField("vif_above_5").alias("vif_above_5"),
    )
