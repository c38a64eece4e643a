"""Running totals, ranks, row numbers and exact quantiles over any amount of rows.

An ordered window without partitioning, or with a hot group, runs in one task.
Here the rows are range-partitioned by group and order instead, so a large
group spans many equally filled slices; each slice is summed on its own and the
few per-slice totals carry the sums across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.session import materialize


def running_totals(
    df: DataFrame,
    order_by: Sequence[Column],
    values: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``cum_<v>`` (inclusive) and ``total_<v>`` per group for every value.

    ``order_by`` must order the rows of a group completely.
    """
    by = list(by)
    placed = df.repartitionByRange(*[F.col(c) for c in by], *order_by).withColumn("_slice", F.spark_partition_id())
    # The split depends on a sample of the data, so it is stored before it is read twice.
    placed = materialize(placed, "slices")

    inside = W.partitionBy(*by, "_slice").orderBy(*order_by).rowsBetween(W.unboundedPreceding, W.currentRow)
    group = W.partitionBy(*by)
    earlier = group.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        placed.groupBy(*by, "_slice")
        .agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
        .select(
            *[F.col(c).alias(f"_key_{c}") for c in [*by, "_slice"]],
            *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_before_{v}") for v in values],
            *[F.sum(f"_sum_{v}").over(group).alias(f"total_{v}") for v in values],
        )
    )
    summed = placed.select("*", *[F.sum(v).over(inside).alias(f"_inside_{v}") for v in values])
    keys = [F.col("_slice") == F.col("_key__slice")] + [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in by]
    return summed.join(carried, keys).select(
        *df.columns,
        *[(F.col(f"_inside_{v}") + F.col(f"_before_{v}")).alias(f"cum_{v}") for v in values],
        *[F.col(f"total_{v}") for v in values],
    )


def row_numbers(
    df: DataFrame, order_by: Sequence[Column], by: Sequence[str] = (), name: str = "row_number", keep: Sequence[str] | None = None
) -> DataFrame:
    """1-based position within the group, without one task per group; ``keep`` names the columns that stay (all).

    The rows move once: slices are sorted and numbered before they are stored, and a group's place
    in a slice, and the rows it has in earlier ones, come from one small row per group and slice.
    """
    by, kept = list(by), list(df.columns if keep is None else keep)
    keys = [F.col(c) for c in by]
    placed = df.repartitionByRange(*keys, *order_by).sortWithinPartitions(*keys, *order_by)
    # The generated number holds the slice in its upper bits and the place in the slice in its lower 33.
    placed = materialize(placed.select(*kept, F.monotonically_increasing_id().alias("_id")), "numbered")
    placed = placed.withColumn("_slice", F.shiftright("_id", 33))
    earlier = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy(*by, "_slice").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows")).select(
        *[F.col(c).alias(f"_key_{c}") for c in by], F.col("_slice").alias("_key__slice"), "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
    )
    same = [F.col("_slice") == F.col("_key__slice")] + [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in by]
    return placed.join(starts, same).select(*kept, (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias(name))


def average_ranks(counts: DataFrame, value: str, count: str, by: Sequence[str] = ()) -> DataFrame:
    """Tie-averaged rank of every distinct value, from a value/count table."""
    ranked = running_totals(counts, [F.col(value)], [count], by)
    rank = F.col(f"cum_{count}") - F.col(count) + (F.col(count) + 1) / 2.0
    return ranked.select(*by, value, count, rank.alias("average_rank"))


def pick_quantiles(
    ranked: DataFrame, value: str, count: str, probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolation quantiles from a value/count table with running totals.

    Only the rows that hold one of the wanted positions leave the scan.
    """
    by = list(by)
    end, start = F.col(f"cum_{count}"), F.col(f"cum_{count}") - F.col(count)
    last = F.col(f"total_{count}") - 1
    positions = F.array(*[F.struct(F.lit(float(p)).alias("p"), (last * F.lit(float(p))).alias("at")) for p in probabilities])
    holds = lambda position: (position >= start) & (position < end)
    hits = F.filter(positions, lambda s: holds(F.floor(s["at"])) | holds(F.ceil(s["at"])))
    found = ranked.select(*by, value, start.alias("_start"), end.alias("_end"), F.explode(hits).alias("_q"))
    at, inside = F.col("_q.at"), lambda p: (p >= F.col("_start")) & (p < F.col("_end"))
    ends = found.groupBy(*by, F.col("_q.p").alias("probability")).agg(
        F.max(F.when(inside(F.floor(at)), F.col(value))).alias("_low"),
        F.max(F.when(inside(F.ceil(at)), F.col(value))).alias("_high"),
        F.max(at - F.floor(at)).alias("_part"),
    )
    quantile = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")
    return ends.select(*by, "probability", quantile.alias("quantile"))


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of a column with any number of distinct values, per group.

    The built-in ``percentile`` keeps one counter per distinct value of a group
    in one task, which suits whole minutes but not continuous scores.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return pick_quantiles(running_totals(counts, [F.col(value)], ["_n"], by), value, "_n", probabilities, by)


def nearest_known(df: DataFrame, order: str, value: str) -> DataFrame:
    """Add ``previous_<v>`` and ``next_<v>``: the last value known at or before a row, and the first at or after it.

    ``value`` must rise with ``order`` where it is known. Slices are searched on their own;
    one row per slice carries the last value into later slices and the first into earlier ones.
    """
    placed = df.repartitionByRange(F.col(order)).withColumn("_slice", F.spark_partition_id())
    placed = materialize(placed, "slices")
    inside = W.partitionBy("_slice").orderBy(order)
    before = inside.rangeBetween(W.unboundedPreceding, W.currentRow)
    after = inside.rangeBetween(W.currentRow, W.unboundedFollowing)
    ends = placed.groupBy("_slice").agg(F.min(value).alias("_first"), F.max(value).alias("_last"))
    by_slice = W.orderBy("_at")  # one row per slice
    carried = ends.select(F.col("_slice").alias("_at"), "_first", "_last").select(
        "_at",
        F.max("_last").over(by_slice.rowsBetween(W.unboundedPreceding, -1)).alias("_earlier"),
        F.min("_first").over(by_slice.rowsBetween(1, W.unboundedFollowing)).alias("_later"),
    )
    found = placed.select("*", F.max(value).over(before).alias("_up_to"), F.min(value).over(after).alias("_from"))
    return found.join(carried, F.col("_slice") == F.col("_at")).select(
        *df.columns, F.coalesce("_up_to", "_earlier").alias(f"previous_{value}"), F.coalesce("_from", "_later").alias(f"next_{value}")
    )
