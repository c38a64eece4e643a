"""Lookup joins: validated, role-playing, and broadcast only when small."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from riskloom.operators.ordering import nearest_known
from riskloom.session import materialize

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 8 << 20


class DuplicateKeyError(ValueError):
    """The looked-up side has more than one row for a key."""


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when one pass proves the table is within ``max_rows`` and ``max_bytes``.

    Bytes are those of the rows written as text, so long strings and arrays count in full.

    Beyond that no hint is given and the join shuffles, with hot keys split by
    adaptive execution.
    """
    found = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("size")
    ).first()
    return F.broadcast(df) if found["n"] <= max_rows and found["size"] <= max_bytes else df


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise if ``keys`` do not identify the rows of ``df``."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).collect()
    if repeated:
        raise DuplicateKeyError(f"key {tuple(repeated[0][k] for k in keys)} of {list(keys)} is repeated")
    return df


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Mapping[str, str],
    prefix: str = "",
    validate: bool = True,
) -> DataFrame:
    """Left join that keeps the left row count.

    ``keys`` maps left columns to right columns; the other right columns are
    added under ``prefix``, so one dimension can be joined in several roles.
    """
    if validate:
        require_unique(right, list(keys.values()))
    values = [c for c in right.columns if c not in keys.values()]
    role = right.select(
        *[F.col(r).alias(f"_key_{l}") for l, r in keys.items()], *[F.col(c).alias(prefix + c) for c in values]
    )
    condition = [F.col(l) == F.col(f"_key_{l}") for l in keys]
    return left.join(role, condition, "left").select(*left.columns, *[prefix + c for c in values])


def fill_zero(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Missing lookups of the columns with these prefixes count as zero."""
    names = [c for c in df.columns if c.startswith(tuple(prefixes))]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in names})


def keep_members(df: DataFrame, column: str, members: DataFrame, key: str) -> DataFrame:
    """Rows whose value occurs in ``members``."""
    return df.join(members.select(F.col(key).alias("_member")), F.col(column) == F.col("_member"), "left_semi")


def distinct_union(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Distinct non-null values over several columns, in one scan."""
    values = df.select(F.explode(F.array(*columns)).alias(name))
    return values.where(F.col(name).isNotNull()).distinct()


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the first in the stated order.

    An aggregate rather than a row number: a hot key is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def nearest_event(
    df: DataFrame, date: str, events: DataFrame, event_date: str = "date", event_name: str = "name", within: int = 3
) -> DataFrame:
    """Distance in days to the nearest event and whether the day is one; a time counts as its day.

    Distinct days and event days are merged in order, so a day meets the events beside it and
    no others, however many there are. The result has one row per day and is joined back: by
    broadcast if a count proves it small, else by a shuffle in which hot days are split. A null
    date has no distance and is no event; without events every distance is null.
    """
    day = lambda c: F.col(c).cast("date")
    per_day = events.where(F.col(event_date).isNotNull()).groupBy(day(event_date).alias("_day")).agg(
        F.concat_ws("; ", F.sort_array(F.collect_set(event_name))).alias("_name")
    ).withColumn("event", F.col("_day"))
    days = df.select(day(date).alias("_day")).where("_day IS NOT NULL").distinct()
    merged = nearest_known(days.join(per_day, "_day", "full"), "_day", "event")
    distance = F.least(F.datediff("_day", "previous_event"), F.datediff("next_event", "_day"))
    calendar = merged.select(
        F.col("_day").alias("_date"),
        F.coalesce("_name", F.lit("None")).alias("holiday_name"),
        F.col("event").isNotNull().cast("int").alias("is_holiday"),
        F.coalesce(distance <= within, F.lit(False)).cast("int").alias("within_3d_holiday"),
        distance.cast("int").alias("days_to_nearest_holiday"),
    )
    joined = df.join(broadcast_if_small(materialize(calendar, "calendar")), day(date) == F.col("_date"), "left").drop("_date")
    none = {"holiday_name": F.lit("None"), "is_holiday": F.lit(0), "within_3d_holiday": F.lit(0)}
    return joined.withColumns({c: F.coalesce(c, default) for c, default in none.items()})
