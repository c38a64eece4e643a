"""Features from past outcomes and from scheduled volumes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from riskloom.functions.values import ratio
from riskloom.operators.joins import broadcast_if_small, lookup_join
from riskloom.session import materialize


def daily_outcomes(df: DataFrame, date: str, keys: Sequence[str], label: str) -> DataFrame:
    """Positives and rows per day and key."""
    return df.groupBy(date, *keys).agg(F.sum(label).alias("delayed"), F.count(F.lit(1)).alias("n"))


def trailing_rate(
    df: DataFrame, date: str, keys: Sequence[str], label: str, name: str, from_day: int, to_day: int
) -> DataFrame:
    """Rate over the days ``date - from_day`` to ``date - to_day``.

    One row per day on which the key has rows; NULL when no earlier day is in
    reach. Rows are reduced to days first, so a window group holds one row per
    day of the key however many events the key has.
    """
    window = W.partitionBy(*keys).orderBy(F.unix_date(date)).rangeBetween(-from_day, -to_day)
    daily = daily_outcomes(df, date, keys, label)
    return daily.select(date, *keys, ratio(F.sum("delayed").over(window), F.sum("n").over(window)).alias(name))


def trailing_features(
    df: DataFrame, date: str = "FlightDate", origin: str = "Origin", dest: str = "Dest", label: str = "ArrDel15"
) -> DataFrame:
    """Origin and destination rates over days -8..-2 and route rates over -29..-2.

    The events are read and shuffled once: the route-days are stored and feed
    all three rates. Only days with an eligible event on the route get a row.
    """
    routes = materialize(daily_outcomes(df, date, [origin, dest], label), "route-days")

    def rates(keys, name, from_day):
        window = W.partitionBy(*keys).orderBy(F.unix_date(date)).rangeBetween(-from_day, -2)
        days = routes
        if len(keys) == 1:
            days = routes.groupBy(date, *keys).agg(F.sum("delayed").alias("delayed"), F.sum("n").alias("n"))
        return days.select(date, *keys, ratio(F.sum("delayed").over(window), F.sum("n").over(window)).alias(name))

    route = rates([origin, dest], "route_recent_delay_rate", 29)
    by_origin = rates([origin], "origin_recent_delay_rate", 8)
    by_dest = rates([dest], "destination_recent_delay_rate", 8)
    joined = lookup_join(route, by_origin, {date: date, origin: origin}, validate=False)
    return lookup_join(joined, by_dest, {date: date, dest: dest}, validate=False)


def congestion(
    df: DataFrame,
    date: str = "FlightDate",
    origin: str = "Origin",
    dest: str = "Dest",
    hour: str = "departure_hour",
) -> DataFrame:
    """Scheduled volumes, cancelled rows included, attached to every row.

    One scan counts departures per day, airport and hour, and arrivals per day and airport; both
    are bounded by the calendar and the airports, not by the rows. The hours of a day and airport
    are packed into one row, so the rows meet a table that broadcasts if a count proves it small,
    and is else joined with the hot keys split. A window over the rows would put a whole day,
    however large, into one task. Rows without an hour have no departures counted, but count for their day.
    """
    sets = df.groupingSets([[date, origin, hour], [date, dest]], date, origin, hour, dest).agg(
        F.count(F.lit(1)).alias("n"), F.grouping(dest).alias("_departs")
    )
    counts = materialize(sets, "counts")
    by_hour = F.filter(F.collect_list(F.struct(F.col(hour).alias("h"), "n")), lambda s: s["h"].isNotNull())
    departures = counts.where("_departs = 1").groupBy(date, origin).agg(
        F.map_from_entries(by_hour).alias("_by_hour"), F.sum("n").alias("_daily")
    )
    arrivals = counts.where("_departs = 0").select(date, dest, F.col("n").alias("dest_daily_scheduled"))
    out = lookup_join(df, _kept_small(departures), {date: date, origin: origin}, validate=False)
    out = lookup_join(out, _kept_small(arrivals), {date: date, dest: dest}, validate=False)
    return out.select(
        *df.columns, F.col("_by_hour")[F.col(hour)].alias("origin_hourly_scheduled"),
        F.when(F.col(hour).isNotNull(), F.col("_daily")).alias("origin_daily_scheduled"), "dest_daily_scheduled",
    )


def _kept_small(table: DataFrame) -> DataFrame:
    """A stored table, broadcast up to 32 MB of text."""
    return broadcast_if_small(materialize(table, "volumes"), max_bytes=32 << 20)
