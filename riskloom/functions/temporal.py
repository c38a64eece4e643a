"""Calendar arithmetic and time-zone conversion."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

def one_hour() -> Column:
    return F.expr("INTERVAL 1 HOUR")


def local_departure(date: Column, hhmm: Column) -> Column:
    """Local wall-clock time of an HHMM number on ``date``; NULL if either is.

    ``2400`` is midnight of the following day.
    """
    minutes = F.floor(hhmm / 100) * 60 + hhmm % 100
    return F.timestamp_seconds(F.unix_date(date).cast("bigint") * 86400 + minutes.cast("bigint") * 60)


def local_to_utc(local: Column, zone: Column) -> Column:
    """Convert wall-clock time to UTC under a fixed daylight-saving policy.

    A time that happens twice is NULL, a time that is skipped moves forward to
    the first one that exists, and an unknown zone gives NULL. Holds for zones
    whose shift is a whole number of hours.
    """
    utc = F.to_utc_timestamp(local, zone)
    back = F.from_utc_timestamp(utc, zone)
    happens_twice = F.from_utc_timestamp(utc + one_hour(), zone) == local
    return (
        F.when(happens_twice, F.lit(None).cast("timestamp"))
        .when(back != local, F.to_utc_timestamp(F.date_trunc("hour", back), zone))
        .otherwise(utc)
    )


def floor_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def ceil_hour(ts: Column) -> Column:
    """The hour itself when ``ts`` is on it, otherwise the next one."""
    floor = F.date_trunc("hour", ts)
    return F.when(floor == ts, floor).otherwise(floor + one_hour())


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM")


def next_month_start(date: Column) -> Column:
    return F.add_months(F.trunc(date, "MM"), 1)


def departure_hour(hhmm: Column) -> Column:
    """Hour of an HHMM number: missing or unreadable is 0, then clipped to 0..23."""
    number = F.coalesce(hhmm.try_cast("int"), F.lit(0))
    return F.least(F.greatest(F.floor(number / 100).cast("int"), F.lit(0)), F.lit(23))


def parse_compact(text: Column) -> Column:
    """``yyyyMMddHHmm`` text as a UTC timestamp, NULL when it is not one."""
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmm"))
