"""From raw schedules to the processed store and the enriched sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

from riskloom.catalog import RENAME
from riskloom.functions.temporal import departure_hour, floor_hour, local_departure, local_to_utc, month_start
from riskloom.functions.values import positive_or_null, to_double
from riskloom.operators.cohort import add_flags
from riskloom.operators.history import congestion
from riskloom.operators.joins import broadcast_if_small, fill_zero, first_per_key, lookup_join, nearest_event
from riskloom.session import materialize

# Columns of the model sample.
SAMPLE_COLUMNS = [
    "Reporting_Airline", "Origin", "Dest", "month", "day_of_week", "departure_hour", "holiday_name", "CRSElapsedTime",
    "Distance", "origin_daily_scheduled", "dest_daily_scheduled", "origin_hourly_scheduled", "is_holiday",
    "within_3d_holiday", "days_to_nearest_holiday", "origin_hazard_forecast_any", "origin_hazard_active_at_prediction",
    "origin_hazard_max_severity", "origin_hazard_convective", "origin_hazard_flood", "origin_hazard_tropical",
    "origin_hazard_wind_fog", "origin_hazard_winter", "dest_hazard_forecast_any", "dest_hazard_active_at_prediction",
    "dest_hazard_max_severity", "dest_hazard_convective", "dest_hazard_flood", "dest_hazard_tropical",
    "dest_hazard_wind_fog", "dest_hazard_winter", "ArrDel15", "ArrDelay", "year", "FlightDate",
]
UNUSED_COLUMNS = ["day_of_year", "doy_sin", "doy_cos", "hour_sin", "hour_cos"]


def scheduled_utc(df: DataFrame, airports: DataFrame) -> DataFrame:
    """Scheduled departure as a UTC time and its hour, by the origin's time zone."""
    zones = airports.select("airport", F.col("timezone").alias("_zone"))
    joined = lookup_join(df, zones, {"Origin": "airport"}, validate=False)
    local = local_departure(F.col("FlightDate"), F.col("CRSDepTime").try_cast("int"))
    return (
        joined.withColumn("scheduled_departure_utc", local_to_utc(local, F.col("_zone")))
        .withColumn("utc_hour", floor_hour(F.col("scheduled_departure_utc")))
        .drop("_zone")
    )


#: Bits a packed hazard value has at most, and the size in text up to which the hours are broadcast.
HAZARD_BITS, HAZARD_BYTES = 4, 64 << 20


def attach_hazards(df: DataFrame, hours: DataFrame) -> DataFrame:
    """Hazards at both ends, both looked up at the scheduled departure hour; none is zero.

    ``hours`` has one row per airport and hour. They become one row per hour with its airports, so
    that both ends are found by one join. Values that one pass proves to be small whole numbers are
    packed into one number for an airport, so the hours, bounded by calendar and airports,
    are mostly small enough to be broadcast and the flights stay where they are.
    """
    values = [c for c in hours.columns if c not in ("airport", "utc_hour")]
    stored = materialize(hours, "hours")
    packed = _packable(stored, values)
    found = sum((F.coalesce(F.col(c), F.lit(0)).cast("long") * (1 << HAZARD_BITS * k) for k, c in enumerate(values)), F.lit(0).cast("long"))
    known = stored.where(F.col("airport").isNotNull()).groupBy(F.col("utc_hour").alias("_hour")).agg(
        F.map_from_entries(F.collect_list(F.struct("airport", found if packed else F.struct(*values)))).alias("_hazards")
    )
    if packed:
        known = broadcast_if_small(materialize(known, "known-hours"), max_bytes=HAZARD_BYTES)
    joined = df.join(known, F.col("utc_hour") == F.col("_hour"), "left").select(
        *df.columns, *[F.col("_hazards")[F.col(airport)].alias(f"_at_{airport}") for airport in ("Origin", "Dest")]
    )

    def at(airport: str, k: int) -> Column:
        if packed:
            return F.shiftright(f"_at_{airport}", HAZARD_BITS * k).bitwiseAND(F.lit((1 << HAZARD_BITS) - 1))
        return F.col(f"_at_{airport}").getField(values[k])

    sides = [(f"{role}_{c}", at(airport, k)) for airport, role in (("Origin", "origin"), ("Dest", "dest")) for k, c in enumerate(values)]
    return fill_zero(joined.select(*df.columns, *[c.alias(n) for n, c in sides]), ("origin_hazard_", "dest_hazard_"))


def _packable(hours: DataFrame, values: Sequence[str]) -> bool:
    """Whether all values are whole numbers of a few bits, missing ones counting as zero."""
    whole = all(isinstance(hours.schema[c].dataType, IntegralType) for c in values)
    if not values or not whole or HAZARD_BITS * len(values) > 63:
        return False
    ends = hours.agg(F.min(F.least(F.lit(0), *values)).alias("low"), F.max(F.greatest(F.lit(0), *values)).alias("high")).first()
    return ends["low"] is None or (ends["low"] >= 0 and ends["high"] < 1 << HAZARD_BITS)


def processed_flights(raw: DataFrame, airports: DataFrame, holidays: DataFrame, hours: DataFrame) -> DataFrame:
    """All schedule features and outcome flags, cancelled and diverted rows kept."""
    df = scheduled_utc(raw, airports).withColumns(
        {
            "month": F.month("FlightDate"),
            "day_of_week": F.weekday("FlightDate"),
            "departure_hour": departure_hour(F.col("CRSDepTime")),
            "year": F.year("FlightDate"),
        }
    )
    df = nearest_event(congestion(df), "FlightDate", holidays)
    return add_flags(attach_hazards(df, hours))


def hub_dimension(raw: DataFrame) -> DataFrame:
    """Trim codes, default the class, coerce the volume, keep one row per airport."""
    clean = raw.select(
        F.trim("airport").alias("airport"),
        F.trim(F.coalesce("hub", F.lit("Non-primary"))).alias("faa_hub_category"),
        to_double(F.col("enplanements")).alias("faa_2023_enplanements"),
    ).withColumn("faa_log_enplanements", F.log1p("faa_2023_enplanements"))
    return first_per_key(clean, ["airport"], ["faa_hub_category", "faa_2023_enplanements"])


def present(df: DataFrame) -> DataFrame:
    """Presentation names, unused columns dropped, impossible durations missing."""
    df = df.withColumnsRenamed(RENAME).drop(*UNUSED_COLUMNS)
    return df.withColumn("scheduled_duration_minutes", positive_or_null(F.col("scheduled_duration_minutes"))).withColumn(
        "flight_date", F.col("FlightDate").cast("date")
    ).drop("FlightDate").withColumn("flight_month", month_start(F.col("flight_date")))


def enrich(
    sample: DataFrame, performance: DataFrame, measures: DataFrame, hubs: DataFrame, keep: Sequence[str] = ()
) -> DataFrame:
    """The model table: trailing rates, last month's network measures, hub classes.

    Every lookup is validated to be many-to-one.
    """
    df = present(sample)
    rates = performance.withColumnsRenamed({"FlightDate": "_day", "Origin": "_from", "Dest": "_to"})
    df = lookup_join(df, rates, {"flight_date": "_day", "origin_airport": "_from", "destination_airport": "_to"})
    for airport, prefix in (("origin_airport", "origin_"), ("destination_airport", "destination_")):
        df = lookup_join(df, measures, {"flight_month": "flight_month", airport: "airport"}, prefix)
    for airport, prefix in (("origin_airport", "origin_"), ("destination_airport", "destination_")):
        df = lookup_join(df, hubs, {airport: "airport"}, prefix)
    return df
