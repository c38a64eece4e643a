"""Registered queries: cohort, calendar, joins, history and hazards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.catalog import AIRLINES, DURATION_EDGES, DURATION_LABELS, HAZARD_GROUPS, RENAME
from riskloom.functions import temporal as T, values as V
from riskloom.operators import history, intervals, joins
from riskloom.operators.cohort import eligible, split_part
from riskloom.operators.profile import daily_anomalies, daily_series
from riskloom.plans import binding as B, flights as P
from riskloom.plans.binding import AIRPORTS_SQL, HAZARDS_SQL, HOLIDAYS_SQL, HUBS_SQL, RAW_SQL, labelled_flights, sql_with
from riskloom.plans.registry import query
from riskloom.session import materialize

NTZ = "timestamp_ntz"
GROUPS = sorted(set(HAZARD_GROUPS.values()))


def eligible_flights(spark, sf_dir, *columns) -> DataFrame:
    return eligible(labelled_flights(spark, sf_dir, *columns, "primary_eligible"))


# --- trailing rates and congestion ------------------------------------------------

_DAILY = """{name} AS (
  SELECT "FlightDate", {keys}, sum("ArrDel15") AS delayed, count(*) AS n FROM flights WHERE primary_eligible = 1 GROUP BY ALL
)"""
# Every day meets the earlier days of its key within the range; the operator uses a window instead.
_ROLL = """{name}_roll AS (
  SELECT t."FlightDate", {ours}, sum(p.delayed) / nullif(sum(p.n), 0) AS {rate} FROM {name} t LEFT JOIN {name} p
  ON {same} AND date_diff('day', p."FlightDate", t."FlightDate") BETWEEN 2 AND {days} GROUP BY ALL
)"""


def _rolled(name: str, keys: str, rate: str, days: int) -> str:
    columns = keys.split(", ")
    ours, same = ", ".join(f"t.{k}" for k in columns), " AND ".join(f"t.{k} = p.{k}" for k in columns)
    return _DAILY.format(name=name, keys=keys) + "," + _ROLL.format(name=name, ours=ours, rate=rate, days=days, same=same)


_ORIGIN_ROLL = _rolled("by_origin", '"Origin"', "origin_recent_delay_rate", 8)
_DEST_ROLL = _rolled("by_dest", '"Dest"', "destination_recent_delay_rate", 8)
_ROUTE_ROLL = _rolled("by_route", '"Origin", "Dest"', "route_recent_delay_rate", 29)
TRAILING_SQL = f"""{_ORIGIN_ROLL},{_DEST_ROLL},{_ROUTE_ROLL}, rates AS (
  SELECT r.*, o.origin_recent_delay_rate, d.destination_recent_delay_rate FROM by_route_roll r
  LEFT JOIN by_origin_roll o ON r."FlightDate" = o."FlightDate" AND r."Origin" = o."Origin"
  LEFT JOIN by_dest_roll d ON r."FlightDate" = d."FlightDate" AND r."Dest" = d."Dest"
)"""


@query("trailing_origin_rate", "WN1 AG11 SCL12", sql_with(RAW_SQL, _ORIGIN_ROLL, body="SELECT * FROM by_origin_roll"))
def trailing_origin_rate(spark, sf_dir):
    flown = eligible_flights(spark, sf_dir, "FlightDate", "Origin", "ArrDel15")
    return history.trailing_rate(flown, "FlightDate", ["Origin"], "ArrDel15", "origin_recent_delay_rate", 8, 2)


@query("trailing_destination_rate", "WN1 AG11", sql_with(RAW_SQL, _DEST_ROLL, body="SELECT * FROM by_dest_roll"))
def trailing_destination_rate(spark, sf_dir):
    flown = eligible_flights(spark, sf_dir, "FlightDate", "Dest", "ArrDel15")
    return history.trailing_rate(flown, "FlightDate", ["Dest"], "ArrDel15", "destination_recent_delay_rate", 8, 2)


@query("trailing_route_rate", "WN2 AG11", sql_with(RAW_SQL, _ROUTE_ROLL, body="SELECT * FROM by_route_roll"))
def trailing_route_rate(spark, sf_dir):
    flown = eligible_flights(spark, sf_dir, "FlightDate", "Origin", "Dest", "ArrDel15")
    return history.trailing_rate(flown, "FlightDate", ["Origin", "Dest"], "ArrDel15", "route_recent_delay_rate", 29, 2)


@query("trailing_features", "JN3 WN1 WN2 AG11", sql_with(RAW_SQL, TRAILING_SQL, body="SELECT * FROM rates"))
def trailing_features(spark, sf_dir):
    return history.trailing_features(eligible_flights(spark, sf_dir, "FlightDate", "Origin", "Dest", "ArrDel15"))


@query(
    "daily_route_outcomes", "AG11",
    sql_with(RAW_SQL, _DAILY.format(name="daily", keys='"Origin", "Dest"'), body="SELECT * FROM daily"),
)
def daily_route_outcomes(spark, sf_dir):
    flown = eligible_flights(spark, sf_dir, "FlightDate", "Origin", "Dest", "ArrDel15")
    return history.daily_outcomes(flown, "FlightDate", ["Origin", "Dest"], "ArrDel15")


CONGESTION_SQL = """congested AS (
  SELECT *, count(*) OVER (PARTITION BY "FlightDate", "Origin") AS origin_daily_scheduled,
         count(*) OVER (PARTITION BY "FlightDate", "Dest") AS dest_daily_scheduled,
         count(*) OVER (PARTITION BY "FlightDate", "Origin", departure_hour) AS origin_hourly_scheduled
  FROM flights
)"""


@query(
    "scheduled_congestion", "WN3",
    sql_with(RAW_SQL, CONGESTION_SQL, body="""SELECT row_key, "FlightDate", "Origin", "Dest", departure_hour,
      origin_hourly_scheduled, origin_daily_scheduled, dest_daily_scheduled FROM congested"""),
)
def scheduled_congestion(spark, sf_dir):
    return history.congestion(labelled_flights(spark, sf_dir, "row_key", "FlightDate", "Origin", "Dest", "departure_hour"))


# --- scalar and calendar functions ------------------------------------------------


@query(
    "cohort_flags", "FLT1 PRJ5",
    sql_with(RAW_SQL, body='SELECT row_key, "Cancelled", "Diverted", "ArrDel15", adverse_operation, primary_eligible FROM flights'),
)
def cohort_flags(spark, sf_dir):
    return labelled_flights(
        spark, sf_dir, "row_key", "Cancelled", "Diverted", "ArrDel15", "adverse_operation", "primary_eligible"
    )


@query(
    "eligible_years", "FLT2 PRJ4",
    sql_with(RAW_SQL, body="""SELECT row_key, "year", "ArrDelay", "ArrDel15" FROM flights
      WHERE primary_eligible = 1 AND "year" IN (1996, 1998, 2000) AND "ArrDelay" IS NOT NULL"""),
)
def eligible_years(spark, sf_dir):
    columns = ["row_key", "year", "ArrDelay", "ArrDel15"]
    df = labelled_flights(spark, sf_dir, *columns, "primary_eligible")
    return eligible(df, [1996, 1998, 2000]).where("ArrDelay IS NOT NULL").select(*columns)


@query(
    "temporal_split_sizes", "FLT3",
    sql_with(RAW_SQL, body="""SELECT CASE WHEN "year" <= 1999 THEN 'fit' WHEN "year" = 2000 THEN 'validate' ELSE 'test' END AS part,
      count(*) AS n, avg("ArrDel15") AS delay_rate FROM flights WHERE primary_eligible = 1 AND "year" <= 2001 GROUP BY 1"""),
)
def temporal_split_sizes(spark, sf_dir):
    rows = eligible_flights(spark, sf_dir, "year", "ArrDel15").withColumn("part", split_part(1999, 2000, 2001)).where("part IS NOT NULL")
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg("ArrDel15").alias("delay_rate"))


@query(
    "valid_durations", "FLT5 PRJ6",
    sql_with(RAW_SQL, body="""SELECT row_key, CASE WHEN "CRSElapsedTime" > 0 THEN "CRSElapsedTime" END AS scheduled_duration_minutes FROM flights"""),
)
def valid_durations(spark, sf_dir):
    df = labelled_flights(spark, sf_dir, "row_key", "CRSElapsedTime")
    return df.select("row_key", V.positive_or_null(F.col("CRSElapsedTime").cast("string")).alias("scheduled_duration_minutes"))


@query(
    "calendar_parts", "SCL4 SCL5",
    sql_with(RAW_SQL, body="""SELECT row_key, "month", day_of_week, departure_hour,
      CAST(date_trunc('month', "FlightDate") AS DATE) AS month_start,
      CAST(date_trunc('month', "FlightDate") + INTERVAL 1 MONTH AS DATE) AS next_month FROM flights"""),
)
def calendar_parts(spark, sf_dir):
    df = labelled_flights(spark, sf_dir, "row_key", "FlightDate", "month", "day_of_week", "departure_hour")
    date = F.col("FlightDate")
    return df.select(
        "row_key", "month", "day_of_week", "departure_hour",
        T.month_start(date).alias("month_start"), T.next_month_start(date).alias("next_month"),
    )


UTC_SQL = """local_times AS (
  SELECT f.*, a.timezone AS zone,
         CAST("FlightDate" AS TIMESTAMP) + to_minutes(CAST(("CRSDepTime" // 100) * 60 + "CRSDepTime" % 100 AS INTEGER)) AS l
  FROM flights f LEFT JOIN airports a ON f."Origin" = a.airport
), instants AS (
  SELECT *, timezone('UTC', timezone(zone, l)) AS u FROM local_times
), scheduled AS (
  SELECT * EXCLUDE (zone, u),
         CASE WHEN timezone(zone, timezone('UTC', u - INTERVAL 1 HOUR)) = l THEN NULL
              WHEN timezone(zone, timezone('UTC', u)) <> l
                THEN timezone('UTC', timezone(zone, date_trunc('hour', timezone(zone, timezone('UTC', u)))))
              ELSE u END AS scheduled_departure_utc
  FROM instants
), timed AS (
  SELECT *, date_trunc('hour', scheduled_departure_utc) AS utc_hour FROM scheduled
)"""


@query(
    "scheduled_departure_utc", "SCL1 SCL2 SCL3",
    sql_with(RAW_SQL, AIRPORTS_SQL, UTC_SQL, body="SELECT row_key, l AS local_time, scheduled_departure_utc, utc_hour FROM timed"),
)
def scheduled_departure_utc(spark, sf_dir):
    raw = labelled_flights(spark, sf_dir, "row_key", "FlightDate", "CRSDepTime", "Origin")
    local = T.local_departure(F.col("FlightDate"), F.col("CRSDepTime"))
    return P.scheduled_utc(raw, B.airports(spark, sf_dir)).select(
        "row_key", local.cast(NTZ).alias("local_time"),
        F.col("scheduled_departure_utc").cast(NTZ).alias("scheduled_departure_utc"), F.col("utc_hour").cast(NTZ).alias("utc_hour"),
    )


@query(
    "hour_bounds", "SCL3",
    """SELECT event_id, date_trunc('hour', ts) AS floor_hour,
         CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS ceil_hour FROM events""",
)
def hour_bounds(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return B.table(spark, sf_dir, "events").select(
        "event_id", T.floor_hour(ts).cast(NTZ).alias("floor_hour"), T.ceil_hour(ts).cast(NTZ).alias("ceil_hour")
    )


@query(
    "duration_bands", "SCL9 AG17",
    sql_with(RAW_SQL, body="""SELECT band, count(*) AS flights, avg("ArrDel15") AS delay_rate FROM (
      SELECT "ArrDel15", CASE WHEN "CRSElapsedTime" >= 420 THEN '420+' WHEN "CRSElapsedTime" >= 300 THEN '300–419'
        WHEN "CRSElapsedTime" >= 240 THEN '240–299' WHEN "CRSElapsedTime" >= 180 THEN '180–239'
        WHEN "CRSElapsedTime" >= 150 THEN '150–179' WHEN "CRSElapsedTime" >= 120 THEN '120–149'
        WHEN "CRSElapsedTime" >= 90 THEN '90–119' WHEN "CRSElapsedTime" >= 60 THEN '60–89'
        WHEN "CRSElapsedTime" >= 0 THEN '<60' END AS band FROM flights WHERE primary_eligible = 1)
      WHERE band IS NOT NULL GROUP BY band"""),
)
def duration_bands(spark, sf_dir):
    df = eligible_flights(spark, sf_dir, "CRSElapsedTime", "ArrDel15")
    banded = df.withColumn("band", V.band(F.col("CRSElapsedTime"), DURATION_EDGES, DURATION_LABELS))
    return banded.where("band IS NOT NULL").groupBy("band").agg(
        F.count(F.lit(1)).alias("flights"), F.avg("ArrDel15").alias("delay_rate")
    )


_airline_sql = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AIRLINES.items())
_carriers = list(AIRLINES)


@query(
    "airline_names", "SCL7",
    f"""WITH parts AS (SELECT p_partkey, ([{', '.join(f"'{c}'" for c in _carriers)}, '??'])[p_partkey % {len(_carriers) + 1} + 1] AS code FROM part)
      SELECT code, CASE code {_airline_sql} ELSE code END AS airline_name, count(*) AS n FROM parts GROUP BY 1, 2""",
)
def airline_names(spark, sf_dir):
    codes = F.array(*[F.lit(c) for c in [*_carriers, "??"]])
    code = F.get(codes, (F.col("p_partkey") % (len(_carriers) + 1)).cast("int"))
    df = B.table(spark, sf_dir, "part").select(code.alias("code"))
    named = df.withColumn("airline_name", V.lookup(F.col("code"), AIRLINES, F.col("code")))
    return named.groupBy("code", "airline_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filled_inputs", "SCL10 SCL11 SCL16 SCL18",
    sql_with(RAW_SQL, body="""SELECT row_key, coalesce("Distance", 0) AS distance, round(ln(1 + coalesce("Distance", 0)), 6) AS log_distance,
      CASE WHEN "CRSElapsedTime" IS NULL AND "Distance" IS NULL THEN NULL
        ELSE (coalesce("CRSElapsedTime", 0) + coalesce("Distance", 0))
          / ((CASE WHEN "CRSElapsedTime" IS NULL THEN 0 ELSE 1 END) + (CASE WHEN "Distance" IS NULL THEN 0 ELSE 1 END)) END AS mean_present,
      CAST("Cancelled" + "Diverted" + coalesce("ArrDel15", 0) AS DOUBLE) AS flag_sum FROM flights"""),
)
def filled_inputs(spark, sf_dir):
    df = labelled_flights(spark, sf_dir, "row_key", "Distance", "CRSElapsedTime", "Cancelled", "Diverted", "ArrDel15")
    means = df.withColumn("mean_present", V.mean_of_present([F.col("CRSElapsedTime"), F.col("Distance")]))
    return means.fillna({"Distance": 0.0}).select(
        "row_key", F.col("Distance").alias("distance"), F.round(F.log1p("Distance"), 6).alias("log_distance"),
        "mean_present", V.sum_of_flags(["Cancelled", "Diverted", "ArrDel15"]).alias("flag_sum"),
    )


# --- joins ------------------------------------------------------------------------


@query("airport_codes", "AG14 ST2", sql_with(RAW_SQL, body='SELECT "Origin" AS airport FROM flights UNION SELECT "Dest" FROM flights'))
def airport_codes(spark, sf_dir):
    return joins.distinct_union(labelled_flights(spark, sf_dir, "Origin", "Dest"), ["Origin", "Dest"], "airport")


@query(
    "served_airports", "FLT8 SRC7",
    sql_with(RAW_SQL, AIRPORTS_SQL, body="""SELECT * FROM airports
      WHERE airport IN (SELECT "Origin" FROM flights UNION SELECT "Dest" FROM flights)"""),
)
def served_airports(spark, sf_dir):
    used = joins.distinct_union(labelled_flights(spark, sf_dir, "Origin", "Dest"), ["Origin", "Dest"], "code")
    return joins.keep_members(B.airports(spark, sf_dir), "airport", used, "code")


HOLIDAY_FEATURES_SQL = """dated AS (
  SELECT d."FlightDate", CAST(min(abs(datediff('day', h."date", d."FlightDate"))) AS INTEGER) AS days_to_nearest_holiday,
         coalesce(max(CASE WHEN h."date" = d."FlightDate" THEN h.name END), 'None') AS holiday_name
  FROM (SELECT DISTINCT "FlightDate" FROM flights) d, holidays h GROUP BY d."FlightDate"
), calendar AS (
  SELECT *, CASE WHEN holiday_name <> 'None' THEN 1 ELSE 0 END AS is_holiday,
         CASE WHEN days_to_nearest_holiday <= 3 THEN 1 ELSE 0 END AS within_3d_holiday FROM dated
)"""


@query(
    "holiday_features", "JN12 AG15 SRC7",
    sql_with(RAW_SQL, HOLIDAYS_SQL, HOLIDAY_FEATURES_SQL, body='SELECT f.row_key, c.* FROM flights f JOIN calendar c USING ("FlightDate")'),
)
def holiday_features(spark, sf_dir):
    return joins.nearest_event(labelled_flights(spark, sf_dir, "row_key", "FlightDate"), "FlightDate", B.holidays(spark, sf_dir))


@query(
    "first_flight_per_route", "AG15",
    sql_with(RAW_SQL, body="""SELECT "Origin", "Dest", row_key, "FlightDate" FROM flights
      QUALIFY row_number() OVER (PARTITION BY "Origin", "Dest" ORDER BY "FlightDate", row_key) = 1"""),
)
def first_flight_per_route(spark, sf_dir):
    df = labelled_flights(spark, sf_dir, "Origin", "Dest", "row_key", "FlightDate")
    return joins.first_per_key(df, ["Origin", "Dest"], ["FlightDate", "row_key"])


@query("hub_dimension", "SRC7 AG15 SCL10 PRJ6 SCL11", sql_with(HUBS_SQL, body="""SELECT airport, faa_hub_category, faa_2023_enplanements,
      round(ln(1 + faa_2023_enplanements), 6) AS faa_log_enplanements FROM hubs"""))
def hub_dimension(spark, sf_dir):
    raw = B.hub_classes(spark, sf_dir)
    hubs = P.hub_dimension(raw.unionByName(raw))
    return hubs.withColumn("faa_log_enplanements", F.round("faa_log_enplanements", 6))


@query(
    "hub_class_roles", "JN6 JN4 PRJ2",
    sql_with(RAW_SQL, HUBS_SQL, body="""SELECT row_key, o.faa_hub_category AS origin_faa_hub_category, o.faa_2023_enplanements AS origin_faa_2023_enplanements,
      d.faa_hub_category AS destination_faa_hub_category, d.faa_2023_enplanements AS destination_faa_2023_enplanements
      FROM flights f LEFT JOIN hubs o ON f."Origin" = o.airport LEFT JOIN hubs d ON f."Dest" = d.airport"""),
)
def hub_class_roles(spark, sf_dir):
    df = labelled_flights(spark, sf_dir, "row_key", "Origin", "Dest")
    hubs = P.hub_dimension(B.hub_classes(spark, sf_dir)).drop("faa_log_enplanements")
    df = joins.lookup_join(df, hubs, {"Origin": "airport"}, "origin_")
    return joins.lookup_join(df, hubs, {"Dest": "airport"}, "destination_").drop("Origin", "Dest")


@query(
    "route_median_duration", "JN11 AG13",
    sql_with(RAW_SQL, body="""SELECT f.row_key, coalesce(CASE WHEN "CRSElapsedTime" > 0 THEN "CRSElapsedTime" END, m.route_median, g.global_median) AS duration
      FROM flights f LEFT JOIN (SELECT "Origin", "Dest", quantile_cont(CASE WHEN "CRSElapsedTime" > 0 THEN "CRSElapsedTime" END, 0.5) AS route_median
        FROM flights GROUP BY ALL) m USING ("Origin", "Dest"),
      (SELECT quantile_cont(CASE WHEN "CRSElapsedTime" > 0 THEN "CRSElapsedTime" END, 0.5) AS global_median FROM flights) g"""),
)
def route_median_duration(spark, sf_dir):
    df = labelled_flights(spark, sf_dir, "row_key", "Origin", "Dest", "CRSElapsedTime").withColumn(
        "duration", V.positive_or_null(F.col("CRSElapsedTime"))
    )
    medians = df.groupBy("Origin", "Dest").agg(F.percentile("duration", F.lit(0.5)).alias("route_median"))
    overall = df.agg(F.percentile("duration", F.lit(0.5))).scalar()
    joined = joins.lookup_join(df, medians, {"Origin": "Origin", "Dest": "Dest"}, validate=False)
    return joined.select("row_key", F.coalesce("duration", "route_median", overall).alias("duration"))


@query(
    "presentation_names", "PRJ1 PRJ3",
    sql_with(RAW_SQL, body="""SELECT row_key, "Reporting_Airline" AS airline, "Origin" AS origin_airport, "Dest" AS destination_airport,
      "month" AS departure_month, day_of_week AS departure_weekday, departure_hour AS scheduled_departure_hour,
      "Distance" AS distance_miles, "ArrDel15" AS arrival_delay_15min FROM flights"""),
)
def presentation_names(spark, sf_dir):
    df = labelled_flights(
        spark, sf_dir, "row_key", "Reporting_Airline", "Origin", "Dest", "month", "day_of_week", "departure_hour",
        "Distance", "ArrDel15", "FlightDate",
    )
    return df.withColumnsRenamed(RENAME).drop("FlightDate", *P.UNUSED_COLUMNS)


# --- hazards ----------------------------------------------------------------------

MATCHED_SQL = """matched AS (
  SELECT a.airport, h.* FROM airports a JOIN hazards h
    ON a.longitude > h.cx - h.hx AND a.longitude < h.cx + h.hx AND a.latitude > h.cy - h.hy AND a.latitude < h.cy + h.hy
)"""
# An hour calendar meets each interval by its bounds; the operator makes the hours of each interval instead.
EXPANDED_SQL = """hazard_hours AS MATERIALIZED (SELECT unnest(generate_series(
    (SELECT date_trunc('hour', min(issued)) FROM matched), (SELECT max(expired) + INTERVAL 25 HOURS FROM matched), INTERVAL 1 HOUR)) AS utc_hour
), expanded AS (
  SELECT airport, hazard_id, hazard_group, severity, utc_hour, 1 - late AS hazard_forecast, late AS hazard_active_at_prediction
  FROM matched JOIN (VALUES (0), (1)) AS kinds (late) ON true
  JOIN hazard_hours ON utc_hour - INTERVAL 24 HOURS >= issued AND utc_hour - to_hours(24 * late) <= expired
)"""
_group_flags = ", ".join(
    f"max(CASE WHEN hazard_group = '{g}' THEN hazard_forecast ELSE 0 END) AS hazard_{g}" for g in GROUPS
)
HOURS_SQL = f"""hours AS (
  SELECT airport, utc_hour, max(hazard_forecast) AS hazard_forecast_any, max(hazard_active_at_prediction) AS hazard_active_at_prediction,
         max(severity) AS hazard_max_severity, {_group_flags} FROM expanded GROUP BY airport, utc_hour
)"""
HAZARD_PARTS = (AIRPORTS_SQL, HAZARDS_SQL, MATCHED_SQL, EXPANDED_SQL, HOURS_SQL)


def matched_hazards(spark, sf_dir) -> DataFrame:
    clean = intervals.clean_intervals(B.hazards(spark, sf_dir))
    return intervals.points_in_polygons(B.airports(spark, sf_dir), clean)


def hours_table(spark, sf_dir) -> DataFrame:
    return intervals.hazard_hours(matched_hazards(spark, sf_dir))


@query(
    "hazard_intervals", "FLT4 SCL6 SCL7",
    sql_with(HAZARDS_SQL, body="SELECT hazard_id, issued, expired, hazard_group, severity FROM hazards"),
)
def hazard_intervals(spark, sf_dir):
    return intervals.clean_intervals(B.hazards(spark, sf_dir)).select(
        "hazard_id", F.col("issued").cast(NTZ).alias("issued"), F.col("expired").cast(NTZ).alias("expired"), "hazard_group", "severity"
    )


@query("airports_in_hazards", "JN1", sql_with(*HAZARD_PARTS[:3], body="SELECT airport, hazard_id, hazard_group, severity FROM matched"))
def airports_in_hazards(spark, sf_dir):
    return matched_hazards(spark, sf_dir).select("airport", "hazard_id", "hazard_group", "severity")


@query(
    "hazard_hour_rows", "ST1 ST3 ST4",
    sql_with(*HAZARD_PARTS[:4], body="""SELECT airport, hazard_group, hazard_forecast, hazard_active_at_prediction, count(*) AS n,
      min(utc_hour) AS first_hour, max(utc_hour) AS last_hour FROM expanded GROUP BY ALL"""),
)
def hazard_hour_rows(spark, sf_dir):
    rows = intervals.expand_hours(matched_hazards(spark, sf_dir), ["airport", "hazard_group"])
    return rows.groupBy("airport", "hazard_group", "hazard_forecast", "hazard_active_at_prediction").agg(
        F.count(F.lit(1)).alias("n"), F.min("utc_hour").cast(NTZ).alias("first_hour"), F.max("utc_hour").cast(NTZ).alias("last_hour")
    )


@query("hazard_airport_hours", "AG10 JN7", sql_with(*HAZARD_PARTS, body="SELECT * FROM hours"))
def hazard_airport_hours(spark, sf_dir):
    return hours_table(spark, sf_dir).withColumn("utc_hour", F.col("utc_hour").cast(NTZ))


_hazard_columns = ["hazard_forecast_any", "hazard_active_at_prediction", "hazard_max_severity", *[f"hazard_{g}" for g in GROUPS]]
EXPOSED_SQL = "exposed AS (SELECT t.*, " + ", ".join(
    f"coalesce({side}.{c}, 0) AS {role}_{c}" for side, role in (("o", "origin"), ("d", "dest")) for c in _hazard_columns
) + """ FROM timed t LEFT JOIN hours o ON t."Origin" = o.airport AND t.utc_hour = o.utc_hour
   LEFT JOIN hours d ON t."Dest" = d.airport AND t.utc_hour = d.utc_hour)"""


@query(
    "flight_hazards", "JN2 PRJ2 SCL10",
    sql_with(RAW_SQL, *HAZARD_PARTS, UTC_SQL, EXPOSED_SQL, body="SELECT row_key, "
             + ", ".join(f"{r}_{c}" for r in ("origin", "dest") for c in _hazard_columns) + " FROM exposed"),
)
def flight_hazards(spark, sf_dir):
    raw = labelled_flights(spark, sf_dir, "row_key", "FlightDate", "CRSDepTime", "Origin", "Dest")
    timed = P.scheduled_utc(raw, B.airports(spark, sf_dir))
    out = P.attach_hazards(timed, hours_table(spark, sf_dir))
    return out.drop("FlightDate", "CRSDepTime", "Origin", "Dest", "scheduled_departure_utc", "utc_hour")


_RAW_COLUMNS = (
    "row_key", "FlightDate", "Reporting_Airline", "Origin", "Dest", "CRSDepTime", "CRSElapsedTime", "Distance",
    "Cancelled", "Diverted", "ArrDel15", "ArrDelay",
)


def processed(spark, sf_dir, raw=None) -> DataFrame:
    """The processed store of the bound flights, or of those given as a stored table."""
    raw = materialize(B.raw_flights(spark, sf_dir, *_RAW_COLUMNS), "raw") if raw is None else raw
    return P.processed_flights(raw, B.airports(spark, sf_dir), B.holidays(spark, sf_dir), hours_table(spark, sf_dir))


_CONGESTED_TIMED_SQL = UTC_SQL.replace("FROM flights f", "FROM congested f")
PROCESSED_PARTS = (
    RAW_SQL, CONGESTION_SQL, *HAZARD_PARTS, _CONGESTED_TIMED_SQL, EXPOSED_SQL, HOLIDAYS_SQL, HOLIDAY_FEATURES_SQL,
    """processed AS (SELECT * FROM exposed JOIN calendar USING ("FlightDate"))""",
)


@query(
    "processed_flights", "FLT1 WN3 JN2 JN12 SCL2 SRC3",
    sql_with(*PROCESSED_PARTS, body="""SELECT row_key, "FlightDate", "Reporting_Airline", "Origin", "Dest", "CRSDepTime", "CRSElapsedTime", "Distance",
      "Cancelled", "Diverted", "ArrDel15", "ArrDelay", scheduled_departure_utc, utc_hour, "month", day_of_week, departure_hour, "year",
      origin_hourly_scheduled, origin_daily_scheduled, dest_daily_scheduled, days_to_nearest_holiday, holiday_name, is_holiday, within_3d_holiday,
      adverse_operation, primary_eligible, """ + ", ".join(f"{r}_{c}" for r in ("origin", "dest") for c in _hazard_columns) + " FROM processed"),
)
def processed_flights(spark, sf_dir):
    df = processed(spark, sf_dir)
    return df.withColumns({c: F.col(c).cast(NTZ) for c in ("scheduled_departure_utc", "utc_hour")})


DAILY_SQL = """daily AS (
  SELECT "FlightDate" AS flight_date, "month" AS calendar_month, count(*) AS scheduled_flights, CAST(sum(primary_eligible) AS BIGINT) AS eligible_flights,
         avg("Cancelled") AS cancellation_rate, avg("ArrDel15") AS delay_rate,
         avg(CASE WHEN primary_eligible = 1 THEN greatest(origin_hazard_forecast_any, dest_hazard_forecast_any) END) AS forecast_hazard_share,
         max(within_3d_holiday) AS holiday_window
  FROM processed GROUP BY 1, 2 HAVING sum(primary_eligible) >= 20
)"""


@query("daily_series", "AG7", sql_with(*PROCESSED_PARTS, DAILY_SQL, body="SELECT * FROM daily"))
def daily_series_query(spark, sf_dir):
    return daily_series(processed(spark, sf_dir), 20)


@query(
    "daily_anomalies", "JN8 WN4 WN5 SCL13 TK2",
    sql_with(*PROCESSED_PARTS, DAILY_SQL, body="""SELECT flight_date, scheduled_flights, delay_rate, cancellation_rate, forecast_hazard_share,
      round(z, 6) AS seasonally_standardized_anomaly, coalesce(nullif(concat_ws('; ',
        CASE WHEN forecast_hazard_share >= (SELECT quantile_cont(forecast_hazard_share, 0.9) FROM daily) THEN 'elevated forecast-hazard exposure' END,
        CASE WHEN cancellation_rate >= (SELECT quantile_cont(cancellation_rate, 0.9) FROM daily) THEN 'elevated cancellations' END,
        CASE WHEN holiday_window = 1 THEN 'federal-holiday window' END), ''), 'no captured external indicator') AS observed_context_not_causal
      FROM (SELECT *, (delay_rate - avg(delay_rate) OVER w) / nullif(stddev_samp(delay_rate) OVER w, 0) AS z FROM daily WINDOW w AS (PARTITION BY calendar_month))
      ORDER BY z DESC NULLS LAST, flight_date LIMIT 12"""),
)
def daily_anomalies_query(spark, sf_dir):
    out = daily_anomalies(daily_series(processed(spark, sf_dir), 20))
    name = "seasonally_standardized_anomaly"
    return out.withColumn(name, F.round(name, 6))
