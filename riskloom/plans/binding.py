"""Binds the generated star-schema tables to the schemas the analyses expect.

Every binding exists twice: as a DataFrame and as the same SELECT for the SQL
check. Integer arithmetic makes both engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.catalog import HAZARD_GROUPS, HAZARD_SIGNIFICANCE
from riskloom.functions.temporal import departure_hour
from riskloom.operators.cohort import add_flags
from riskloom.session import spread

ZONES = ["America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "America/Phoenix"]
HUBS = ["Large", "Medium", "Small"]
HOLIDAYS = {"01-01": "New Year", "07-04": "Independence Day", "11-11": "Veterans Day", "12-25": "Christmas Day"}
CODES = [*HAZARD_GROUPS, "XX"]
SIGNIFICANCE = [*HAZARD_SIGNIFICANCE, "X"]
EVENT_SHIFT_SECONDS = 820_540_800

_FROM_ORIGIN = {"Origin", "ArrDelay", "ArrDel15", "score_a", "adverse"}


SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
        "o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
        "l_shipdate TIMESTAMP_NTZ"
    ),
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its declared schema, so no job runs to infer one."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def raw_flights(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Scheduled flights, one per line item, over the whole table.

    Only the dimension tables that the requested columns need are joined: each
    is keyed uniquely and complete, so leaving one out keeps the same rows.
    ``airlines`` holds what ``Reporting_Airline`` would be, for ``with_airline``.
    """
    need = set(columns)
    item = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey").select(
        F.col("l_orderkey").alias("ok"),
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        F.col("l_linenumber").alias("ln"),
        F.col("l_quantity").alias("qty"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("disc"),
        F.col("l_shipdate").cast("date").alias("FlightDate"),
    )
    if need & _FROM_ORIGIN:
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("onk"))
        item = item.join(supplier, F.col("sk") == F.col("s_suppkey"))
    if "Origin" in need:
        nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("o_key"), F.col("n_name").alias("Origin"))
        item = item.join(nation, F.col("onk") == F.col("o_key"))
    if "Dest" in need:
        # Orders meet customers and nations first: they are fewer than the items, which then move once.
        order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("d_key"), F.col("n_name").alias("Dest"))
        customer = customer.join(nation, F.col("c_nationkey") == F.col("d_key")).select("c_custkey", "Dest")
        order = order.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "Dest")
        item = item.join(order, F.col("ok") == F.col("o_orderkey"))
    if "Reporting_Airline" in need:
        part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("Reporting_Airline"))
        item = item.join(part, F.col("pk") == F.col("p_partkey"))
    if "airlines" in need:
        # As a list, so that rows stay as they are whether or how often their part is known.
        part = table(spark, sf_dir, "part").groupBy("p_partkey").agg(
            F.collect_list(F.struct(F.col("p_brand").alias("Reporting_Airline"))).alias("airlines")
        )
        item = item.join(part, F.col("pk") == F.col("p_partkey"), "left")

    # Stepwise, so that a value used by several columns is computed once.
    ok, pk, sk, ln, qty = (F.col(c) for c in ("ok", "pk", "sk", "ln", "qty"))
    flagged = (ok + 3 * pk) % 59 == 0
    item = item.withColumns({
        "hour": ((7 * ok + 13 * pk + 3 * ln) % 24).cast("int"),
        "Cancelled": flagged.cast("int"),
        "Diverted": (~flagged & ((ok + sk) % 401 == 0)).cast("int"),
    })
    late = (F.col("hour") >= 15).cast("int")
    from_origin = F.col("onk") % 5 if need & _FROM_ORIGIN else F.lit(None).cast("int")
    item = item.withColumn(
        "raw_delay",
        4 * F.col("disc") + 12 * late + 2 * from_origin - 45 + (31 * ok + 17 * pk + 5 * ln) % 41
        + 150 * ((5 * ok + 11 * pk) % 50 == 0).cast("int"),
    )
    flown = (F.col("Cancelled") == 0) & (F.col("Diverted") == 0)
    derived = {
        "row_key": F.concat_ws("-", ok, ln, pk, sk, "FlightDate"),
        "year": F.year("FlightDate"),
        "CRSDepTime": (100 * F.col("hour") + pk % 60).cast("int"),
        "CRSElapsedTime": F.when(pk % 97 == 0, F.lit(0.0)).when(pk % 89 != 0, 30 + 6 * qty).cast("double"),
        "Distance": F.when(pk % 79 == 0, F.lit(0.0)).when(pk % 83 != 0, 8 * (30 + 6 * qty)).cast("double"),
        "ArrDelay": F.when(flown, F.col("raw_delay").cast("double")),
        "ArrDel15": F.when(flown, (F.col("raw_delay") >= 15).cast("double")),
        "score_a": (20 + 8 * F.col("disc") + 24 * late + 4 * from_origin + (13 * ok + 29 * pk) % 60).cast("double") / 400,
        "score_b": (50 + (7 * ok + pk) % 200).cast("double") / 400,
    }
    return item.select(*[derived[c].alias(c) if c in derived else F.col(c) for c in columns])


def with_airline(flights: DataFrame) -> DataFrame:
    """Flights with ``airlines`` as rows with ``Reporting_Airline``, one for each part found."""
    return flights.select(*[c for c in flights.columns if c != "airlines"], F.inline("airlines"))


def labelled_flights(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Bound flights with the cohort flags and calendar parts asked for."""
    base = {
        "primary_eligible": ("Cancelled", "Diverted", "ArrDel15"),
        "adverse_operation": ("Cancelled", "Diverted", "ArrDel15"),
        "departure_hour": ("CRSDepTime",),
        "month": ("FlightDate",),
        "day_of_week": ("FlightDate",),
    }
    raw = list(dict.fromkeys(r for c in columns for r in base.get(c, (c,))))
    df = raw_flights(spark, sf_dir, *raw)
    if {"primary_eligible", "adverse_operation"} & set(columns):
        df = add_flags(df)
    calendar = {
        "departure_hour": lambda: departure_hour(F.col("CRSDepTime")),
        "month": lambda: F.month("FlightDate"),
        "day_of_week": lambda: F.weekday("FlightDate"),
    }
    return df.select(*[calendar[c]().alias(c) if c in calendar else F.col(c) for c in columns])


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    zones = F.array(*[F.lit(z) for z in ZONES])
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("airport"),
        (25 + key).cast("double").alias("latitude"),
        (-120 + 2 * key).cast("double").alias("longitude"),
        F.get(zones, key % 5).alias("timezone"),
    )


def hub_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw hub classes, with spaces around codes and without a class or volume in some rows."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")).alias("airport"),
        F.when(key % 8 != 6, F.get(F.array(*[F.lit(h) for h in HUBS]), key % 3)).alias("hub"),
        F.when(key % 12 == 0, F.lit("n/a")).otherwise((1000 * (key + 1)).cast("string")).alias("enplanements"),
    )


def hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hazard products with text bounds, codes and a rectangular outline."""
    event, user = F.col("event_id"), F.col("user_id")
    issued = F.unix_seconds(F.col("ts").cast("timestamp")) - EVENT_SHIFT_SECONDS
    length = (7 * event) % 120 * 3600 + F.when(event % 211 == 0, -3600 - (7 * event) % 120 * 3600).otherwise(0)
    compact = lambda seconds: F.date_format(F.timestamp_seconds(seconds), "yyyyMMddHHmm")
    x, y = -120.0 + 2 * (user % 25), 25.0 + user % 25
    half_x, half_y = 0.5 + event % 3, 0.5 + event % 2
    corner = lambda sx, sy: F.struct((x + sx * half_x).alias("x"), (y + sy * half_y).alias("y"))
    return spread(table(spark, sf_dir, "events"), "event_id").select(
        event.alias("hazard_id"),
        F.when(event % 307 == 0, F.lit("unknown")).otherwise(compact(issued)).alias("ISSUED"),
        compact(issued + length).alias("EXPIRED"),
        F.get(F.array(*[F.lit(c) for c in CODES]), (event % len(CODES)).cast("int")).alias("PHENOM"),
        F.get(F.array(*[F.lit(c) for c in SIGNIFICANCE]), (event % len(SIGNIFICANCE)).cast("int")).alias("SIG"),
        F.array(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))).alias("rings"),
    )


def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-date holidays of every flight year and one year either side."""
    span = raw_flights(spark, sf_dir, "year").agg(F.min("year").alias("first"), F.max("year").alias("last"))
    years = span.select(F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("y"))
    days = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(n).alias("n")) for d, n in HOLIDAYS.items()])
    return years.select("y", F.explode(days).alias("h")).select(
        F.to_date(F.concat_ws("-", "y", "h.d")).alias("date"), F.col("h.n").alias("name")
    )


# --- the same bindings as SQL -------------------------------------------------

_zone_list = ", ".join(f"'{z}'" for z in ZONES)
_hub_list = ", ".join(f"'{h}'" for h in HUBS)
_code_list = ", ".join(f"'{c}'" for c in CODES)
_sig_list = ", ".join(f"'{c}'" for c in SIGNIFICANCE)

RAW_SQL = """
items AS (
  SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln, l_quantity AS qty,
         CAST(round(l_discount * 100) AS INTEGER) AS disc, CAST(l_shipdate AS DATE) AS "FlightDate",
         p_brand AS "Reporting_Airline", o.n_name AS "Origin", d.n_name AS "Dest", o.n_nationkey AS onk,
         CAST((7 * l_orderkey + 13 * l_partkey + 3 * l_linenumber) % 24 AS INTEGER) AS hh,
         CASE WHEN (l_orderkey + 3 * l_partkey) % 59 = 0 THEN 1 ELSE 0 END AS "Cancelled",
         CASE WHEN (l_orderkey + 3 * l_partkey) % 59 <> 0 AND (l_orderkey + l_suppkey) % 401 = 0 THEN 1 ELSE 0 END AS "Diverted"
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation d ON c_nationkey = d.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation o ON s_nationkey = o.n_nationkey
  JOIN part ON l_partkey = p_partkey
), delays AS (
  SELECT *, CASE WHEN hh >= 15 THEN 1 ELSE 0 END AS late,
         4 * disc + 12 * (CASE WHEN hh >= 15 THEN 1 ELSE 0 END) + 2 * (onk % 5) - 45
           + (31 * ok + 17 * pk + 5 * ln) % 41
           + 150 * (CASE WHEN (5 * ok + 11 * pk) % 50 = 0 THEN 1 ELSE 0 END) AS raw_delay
  FROM items
), flights AS (
  SELECT ok || '-' || ln || '-' || pk || '-' || sk || '-' || CAST("FlightDate" AS VARCHAR) AS row_key, "FlightDate", CAST(year("FlightDate") AS INTEGER) AS "year",
         CAST(month("FlightDate") AS INTEGER) AS "month", CAST(isodow("FlightDate") - 1 AS INTEGER) AS day_of_week,
         "Reporting_Airline", "Origin", "Dest", CAST(100 * hh + pk % 60 AS INTEGER) AS "CRSDepTime", hh AS departure_hour,
         CASE WHEN pk % 97 = 0 THEN 0.0 WHEN pk % 89 = 0 THEN NULL ELSE 30 + 6 * qty END AS "CRSElapsedTime",
         CASE WHEN pk % 79 = 0 THEN 0.0 WHEN pk % 83 = 0 THEN NULL ELSE 8 * (30 + 6 * qty) END AS "Distance",
         "Cancelled", "Diverted",
         CASE WHEN "Cancelled" = 0 AND "Diverted" = 0 THEN CAST(raw_delay AS DOUBLE) END AS "ArrDelay",
         CASE WHEN "Cancelled" = 0 AND "Diverted" = 0 THEN CASE WHEN raw_delay >= 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS "ArrDel15",
         CASE WHEN "Cancelled" = 0 AND "Diverted" = 0 THEN 1 ELSE 0 END AS primary_eligible,
         CASE WHEN "Cancelled" = 1 OR "Diverted" = 1 OR raw_delay >= 15 THEN 1 ELSE 0 END AS adverse_operation,
         CAST(20 + 8 * disc + 24 * late + 4 * (onk % 5) + (13 * ok + 29 * pk) % 60 AS DOUBLE) / 400 AS score_a,
         CAST(50 + (7 * ok + pk) % 200 AS DOUBLE) / 400 AS score_b, disc, qty
  FROM delays
)"""

AIRPORTS_SQL = f"""
airports AS (
  SELECT n_name AS airport, CAST(25 + n_nationkey AS DOUBLE) AS latitude, CAST(-120 + 2 * n_nationkey AS DOUBLE) AS longitude,
         ([{_zone_list}])[n_nationkey % 5 + 1] AS timezone
  FROM nation
)"""

HUBS_SQL = f"""
hubs AS (
  SELECT n_name AS airport,
         CASE WHEN n_nationkey % 8 <> 6 THEN ([{_hub_list}])[n_nationkey % 3 + 1] ELSE 'Non-primary' END AS faa_hub_category,
         CASE WHEN n_nationkey % 12 <> 0 THEN CAST(1000 * (n_nationkey + 1) AS DOUBLE) END AS faa_2023_enplanements
  FROM nation
)"""

_groups_sql = " ".join(f"WHEN '{code}' THEN '{group}'" for code, group in HAZARD_GROUPS.items())
_severity_sql = " ".join(f"WHEN '{code}' THEN {rank}" for code, rank in HAZARD_SIGNIFICANCE.items())

HAZARDS_SQL = f"""
hazard_rows AS (
  SELECT event_id AS hazard_id, ([{_code_list}])[event_id % {len(CODES)} + 1] AS phenom,
         ([{_sig_list}])[event_id % {len(SIGNIFICANCE)} + 1] AS sig,
         CASE WHEN event_id % 307 <> 0 THEN date_trunc('minute', date_trunc('second', ts) - to_seconds({EVENT_SHIFT_SECONDS})) END AS issued,
         date_trunc('minute', date_trunc('second', ts) - to_seconds({EVENT_SHIFT_SECONDS})
           + to_hours(CASE WHEN event_id % 211 = 0 THEN -1 ELSE CAST((7 * event_id) % 120 AS INTEGER) END)) AS expired,
         -120.0 + 2 * (user_id % 25) AS cx, 25.0 + user_id % 25 AS cy, 0.5 + event_id % 3 AS hx, 0.5 + event_id % 2 AS hy
  FROM events
), hazards AS (
  SELECT *, CASE phenom {_groups_sql} ELSE 'other' END AS hazard_group, CASE sig {_severity_sql} ELSE 0 END AS severity
  FROM hazard_rows WHERE issued IS NOT NULL AND expired IS NOT NULL AND expired >= issued
)"""

HOLIDAYS_SQL = """
holidays AS (
  SELECT CAST(y || '-' || d AS DATE) AS "date", n AS name
  FROM (SELECT unnest(generate_series(min("year") - 1, max("year") + 1)) AS y FROM flights),
       (VALUES """ + ", ".join(f"('{d}', '{n}')" for d, n in HOLIDAYS.items()) + """) AS h(d, n)
)"""


def sql_with(*parts: str, body: str) -> str:
    """A query over the bound tables: the CTEs it needs, then the body."""
    return "WITH " + ",".join(parts) + "\n" + body
