import datetime as dt

from pyspark.sql import functions as F

from riskloom.functions import temporal as T, values as V
from tests.conftest import rows


def one(spark, expression, schema="x int", value=(1,)):
    return spark.createDataFrame([value], schema).select(expression.alias("v")).first()["v"]


def utc(spark, text, zone):
    df = spark.createDataFrame([(text, zone)], "t string, z string")
    return df.select(F.date_format(T.local_to_utc(F.to_timestamp("t"), F.col("z")), "yyyy-MM-dd HH:mm").alias("u")).first()["u"]


def test_skipped_local_time_moves_forward(spark):
    assert utc(spark, "2024-03-10 02:30:00", "America/New_York") == "2024-03-10 07:00"
    assert utc(spark, "2024-03-10 02:00:00", "America/New_York") == "2024-03-10 07:00"


def test_repeated_local_time_is_missing(spark):
    assert utc(spark, "2024-11-03 01:30:00", "America/New_York") is None
    assert utc(spark, "2024-11-03 00:59:00", "America/New_York") == "2024-11-03 04:59"
    assert utc(spark, "2024-11-03 02:00:00", "America/New_York") == "2024-11-03 07:00"


def test_zone_without_daylight_saving_and_unknown_zone(spark):
    assert utc(spark, "2024-03-10 02:30:00", "America/Phoenix") == "2024-03-10 09:30"
    assert utc(spark, "2024-03-10 02:30:00", None) is None


def test_local_departure_edges(spark):
    df = spark.createDataFrame([(1, 905), (2, 2400), (3, None), (4, 0)], "id int, hhmm int").withColumn("d", F.lit("2024-02-29").cast("date"))
    got = {r["id"]: r["t"] for r in df.select("id", F.date_format(T.local_departure(F.col("d"), F.col("hhmm")), "yyyy-MM-dd HH:mm").alias("t")).collect()}
    assert got == {1: "2024-02-29 09:05", 2: "2024-03-01 00:00", 3: None, 4: "2024-02-29 00:00"}


def test_departure_hour_clips_and_defaults(spark):
    df = spark.createDataFrame([("2400",), ("905",), (None,), ("bad",), ("-5",)], "h string")
    assert [r[0] for r in df.select(T.departure_hour(F.col("h"))).collect()] == [23, 9, 0, 0, 0]


def test_hour_rounding(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("2024-01-01 10:00:01",)], "t string").select(F.to_timestamp("t").alias("t"))
    out = df.select(T.floor_hour(F.col("t")).alias("f"), T.ceil_hour(F.col("t")).alias("c")).collect()
    assert out[0]["f"] == out[0]["c"] == out[1]["f"]
    assert out[1]["c"] - out[1]["f"] == dt.timedelta(hours=1)


def test_calendar_parts(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29),), (dt.date(2024, 12, 31),)], "d date")
    assert rows(df.select(T.month_start(F.col("d")), T.next_month_start(F.col("d")))) == [
        (dt.date(2024, 12, 1), dt.date(2025, 1, 1)), (dt.date(2024, 2, 1), dt.date(2024, 3, 1))]


def test_compact_parse(spark):
    df = spark.createDataFrame([("202401311259",), ("202413311259",), ("x",), (None,)], "s string")
    got = [r[0] for r in df.select(F.date_format(T.parse_compact(F.col("s")), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2024-01-31 12:59", None, None, None]


def test_numeric_parse(spark):
    df = spark.createDataFrame([("1.5",), ("bad",), ("NaN",), (None,), ("-2",)], "s string")
    assert [r[0] for r in df.select(V.to_double(F.col("s"))).collect()] == [1.5, None, None, None, -2.0]
    assert [r[0] for r in df.select(V.positive_or_null(F.col("s"))).collect()] == [1.5, None, None, None, None]


def test_bins_and_bands(spark):
    df = spark.createDataFrame([(-500.0,), (-1.0,), (0.0,), (305.0,), (None,)], "v double")
    assert [r[0] for r in df.select(V.clipped_bin(F.col("v"), 10, -60, 300)).collect()] == [-60.0, -10.0, 0.0, 300.0, None]
    bands = spark.createDataFrame([(0.0,), (59.9,), (60.0,), (1e9,), (-1.0,), (None,)], "v double")
    assert [r[0] for r in bands.select(V.band(F.col("v"), [0, 60], ["low", "high"])).collect()] == ["low", "low", "high", "high", None, None]


def test_reasons_and_lookup(spark):
    df = spark.createDataFrame([(1, True, None), (2, False, False), (3, True, True)], "id int, a boolean, b boolean")
    text = V.joined_reasons([(F.col("a"), "first"), (F.col("b"), "second")], "none")
    assert [r[0] for r in df.orderBy("id").select(text).collect()] == ["first", "none", "first; second"]
    assert one(spark, V.lookup(F.lit("b"), {"a": 1}, F.lit(9))) == 9
    assert one(spark, V.lookup(F.lit(None).cast("string"), {"a": 1}, F.lit(9))) == 9


def test_row_means_and_chains(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(V.mean_of_present([F.col("a"), F.col("b")])).collect()] == [1.0, None, 2.5]
    chain = spark.createDataFrame([(0.5, 0.6, 0.1), (0.5, None, 0.1)], "a double, b double, c double")
    assert [tuple(r) for r in chain.select(*V.running_minimum(["a", "b", "c"])).collect()] == [(0.5, 0.5, 0.1), (0.5, None, None)]


def test_risk_points_and_logit(spark):
    assert one(spark, V.risk_points(F.lit(0.0), F.lit(0.2))) == 0.0
    assert abs(one(spark, V.risk_points(F.lit(100.0), F.lit(0.2))) - 80.0) < 1e-6
    assert abs(one(spark, V.sigmoid(V.logit(F.lit(0.3)))) - 0.3) < 1e-12


def test_display_name(spark):
    names = {"airline": "Airline"}
    assert one(spark, V.display_name(F.lit("airline"), names)) == "Airline"
    assert one(spark, V.display_name(F.lit("airline & some_new_term"), names)) == "Airline × Some New Term"
