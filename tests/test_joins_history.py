import datetime as dt

import numpy as np

import pytest
from pyspark.sql import functions as F

from riskloom.operators import history, joins
from riskloom.operators.cohort import add_flags
from tests.conftest import rows

DAY0 = dt.date(2024, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=i)


def flights(spark, data):
    return spark.createDataFrame(data, "FlightDate date, Origin string, Dest string, ArrDel15 double")


def test_trailing_rate_uses_a_gapped_range_of_days(spark):
    data = [(day(d), "A", "B", v) for d in (0, 1, 2, 3, 8, 9, 10, 40) for v in (1.0, 0.0)]
    out = history.trailing_rate(flights(spark, data), "FlightDate", ["Origin"], "ArrDel15", "rate", 8, 2)
    assert [r["rate"] for r in out.orderBy("FlightDate").collect()] == [None, None, 0.5, 0.5, 0.5, 0.5, 0.5, None]


def test_trailing_features_do_not_see_the_last_day_or_the_future(spark):
    data = [(day(d), o, x, float((d + len(o)) % 2)) for d in range(40) for o, x in (("A", "B"), ("AA", "B"), ("A", "C"))]
    before = rows(history.trailing_features(flights(spark, data)).where(F.col("FlightDate") <= day(20)))
    changed = [(d, o, x, 1.0 - v if d >= day(19) else v) for d, o, x, v in data]
    after = rows(history.trailing_features(flights(spark, changed)).where(F.col("FlightDate") <= day(20)))
    assert before == after and len(before) == 63


def test_trailing_features_match_the_single_rates(spark):
    data = [(day((7 * i) % 45), "AB"[i % 2], "XYZ"[i % 3], float(i % 5 == 0)) for i in range(300)]
    df = flights(spark, data)
    joined = history.trailing_features(df)
    single = history.trailing_rate(df, "FlightDate", ["Dest"], "ArrDel15", "r", 8, 2)
    assert set(rows(joined, "FlightDate", "Dest", "destination_recent_delay_rate")) <= set(rows(single, "FlightDate", "Dest", "r"))


def test_congestion_counts_all_rows_and_keeps_them(spark):
    data = [(1, day(0), "A", "B", 5), (2, day(0), "A", "C", 5), (3, day(0), "A", "B", 6), (4, day(0), "B", "A", 5), (5, day(1), "A", "B", 5)]
    df = spark.createDataFrame(data, "id int, FlightDate date, Origin string, Dest string, departure_hour int")
    out = history.congestion(df)
    assert rows(out, "id", "origin_hourly_scheduled", "origin_daily_scheduled", "dest_daily_scheduled") == [
        (1, 2, 3, 2), (2, 2, 3, 1), (3, 1, 3, 2), (4, 1, 1, 1), (5, 1, 1, 1)]


def test_congestion_with_one_hot_day(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 2700, F.lit(day(0))).otherwise(F.lit(day(1))).alias("FlightDate"),
        F.lit("A").alias("Origin"), F.lit("B").alias("Dest"), F.lit(3).alias("departure_hour"))
    assert rows(history.congestion(df).groupBy("origin_daily_scheduled").count()) == [(2700, 2700), (300, 300)]


def test_hot_key_of_a_shuffled_lookup_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        fact = spark.range(0, 60_000, 1, 12).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 500).alias("k"))
        out = joins.lookup_join(fact, spark.range(500).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v")), {"k": "key"}, validate=False)
        assert out.groupBy().agg(F.count("v"), F.sum(F.col("v") - 2 * F.col("k"))).first() == (60_000, 0)
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lookup_join_rejects_repeated_keys(spark):
    left = spark.createDataFrame([("A",), ("B",)], "k string")
    right = spark.createDataFrame([("A", 1), ("A", 2)], "k string, v int")
    with pytest.raises(joins.DuplicateKeyError):
        joins.lookup_join(left, right, {"k": "k"})


def test_lookup_join_roles_and_misses(spark):
    left = spark.createDataFrame([("A", "B"), ("C", None)], "o string, d string")
    right = spark.createDataFrame([("A", 1), ("B", 2)], "k string, v int")
    out = joins.lookup_join(joins.lookup_join(left, right, {"o": "k"}, "o_"), right, {"d": "k"}, "d_")
    assert rows(out, "o", "o_v", "d_v") == [("A", 1, 2), ("C", None, None)]
    assert rows(joins.fill_zero(out, ("o_", "d_")), "o_v", "d_v") == [(0, 0), (1, 2)]


def test_broadcast_only_below_the_limit(spark):
    small, fact = spark.range(10), spark.range(100).withColumnRenamed("id", "k")
    plan = lambda right: fact.join(right, F.col("k") == F.col("id"))._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(joins.broadcast_if_small(small, 10))
    assert "broadcast" not in plan(joins.broadcast_if_small(small, 9))


def test_first_per_key_and_distinct_union(spark):
    df = spark.createDataFrame([("A", 2, "x"), ("A", 1, "y"), ("B", None, "z")], "k string, o int, v string")
    assert rows(joins.first_per_key(df, ["k"], ["o", "v"]), "k", "v") == [("A", "y"), ("B", "z")]
    both = spark.createDataFrame([("A", "B"), ("B", None)], "o string, d string")
    assert rows(joins.distinct_union(both, ["o", "d"], "a")) == [("A",), ("B",)]


def test_nearest_event_distance(spark):
    dates = spark.createDataFrame([(1, dt.date(2024, 12, 22)), (2, dt.date(2024, 12, 25)), (3, dt.date(2024, 12, 29)), (4, dt.date(2024, 12, 30))], "id int, d date")
    events = spark.createDataFrame([(dt.date(2024, 12, 25), "C"), (dt.date(2025, 1, 1), "N"), (dt.date(2023, 1, 1), "O")], "date date, name string")
    out = joins.nearest_event(dates, "d", events)
    assert rows(out, "id", "holiday_name", "is_holiday", "within_3d_holiday", "days_to_nearest_holiday") == [
        (1, "None", 0, 1, 3), (2, "C", 1, 1, 0), (3, "None", 0, 1, 3), (4, "None", 0, 1, 2)]


def test_nearest_event_of_many_days_times_and_a_hot_day(spark):
    random = np.random.default_rng(3)
    start = dt.datetime(2020, 1, 1, 13)
    times = [start + dt.timedelta(hours=int(h)) for h in random.integers(0, 24 * 900, 300)] + [dt.datetime(2021, 5, 5, 1)] * 500
    holidays = [start.date() + dt.timedelta(days=int(d)) for d in random.integers(100, 700, 40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)] + [(-1, None)], "id int, t timestamp").repartition(5)
    events = spark.createDataFrame([(d, f"n{k % 3}") for k, d in enumerate(holidays)] + [(None, "x")], "date date, name string")
    got = {r["id"]: r for r in joins.nearest_event(df, "t", events, within=2).collect()}
    assert len(got) == len(times) + 1
    for i, t in enumerate(times):
        near = min(abs((t.date() - d).days) for d in holidays)
        names = sorted({f"n{k % 3}" for k, d in enumerate(holidays) if d == t.date()})
        assert (got[i]["days_to_nearest_holiday"], got[i]["is_holiday"], got[i]["within_3d_holiday"]) == (near, int(near == 0), int(near <= 2))
        assert got[i]["holiday_name"] == ("; ".join(names) or "None")
    assert (got[-1]["days_to_nearest_holiday"], got[-1]["is_holiday"], got[-1]["holiday_name"]) == (None, 0, "None")
    alone = joins.nearest_event(df, "t", events.limit(0)).first()
    assert (alone["days_to_nearest_holiday"], alone["is_holiday"], alone["within_3d_holiday"]) == (None, 0, 0)


def test_flags_are_null_safe(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, None), (1, 0, None), (None, 0, 1.0), (0, 1, None)], "Cancelled int, Diverted int, ArrDel15 double")
    assert [tuple(r) for r in add_flags(df).select("primary_eligible", "adverse_operation").collect()] == [(1, 1), (0, 0), (0, 1), (0, 1), (0, 1)]


def test_broadcast_counts_bytes_too(spark):
    wide = spark.range(3).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    fact = spark.range(100).withColumnRenamed("id", "k")
    plan = lambda right: fact.join(right, F.col("k") == F.col("id"))._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan(joins.broadcast_if_small(wide, max_bytes=20_000))
    assert "broadcast" in plan(joins.broadcast_if_small(wide, max_bytes=40_000))


def test_congestion_moves_no_rows(spark):
    from datetime import date

    from riskloom.operators import history

    day = date(2000, 1, 1)
    data = [(day, "A", "B", 5)] * 3 + [(day, "A", "C", 6), (day, "A", "B", None), (day, None, "B", 5), (None, "A", "B", 5), (day, "B", "A", 5)]
    df = spark.createDataFrame(data, "FlightDate date, Origin string, Dest string, departure_hour int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = history.congestion(df)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        found = {tuple(r) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert found == {
        (day, "A", "B", 5, 3, 5, 5), (day, "A", "C", 6, 1, 5, 1), (day, "A", "B", None, None, None, 5),
        (day, None, "B", 5, None, None, 5), (None, "A", "B", 5, None, None, None), (day, "B", "A", 5, 1, 1, 1),
    }
    assert out.count() == len(data)
