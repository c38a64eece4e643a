"""What the enriched table is made of: shared flights and packed hazard hours."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from riskloom.operators.binning import Bins
from riskloom.plans import binding as B, flights as P
from tests.conftest import rows


def test_airlines_as_a_list_give_the_same_flights(spark):
    """Repeated, unknown and null parts drop or repeat a flight as a join does."""
    folder, day = tempfile.mkdtemp(prefix="run-"), dt.datetime(1999, 3, 1)
    items = [(1, p, 1, n, 2.0, 1.0, 0.03, 0.0, "N", "O", day) for n, p in enumerate((5, 6, 7, 8, None, 5))]
    parts = [(5, "x", "B1"), (6, "y", "B2"), (6, "z", "B3"), (7, "w", None), (None, "v", "B4")]
    tables = {
        "lineitem": items, "part": [(k, n, b, "t", 1, 1.0) for k, n, b in parts], "supplier": [(1, "s", 0, 0.0)],
        "customer": [(1, "c", 1, 0.0, "m")], "orders": [(1, 1, "O", 1.0, day, "p")], "nation": [(0, "A", 0), (1, "B", 0)],
    }
    for name, data in tables.items():
        spark.createDataFrame(data, B.SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
    columns = ["row_key", "Reporting_Airline", "Origin", "Dest"]
    wanted = rows(B.raw_flights(spark, folder, *columns))
    bound = B.raw_flights(spark, folder, "row_key", "airlines", "Origin", "Dest")
    assert bound.count() == len(items) and len(wanted) == 5
    assert rows(B.with_airline(bound).select(*columns)) == wanted


@pytest.mark.parametrize("severity, packed", [(3, True), (15, True), (16, False), (-1, False)])
def test_hazard_hours_are_packed_and_broadcast(spark, severity, packed):
    names = ["hazard_forecast_any", "hazard_max_severity", "hazard_flood"]
    hour = lambda h: dt.datetime(1999, 1, 1, h)
    hours = spark.createDataFrame(
        [("a", hour(1), 1, severity, 0), ("b", hour(1), 0, None, 1), ("a", hour(2), 1, 2, 1), (None, hour(1), 1, 1, 1)],
        "airport string, utc_hour timestamp, " + ", ".join(f"{n} int" for n in names),
    )
    flights = [(1, "a", "b", hour(1)), (2, "b", "a", hour(2)), (3, "c", None, hour(1)), (4, "a", "a", None), (5, "a", "b", hour(9))]
    df = spark.createDataFrame(flights, "row_key int, Origin string, Dest string, utc_hour timestamp")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = P.attach_hazards(df, hours)
        assert ("BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()) == packed
        found = rows(out.select("row_key", *[f"{r}_{n}" for r in ("origin", "dest") for n in names]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    none = (0, 0, 0)
    assert found == [(1, 1, severity, 0, 0, 0, 1), (2, *none, 1, 2, 1), (3, *none, *none), (4, *none, *none), (5, *none, *none)]
    assert out.where(F.col("origin_hazard_flood").isNull()).count() == 0


def test_numbers_are_placed_a_batch_at_a_time(spark):
    """Codes count the edges not above a number, from 1; missing and NaN are 0, and other columns stay."""
    inf, nan = float("inf"), float("nan")
    values = [None, nan, -inf, -1.0, 0.0, 0.5, 1.0, 2.5, inf]
    df = spark.createDataFrame([(i, None if i == 3 else "x", v, i) for i, v in enumerate(values)], "id int, t string, a double, b int")
    coded = Bins([], ["a", "b", "c"], {}, {"a": [0.0, 1.0], "b": [4.0], "c": []}, None).encode(df.withColumn("c", F.lit(7)), ["id", "t"])
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "UDF" not in plan
    assert dict(coded.dtypes) == {"id": "int", "t": "string", "codes": "array<smallint>"}
    found = {r["id"]: (r["t"], r["codes"]) for r in coded.collect()}
    wanted = [0, 0, 1, 1, 2, 2, 3, 3, 3]
    assert found == {i: (None if i == 3 else "x", [w, 1 + (i >= 4), 1]) for i, w in enumerate(wanted)}
    assert Bins([], ["a"], {}, {"a": [0.0]}, None).encode(df.limit(0), []).count() == 0
