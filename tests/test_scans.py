"""How often and in which order queries join the flights, on tables of a few rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from riskloom.operators import graph as G, ordering as O
from riskloom.plans import binding as B, load_all
from riskloom.plans.registry import QUERIES

load_all()


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """Own tables: 240 items of 40 orders over 900 days, four nations."""
    path = str(tmp_path_factory.mktemp("tiny"))
    day = lambda k: datetime.datetime(1999, 1, 1) + datetime.timedelta(days=k)
    tables = {
        "nation": [(k, f"N{k}", 0) for k in range(4)],
        "customer": [(k, f"c{k}", k % 4, 0.0, "m") for k in range(12)],
        "supplier": [(k, f"s{k}", (k + k // 4) % 4, 0.0) for k in range(9)],
        "part": [(k, f"p{k}", f"B{k % 3}", "t", 1, 1.0) for k in range(15)],
        "orders": [(k, k % 12, "O", 1.0, day(k), "1") for k in range(40)],
        "lineitem": [
            (k % 40, (7 * k) % 15, (5 * k) % 9, k // 40, float(k % 30), 1.0, (k % 11) / 100, 0.0, "N", "O", day(k * 15 // 4)) for k in range(240)
        ],
    }
    for name, data in tables.items():
        spark.createDataFrame(data, B.SCHEMAS[name]).write.parquet(f"{path}/{name}.parquet")
    return path


def _tree(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def _depth(line):
    return len(line) - len(line.lstrip(" :+-"))


def test_customers_meet_orders_before_items(spark, tiny):
    lines = _tree(B.raw_flights(spark, tiny, "Origin", "Dest"))
    at = next(k for k, line in enumerate(lines) if "Join" in line and "o_custkey" in line)
    below = []
    for line in lines[at + 1:]:
        if _depth(line) <= _depth(lines[at]):
            break
        below.append(line)
    assert below and not any("l_orderkey" in line for line in below)


@pytest.mark.parametrize("name, scans", [("previous_month_shares", 1), ("neighbour_features", 0), ("audit_summary", 0)])
def test_flights_are_joined_once(spark, tiny, name, scans):
    out = QUERIES[name](spark, tiny)
    assert sum("Relation [l_orderkey" in line for line in _tree(out)) == scans
    assert out.count()


def test_risk_waterfall_reads_stored_rows(spark, tiny):
    out = QUERIES["risk_waterfall"](spark, tiny)
    # The base rate alone goes back to the items; it needs suppliers, but neither orders nor parts.
    assert not any("Relation [o_orderkey" in line or "Relation [p_partkey" in line for line in _tree(out)) and out.count()


def test_node_profile_reads_its_rows_once(spark):
    df = spark.createDataFrame([("a", "b", 1, 10.0), ("b", "c", 0, 20.0)], "o string, d string, y int, m double")
    out = G.node_profile(df, "o", "d", "y", "m")
    assert not any("LocalRelation" in line or "LogicalRDD" in line for line in _tree(out))
    assert {r["node"]: (r["out_flights"], r["in_flights"]) for r in out.collect()} == {"a": (1, None), "b": (1, 1), "c": (None, 1)}


def test_row_numbers_move_rows_once(spark):
    df = spark.createDataFrame([(k % 3 if k % 5 else None, k * 7 % 31) for k in range(90)], "g int, v int").repartition(5)
    out = O.row_numbers(df, [F.col("v")], ["g"], "n", ["g", "v"])
    assert not any("Window" in line and "v#" in line for line in _tree(out))  # only group, slice and their counts
    want = [(g, v, n) for g in (None, 0, 1, 2) for n, v in enumerate(sorted(k * 7 % 31 for k in range(90) if (k % 3 if k % 5 else None) == g), 1)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
