import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import graph as G, intervals as I
from tests.conftest import rows

M1, M2 = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
# A dangling node E in the first month; the second is a plain cycle.
EDGES = [(M1, "A", "B", 4.0), (M1, "A", "C", 1.0), (M1, "B", "C", 9.0), (M1, "C", "A", 4.0), (M1, "C", "D", 1.0), (M1, "D", "E", 4.0), (M1, "B", "D", 1.0),
         (M2, "A", "B", 1.0), (M2, "B", "C", 1.0), (M2, "C", "D", 1.0), (M2, "D", "A", 1.0)]


def edges(spark, data=EDGES):
    df = spark.createDataFrame(data, "network_month date, src string, dst string, weight double")
    return df.withColumn("length", 1.0 / F.sqrt("weight"))


def dense_pagerank(data, tolerance=1e-6, damping=0.85, rounds=None):
    nodes = sorted({n for _, a, b, _ in data for n in (a, b)})
    at, n = {v: i for i, v in enumerate(nodes)}, len(nodes)
    w = np.zeros((n, n))
    for _, a, b, x in data:
        w[at[a], at[b]] += x
    out = w.sum(1)
    share = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    x = np.full(n, 1 / n)
    for i in range(rounds or 100):
        new = damping * (x @ share + x[out == 0].sum() / n) + (1 - damping) / n
        change, x = np.abs(new - x).sum(), new
        if rounds is None and change < n * tolerance:
            break
    return dict(zip(nodes, x))


def dense_betweenness(data):
    nodes = sorted({n for _, a, b, _ in data for n in (a, b)})
    length = {(a, b): 1.0 / np.sqrt(w) for _, a, b, w in data if a != b}
    total = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        best, paths = None, []

        def walk(path, d):
            nonlocal best, paths
            if best is not None and d > best + 1e-12:
                return
            if path[-1] == t:
                if best is None or d < best - 1e-12:
                    best, paths = d, []
                paths.append(list(path))
                return
            for (a, b), x in length.items():
                if a == path[-1] and b not in path:
                    walk([*path, b], d + x)

        walk([s], 0.0)
        paths = [p for p in paths]
        for p in paths:
            for v in p[1:-1]:
                total[v] += 1 / len(paths)
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def by_month(df, value):
    out = {}
    for r in df.collect():
        out.setdefault(r["network_month"], {})[r["node"]] = r[value]
    return out


@pytest.mark.parametrize("rounds", [None, 4])
def test_pagerank_matches_dense_iteration(spark, rounds):
    got = by_month(G.pagerank(edges(spark), rounds=rounds), "network_pagerank")
    for month in (M1, M2):
        want = dense_pagerank([e for e in EDGES if e[0] == month], rounds=rounds)
        assert got[month].keys() == want.keys()
        assert all(abs(got[month][v] - want[v]) < 1e-12 for v in want)
        assert abs(sum(got[month].values()) - 1) < 1e-9


def test_pagerank_reports_missing_convergence(spark):
    with pytest.raises(RuntimeError):
        G.pagerank(edges(spark), max_rounds=2)


def test_betweenness_matches_path_enumeration(spark):
    got = by_month(G.betweenness(edges(spark)), "network_betweenness")
    for month in (M1, M2):
        want = dense_betweenness([e for e in EDGES if e[0] == month])
        assert all(abs(got[month][v] - want[v]) < 1e-9 for v in want)


def test_betweenness_counts_tied_paths(spark):
    data = [(M1, a, b, 1.0) for a, b in [("S", "A"), ("S", "B"), ("A", "T"), ("B", "T"), ("T", "U"), ("A", "A")]]
    got = by_month(G.betweenness(edges(spark, data)), "network_betweenness")[M1]
    want = dense_betweenness(data)
    assert all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_sampled_betweenness_scales_by_sources(spark):
    got = by_month(G.betweenness(edges(spark), max_sources=2), "network_betweenness")
    assert set(got[M2]) == set("ABCD")
    # Every source of a four-cycle adds dependencies 2, 1 and 0 on the other nodes: 6 in total, scaled by n / k.
    assert abs(sum(got[M2].values()) - 2 * 3 * (4 / 2) / (3 * 2)) < 1e-9


def test_shares_and_lag(spark):
    out = by_month(G.shares(edges(spark)), "network_weighted_out_share")
    assert abs(sum(out[M1].values()) - 1) < 1e-12 and out[M1]["E"] == 0.0
    lagged = G.lagged_measures(edges(spark))
    assert {r[0] for r in lagged.select("flight_month").distinct().collect()} == {M2, dt.date(2024, 3, 1)}
    assert lagged.count() == 9


def test_neighbour_mean_and_normalized(spark):
    df = edges(spark).where(F.col("network_month") == M1)
    share = {(r["src"], r["dst"]): r["share"] for r in G.normalized(df).collect()}
    assert share["A", "B"] == 0.8 and share["D", "E"] == 1.0
    features = spark.createDataFrame([(n, float(i)) for i, n in enumerate("ABCDE")], "node string, v double")
    assert abs({r[0]: r[1] for r in G.neighbour_mean(df, features, ["v"]).collect()}["A"] - (0.8 * 1 + 0.2 * 2)) < 1e-12
    assert abs({r[0]: r[1] for r in G.neighbour_mean(df, features, ["v"], out=False).collect()}["C"] - (0.1 * 0 + 0.9 * 1)) < 1e-12


def test_node_profile_keeps_one_sided_nodes(spark):
    data = [("A", "B", 1.0, 60.0), ("A", "B", 0.0, None), ("A", "C", None, 90.0)]
    df = spark.createDataFrame(data, "o string, d string, y double, m double")
    out = {r["node"]: r for r in G.node_profile(df, "o", "d", "y", "m").collect()}
    assert (out["A"]["out_flights"], out["A"]["out_delay_rate"], out["A"]["out_unique_neighbors"], out["A"]["out_mean_duration"]) == (3, 0.5, 2, 75.0)
    assert out["A"]["in_flights"] is None and out["B"]["out_flights"] is None and out["C"]["in_delay_rate"] is None
    scaled = G.standardize_nodes(G.node_profile(df, "o", "d", "y", "m"), ["out_flights", "in_flights"], ["in_delay_rate"]).collect()
    assert abs(sum(r["in_flights"] for r in scaled)) < 1e-9 and all(r["out_flights"] == 0.0 for r in scaled)


# --- polygons and intervals ---------------------------------------------------------------

TRIANGLE = [[(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]]
CONCAVE = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]]
HOLED = [[(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0)], [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)]]


@pytest.mark.parametrize("ring, point, inside", [
    (TRIANGLE, (1.0, 1.0), True), (TRIANGLE, (3.0, 3.0), False), (TRIANGLE, (2.0, 2.0), False), (TRIANGLE, (0.0, 0.0), False),
    (TRIANGLE, (2.0, 0.0), False), (CONCAVE, (2.0, 3.0), False), (CONCAVE, (0.5, 3.0), True), (CONCAVE, (2.0, 1.0), False),
    (CONCAVE, (2.0, 0.5), True), (HOLED, (3.0, 3.0), False), (HOLED, (1.0, 3.0), True), (HOLED, (2.0, 3.0), False),
])
def test_points_in_polygons(spark, ring, point, inside):
    points = spark.createDataFrame([("P", *point)], "airport string, longitude double, latitude double")
    shapes = spark.createDataFrame([(1, ring)], "id int, rings array<array<struct<x:double,y:double>>>")
    assert I.points_in_polygons(points, shapes).count() == int(inside)


def even_odd(x, y, rings):
    crossings = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return False
            crossings += (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay)
    return crossings % 2 == 1


@pytest.mark.parametrize("cell", [0.5, 1.0, 7.0])
def test_whole_cells_and_border_cells_give_the_pairs_of_brute_force(spark, cell):
    rng = np.random.default_rng(3)
    shapes = []
    for i in range(12):
        turn = np.sort(rng.uniform(0, 2 * np.pi, 9))
        reach = rng.integers(2, 8, 9)
        centre = rng.integers(-6, 7, 2).tolist()
        outer = [(float(round(centre[0] + r * np.cos(t))), float(round(centre[1] + r * np.sin(t)))) for t, r in zip(turn, reach)]
        hole = [(centre[0] + a * 0.5, centre[1] + b * 0.5) for a, b in [(-1, -1), (1, -1), (1, 1), (-1, 1)]]
        shapes.append((i, [outer + outer[:1], hole + hole[:1]]))
    points = [(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.integers(-28, 29, (300, 2)) / 2)]
    want = sorted((p, i) for p, a, b in points for i, rings in shapes if even_odd(a, b, rings))
    typed = "id int, rings array<array<struct<x:double,y:double>>>"
    polygons = spark.createDataFrame(shapes + [(90, None), (91, []), (92, [[]])], typed)
    placed = spark.createDataFrame(points + [("n", None, 0.0), ("f", float("nan"), 0.0), ("i", 0.0, float("inf"))],
                                   "airport string, longitude double, latitude double")
    assert want and rows(I.points_in_polygons(placed, polygons, cell=cell), "airport", "id") == sorted(want, key=repr)
    cells = I.covering_cells(polygons, "id", "rings", cell)
    assert cells.columns == ["id", "_cx", "_cy", "_whole"] and cells.count() == cells.distinct().count()
    # A side passes through no more cells than its extent allows, so the others were decided as a whole.
    sides = [abs(ax - bx) + abs(ay - by) for _, rings in shapes for r in rings for (ax, ay), (bx, by) in zip(r, r[1:])]
    assert 0 < cells.where("NOT _whole").count() <= sum(3 * d / cell + 9 for d in sides)
    if cell == 0.5:
        assert cells.where("_whole").count() > 0
    whole = cells.where("_whole").select("id", ((F.col("_cx") + 0.1) * cell).alias("x"), ((F.col("_cy") + 0.9) * cell).alias("y"))
    assert all(even_odd(x, y, dict(shapes)[i]) for i, x, y in whole.collect())


def hazard(spark, *data):
    raw = spark.createDataFrame([(a, i, e, p, s) for a, i, e, p, s in data], "airport string, ISSUED string, EXPIRED string, PHENOM string, SIG string")
    return I.clean_intervals(raw)


def test_intervals_are_cleaned(spark):
    out = hazard(spark, ("A", "202401010000", "202401010000", "WS", "W"), ("A", "202401020000", "202401010000", "WS", "W"),
                 ("A", None, "202401010000", "WS", "W"), ("A", "bad", "202401010000", "ZZ", "?"), ("A", "202401010000", "202401020000", "ZZ", "?"))
    assert rows(out, "hazard_group", "severity") == [("other", 0), ("winter", 3)]


def hours(df):
    return rows(df.select("airport", F.date_format("utc_hour", "dd HH").alias("h"), "hazard_forecast_any", "hazard_active_at_prediction",
                          "hazard_max_severity", "hazard_winter", "hazard_flood"))


def test_hours_start_a_day_after_issue(spark):
    df = hazard(spark, ("A", "202401010030", "202401020215", "WS", "Y"))
    got = hours(I.hazard_hours(df))
    # Usable from the first full hour 24 h after issue; forecast until expiry, active until 24 h after it.
    assert got[0] == ("A", "02 01", 1, 1, 1, 1, 0) and got[1] == ("A", "02 02", 1, 1, 1, 1, 0)
    assert got[2] == ("A", "02 03", 0, 1, 1, 0, 0) and got[-1] == ("A", "03 02", 0, 1, 1, 0, 0) and len(got) == 26


def test_hours_merge_overlapping_hazards(spark):
    df = hazard(spark, ("A", "202401010000", "202401020000", "WS", "Y"), ("A", "202401010000", "202401010100", "FF", "W"))
    got = {r[1]: r for r in hours(I.hazard_hours(df))}
    assert got["02 00"] == ("A", "02 00", 1, 1, 3, 1, 0)
    assert got["02 02"] == ("A", "02 02", 0, 1, 1, 0, 0)


def test_single_expansion_equals_the_union_of_both_spans(spark):
    df = hazard(spark, *[("AB"[i % 2], f"2024010{1 + i % 3}{i % 24:02d}{(7 * i) % 60:02d}", f"2024010{3 + i % 4}{(5 * i) % 24:02d}00", ["WS", "FF", "ZZ"][i % 3], "YAW"[i % 3]) for i in range(24)])
    union = I.expand_hours(df, ["airport", "severity", "hazard_group"])
    flag = lambda g: F.max(F.when(F.col("hazard_group") == g, F.col("hazard_forecast")).otherwise(0))
    want = union.groupBy("airport", "utc_hour").agg(F.max("hazard_forecast").alias("hazard_forecast_any"), F.max("hazard_active_at_prediction").alias("hazard_active_at_prediction"),
                                                    F.max("severity").alias("hazard_max_severity"), flag("winter").alias("hazard_winter"), flag("flood").alias("hazard_flood"))
    assert hours(want) == hours(I.hazard_hours(df))


def test_no_intersection_is_reported(spark):
    empty = spark.createDataFrame([], "a int")
    with pytest.raises(ValueError):
        I.require_rows(empty, "no hazard meets an airport")


def test_overlapping_spans_are_counted_not_expanded(spark):
    kinds = [("WS", "Y"), ("FF", "A"), ("ZZ", "W"), ("ZZ", "?")]
    df = hazard(spark, *[("AB"[i % 2], f"202401{1 + i % 9:02d}{i % 24:02d}30", f"202401{9 + i % 9:02d}{(7 * i) % 24:02d}00", *kinds[i % 4]) for i in range(120)])
    union = I.expand_hours(df, ["airport", "severity", "hazard_group"])
    flag = lambda g: F.max(F.when(F.col("hazard_group") == g, F.col("hazard_forecast")).otherwise(0))
    want = union.groupBy("airport", "utc_hour").agg(F.max("hazard_forecast").alias("hazard_forecast_any"), F.max("hazard_active_at_prediction").alias("hazard_active_at_prediction"),
                                                    F.max("severity").alias("hazard_max_severity"), flag("winter").alias("hazard_winter"), flag("flood").alias("hazard_flood"))
    got = I.hazard_hours(df)
    assert hours(want) == hours(got)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # Plans are printed from the result down: hours are made above the running sums of changes.
    assert plan.index("Generate explode") < plan.index("Window") < plan.index("Generate inline")


def test_hazards_of_both_ends_come_from_one_join(spark):
    from riskloom.plans import flights as P

    hour = dt.datetime(2024, 1, 1, 5)
    table = spark.createDataFrame([("A", hour, 1, 3), ("B", hour, 0, 1)], "airport string, utc_hour timestamp, hazard_forecast_any int, hazard_max_severity int")
    data = [("A", "B", hour), ("B", "C", hour), (None, "A", hour), ("A", "B", None)]
    df = spark.createDataFrame(data, "Origin string, Dest string, utc_hour timestamp")
    out = P.attach_hazards(df, table)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
    assert {tuple(r)[:2] + tuple(r)[3:] for r in out.collect()} == {("A", "B", 1, 3, 0, 1), ("B", "C", 0, 1, 0, 0), (None, "A", 0, 0, 1, 3), ("A", "B", 0, 0, 0, 0)}
