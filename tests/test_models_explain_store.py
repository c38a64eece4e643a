import datetime as dt
import math
import pathlib
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import explain as X, models as ML, profile as R
from riskloom.plans import flights as P
from riskloom.session import materialize
from riskloom.sources import store
from tests.conftest import rows

RATES = ["o", "d", "r"]


def backoff_frame(spark, data):
    return spark.createDataFrame(data, "a string, b string, o double, d double, r double, minutes double")


def test_backoff_reads_original_values(spark):
    train = backoff_frame(spark, [("A", "B", 0.2, 0.4, 0.6, 60.0), ("A", "B", 0.4, 0.6, 0.8, 80.0), ("A", "C", None, None, None, 200.0)])
    fitted = ML.fit_backoff(train, RATES, "minutes", ["a", "b"])
    out = ML.apply_backoff(backoff_frame(spark, [("A", "B", None, 0.5, None, None), ("Z", "Z", None, None, None, None), ("A", "C", 0.1, None, 0.3, 5.0)]), fitted).collect()
    first, unseen, third = out
    assert (first["o"], first["d"], first["r"], first["minutes"]) == (0.5, 0.5, 0.5, 70.0)
    assert np.allclose([unseen["o"], unseen["d"], unseen["r"], unseen["minutes"]], [0.3, 0.5, 0.7, 80.0])
    assert (third["o"], third["d"], third["r"], third["minutes"]) == (0.1, 0.2, 0.3, 5.0)
    assert (first["o_history_unavailable"], first["d_history_unavailable"], first["scheduled_duration_history_unavailable"]) == (1, 0, 1)


def test_backoff_pools_when_a_column_is_empty(spark):
    train = backoff_frame(spark, [("A", "B", 0.2, 0.4, None, 60.0)])
    assert ML.fit_backoff(train, RATES, "minutes", ["a", "b"]).rates["r"] == pytest.approx(0.3)


def test_pooling_indexing_and_scaling(spark):
    train = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [("c",)] * 4, "k string")
    test = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "k string")
    assert [r[0] for r in ML.pool_rare(test, "k", ML.level_counts(train, "k"), 4).collect()] == ["a", "infrequent", None, None]
    assert [r["i"] for r in ML.index_levels(test, train, "k", "i").collect()] == [1, 2, 0, 0]
    numbers = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "v double, c double")
    got = [tuple(r) for r in ML.standardize(numbers, numbers, ["v", "c"]).collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0), (0.0, 0.0)]
    assert [r["v"] for r in ML.scale_only(numbers, numbers, ["v"]).collect()] == [1.0, 3.0, None]


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(3000):
        hour, code = int(rng.integers(0, 24)), "xyz"[rng.integers(3)]
        p = 1 / (1 + math.exp(-(-1.5 + 0.1 * hour + (1.0 if code == "x" else 0.0))))
        data.append((str(i), code, float(hour) if i % 50 else None, float(rng.normal()), int(rng.random() < p), 2000 + i % 3))
    return spark.createDataFrame(data, "row_key string, code string, hour double, noise double, label int, year int").cache()


def test_grid_search_and_persistence(spark, learnable):
    filled = learnable.fillna(0.0, ["hour"])
    train, valid = filled.where("year < 2002"), filled.where("year = 2002")
    fit = lambda df, columns, **p: ML.logistic([c for c in columns if c == "code"], [c for c in columns if c != "code"], maxIter=20, **p).fit(df)
    models, metrics = ML.grid_search(train, valid, {"weak 1": lambda df: fit(df, ["code", "hour"], regParam=1.0), "free 0": lambda df: fit(df, ["code", "hour"])})
    assert {r["model"] for r in metrics.collect()} == {"weak 1", "free 0"} and all(r["roc_auc"] > 0.6 for r in metrics.collect())
    assert ML.best_by_group(metrics, F.lit("all")).count() == 1
    path = tempfile.mkdtemp(prefix="run-") + "/model"
    store.save_model(models["free 0"], path)
    score = lambda m: [r["p"] for r in ML.add_probability(valid, m, "p").orderBy("row_key").collect()]
    assert score(store.load_model(path)) == score(models["free 0"])


# --- explanations ----------------------------------------------------------------------------


def curve(spark, ys, feature="f"):
    return spark.createDataFrame([(feature, float(i), float(y)) for i, y in enumerate(ys)], "feature string, x double, effect double")


def test_shape_review_counts_material_reversals(spark):
    ys = [0.0, 1.0, 0.5, 0.5 + 1e-7, 2.0, 1.0]
    r = X.shape_review(curve(spark, ys)).first()
    first = np.diff(ys)
    material = first[np.abs(first) > max(np.ptp(ys) * 0.005, 1e-5)]
    assert r["direction_reversals"] == int((np.sign(material[1:]) != np.sign(material[:-1])).sum()) == 3
    assert abs(r["roughness_ratio"] - np.abs(np.diff(ys, n=2)).sum() / np.abs(first).sum()) < 1e-12
    short = X.shape_review(curve(spark, [1.0, 2.0])).first()
    assert (short["roughness_ratio"], short["direction_reversals"], short["spearman_x_to_effect"]) == (0.0, 0, None)
    assert X.shape_review(curve(spark, [1.0] * 4)).first()["roughness_ratio"] == 0.0


def test_smoothing_keeps_parabolas_and_short_curves(spark):
    ys = [x * x - 3 * x for x in range(9)]
    assert all(abs(r["smoothed"] - r["effect"]) < 1e-9 for r in X.smooth(curve(spark, ys), 5).collect())
    assert [r["smoothed"] for r in X.smooth(curve(spark, [1.0, 5.0]), 5).orderBy("x").collect()] == [1.0, 5.0]
    noisy = [0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0]
    middle = X.smooth(curve(spark, noisy), 5).where("x = 3").first()["smoothed"]
    assert abs(middle - np.dot([-3, 12, 17, 12, -3], noisy[1:6]) / 35) < 1e-12


def test_monotone_fit_never_falls(spark):
    out = [r["monotone"] for r in X.monotone_fit(curve(spark, [1.0, 3.0, 2.0, 4.0])).orderBy("x").collect()]
    assert out == [1.0, 2.5, 2.5, 4.0]


def test_waterfall_adds_up(spark):
    values = [0.5, -0.2, 0.1, 0.05, -0.01]
    df = spark.createDataFrame([("k", f"t{i}", v) for i, v in enumerate(values)], "row_key string, term string, contribution double")
    out = X.waterfall(df, -1.0, top=2).orderBy("step").collect()
    assert [r["term"] for r in out] == ["intercept", "t0", "t1", "other_terms"]
    assert out[0]["start_probability"] == 0.0 and abs(out[-1]["end_probability"] - 1 / (1 + math.exp(1.0 - sum(values)))) < 1e-12
    assert abs(sum(r["change_percentage_points"] for r in out) - 100 * out[-1]["end_probability"]) < 1e-9
    assert len(X.waterfall(df, -1.0, top=5).collect()) == 6


def test_nearest_row_prefers_candidates_and_falls_back(spark):
    df = spark.createDataFrame([("a", 0.72, 0), ("b", 0.70, 1), ("c", 0.1, 1)], "k string, p double, y int")
    assert X.nearest_row(df, F.col("y") == 1, F.col("p"), 0.72, "k").first()["k"] == "b"
    assert X.nearest_row(df, F.col("y") == 7, F.col("p"), 0.72, "k").first()["k"] == "a"


def test_severity_profile_is_coherent(spark):
    df = spark.createDataFrame([("A", 0.7, 0.8, 0.3)], "o string, a double, b double, c double")
    assert rows(X.severity_profile(df, {15: "a", 30: "b", 60: "c"}, ["o"])) == [("A", 15, 0.7, 0.7), ("A", 30, 0.8, 0.7), ("A", 60, 0.3, 0.3)]


def test_category_risk_filters_and_ranks(spark):
    effects = spark.createDataFrame([("t", "a", 10, 0.5), ("t", "b", 1, 9.0), ("t", "c", 10, 0.7)], "term string, level string, rows long, score double")
    assert [(r["rank"], r["level"]) for r in X.category_risk(effects, 0.2, 5, 10).orderBy("rank").collect()] == [(1, "c"), (2, "a")]


def test_category_risk_keeps_the_best_of_each_task_before_the_shuffle(spark):
    effects = spark.range(20000).repartition(6).select(
        (F.col("id") % 2).cast("string").alias("term"), F.col("id").cast("string").alias("level"), F.lit(9).alias("rows"),
        (F.col("id") % 500 / 100.0).alias("score"),
    )
    top = X.category_risk(effects, 0.2, 5, 10)
    plan = top._jdf.queryExecution().executedPlan().toString()
    limits = [i for i in range(len(plan)) if plan.startswith("WindowGroupLimit", i)]
    assert len(limits) == 2 and limits[0] < plan.index("Exchange hashpartitioning") < limits[1], plan
    got = [(r["term"], r["level"]) for r in top.orderBy("term", "rank").collect()]
    want = lambda best: sorted(str(i) for i in range(best, 20000, 500))[:10]
    assert got == [("0", level) for level in want(498)] + [("1", level) for level in want(499)]



# --- profiles and storage -----------------------------------------------------------------------


def test_distribution_and_missingness(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 130)], "ArrDelay double")
    r = R.distribution(df).first()
    assert (r["eligible_flights"], r["median"], r["maximum"], r["delay_ge_15"], r["delay_ge_120"]) == (5, 3.0, 130.0, 0.2, 0.2)
    audit = spark.createDataFrame([("d", None, 1.0), ("d", 2.0, 0.0), ("h", 1.0, 1.0)], "split string, f double, y double")
    assert rows(R.missingness(audit, "split", ["f"], "y"), "split", "missing_observations", "delay_rate_when_missing", "delay_rate_when_present") == [
        ("d", 1, 1.0, 0.0), ("h", 0, None, 1.0)]


def test_variance_screen_of_constant_and_single_row(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert rows(R.variance_screen(df, ["a"])) == [("a", None, True)]


def test_hub_dimension_cleans_and_dedupes(spark):
    raw = spark.createDataFrame([(" JFK ", "Large", "100"), ("JFK", "Large", "100"), ("X", None, "n/a")], "airport string, hub string, enplanements string")
    out = rows(P.hub_dimension(raw), "airport", "faa_hub_category", "faa_2023_enplanements")
    assert out == [("JFK", "Large", 100.0), ("X", "Non-primary", None)]


def test_store_prunes_partitions_and_checks_months(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/store"
    df = spark.createDataFrame([(y, m, float(m)) for y in (2022, 2023) for m in range(1, 13)], "year int, month int, v double")
    store.write_store(df, path)
    store.write_store(df.withColumn("v", F.lit(-1.0)), path)
    back = store.read_store(spark, path)
    assert back.count() == 24 and back.where("v < 0").count() == 0
    plan = back.where("year = 2022").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "ReadSchema: struct<v:double>" in plan
    store.write_store(df.where("year = 2022 AND month = 1").withColumn("v", F.lit(-1.0)), path, overwrite=True)
    assert spark.read.parquet(path).where("v < 0").count() == 1 and spark.read.parquet(path).count() == 24
    back = store.read_store(spark, path)
    store.require_months(back, [2022, 2023])
    with pytest.raises(store.MissingInputError, match="2024-01"):
        store.require_months(back, [2023, 2024])


def test_store_resumes_by_month(spark):
    root = tempfile.mkdtemp(prefix="run-") + "/store"
    df = spark.createDataFrame([(2022, m, float(m)) for m in range(1, 7) for _ in range(3)], "year int, month int, v double")
    assert store.resume_store(df.where("month <= 2"), root, at_a_time=1) == 2
    files = lambda m: sorted(p.name for p in pathlib.Path(root, "year=2022", f"month={m}").glob("*.parquet"))
    first = files(1) + files(2)
    # A run killed in month 3 left rows but no record.
    df.where("month = 3").limit(1).write.mode("append").partitionBy("year", "month").parquet(root)
    assert store.resume_store(df.withColumn("v", -F.col("v")), root, at_a_time=2) == 4
    assert files(1) + files(2) == first
    back = store.read_store(spark, root)
    assert back.count() == 18 and back.where("v > 0").agg(F.max("month")).first()[0] == 2
    assert store.resume_store(df, root) == 0
    assert rows(store.finished_parts(spark, root), "year", "month", "rows") == [(2022, m, 3) for m in range(1, 7)]
    with pytest.raises(ValueError):
        store.resume_store(df.withColumn("month", F.lit(None).cast("int")), root)


def test_publish_exact_keeps_the_old_table_on_a_wrong_count(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/sample"
    assert store.publish_exact(spark.range(10), path, 10)
    assert not store.publish_exact(spark.range(3), path, 3)
    with pytest.raises(ValueError, match="expected 5 rows, wrote 3"):
        store.publish_exact(spark.range(3), path, 5, overwrite=True)
    assert spark.read.parquet(path).count() == 10
    assert store.publish_exact(spark.range(3), path, 3, overwrite=True) and spark.read.parquet(path).count() == 3


def test_reports_round_trip(spark):
    path = tempfile.mkdtemp(prefix="run-")
    df = spark.createDataFrame([("a, b", 0.5), ("c", None)], "n string, v double")
    for fmt in ("csv", "json"):
        store.write_report(df, f"{path}/{fmt}", fmt)
        assert rows(store.read_report(spark, f"{path}/{fmt}", "n string, v double", fmt)) == rows(df)


def test_raw_csv_reads_only_named_columns(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/raw.csv"
    with open(path, "w") as f:
        f.write("FlightDate,Reporting_Airline,Origin,Dest,CRSDepTime,CRSArrTime,CRSElapsedTime,Distance,Cancelled,Diverted,ArrDel15,ArrDelay\n")
        f.write("2024-01-01,AA,JFK,MIA,905,1200,175,1089,0,0,,\n")
    row = store.read_csv(spark, path, store.RAW_SCHEMA, ["FlightDate", "CRSDepTime", "ArrDel15"]).first()
    assert tuple(row) == (dt.date(2024, 1, 1), 905, None)


def test_scoring_works_after_graph_measures(spark):
    """A measure that counts while it iterates must not leave anything in the session that models carry along."""
    from riskloom.operators import graph as G

    day = dt.date(2024, 1, 1)
    edges = spark.createDataFrame([(day, "A", "B", 1.0, 1.0), (day, "B", "C", 1.0, 1.0), (day, "C", "A", 2.0, 0.5)],
                                  "network_month date, src string, dst string, weight double, length double")
    G.pagerank(edges).collect(), G.betweenness(edges).collect()
    rows = spark.createDataFrame([(float(k % 2), float(k)) for k in range(40)], "label double, x double")
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    model = LogisticRegression(featuresCol="features", labelCol="label").fit(vectors)
    assert materialize(model.transform(vectors).select("prediction"), "scores").count() == 40


def test_smoothing_window_shrinks_to_the_curve(spark):
    random = np.random.default_rng(0)
    for n in (4, 5, 6, 12, 31, 40):
        ys = random.random(n).tolist()
        got = [r["smoothed"] for r in X.smooth(curve(spark, ys)).orderBy("x").collect()]
        width = min(31, n if n % 2 else n - 1)
        if width < 5:
            assert got == ys
            continue
        want = []
        for i in range(n):
            low = min(max(i - width // 2, 0), n - width)
            fit = np.polyfit(np.arange(width), ys[low : low + width], 2)
            want.append(np.polyval(fit, i - low))
        assert np.allclose(got, want)


def test_unfinished_store_is_written_again(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([(2020, 1, 5), (2020, 2, 6)], "year int, month int, v int")
    df.limit(1).write.partitionBy("year", "month").parquet(root)
    (tmp_path / "store" / "_SUCCESS").unlink()
    store.write_store(df, root)
    assert store.read_store(spark, root).count() == 2
    store.write_store(df.limit(0), root)
    assert store.read_store(spark, root).count() == 2


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = str(tmp_path / "wide.csv")
    with open(path, "w") as f:
        f.write("Extra,ArrDel15,CRSDepTime,FlightDate,More\nx,,905,2024-01-01,1\ny,1.0,abc,2024-01-02,2\n")
    got = store.read_csv(spark, path, store.RAW_SCHEMA, ["FlightDate", "CRSDepTime", "ArrDel15"]).collect()
    assert [tuple(r) for r in got] == [(dt.date(2024, 1, 1), 905, None), (dt.date(2024, 1, 2), None, 1.0)]
    with pytest.raises(store.MissingInputError):
        store.read_csv(spark, path, store.RAW_SCHEMA, ["Origin"])
