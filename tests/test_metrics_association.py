import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import association as A, metrics as M
from tests.conftest import rows


def scores(spark, data):
    return spark.createDataFrame(data, "model string, label int, score double")


def brute(data):
    """AUC by counting pairs and AP by thresholds."""
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for t in sorted({s for _, s in data}, reverse=True):
        hit = sum(1 for s in pos if s >= t)
        ap += (hit - seen) / len(pos) * hit / sum(1 for _, s in data if s >= t)
        seen = hit
    return auc, ap


def test_evaluate_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    data = [(m, int(rng.random() < 0.3), float(np.round(rng.random(), 1 + i))) for i, m in enumerate("ab") for _ in range(400)]
    for r in M.evaluate(scores(spark, data)).collect():
        part = [(y, s) for m, y, s in data if m == r["model"]]
        auc, ap = brute(part)
        y, p = np.array([v[0] for v in part]), np.array([v[1] for v in part])
        clipped = np.clip(p, 1e-7, 1 - 1e-7)
        cut = np.quantile(clipped, 0.9)
        assert abs(r["roc_auc"] - auc) < 1e-9 and abs(r["average_precision"] - ap) < 1e-9
        assert abs(r["log_loss"] + np.mean(y * np.log(clipped) + (1 - y) * np.log(1 - clipped))) < 1e-9
        assert abs(r["brier_score"] - np.mean((clipped - y) ** 2)) < 1e-9
        assert abs(r["top_decile_delay_rate"] - y[clipped >= cut].mean()) < 1e-9
        assert abs(r["share_delays_captured_top_decile"] - y[clipped >= cut].sum() / y.sum()) < 1e-9


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_and_single_row(spark, label):
    row = M.evaluate(scores(spark, [("a", label, 0.25)])).first()
    assert row["roc_auc"] is None and row["base_rate"] == label
    assert row["average_precision"] == (1.0 if label else None)


def test_evaluate_without_groups(spark):
    data = [("a", 1, 0.9), ("a", 0, 0.1), ("a", 1, 0.4), ("a", 0, 0.4)]
    grouped = M.evaluate(scores(spark, data)).drop("model").first()
    assert M.evaluate(scores(spark, data), by=()).first() == grouped


def test_curves_end_at_one(spark):
    data = [("a", 1, 0.9), ("a", 0, 0.8), ("a", 1, 0.4), ("a", 0, 0.4)]
    assert rows(M.roc_points(scores(spark, data)), "threshold", "false_positive_rate", "true_positive_rate") == [
        (0.4, 1.0, 1.0), (0.8, 0.5, 0.5), (0.9, 0.0, 0.5)]
    assert rows(M.pr_points(scores(spark, data), min_recall=0.6), "threshold", "precision", "recall") == [(0.4, 0.5, 1.0)]


def test_calibration_bins_hold_all_rows(spark):
    data = [("a", i % 2, i / 120) for i in range(120)]
    out = M.calibration_bins(scores(spark, data), bins=12).collect()
    assert len(out) == 12 and sum(r["rows"] for r in out) == 120 and all(r["rows"] == 10 for r in out)


def test_paired_gain(spark):
    df = spark.createDataFrame([(1, 0.9, 0.5), (0, 0.2, 0.5), (1, 0.6, 0.5)], "y int, a double, b double")
    r = M.paired_gain(df, "y", "a", "b").first()
    d = np.array([math.log(0.9 / 0.5), math.log(0.8 / 0.5), math.log(0.6 / 0.5)])
    assert abs(r["log_loss_gain"] - d.mean()) < 1e-12
    assert abs(r["ci_high"] - d.mean() - 1.96 * d.std(ddof=1) / math.sqrt(3)) < 1e-12


def test_block_decisions(spark):
    metrics = spark.createDataFrame([("full", 0.5, 0.7), ("x", 0.4995, 0.7), ("y", 0.499, 0.69), ("z", 0.6, 0.7)], "model string, average_precision double, roc_auc double")
    out = M.block_decisions(metrics, "full", 0.0009, ["z"])
    assert rows(out, "feature_group", "included", "decision") == [
        ("x", False, "Excluded: no material validation lift"), ("y", True, "Included"), ("z", True, "Required task definition")]


# --- association ------------------------------------------------------------------------


def ranks(values):
    order = sorted(values)
    return np.array([order.index(v) + (order.count(v) + 1) / 2 for v in values])


def test_spearman_fills_medians_and_averages_ties(spark):
    rng = np.random.default_rng(5)
    a = [float(x) for x in rng.integers(0, 20, 200)]
    b = [None if i % 17 == 0 else float(x + rng.integers(0, 5)) for i, x in enumerate(a)]
    df = spark.createDataFrame(list(zip(a, b, [3.0] * 200)), "a double, b double, c double")
    got = {(r[0], r[1]): r[2] for r in A.spearman_pairs(df, ["a", "b", "c"]).collect()}
    filled = [np.median([x for x in b if x is not None]) if x is None else x for x in b]
    assert abs(got["a", "b"] - np.corrcoef(ranks(a), ranks(filled))[0, 1]) < 1e-9
    assert got["a", "c"] is None


def test_vif_matches_the_inverse_correlation_matrix(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3))
    x[:, 2] += x[:, 0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = {r["feature"]: r["vif"] for r in A.variance_inflation(df, ["a", "b", "c"]).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    assert np.allclose([got["a"], got["b"], got["c"]], want)


def dense_v(pairs):
    xs, ys = sorted({p[0] for p in pairs}), sorted({p[1] for p in pairs})
    o = np.array([[sum(1 for p in pairs if p == (x, y)) for y in ys] for x in xs], float)
    n = o.sum()
    e = o.sum(1, keepdims=True) @ o.sum(0, keepdims=True) / n
    r, c = o.shape
    phi = max(0.0, ((o - e) ** 2 / e).sum() / n - (r - 1) * (c - 1) / (n - 1))
    room = min(r - (r - 1) ** 2 / (n - 1) - 1, c - (c - 1) ** 2 / (n - 1) - 1)
    return math.sqrt(phi / room) if room > 0 else 0.0


def test_cramers_v_matches_the_dense_table(spark):
    rng = np.random.default_rng(11)
    data = [("abc"[rng.integers(3)], None if i % 29 == 0 else "xyzw"[rng.integers(4)], "k") for i in range(500)]
    df = spark.createDataFrame(data, "p string, q string, k string")
    got = {(r[0], r[1]): r[2] for r in A.cramers_v(df, ["p", "q", "k"]).collect()}
    assert abs(got["p", "q"] - dense_v([(p, q) for p, q, _ in data if q])) < 1e-9
    assert got["p", "k"] == 0.0
    same = A.cramers_v(df.select("p", F.col("p").alias("p2")), ["p", "p2"]).first()
    assert abs(same["corrected_cramers_v"] - 1.0) < 0.01


def test_correlation_ratio_with_missing_category_and_number(spark):
    data = [("a", 1.0), ("a", 2.0), (None, 5.0), (None, 6.0), ("b", None), ("b", 3.0)]
    df = spark.createDataFrame(data, "c string, v double")
    kept = [(c or "nan", v) for c, v in data if v is not None]
    grand = np.mean([v for _, v in kept])
    groups = {c: [v for k, v in kept if k == c] for c, _ in kept}
    between = sum(len(v) * (np.mean(v) - grand) ** 2 for v in groups.values())
    want = math.sqrt(between / sum((v - grand) ** 2 for _, v in kept))
    assert abs(A.correlation_ratio(df, ["c"], ["v"]).first()["correlation_ratio_eta"] - want) < 1e-12
    constant = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "c string, v double")
    assert A.correlation_ratio(constant, ["c"], ["v"]).first()["correlation_ratio_eta"] == 0.0


def test_scores_are_clipped_before_they_are_ranked(spark):
    data = [(1, 1.0), (0, 1.0 - 1e-9), (1, 0.0), (0, -0.5), (1, 0.4), (0, 0.3), (0, 2.0)]
    got = M.evaluate(scores(spark, [("m", y, s) for y, s in data])).first()
    auc, ap = brute([(y, min(max(s, 1e-7), 1 - 1e-7)) for y, s in data])
    assert abs(got["roc_auc"] - auc) < 1e-12 and abs(got["average_precision"] - ap) < 1e-12


def test_an_empty_column_empties_only_its_own_pairs(spark):
    df = spark.createDataFrame([(1.0, 3.0, None), (2.0, 1.0, None), (3.0, 4.0, None), (4.0, 9.0, None)], "a double, b double, c double")
    got = {(r["feature_1"], r["feature_2"]): r["spearman_correlation"] for r in A.spearman_pairs(df, ["a", "b", "c"]).collect()}
    assert abs(got["a", "b"] - 0.8) < 1e-12 and got["a", "c"] is None and got["b", "c"] is None
