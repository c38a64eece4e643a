"""The model queries hand whole jobs to the estimators, on the enriched table with every feature group."""

import numpy as np
import pytest

from riskloom.catalog import FEATURE_GROUPS, REQUIRED_GROUPS
from riskloom.operators import additive as AD, boosting
from riskloom.plans import model_queries as Q, model_table as T


@pytest.fixture
def few_rounds(monkeypatch):
    """Candidates as the queries ask for them, fitted with few rounds."""
    asked, fit, terms = {}, boosting.fit, AD.fit

    def trees(rows, bins, candidates, **more):
        asked.update(candidates)
        return fit(rows, bins, {c: boosting.Trees(**{**p.__dict__, "rounds": 2}) for c, p in candidates.items()}, **more)

    def additive(rows, bins, candidates, interactions, **more):
        asked.update({c: (p, interactions[c]) for c, p in candidates.items()})
        return terms(rows, bins, {c: AD.Additive(**{**p.__dict__, "rounds": 8, "rate": 0.3}) for c, p in candidates.items()}, interactions, **more)

    monkeypatch.setattr(boosting, "fit", trees)
    monkeypatch.setattr(AD, "fit", additive)
    return asked


def test_enriched_table_has_every_group(spark, sf_dir):
    table = T.enriched(spark, sf_dir)
    assert set(T.FEATURES) == {f for fs in FEATURE_GROUPS.values() for f in fs} <= set(table.columns)
    assert table.count() == table.select("row_key").distinct().count() > 50_000
    counts = table.groupBy().agg(*[Q.F.count_if(Q.F.col(f).isNotNull()).alias(f) for f in T.FEATURES]).first()
    assert min(counts) > 10_000
    plan = table.where("year = 2001").select("label")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_trees_see_all_features_and_rounds(spark, sf_dir, few_rounds):
    assert Q.boosted_trees(spark, sf_dir).first()["roc_auc"] > 0.5
    assert few_rounds == {"boosted_trees": boosting.Trees(650)}
    assert {r["feature"] for r in Q.tree_importance(spark, sf_dir).collect()} <= set(T.FEATURES)
    assert Q.training_loss(spark, sf_dir).count() == 2
    few_rounds.clear()
    Q.seed_ensemble(spark, sf_dir).collect()
    assert {(p.rounds, p.seed) for p in few_rounds.values()} == {(650, s) for s in (42, 43, 44)}


def test_grid_has_all_candidates(spark, sf_dir, few_rounds):
    assert {r["family"] for r in Q.grid_search(spark, sf_dir).collect()} == {"logistic", "trees", "additive"}
    trees = [p for p in few_rounds.values() if isinstance(p, boosting.Trees)]
    assert [(p.rounds, p.depth) for p in trees] == [(450, 4), (450, 6), (450, 8), (450, 6)]
    assert sorted((p.rounds, n) for p, n in (v for v in few_rounds.values() if isinstance(v, tuple))) == [(900, 0), (1100, 5), (1300, 8)]


def test_all_optional_blocks_are_screened(spark, sf_dir, few_rounds):
    table = {r["feature_group"]: r for r in Q.block_ablation(spark, sf_dir).collect()}
    optional = set(FEATURE_GROUPS) - set(REQUIRED_GROUPS)
    assert set(table) == set(FEATURE_GROUPS) and len(optional) == 6
    assert {c: set(p.without) for c, p in few_rounds.items()} == {"full": set(), **{g: set(FEATURE_GROUPS[g]) for g in optional}}
    assert all(p.rounds == 300 for p in few_rounds.values())
    assert all(table[g]["loss_gain_ci_low"] <= table[g]["paired_log_loss_gain"] <= table[g]["loss_gain_ci_high"] for g in optional)


def test_permutation_tables(spark, sf_dir, few_rounds):
    found = {r["feature"]: r for r in Q.permutation_significance(spark, sf_dir).collect()}
    assert set(found) == {*FEATURE_GROUPS["Lagged network centrality"], *FEATURE_GROUPS["Recent delay propagation"]}
    checks = {r["feature"]: r for r in Q.conditional_audit(spark, sf_dir).collect()}
    assert {f: r["conditioned_within"] for f, r in checks.items()} == Q.CONDITIONED
    for r in checks.values():
        drop = 1e4 * (r["baseline_average_precision"] - r["conditional_permutation_average_precision"])
        assert abs(drop - r["average_precision_drop_basis_points"]) < 1e-9
        assert r["interpretation"].startswith("Retains" if drop >= 1 else "Mostly")


def test_severity_of_every_test_row(spark, sf_dir, few_rounds):
    test = T.split(spark, sf_dir)["test"]
    found = Q.severity_models(spark, sf_dir).collect()
    assert {(p.label, n) for p, n in few_rounds.values()} == {(f"late_{t}", 8) for t in (30, 60, 120)}
    assert sorted(r["row_key"] for r in found) == sorted(r["row_key"] for r in test.select("row_key").collect())
    for r in found:
        raw = [r[f"p_delay_ge_{t}"] for t in (30, 60, 120)]
        assert all(0 < p < 1 for p in raw)
        assert [r[f"p_delay_ge_{t}_coherent"] for t in (30, 60, 120)] == [min(raw[: k + 1]) for k in range(3)]
    metrics = {r["delay_threshold_minutes"]: r for r in Q.severity_metrics(spark, sf_dir).collect()}
    assert sorted(metrics) == [30, 60, 120]
    for t, r in metrics.items():
        late = [x["actual_delay_minutes"] is not None and x["actual_delay_minutes"] >= t for x in found]
        assert abs(r["base_rate"] - sum(late) / len(late)) < 1e-12
        brier = np.mean([(x[f"p_delay_ge_{t}"] - y) ** 2 for x, y in zip(found, late)])
        assert abs(r["brier_score"] - brier) < 1e-6
    assert [r["delay_threshold_minutes"] for r in Q.severity_example(spark, sf_dir).collect()] == [15, 30, 60, 120]


def test_additive_queries(spark, sf_dir, few_rounds):
    assert Q.additive_model(spark, sf_dir).first()["roc_auc"] > 0.55
    assert few_rounds == {"additive": (AD.Additive(1300, 0.03, 50), 8)}
    terms = [r["term"] for r in Q.additive_importance(spark, sf_dir).collect()]
    assert len(terms) == len(T.FEATURES) + 8
    curves = Q.additive_curves(spark, sf_dir).collect()
    for f in {r["feature"] for r in curves}:
        own = [r["monotone"] for r in sorted((r for r in curves if r["feature"] == f), key=lambda r: r["x"])]
        assert own == sorted(own)
