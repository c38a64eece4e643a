"""Registered queries: feature preparation, estimators, selection and explanations."""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from riskloom.catalog import (
    DEFAULT_SOURCE, DISPLAY, DURATION_EDGES, DURATION_LABELS, EXCLUDED_FEATURES, FEATURE_GROUPS, GROUP_SOURCE,
    PERMUTATION_VERDICT_AP, REQUIRED_GROUPS, SCREEN_THRESHOLD_AP, SEVERITY_MINUTES, SHAPE_ADVICE, DEFAULT_SHAPE_ADVICE,
)
from riskloom.functions import values as V
from riskloom.operators import (
    additive as AD, binning, boosting, explain as X, history, joins, metrics as M, models as ML, profile as R, sampling,
    stochastic as SG,
)
from riskloom.operators.cohort import eligible
from riskloom.plans import flights as P, model_table as T
from riskloom.plans.binding import RAW_SQL, labelled_flights, sql_with
from riskloom.plans.feature_queries import TRAILING_SQL, eligible_flights
from riskloom.plans.profile_queries import metrics_sql
from riskloom.plans.registry import query
from riskloom.session import at_once, materialize, scratch_dir
from riskloom.sources import store

RATES = ["origin_recent_delay_rate", "destination_recent_delay_rate", "route_recent_delay_rate"]
DURATION = "scheduled_duration_minutes"


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def model_table(spark, sf_dir):
    """Eligible bound flights with schedule, congestion and history features."""
    df = labelled_flights(
        spark, sf_dir, "row_key", "FlightDate", "year", "month", "day_of_week", "departure_hour", "Reporting_Airline",
        "Origin", "Dest", "CRSElapsedTime", "disc", "ArrDel15", "ArrDelay", "primary_eligible",
    )
    df = materialize(df, "flights")
    counted = eligible(history.congestion(df))
    rates = history.trailing_features(eligible(df))
    joined = joins.lookup_join(counted, rates, {c: c for c in ("FlightDate", "Origin", "Dest")}, validate=False)
    return P.present(joined).withColumn("label", F.col("arrival_delay_15min").cast("int"))


MODEL_SQL = """model_rows AS (
  SELECT f.row_key, f."year", f."Origin" AS origin_airport, f."Dest" AS destination_airport, f."Reporting_Airline" AS airline, f.departure_hour,
         CASE WHEN f."CRSElapsedTime" > 0 THEN f."CRSElapsedTime" END AS scheduled_duration_minutes, r.origin_recent_delay_rate,
         r.destination_recent_delay_rate, r.route_recent_delay_rate, f."ArrDel15" AS label
  FROM flights f LEFT JOIN rates r USING ("FlightDate", "Origin", "Dest") WHERE primary_eligible = 1
)"""
_MODEL_PARTS = (RAW_SQL, TRAILING_SQL, MODEL_SQL)


# --- feature preparation ----------------------------------------------------------------


@query(
    "pooled_levels", "ML1",
    sql_with(RAW_SQL, """counts AS (SELECT "Origin" || '>' || "Dest" AS level, count(*) AS n FROM flights WHERE "year" <= 1999 GROUP BY ALL
    ), pooled AS (SELECT CASE WHEN c.n IS NULL THEN NULL WHEN c.n < 60 THEN 'infrequent' ELSE c.level END AS route
      FROM flights f LEFT JOIN counts c ON f."Origin" || '>' || f."Dest" = c.level)""",
             body="SELECT route, count(*) AS n FROM pooled GROUP BY route"),
)
def pooled_levels(spark, sf_dir):
    df = labelled_flights(spark, sf_dir, "Origin", "Dest", "year").withColumn("route", F.concat_ws(">", "Origin", "Dest"))
    counts = ML.level_counts(df.where("year <= 1999"), "route")
    return ML.pool_rare(df, "route", counts, min_rows=60).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query(
    "scaled_numbers", "ML2",
    sql_with(RAW_SQL, body="""SELECT row_key, round(disc / (SELECT stddev_pop(disc) FROM flights WHERE "year" <= 1999), 6) AS disc,
      round(departure_hour / (SELECT stddev_pop(departure_hour) FROM flights WHERE "year" <= 1999), 6) AS departure_hour FROM flights"""),
)
def scaled_numbers(spark, sf_dir):
    df = labelled_flights(spark, sf_dir, "row_key", "year", "disc", "departure_hour")
    return _rounded(ML.scale_only(df, df.where("year <= 1999"), ["disc", "departure_hour"]).drop("year"), "disc", "departure_hour")


def _mean_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN NULL ELSE (coalesce({a}, 0) + coalesce({b}, 0)) / (({a} IS NOT NULL)::INT + ({b} IS NOT NULL)::INT) END"


@query(
    "backoff_imputation", "ML3 ML4 AG13 SCL16",
    sql_with(*_MODEL_PARTS, "fit AS (SELECT * FROM model_rows WHERE \"year\" <= 1999)", """medians AS (
      SELECT origin_airport, destination_airport, quantile_cont(scheduled_duration_minutes, 0.5) AS m FROM fit GROUP BY ALL)""",
             body="SELECT row_key, " + ", ".join(
        f"round(coalesce({r}, {_mean_sql(*[o for o in RATES if o != r])}, (SELECT avg({r}) FROM fit)), 6) AS {r}, ({r} IS NULL)::INT AS {r}_history_unavailable"
        for r in RATES) + f""", coalesce({DURATION}, m, (SELECT quantile_cont({DURATION}, 0.5) FROM fit)) AS {DURATION},
      ({DURATION} IS NULL)::INT AS scheduled_duration_history_unavailable FROM model_rows LEFT JOIN medians USING (origin_airport, destination_airport)"""),
)
def backoff_imputation(spark, sf_dir):
    columns = ["row_key", "year", "origin_airport", "destination_airport", DURATION, *RATES]
    df = materialize(model_table(spark, sf_dir).select(*columns), "model")
    fitted = ML.fit_backoff(df.where("year <= 1999"), RATES, DURATION, ["origin_airport", "destination_airport"])
    return _rounded(ML.apply_backoff(df, fitted).drop("year", "origin_airport", "destination_airport"), *RATES)


@query(
    "standardized_numbers", "ML5",
    sql_with(*_MODEL_PARTS, "fit AS (SELECT * FROM model_rows WHERE \"year\" <= 1999)", "med AS (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.5) AS {c}" for c in [DURATION, RATES[0]]) + " FROM fit)", "stats AS (SELECT " + ", ".join(
        f"avg(coalesce(f.{c}, med.{c})) AS m_{c}, stddev_samp(coalesce(f.{c}, med.{c})) AS s_{c}" for c in [DURATION, RATES[0]]) + " FROM fit f, med)",
             body="SELECT row_key, " + ", ".join(f"round((coalesce(r.{c}, med.{c}) - m_{c}) / s_{c}, 6) AS {c}" for c in [DURATION, RATES[0]])
             + " FROM model_rows r, med, stats"),
)
def standardized_numbers(spark, sf_dir):
    columns = [DURATION, RATES[0]]
    df = materialize(model_table(spark, sf_dir).select("row_key", "year", *columns), "model")
    return _rounded(ML.standardize(df, df.where("year <= 1999"), columns).drop("year"), *columns)


@query(
    "indexed_levels", "ML6",
    sql_with(RAW_SQL, """known AS (SELECT airline, row_number() OVER (ORDER BY airline) AS i FROM (
      SELECT DISTINCT "Reporting_Airline" AS airline FROM flights WHERE "year" <= 1999))""",
             body="""SELECT row_key, CAST(coalesce(i, 0) AS INTEGER) AS airline_index FROM flights LEFT JOIN known ON "Reporting_Airline" = airline"""),
)
def indexed_levels(spark, sf_dir):
    df = labelled_flights(spark, sf_dir, "row_key", "year", "Reporting_Airline")
    return ML.index_levels(df, df.where("year <= 1999"), "Reporting_Airline", "airline_index").select("row_key", "airline_index")


@query(
    "linear_score", "ML14 SCL11",
    sql_with(RAW_SQL, body="SELECT row_key, round(1 / (1 + exp(-(-2.5 + 0.08 * departure_hour + 0.2 * disc - 0.05 * day_of_week))), 6) AS probability FROM flights"),
)
def linear_score(spark, sf_dir):
    df = labelled_flights(spark, sf_dir, "row_key", "departure_hour", "disc", "day_of_week")
    score = V.linear_score({"departure_hour": 0.08, "disc": 0.2, "day_of_week": -0.05}, -2.5)
    return df.select("row_key", F.round(score, 6).alias("probability"))


@query(
    "aligned_predictions", "JN13 TK7",
    sql_with(RAW_SQL, """picked AS (SELECT row_key FROM flights WHERE primary_eligible = 1 AND "year" = 2001 ORDER BY md5(row_key || '-74') LIMIT 400)""",
             body="""SELECT row_key, "ArrDel15" AS actual, score_a, score_b FROM picked JOIN flights USING (row_key)"""),
)
def aligned_predictions(spark, sf_dir):
    rows = eligible_flights(spark, sf_dir, "row_key", "year", "ArrDel15").where("year = 2001")
    picked = sampling.exact_sample(rows.select("row_key", F.col("ArrDel15").alias("actual")), 400, "row_key", 74, allow_fewer=True)
    predictions = labelled_flights(spark, sf_dir, "row_key", "score_a", "score_b")
    return picked.join(predictions, "row_key")


# --- estimators ------------------------------------------------------------------------------

CATEGORIES, NUMBERS, FEATURES = T.CATEGORIES, T.NUMBERS, T.FEATURES
FLAGS = [*[f"{r}_history_unavailable" for r in RATES], "scheduled_duration_history_unavailable"]
_LATE = {t: f"late_{t}" for t in (15, *SEVERITY_MINUTES)}


def coded(spark, sf_dir, until=1999):
    """Bins fitted on years up to ``until``, and all enriched rows as codes, stored once."""
    table = T.enriched(spark, sf_dir)
    bins = binning.fit_bins(table.where(F.col("year") <= until), CATEGORIES, NUMBERS)
    rows = table.withColumns({c: F.coalesce(F.col("ArrDelay") >= t, F.lit(False)).cast("int") for t, c in _LATE.items()})
    kept = ["row_key", "year", "label", "ArrDelay", *_LATE.values(), "origin_airport", "destination_airport", "scheduled_departure_hour"]
    return bins, materialize(bins.encode(rows, kept), "coded")


def _metrics_of(scored, models):
    return M.evaluate(M.model_scores(scored, "label", models))


# Rounds of the final trees, of the grid's and of the screening's.
FINAL_ROUNDS, GRID_ROUNDS, SCREEN_ROUNDS = 650, 450, 300
# Candidates of the three grids.
LOGISTIC_GRID = [{"penalty": 3e-6}, {"penalty": 1e-5}, {"penalty": 3e-5}, {"penalty": 1e-5, "l1_ratio": 0.05}]
TREE_GRID = [
    {"depth": 4, "child_weight": 10.0, "rate": 0.05, "ridge": 2.0}, {"depth": 6, "child_weight": 10.0, "rate": 0.05, "ridge": 2.0},
    {"depth": 8, "child_weight": 20.0, "rate": 0.04, "ridge": 3.0},
    {"depth": 6, "child_weight": 25.0, "rate": 0.04, "ridge": 5.0, "rows": 0.9, "columns": 0.9},
]
ADDITIVE_GRID = [
    (0, {"rate": 0.05, "rounds": 900, "leaf_rows": 30}), (5, {"rate": 0.04, "rounds": 1100, "leaf_rows": 30}),
    (8, {"rate": 0.03, "rounds": 1300, "leaf_rows": 50}),
]
PAIRS = 8


def prepared(spark, sf_dir):
    """Enriched rows with complete numbers, missing flags and pooled levels as codes, stored once.

    History and duration fall back as fitted on the fit years; other numbers to their mean there.
    """
    rows = T.enriched(spark, sf_dir)
    fit = rows.where("year <= 1999")
    bins = binning.fit_bins(fit, CATEGORIES, [])
    fitted = ML.fit_backoff(fit, RATES, DURATION, ["origin_airport", "destination_airport"])
    others = [c for c in NUMBERS if c not in (DURATION, *RATES)]
    means = fit.agg(*[F.avg(c).alias(c) for c in others]).first()
    filled = ML.apply_backoff(rows, fitted).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c] or 0.0)) for c in others})
    return bins, materialize(bins.encode(filled, ["row_key", "year", "label", *NUMBERS, *FLAGS]), "prepared")


def regression(spark, sf_dir, candidates, until):
    """Fitted regressions of all candidates and the prepared rows."""
    bins, rows = prepared(spark, sf_dir)
    return SG.fit(rows.where(F.col("year") <= until), bins, [*NUMBERS, *FLAGS], candidates), rows


@query("logistic_regression", "ML7 ML2 SNK7")
def logistic_regression(spark, sf_dir):
    """Test metrics of the fitted regression after storing it as tables and loading it."""
    models, rows = regression(spark, sf_dir, {"final": SG.Regression()}, 2000)
    path = f"{scratch_dir(spark)}/regression-{uuid.uuid4().hex}"
    models["final"].save(spark, path)
    scored = SG.RegressionModel.load(spark, path).score(rows.where("year = 2001"), "logistic_regression")
    return _metrics_of(materialize(scored.select("label", "logistic_regression"), "scored"), ["logistic_regression"])


@query("logistic_coefficients", "ML16")
def logistic_coefficients(spark, sf_dir):
    models, _ = regression(spark, sf_dir, {"final": SG.Regression(l1_ratio=0.05)}, 2000)
    return models["final"].coefficients(spark)


def final_trees(spark, sf_dir, candidates):
    """Bins, trees of all candidates fitted on the years before the test year, and the coded test rows."""
    bins, rows = coded(spark, sf_dir, 2000)
    return bins, boosting.fit(rows.where("year <= 2000"), bins, candidates), rows.where("year = 2001")


@query("boosted_trees", "ML8")
def boosted_trees(spark, sf_dir):
    bins, model, test = final_trees(spark, sf_dir, {"boosted_trees": boosting.Trees(FINAL_ROUNDS)})
    scored = boosting.score(test.select("label", "codes"), boosting.load(model, bins), {"boosted_trees": "boosted_trees"})
    return _metrics_of(materialize(scored, "scored"), ["boosted_trees"])


@query("tree_importance", "ML16")
def tree_importance(spark, sf_dir):
    bins, model, _ = final_trees(spark, sf_dir, {"boosted_trees": boosting.Trees(FINAL_ROUNDS)})
    return boosting.importance(model, bins).drop("candidate").orderBy(F.desc("importance"), "feature")


@query("training_loss", "ML8")
def training_loss(spark, sf_dir):
    """Log loss on the fit rows before every round."""
    _, model, _ = final_trees(spark, sf_dir, {"boosted_trees": boosting.Trees(FINAL_ROUNDS)})
    return boosting.losses(model).drop("candidate").orderBy("tree")


def additive(spark, sf_dir, candidates, interactions, until=2000):
    """Bins, additive models of all candidates fitted on years up to ``until``, and all coded rows."""
    bins, rows = coded(spark, sf_dir, until)
    return AD.fit(rows.where(F.col("year") <= until), bins, candidates, interactions), rows


def final_additive(spark, sf_dir):
    models, rows = additive(spark, sf_dir, {"additive": AD.Additive()}, {"additive": PAIRS})
    return models["additive"], rows


def _probability(margin):
    return 1.0 / (1.0 + F.exp(-F.col(margin)))


@query("additive_model", "ML9 SNK7")
def additive_model(spark, sf_dir):
    """Test metrics of the fitted model after storing it as tables and loading it."""
    model, rows = final_additive(spark, sf_dir)
    path = f"{scratch_dir(spark)}/additive-{uuid.uuid4().hex}"
    model.save(spark, path)
    test = AD.AdditiveModel.load(spark, path).margin_of_codes(rows.where("year = 2001"), "_margin")
    return _metrics_of(materialize(test.select("label", _probability("_margin").alias("additive")), "scored"), ["additive"])


@query("additive_importance", "ML16 EX1 SCL15")
def additive_importance(spark, sf_dir):
    model, _ = final_additive(spark, sf_dir)
    table = model.importance(T.split(spark, sf_dir)["test"])
    return table.withColumn("display_term", V.display_name(F.col("term"), DISPLAY)).orderBy(F.desc("importance"), "term")


@query("additive_curves", "EX1 EX7")
def additive_curves(spark, sf_dir):
    """Response curves of all numbers with more than two bins, each with its monotone fit."""
    model, _ = final_additive(spark, sf_dir)
    curves = [model.curve(spark, f) for f in NUMBERS if len(model.bins.edges[f]) > 2]
    stacked = curves[0]
    for curve in curves[1:]:
        stacked = stacked.unionByName(curve)
    return X.monotone_fit(stacked.withColumnsRenamed({"term": "feature", "score": "effect"}))


def severity_scores(spark, sf_dir, thresholds):
    """Test rows with the probability of reaching each threshold, one model each, and the names of these columns."""
    candidates = {str(t): AD.Additive(label=_LATE[t]) for t in thresholds}
    models, rows = additive(spark, sf_dir, candidates, {c: PAIRS for c in candidates}, 1999)
    scored, columns = rows.where("year = 2001"), {t: f"p_delay_ge_{t}" for t in thresholds}
    for t, c in columns.items():
        scored = models[str(t)].margin_of_codes(scored, f"_m{t}").withColumn(c, _probability(f"_m{t}"))
    return materialize(scored.drop("codes", *[f"_m{t}" for t in thresholds]), "severity"), columns


@query("severity_models", "ML10 SCL17")
def severity_models(spark, sf_dir):
    """Raw and coherent severity probabilities of every test row."""
    scored, columns = severity_scores(spark, sf_dir, SEVERITY_MINUTES)
    coherent = X.running_minimum(list(columns.values()))
    return scored.select("row_key", F.col("ArrDelay").alias("actual_delay_minutes"), *columns.values(), *[
        low.alias(f"{c}_coherent") for c, low in zip(columns.values(), coherent)
    ])


@query("severity_metrics", "ML10")
def severity_metrics(spark, sf_dir):
    """Metrics of each threshold's model over all test rows."""
    scored, columns = severity_scores(spark, sf_dir, SEVERITY_MINUTES)
    lines = F.array(*[
        F.struct(F.lit(t).alias("delay_threshold_minutes"), F.col(_LATE[t]).alias("label"), F.col(c).alias("score")) for t, c in columns.items()
    ])
    return M.evaluate(scored.select(F.inline(lines)), ["delay_threshold_minutes"])


@query("severity_example", "ML10 SCL17 EX8")
def severity_example(spark, sf_dir):
    """Severity probabilities of the flight nearest to a risk of 0.5, raw and coherent."""
    stored, columns = severity_scores(spark, sf_dir, (15, *SEVERITY_MINUTES))
    example = X.nearest_row(stored, F.col("label") == 1, F.col("p_delay_ge_15"), 0.5, "row_key")
    return X.severity_profile(example, columns, ["origin_airport", "destination_airport", "scheduled_departure_hour"])


def _named(family, params):
    return f"{family} " + " ".join(f"{k}={v}" for k, v in params.items())


@query("grid_search", "ML11 TK5 EV9")
def grid_search(spark, sf_dir):
    """The best candidate of each family by average precision on the validation year."""
    T.enriched(spark, sf_dir)  # stored before several parts ask for it
    (bins, rows), (levels, complete) = at_once(spark, lambda: coded(spark, sf_dir), lambda: prepared(spark, sf_dir))
    fit, valid = rows.where("year <= 1999"), rows.where("year = 2000")

    def lines(scored, names):
        columns = {c: f"c{k}" for k, c in enumerate(names)}
        return M.model_scores(materialize(scored.select("label", *columns.values()), "scored"), "label", columns)

    def by_trees():
        trees = {_named("trees", p): boosting.Trees(GRID_ROUNDS, **p) for p in TREE_GRID}
        model = boosting.load(boosting.fit(fit, bins, trees), bins)
        return lines(boosting.score(valid.select("label", "codes"), model, {c: f"c{k}" for k, c in enumerate(trees)}), trees)

    def by_terms():
        terms = {f"additive pairs={n} " + _named("", p).strip(): (n, AD.Additive(**p)) for n, p in ADDITIVE_GRID}
        models = AD.fit(fit, bins, {c: p for c, (_, p) in terms.items()}, {c: n for c, (n, _) in terms.items()})
        scored = valid
        for k, c in enumerate(terms):
            scored = models[c].margin_of_codes(scored, f"_m{k}").withColumn(f"c{k}", _probability(f"_m{k}"))
        return lines(scored, terms)

    def by_regression():
        grid = {_named("logistic", p): SG.Regression(epochs=80, patience=5, **p) for p in LOGISTIC_GRID}
        models, scored = SG.fit(complete.where("year <= 1999"), levels, [*NUMBERS, *FLAGS], grid), complete.where("year = 2000")
        for k, c in enumerate(grid):
            scored = models[c].score(scored, f"c{k}")
        return lines(scored, grid)

    trees, terms, regressions = at_once(spark, by_trees, by_terms, by_regression)
    metrics = M.evaluate(trees.unionByName(terms).unionByName(regressions))
    return ML.best_by_group(metrics, F.split("model", " ")[0])


@query("block_ablation", "ML12 AS11")
def block_ablation(spark, sf_dir):
    """Every optional feature block screened by trees without it: gains on the validation year and a paired interval."""
    bins, rows = coded(spark, sf_dir)
    optional = [g for g in FEATURE_GROUPS if g not in REQUIRED_GROUPS]
    candidates = {"full": boosting.Trees(SCREEN_ROUNDS)} | {g: boosting.Trees(SCREEN_ROUNDS, without=tuple(FEATURE_GROUPS[g])) for g in optional}
    model = boosting.fit(rows.where("year <= 1999"), bins, candidates)
    valid = rows.where("year = 2000").select("label", "codes")
    scored = materialize(boosting.score(valid, boosting.load(model, bins), {c: c for c in candidates}), "scored")
    return screening_table(scored, "full", optional, list(REQUIRED_GROUPS))


def screening_table(scored, full, optional, required):
    """Gains of a full model over models without a block, from one table with a score column for each."""
    decided = M.block_decisions(M.evaluate(M.model_scores(scored, "label", [full, *optional])), full, SCREEN_THRESHOLD_AP, ())
    lines = F.array(*[F.struct(F.lit(g).alias("_group"), F.col(f"`{g}`").alias("_without")) for g in optional])
    gains = M.paired_gain(scored.select("label", F.col(full).alias("_full"), F.inline(lines)), "label", "_full", "_without", ["_group"])
    table = decided.join(F.broadcast(gains), F.col("feature_group") == F.col("_group")).select(  # one row per block
        "feature_group", "validation_ap_without_group", "validation_ap_gain", "validation_auc_gain",
        F.col("log_loss_gain").alias("paired_log_loss_gain"), F.col("ci_low").alias("loss_gain_ci_low"), F.col("ci_high").alias("loss_gain_ci_high"),
        "included", "decision",
    )
    kept = [(g, *[None] * 6, True, "Required task definition") for g in required]
    return table.unionByName(scored.sparkSession.createDataFrame(kept, table.schema))


@query("permutation_significance", "AS10 AS11")
def permutation_significance(spark, sf_dir):
    """Extra log loss of the screening trees when one history or network column is shuffled over the validation year."""
    bins, rows = coded(spark, sf_dir)
    model = boosting.load(boosting.fit(rows.where("year <= 1999"), bins, {"full": boosting.Trees(SCREEN_ROUNDS)}), bins)
    features = [*FEATURE_GROUPS["Lagged network centrality"], *FEATURE_GROUPS["Recent delay propagation"]]
    valid = rows.where("year = 2000").select("row_key", "label", "codes")
    swapped = sampling.exchange(valid, ["codes"], "row_key", 42)
    scored = materialize(boosting.score_exchanged(swapped, model, "full", bins, features).drop("row_key"), "scored")
    lines = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"permuted_{f}").alias("_permuted")) for f in features])
    gains = M.paired_gain(scored.select("label", "baseline", F.inline(lines)), "label", "baseline", "_permuted", ["feature"])
    return gains.select(
        "feature", V.display_name(F.col("feature"), DISPLAY).alias("display_name"), F.col("log_loss_gain").alias("permutation_log_loss_gain"),
        F.col("ci_low").alias("loss_gain_ci_low"), F.col("ci_high").alias("loss_gain_ci_high"), "statistically_detectable",
    )


# Congestion columns and the airport they are shuffled within.
CONDITIONED = {"origin_hourly_scheduled_flights": "origin_airport", "destination_daily_scheduled_flights": "destination_airport"}


@query("conditional_audit", "AS9 EV2 SCL14")
def conditional_audit(spark, sf_dir):
    """What the additive model loses when a congestion column is shuffled among the test flights of its airport."""
    model, rows = final_additive(spark, sf_dir)
    test = rows.where("year = 2001").select("row_key", "label", "codes", *CONDITIONED.values())
    scored = model.margin_of_codes(test, "_m").select("label", F.lit("baseline").alias("model"), _probability("_m").alias("score"))
    for feature, within in CONDITIONED.items():
        swapped = sampling.exchange(test, ["codes"], "row_key", 808, [within])
        place = bins_place(model.bins, feature)
        mixed = F.transform("codes", lambda c, k: F.when(k == place, F.get("given_codes", F.lit(place))).otherwise(c))
        part = model.margin_of_codes(swapped.withColumn("codes", mixed), "_m").select("label", F.lit(feature).alias("model"), _probability("_m").alias("score"))
        scored = scored.unionByName(part)
    table = materialize(M.evaluate(materialize(scored, "scored")), "metrics")
    base = table.where("model = 'baseline'").select(F.struct("average_precision", "log_loss")).scalar()
    within = F.create_map(*[F.lit(x) for kv in CONDITIONED.items() for x in kv])
    drop = base.getField("average_precision") - F.col("average_precision")
    return table.where("model <> 'baseline'").select(
        F.col("model").alias("feature"), within[F.col("model")].alias("conditioned_within"),
        base.getField("average_precision").alias("baseline_average_precision"),
        F.col("average_precision").alias("conditional_permutation_average_precision"),
        (drop * 10_000).alias("average_precision_drop_basis_points"), (F.col("log_loss") - base.getField("log_loss")).alias("log_loss_increase"),
        M.permutation_verdict(base.getField("average_precision"), F.col("average_precision"), PERMUTATION_VERDICT_AP).alias("interpretation"),
    )


def bins_place(bins, feature):
    return bins.features.index(feature)


@query("seed_ensemble", "ML15 EV9 AS11")
def seed_ensemble(spark, sf_dir):
    """Log-loss gain of the three-seed mean over a single seed; all seeds are fitted at once."""
    seeds = {f"seed_{s}": boosting.Trees(FINAL_ROUNDS, seed=s) for s in (42, 43, 44)}
    bins, model, test = final_trees(spark, sf_dir, seeds)
    scored = boosting.score(test.select("label", "codes"), boosting.load(model, bins), {c: c for c in seeds})
    stored = materialize(scored.select("label", F.col("seed_42").alias("single"), (sum(F.col(c) for c in seeds) / len(seeds)).alias("mean")), "ensemble")
    return M.paired_gain(stored, "label", "mean", "single")


# --- searches that SQL can repeat ----------------------------------------------------------

_SEARCHED = ["Origin", "departure_hour", "CRSElapsedTime"]


@query(
    "root_split", "ML8",
    sql_with(RAW_SQL, """fit AS (
      SELECT "Origin", departure_hour, "CRSElapsedTime" AS duration, "ArrDel15" AS y, avg("ArrDel15") OVER () AS p FROM flights WHERE primary_eligible = 1 AND "year" <= 1999
    ), rows_ AS (SELECT *, p - y AS g, p * (1 - p) AS h FROM fit
    ), whole AS (SELECT sum(g) AS tg, sum(h) AS th FROM rows_
    ), bins AS (
      SELECT 'Origin' AS feature, "Origin" AS level, CAST(NULL AS DOUBLE) AS value, sum(g) AS g, sum(h) AS h FROM rows_ GROUP BY ALL
      UNION ALL SELECT 'departure_hour', NULL, CAST(departure_hour AS DOUBLE), sum(g), sum(h) FROM rows_ GROUP BY ALL
      UNION ALL SELECT 'CRSElapsedTime', NULL, CAST(duration AS DOUBLE), sum(g), sum(h) FROM rows_ GROUP BY ALL
    ), missing AS (SELECT feature, sum(g) AS mg, sum(h) AS mh FROM bins WHERE feature <> 'Origin' AND value IS NULL GROUP BY feature
    ), lefts AS (
      SELECT feature, level, CAST(NULL AS DOUBLE) AS below, false AS missing_left, g, h FROM bins WHERE feature = 'Origin'
      UNION ALL
      SELECT feature, NULL, lead(value) OVER w, false, sum(g) OVER (w ROWS UNBOUNDED PRECEDING), sum(h) OVER (w ROWS UNBOUNDED PRECEDING)
      FROM bins WHERE feature <> 'Origin' AND value IS NOT NULL WINDOW w AS (PARTITION BY feature ORDER BY value)
    ), sides AS (
      SELECT * FROM lefts UNION ALL
      SELECT l.feature, level, below, true, g + mg, h + mh FROM lefts l JOIN missing m ON l.feature = m.feature WHERE l.below IS NOT NULL
    ), gains AS (
      SELECT feature, coalesce(level, CASE WHEN below IS NULL THEN 'present' ELSE 'below ' || CAST(below AS VARCHAR) END) AS split, missing_left,
             round((g * g / (h + 2) + (tg - g) * (tg - g) / (th - h + 2) - tg * tg / (th + 2)) / 2, 6) AS gain
      FROM sides, whole WHERE h >= 10 AND th - h >= 10
    )""", body="SELECT feature, max(gain) AS best_gain, arg_max(split, gain) AS split FROM gains GROUP BY feature"),
)
def root_split(spark, sf_dir):
    """The best first split of each of three features, from the histogram that trees are grown on."""
    fit = eligible_flights(spark, sf_dir, "row_key", "year", "ArrDel15", *_SEARCHED).where("year <= 1999")
    fit = materialize(fit.withColumns({"departure_hour": F.col("departure_hour").cast("double"), "p": F.lit(fit.agg(F.avg("ArrDel15")).first()[0])}), "fit")
    bins = binning.fit_bins(fit, ["Origin"], ["departure_hour", "CRSElapsedTime"], min_rows=1)
    coded = bins.encode(fit.withColumns({"g": F.col("p") - F.col("ArrDel15"), "h": F.col("p") * (1 - F.col("p"))}), ["g", "h"])
    layout = boosting.Layout(bins.widths(), 1)
    g, h = np.zeros((1, layout.places)), np.zeros((1, layout.places))
    for r in binning.sum_by_code(coded, _SEARCHED, ["g", "h"]).collect():  # one row per bin
        at = layout.starts[_SEARCHED.index(r["feature"])] + r["code"]
        g[0, at], h[0, at] = r["g"], r["h"]
    rows = []
    for k, f in enumerate(_SEARCHED):
        own = layout.feature == k
        place, _, gain, _, _ = boosting.best_splits(g, h, g[:, own].sum(1), h[:, own].sum(1), layout, np.arange(len(_SEARCHED)) == k, 10.0, 2.0)
        code = int(layout.code[place[0]])
        edges = bins.edges.get(f, [])
        split = bins.names[f][code - 1] if f in bins.names else "present" if code > len(edges) else f"below {edges[code - 1]}"
        rows.append((f, round(float(gain[0]), 6), split))
    return spark.createDataFrame(rows, "feature string, best_gain double, split string")


_PAIRED = {"departure_hour": 24, "month": 13, "day_of_week": 7, "disc": 11}


@query(
    "pair_ranking", "ML9",
    sql_with(RAW_SQL, """rows_ AS (
      SELECT departure_hour, "month", day_of_week, disc, score_a - "ArrDel15" AS g, score_a * (1 - score_a) AS h FROM flights WHERE primary_eligible = 1
    ), cells AS (""" + " UNION ALL ".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, "{a}" AS i, "{b}" AS j, sum(g) AS g, sum(h) AS h FROM rows_ GROUP BY ALL"""
        for a, b in combinations(_PAIRED, 2)) + """
    ), parts AS (
      SELECT a, b, sum(g * g / (h + 1)) AS s FROM cells GROUP BY a, b
      UNION ALL SELECT a, b, -sum(g * g / (h + 1)) FROM (SELECT a, b, i, sum(g) AS g, sum(h) AS h FROM cells GROUP BY a, b, i) GROUP BY a, b
      UNION ALL SELECT a, b, -sum(g * g / (h + 1)) FROM (SELECT a, b, j, sum(g) AS g, sum(h) AS h FROM cells GROUP BY a, b, j) GROUP BY a, b
      UNION ALL SELECT a, b, sum(g * g / (h + 1)) FROM (SELECT a, b, sum(g) AS g, sum(h) AS h FROM cells GROUP BY a, b) GROUP BY a, b
    )""", body="SELECT a, b, round(sum(s) / 2, 6) AS gain FROM parts GROUP BY a, b"),
)
def pair_ranking(spark, sf_dir):
    """Loss that each pair of four columns could remove from a given score, beyond both columns alone."""
    rows = eligible_flights(spark, sf_dir, "score_a", "ArrDel15", *_PAIRED)
    p = F.col("score_a")
    coded = rows.select(F.array(*[F.col(c).cast("smallint") for c in _PAIRED]).alias("codes"), (p - F.col("ArrDel15")).alias("g"), (p * (1 - p)).alias("h"))
    gains = AD.pair_gains(coded, list(_PAIRED), [np.arange(n) for n in _PAIRED.values()])
    return gains.withColumn("gain", F.round("gain", 6))


# --- decisions and catalogue --------------------------------------------------------------

# Scores with one component left out stand for refits without a feature block.
_LEFT_OUT = {"disc": "8 * disc", "hour": "24 * (CASE WHEN departure_hour >= 15 THEN 1 ELSE 0 END)", "noise": "1 * (disc % 2)"}
BLOCKS_SQL = """scored AS (SELECT 'full' AS model, CAST("ArrDel15" AS INTEGER) AS label, score_a AS score FROM flights WHERE primary_eligible = 1""" + "".join(
    f""" UNION ALL SELECT '{n}', CAST("ArrDel15" AS INTEGER), (round(400 * score_a) - {e}) / 400 FROM flights WHERE primary_eligible = 1""" for n, e in _LEFT_OUT.items()) + ")"


def block_metrics(spark, sf_dir):
    df = eligible_flights(spark, sf_dir, "ArrDel15", "score_a", "disc", "departure_hour").withColumnRenamed("score_a", "full")
    df = df.withColumns({n: (F.round(F.col("full") * 400) - F.expr(e)) / 400 for n, e in _LEFT_OUT.items()})
    return _rounded(M.evaluate(M.model_scores(df, "ArrDel15", ["full", *_LEFT_OUT])), "average_precision", "roc_auc")


def decisions(spark, sf_dir):
    out = M.block_decisions(block_metrics(spark, sf_dir), "full", SCREEN_THRESHOLD_AP, ["hour"])
    return out.withColumns({c: F.round(c, 5) for c in ("validation_ap_gain", "validation_auc_gain")})


DECISIONS_SQL = """decisions AS (
  SELECT e.model AS feature_group, e.average_precision AS validation_ap_without_group, round(f.average_precision - e.average_precision, 5) AS validation_ap_gain,
         round(f.roc_auc - e.roc_auc, 5) AS validation_auc_gain, e.model = 'hour' OR f.average_precision - e.average_precision >= 0.001 AS included,
         CASE WHEN e.model = 'hour' THEN 'Required task definition' WHEN f.average_precision - e.average_precision >= 0.001 THEN 'Included'
           ELSE 'Excluded: no material validation lift' END AS decision
  FROM evaluated e, evaluated f WHERE f.model = 'full' AND e.model <> 'full'
)"""
_DECISION_PARTS = (RAW_SQL, BLOCKS_SQL, metrics_sql("scored"), DECISIONS_SQL)


@query("block_decisions", "ML12 SCL14", sql_with(*_DECISION_PARTS, body="SELECT * FROM decisions"))
def block_decisions(spark, sf_dir):
    return decisions(spark, sf_dir)


# Which screened block decides about which feature group.
_SCREENED = {"Scheduled congestion": "noise", "Recent delay propagation": "disc", "Schedule timing": "hour"}


def catalog_rows():
    """(feature, name, group, source, screened block, fixed decision) of every known feature."""
    rows = [(f, DISPLAY[f], g, GROUP_SOURCE.get(g, DEFAULT_SOURCE), _SCREENED.get(g), None) for g, fs in FEATURE_GROUPS.items() for f in fs]
    return rows + [(f, n, g, "Candidate / derived", None, d) for f, g, n, d in EXCLUDED_FEATURES]


_q = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"


@query(
    "feature_catalog", "ML13 ST1",
    sql_with(*_DECISION_PARTS, "known AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_q(v) for v in r) + ")" for r in catalog_rows())
             + ") k(feature, display_name, feature_group, source, block, fixed))",
             body="""SELECT k.feature, k.display_name, k.feature_group, k.source, d.validation_ap_gain AS validation_ap_gain_for_group,
      fixed IS NULL AND coalesce(d.included, true) AS included, coalesce(fixed, d.decision, 'Included') AS decision
      FROM known k LEFT JOIN decisions d ON k.block = d.feature_group"""),
)
def feature_catalog(spark, sf_dir):
    schema = "feature string, display_name string, feature_group string, source string, block string, fixed string"
    known = spark.createDataFrame(catalog_rows(), schema)
    screened = decisions(spark, sf_dir).select(F.col("feature_group").alias("_block"), "validation_ap_gain", F.col("included").alias("_in"), F.col("decision").alias("_why"))
    joined = known.join(screened, F.col("block") == F.col("_block"), "left")
    return joined.select(
        "feature", "display_name", "feature_group", "source", F.col("validation_ap_gain").alias("validation_ap_gain_for_group"),
        (F.col("fixed").isNull() & F.coalesce("_in", F.lit(True))).alias("included"),
        F.coalesce("fixed", "_why", F.lit("Included")).alias("decision"),
    )


# --- explanations ------------------------------------------------------------------------

_TERMS = {"Origin": '"Origin"', "Dest": '"Dest"', "Reporting_Airline": '"Reporting_Airline"', "scheduled_departure_hour": "departure_hour",
          "disc": "disc", "day_of_week": "day_of_week", "scheduled_duration_minutes": 'CAST("CRSElapsedTime" AS BIGINT)'}


def _term_columns():
    columns = {t: F.col(t) for t in ("Origin", "Dest", "Reporting_Airline", "disc", "day_of_week")}
    return columns | {"scheduled_departure_hour": F.col("departure_hour"), "scheduled_duration_minutes": F.col("CRSElapsedTime").cast("bigint")}


EFFECTS_SQL = """base AS (SELECT ln(sum("ArrDel15") / (count(*) - sum("ArrDel15"))) AS b, avg("ArrDel15") AS rate FROM flights WHERE primary_eligible = 1
), effects AS (""" + " UNION ALL ".join(
    f"""SELECT '{t}' AS term, CAST({x} AS VARCHAR) AS level, count(*) AS "rows", ln((sum("ArrDel15") + 1) / (count(*) - sum("ArrDel15") + 1)) - (SELECT b FROM base) AS score
    FROM flights WHERE primary_eligible = 1 AND {x} IS NOT NULL GROUP BY ALL""" for t, x in _TERMS.items()) + ")"
CURVES_SQL = """curves AS (SELECT term AS feature, CAST(level AS DOUBLE) AS x, score AS effect FROM effects
  WHERE term IN ('scheduled_departure_hour', 'disc', 'day_of_week', 'scheduled_duration_minutes'))"""


def explained(spark, sf_dir, *more):
    return eligible_flights(spark, sf_dir, "Origin", "Dest", "Reporting_Airline", "departure_hour", "disc", "day_of_week", "CRSElapsedTime", "ArrDel15", *more)


def effects_table(spark, sf_dir, flights=None):
    df = explained(spark, sf_dir) if flights is None else flights
    return materialize(X.level_effects(df, "ArrDel15", _term_columns()), "effects")


def base_rate(spark, sf_dir):
    return eligible_flights(spark, sf_dir, "ArrDel15").agg(F.avg("ArrDel15")).scalar()


@query("response_curves", "EX1", sql_with(RAW_SQL, EFFECTS_SQL, CURVES_SQL, body="SELECT feature, x, round(effect, 6) AS effect FROM curves"))
def response_curves(spark, sf_dir):
    return _rounded(X.response_curve(effects_table(spark, sf_dir)), "effect")


@query(
    "risk_points", "EX2 SCL11",
    sql_with(RAW_SQL, EFFECTS_SQL, body="""SELECT term, level, round(100 * (1 / (1 + exp(-greatest(least(ln(rate / (1 - rate)) + score, 30), -30))) - rate), 6) AS risk_change_pp
      FROM effects, base"""),
)
def risk_points(spark, sf_dir):
    change = V.risk_points(F.col("score"), base_rate(spark, sf_dir))
    return effects_table(spark, sf_dir).select("term", "level", F.round(change, 6).alias("risk_change_pp"))


@query(
    "riskiest_airports", "EX3 JN10 TK2 WN7",
    sql_with(RAW_SQL, EFFECTS_SQL, body="""SELECT term, CAST(rank AS INTEGER) AS rank, level, "rows" AS sample_flights,
      round(100 * (1 / (1 + exp(-greatest(least(ln(rate / (1 - rate)) + score, 30), -30))) - rate), 6) AS risk_change_at_baseline_pp FROM (
        SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, level) AS rank FROM effects WHERE term IN ('Origin', 'Dest') AND "rows" >= 150), base WHERE rank <= 10"""),
)
def riskiest_airports(spark, sf_dir):
    # Effects and their counts come from one stored aggregate of the flights.
    effects = materialize(effects_table(spark, sf_dir).where(F.col("term").isin("Origin", "Dest")), "effects")
    counts = effects.select("term", "level", "rows")
    counted = joins.lookup_join(effects.drop("rows"), counts, {"term": "term", "level": "level"}, validate=False)
    return _rounded(X.category_risk(counted, base_rate(spark, sf_dir), 150), "risk_change_at_baseline_pp")


_bands = " ".join(f"WHEN d >= {e} THEN '{n}'" for e, n in reversed(list(zip(DURATION_EDGES, DURATION_LABELS))))


@query(
    "duration_risk", "EX4 AG17 SCL9",
    sql_with(RAW_SQL, EFFECTS_SQL, body=f"""SELECT CASE {_bands} END AS duration_band_minutes, count(*) AS sample_flights, round(avg(pp), 6) AS mean_risk_change_percentage_points FROM (
      SELECT "CRSElapsedTime" AS d, 100 * (1 / (1 + exp(-(ln(rate / (1 - rate)) + score))) - rate) AS pp FROM flights
      JOIN effects ON term = 'scheduled_duration_minutes' AND level = CAST(CAST("CRSElapsedTime" AS BIGINT) AS VARCHAR), base WHERE primary_eligible = 1) GROUP BY 1"""),
)
def duration_risk(spark, sf_dir):
    effects = effects_table(spark, sf_dir).where("term = 'scheduled_duration_minutes'").select("level", "score")
    df = eligible_flights(spark, sf_dir, "CRSElapsedTime").withColumn("level", F.col("CRSElapsedTime").cast("bigint").cast("string"))
    rows = df.join(effects, "level").select(
        V.band(F.col("CRSElapsedTime"), DURATION_EDGES, DURATION_LABELS).alias("duration_band_minutes"),
        V.risk_points(F.col("score"), base_rate(spark, sf_dir)).alias("pp"),
    )
    return _rounded(R.band_summary(rows, "duration_band_minutes", "pp"), "mean_risk_change_percentage_points")


_EXAMPLE_COLUMNS = ("row_key", "score_a", "Cancelled", "Diverted")


def example_flight(spark, sf_dir, flights=None):
    """A delayed flight of high risk without diversion or cancellation flags, nearest to 0.72."""
    df = explained(spark, sf_dir, *_EXAMPLE_COLUMNS) if flights is None else flights
    candidate = (F.col("ArrDel15") == 1) & F.col("score_a").between(0.45, 0.78) & (V.sum_of_flags(["Cancelled", "Diverted"]) == 0) & (F.col("disc") > 3)
    return X.nearest_row(df, candidate, F.col("score_a"), 0.72, "row_key")


EXAMPLE_SQL = """example AS (SELECT * FROM flights WHERE primary_eligible = 1 ORDER BY ("ArrDel15" = 1 AND score_a BETWEEN 0.45 AND 0.78
  AND "Cancelled" + "Diverted" = 0 AND disc > 3) DESC, abs(score_a - 0.72), row_key LIMIT 1)"""


@query("example_flight", "TK4 FLT7 SCL18", sql_with(RAW_SQL, EXAMPLE_SQL, body='SELECT row_key, "Origin", "Dest", score_a, disc FROM example'))
def example_flight_query(spark, sf_dir):
    return example_flight(spark, sf_dir).select("row_key", "Origin", "Dest", "score_a", "disc")


CONTRIBUTIONS_SQL = "contributions AS (" + " UNION ALL ".join(
    f"SELECT row_key, '{t}' AS term, score AS contribution FROM example JOIN effects ON term = '{t}' AND level = CAST({x} AS VARCHAR)" for t, x in _TERMS.items()) + ")"
WATERFALL_SQL = """placed AS (SELECT *, row_number() OVER (ORDER BY abs(contribution) DESC, term) AS place FROM contributions
), steps AS (
  SELECT row_key, 0 AS step, 'intercept' AS term, b AS contribution FROM example, base
  UNION ALL SELECT row_key, place, term, contribution FROM placed WHERE place <= 4
  UNION ALL SELECT row_key, 5, 'other_terms', sum(contribution) FROM placed WHERE place > 4 GROUP BY row_key
), summed AS (SELECT *, 1 / (1 + exp(-sum(contribution) OVER (ORDER BY step))) AS p FROM steps)"""


@query(
    "risk_waterfall", "EX5 TK3 WN8",
    sql_with(RAW_SQL, EFFECTS_SQL, EXAMPLE_SQL, CONTRIBUTIONS_SQL, WATERFALL_SQL, body="""SELECT row_key, CAST(step AS INTEGER) AS step, term, round(contribution, 6) AS contribution,
      round(coalesce(lag(p) OVER (ORDER BY step), 0), 6) AS start_probability, round(p, 6) AS end_probability,
      round(100 * (p - coalesce(lag(p) OVER (ORDER BY step), 0)), 6) AS change_percentage_points, round(last_value(p) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS final_probability FROM summed"""),
)
def risk_waterfall(spark, sf_dir):
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), c.cast("string").alias("level")) for t, c in _term_columns().items()])
    # The example and the effects read the same rows, joined and stored once.
    flights = materialize(explained(spark, sf_dir, *_EXAMPLE_COLUMNS), "explained")
    example = materialize(example_flight(spark, sf_dir, flights), "example").select("row_key", F.inline(pairs))
    contributions = example.join(effects_table(spark, sf_dir, flights), ["term", "level"]).select("row_key", "term", F.col("score").alias("contribution"))
    out = X.waterfall(contributions, V.logit(base_rate(spark, sf_dir)), top=4)
    return _rounded(out, "contribution", "start_probability", "end_probability", "change_percentage_points", "final_probability")


_advice = " ".join(f"WHEN '{f}' THEN {_q(a)}" for f, a in SHAPE_ADVICE.items())


_SHAPE_PARTS = (RAW_SQL, EFFECTS_SQL, CURVES_SQL, """steps AS (
      SELECT *, effect - lag(effect) OVER w AS d1, max(effect) OVER (PARTITION BY feature) - min(effect) OVER (PARTITION BY feature) AS span,
        rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY feature ORDER BY effect) + (count(*) OVER (PARTITION BY feature, effect) - 1) / 2.0 AS ry FROM curves WINDOW w AS (PARTITION BY feature ORDER BY x)
    ), turns AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY feature ORDER BY x) AS d2 FROM steps
    ), material AS (SELECT feature, sign(d1) AS s, lag(sign(d1)) OVER (PARTITION BY feature ORDER BY x) AS before FROM steps WHERE abs(d1) > greatest(span * 0.005, 1e-5))""")
_SHAPE_BODY = f"""SELECT t.feature, count(*) AS bins_or_levels, round(sum(abs(d2)) / greatest(sum(abs(d1)), 1e-9), 6) AS roughness_ratio,
      (SELECT count(*) FROM material m WHERE m.feature = t.feature AND s <> before) AS direction_reversals, round(corr(rx, ry), 6) AS spearman_x_to_effect,
      CASE t.feature {_advice} ELSE {_q(DEFAULT_SHAPE_ADVICE)} END AS production_recommendation FROM turns t GROUP BY t.feature"""


@query("shape_review", "EX6 WN9", sql_with(*_SHAPE_PARTS, body=_SHAPE_BODY))
def shape_review(spark, sf_dir):
    curves = X.response_curve(effects_table(spark, sf_dir))
    return _rounded(X.shape_review(curves), "roughness_ratio", "spearman_x_to_effect")


@query(
    "reported_shapes", "FLT9 TK1",
    sql_with(*_SHAPE_PARTS, body=f"SELECT * FROM ({_SHAPE_BODY}) WHERE feature NOT IN ('airline', 'scheduled_departure_hour') AND roughness_ratio IS NOT NULL"),
)
def reported_shapes(spark, sf_dir):
    table = shape_review(spark, sf_dir)
    return table.where(~F.col("feature").isin("airline", "scheduled_departure_hour") & F.col("roughness_ratio").isNotNull())


_SMOOTH = [-3, 12, 17, 12, -3]
_EDGE = ([31, 9, -3, -5, 3], [9, 13, 12, 6, -5])


def _dot(weights, names) -> str:
    return "(" + " + ".join(f"{w} * {n}" for w, n in zip(weights, names)) + ") / 35.0"


@query(
    "smoothed_curves", "WN10",
    sql_with(RAW_SQL, EFFECTS_SQL, CURVES_SQL, "placed AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY x) AS i, count(*) OVER (PARTITION BY feature) AS n, "
             + ", ".join(f"lag(effect, {k}) OVER w AS b{k}, lead(effect, {k}) OVER w AS a{k}" for k in range(1, 5))
             + " FROM curves WINDOW w AS (PARTITION BY feature ORDER BY x))",
             body=f"""SELECT feature, x, round(effect, 6) AS effect, round(CASE WHEN i = 1 THEN {_dot(_EDGE[0], ['effect', 'a1', 'a2', 'a3', 'a4'])}
      WHEN i = 2 THEN {_dot(_EDGE[1], ['b1', 'effect', 'a1', 'a2', 'a3'])} WHEN i = n THEN {_dot(_EDGE[0], ['effect', 'b1', 'b2', 'b3', 'b4'])}
      WHEN i = n - 1 THEN {_dot(_EDGE[1], ['a1', 'effect', 'b1', 'b2', 'b3'])} ELSE {_dot(_SMOOTH, ['b2', 'b1', 'effect', 'a1', 'a2'])} END, 6) AS smoothed FROM placed"""),
)
def smoothed_curves(spark, sf_dir):
    return _rounded(X.smooth(X.response_curve(effects_table(spark, sf_dir)), 5), "effect", "smoothed")


@query(
    "severity_profile", "EX8 SCL17",
    sql_with(RAW_SQL, EXAMPLE_SQL, """raw AS (SELECT "Origin" AS origin_airport, "Dest" AS destination_airport, departure_hour AS scheduled_departure_hour,
      unnest([15, 30, 60, 120]) AS delay_threshold_minutes, unnest([score_a, score_b, score_a / 2, score_a * 0.75]) AS raw_probability FROM example)""",
             body="SELECT *, min(raw_probability) OVER (ORDER BY delay_threshold_minutes) AS coherent_probability FROM raw"),
)
def severity_profile(spark, sf_dir):
    df = eligible_flights(spark, sf_dir, "row_key", "Origin", "Dest", "departure_hour", "score_a", "score_b", "ArrDel15", "disc", "Cancelled", "Diverted")
    candidate = (F.col("ArrDel15") == 1) & F.col("score_a").between(0.45, 0.78) & (V.sum_of_flags(["Cancelled", "Diverted"]) == 0) & (F.col("disc") > 3)
    example = X.nearest_row(df, candidate, F.col("score_a"), 0.72, "row_key").select(
        F.col("Origin").alias("origin_airport"), F.col("Dest").alias("destination_airport"), F.col("departure_hour").alias("scheduled_departure_hour"),
        F.col("score_a").alias("p15"), F.col("score_b").alias("p30"), (F.col("score_a") / 2).alias("p60"), (F.col("score_a") * 0.75).alias("p120"),
    )
    keep = ["origin_airport", "destination_airport", "scheduled_departure_hour"]
    return X.severity_profile(example, {15: "p15", 30: "p30", 60: "p60", 120: "p120"}, keep)
