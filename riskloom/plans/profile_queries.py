"""Registered queries: profiles, audits, sampling, association, evaluation, reading and writing."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from riskloom.catalog import AIRLINES, CATEGORICAL, DISPLAY, HISTORY_RATES, PERMUTATION_VERDICT_AP
from riskloom.functions import values as V
from riskloom.operators import association as A, history, joins, metrics as M, profile as R, sampling
from riskloom.plans import binding as B, flights as P
from riskloom.plans.binding import HUBS_SQL, RAW_SQL, labelled_flights, sql_with
from riskloom.plans.feature_queries import TRAILING_SQL, eligible_flights
from riskloom.plans.registry import query
from riskloom.session import materialize, scratch_dir
from riskloom.sources import store

# --- descriptive profiles -----------------------------------------------------------


@query(
    "delay_distribution", "AG1",
    sql_with(RAW_SQL, body="""SELECT count(*) AS eligible_flights, avg("ArrDelay") AS mean_delay_minutes, """
             + ", ".join(f'quantile_cont("ArrDelay", {p}) AS {n}' for n, p in
                         {"p01": 0.01, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}.items())
             + ', max("ArrDelay") AS maximum, ' + ", ".join(f'avg(CASE WHEN "ArrDelay" >= {t} THEN 1 ELSE 0 END) AS delay_ge_{t}' for t in (15, 30, 60, 120))
             + ' FROM flights WHERE primary_eligible = 1 AND "ArrDelay" IS NOT NULL'),
)
def delay_distribution(spark, sf_dir):
    return R.distribution(eligible_flights(spark, sf_dir, "ArrDelay").where("ArrDelay IS NOT NULL"))


@query(
    "delay_histogram", "AG2 SCL8 WN6",
    sql_with(RAW_SQL, body="""SELECT delay_bin, count(*) AS flights, count(*) / sum(count(*)) OVER () AS share FROM (
      SELECT greatest(-60.0, least(300.0, floor("ArrDelay" / 10) * 10)) AS delay_bin FROM flights WHERE primary_eligible = 1 AND "ArrDelay" IS NOT NULL)
      GROUP BY delay_bin"""),
)
def delay_histogram(spark, sf_dir):
    return R.histogram(eligible_flights(spark, sf_dir, "ArrDelay").where("ArrDelay IS NOT NULL"))


_PROFILE_SQL = """SELECT {key}, count(*) AS scheduled_flights, avg("Cancelled") AS cancellation_rate,
  CAST(sum(primary_eligible) AS BIGINT) AS eligible_flights, avg(CASE WHEN primary_eligible = 1 THEN "ArrDel15" END) AS {rate}{more}
  FROM flights GROUP BY ALL HAVING count(*) >= {least}"""
_q = lambda p: f'quantile_cont(CASE WHEN primary_eligible = 1 THEN "ArrDelay" END, {p})'


@query(
    "airline_profile", "AG3 SCL7 TK1",
    sql_with(RAW_SQL, body=_PROFILE_SQL.format(
        key='"Reporting_Airline" AS airline, "Reporting_Airline" AS airline_name', rate="delay_rate", least=200,
        more=f", {_q(0.5)} AS median_delay_minutes, {_q(0.9)} AS p90_delay_minutes")),
)
def airline_profile(spark, sf_dir):
    df = labelled_flights(spark, sf_dir, "Reporting_Airline", "Cancelled", "primary_eligible", "ArrDel15", "ArrDelay")
    out = R.group_profile(
        df, {"airline": F.col("Reporting_Airline")}, 200,
        quantiles={"median_delay_minutes": 0.5, "p90_delay_minutes": 0.9},
    )
    return out.withColumn("airline_name", V.lookup(F.col("airline"), AIRLINES, F.col("airline"))).orderBy(F.desc("delay_rate"))


@query(
    "airport_profile", "AG4 TK1",
    sql_with(RAW_SQL, body=_PROFILE_SQL.format(
        key='"Origin" AS airport', rate="origin_delay_rate", least=200, more=f", {_q(0.9)} AS p90_delay_minutes")),
)
def airport_profile(spark, sf_dir):
    df = labelled_flights(spark, sf_dir, "Origin", "Cancelled", "primary_eligible", "ArrDel15", "ArrDelay")
    out = R.group_profile(df, {"airport": F.col("Origin")}, 200, "origin_delay_rate", {"p90_delay_minutes": 0.9})
    return out.orderBy(F.desc("scheduled_flights"), "airport")


@query(
    "monthly_profile", "AG5 SCL4",
    sql_with(RAW_SQL, body=_PROFILE_SQL.format(
        key="""CAST(date_trunc('month', "FlightDate") AS DATE) AS "month_start" """, rate="delay_rate", least=0,
        more=', avg(CASE WHEN primary_eligible = 1 THEN "ArrDelay" END) AS mean_delay_minutes')),
)
def monthly_profile(spark, sf_dir):
    df = labelled_flights(spark, sf_dir, "FlightDate", "Cancelled", "primary_eligible", "ArrDel15", "ArrDelay")
    return R.group_profile(df, {"month_start": F.trunc("FlightDate", "MM")}, mean_name="mean_delay_minutes")


@query(
    "hourly_profile", "AG6",
    sql_with(RAW_SQL, body="""SELECT departure_hour, count(*) AS eligible_flights, avg("ArrDel15") AS delay_rate, avg("ArrDelay") AS mean_delay_minutes
      FROM flights WHERE primary_eligible = 1 GROUP BY departure_hour"""),
)
def hourly_profile(spark, sf_dir):
    return R.hourly_profile(labelled_flights(spark, sf_dir, "departure_hour", "primary_eligible", "ArrDel15", "ArrDelay"))


@query(
    "yearly_summary", "AG8",
    sql_with(RAW_SQL, body="""SELECT "year", count(*) AS flights, avg(primary_eligible) AS eligible_rate, avg("Cancelled") AS cancellation_rate,
      avg("Diverted") AS diversion_rate, avg(CASE WHEN primary_eligible = 1 THEN "ArrDel15" END) AS delay_rate FROM flights GROUP BY "year" """),
)
def yearly_summary(spark, sf_dir):
    return R.yearly_summary(labelled_flights(spark, sf_dir, "year", "Cancelled", "Diverted", "primary_eligible", "ArrDel15"))


_checks = {
    "Canceled flights": '"Cancelled" = 1', "Diverted flights": '"Diverted" = 1',
    "Canceled flights with missing arrival delay": '"Cancelled" = 1 AND "ArrDelay" IS NULL',
    "Eligible flights missing arrival delay": 'primary_eligible = 1 AND "ArrDelay" IS NULL',
    "Invalid/nonpositive scheduled duration": '"CRSElapsedTime" IS NULL OR "CRSElapsedTime" <= 0',
    "Invalid/nonpositive distance": '"Distance" IS NULL OR "Distance" <= 0',
    "Missing airline/origin/destination": '"Reporting_Airline" IS NULL OR "Origin" IS NULL OR "Dest" IS NULL',
    "Arrival delays over 24 hours": 'primary_eligible = 1 AND "ArrDelay" > 1440',
    "Arrivals over 2 hours early": 'primary_eligible = 1 AND "ArrDelay" < -120',
}


@query(
    "data_quality", "AG9 ST6",
    sql_with(RAW_SQL, body=" UNION ALL ".join(
        f"""SELECT '{c}' AS "check", count(*) FILTER ({sql}) AS "rows", '{R.QUALITY_TREATMENT[c]}' AS treatment,
          count(*) FILTER ({sql}) / count(*) AS share_of_all_rows FROM flights""" for c, sql in _checks.items())),
)
def data_quality(spark, sf_dir):
    return R.quality_table(labelled_flights(
        spark, sf_dir, "Reporting_Airline", "Origin", "Dest", "CRSElapsedTime", "Distance", "Cancelled", "Diverted",
        "ArrDelay", "primary_eligible",
    ))


@query(
    "busiest_origins", "TK2 WN7",
    sql_with(RAW_SQL, body="""SELECT "Origin" AS airport, count(*) AS flights, row_number() OVER (ORDER BY count(*) DESC, "Origin") AS rank
      FROM flights GROUP BY "Origin" ORDER BY flights DESC, "Origin" LIMIT 10"""),
)
def busiest_origins(spark, sf_dir):
    counts = labelled_flights(spark, sf_dir, "Origin").groupBy(F.col("Origin").alias("airport")).agg(F.count(F.lit(1)).alias("flights"))
    top = counts.orderBy(F.desc("flights"), "airport").limit(10)
    # Ten rows are left to number.
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("flights"), "airport")).cast("bigint"))


@query(
    "busiest_day_per_origin", "TK5",
    sql_with(RAW_SQL, body="""SELECT "Origin" AS airport, "FlightDate" AS busiest_day, n AS flights FROM (
      SELECT "Origin", "FlightDate", count(*) AS n FROM flights GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY "Origin" ORDER BY n DESC, "FlightDate") = 1"""),
)
def busiest_day_per_origin(spark, sf_dir):
    days = labelled_flights(spark, sf_dir, "Origin", "FlightDate").groupBy("Origin", "FlightDate").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct("FlightDate", "n"), F.struct("n", -F.unix_date("FlightDate")))
    return days.groupBy(F.col("Origin").alias("airport")).agg(best.alias("b")).select(
        "airport", F.col("b.FlightDate").alias("busiest_day"), F.col("b.n").alias("flights")
    )


# --- missing values and variance ------------------------------------------------------

_AUDITED = ["airline", "scheduled_duration_minutes", "origin_recent_delay_rate", "destination_recent_delay_rate",
            "route_recent_delay_rate", "origin_faa_hub_category", "scheduled_departure_hour"]
# Reasons why a feature can be missing, and how each kind of model handles it.
MISSING_REASON = {
    "history": "Insufficient lag history for a new date/airport/route",
    "duration": "Missing or nonpositive BTS scheduled duration",
    "hub": "Airport code has no mapped FAA hub classification",
    "category": "Unclassified source category",
    "none": "No missing observations",
}
MISSING_HANDLING = {
    "history": "Missing-history indicator + hierarchical, training-only backoff",
    "duration": "Missing-value indicator + training-only route median backoff",
    "hub": "Explicit Unknown / unclassified category",
    "category": "Explicit Unknown / unclassified category",
    "none": "Observed value; no imputation",
}
TREE_HANDLING = {
    "history": "Native learned missing branch; no imputation",
    "duration": "Native learned missing branch; no imputation",
    "hub": "Explicit Unknown / unclassified category",
    "category": "Explicit Unknown / unclassified category",
    "none": "Native learned missing branch if a future NaN occurs",
}
ADDITIVE_HANDLING = {
    "history": "Native missing-value bin; no imputation",
    "duration": "Native missing-value bin; no imputation",
    "hub": "Explicit Unknown / unclassified category",
    "category": "Explicit Unknown / unclassified category",
    "none": "Native missing-value bin if a future NaN occurs",
}


def missing_kind(feature):
    return (
        F.when(feature.isin(*HISTORY_RATES), "history").when(feature == "scheduled_duration_minutes", "duration")
        .when(feature.endswith("faa_hub_category"), "hub").when(feature.isin(*CATEGORICAL), "category").otherwise("none")
    )


def audited(spark, sf_dir):
    df = eligible_flights(spark, sf_dir, "FlightDate", "year", "Reporting_Airline", "Origin", "Dest", "CRSElapsedTime",
                          "departure_hour", "ArrDel15")
    df = materialize(df, "flights")
    rates = history.trailing_features(df)
    df = joins.lookup_join(df, rates, {c: c for c in ("FlightDate", "Origin", "Dest")}, validate=False)
    hubs = P.hub_dimension(B.hub_classes(spark, sf_dir)).select("airport", "faa_hub_category")
    df = joins.lookup_join(df, hubs, {"Origin": "airport"}, "origin_")
    return P.present(df).withColumn("split", F.when(F.col("year") <= 2000, "Development").otherwise("Holdout"))


AUDITED_SQL = """audited AS (
  SELECT CASE WHEN f."year" <= 2000 THEN 'Development' ELSE 'Holdout' END AS split, f."Reporting_Airline" AS airline,
         CASE WHEN f."CRSElapsedTime" > 0 THEN f."CRSElapsedTime" END AS scheduled_duration_minutes, r.origin_recent_delay_rate,
         r.destination_recent_delay_rate, r.route_recent_delay_rate, h.faa_hub_category AS origin_faa_hub_category,
         f.departure_hour AS scheduled_departure_hour, f."ArrDel15" AS label
  FROM flights f LEFT JOIN rates r USING ("FlightDate", "Origin", "Dest") LEFT JOIN hubs h ON f."Origin" = h.airport WHERE primary_eligible = 1
)"""
_AUDIT_PARTS = (RAW_SQL, TRAILING_SQL, HUBS_SQL, AUDITED_SQL)
_kinds = {f: ("history" if f.endswith("_delay_rate") else "duration" if "duration" in f else "hub" if f.endswith("hub_category")
              else "category" if f == "airline" else "none") for f in _AUDITED}


@query(
    "feature_missingness", "AG18 SCL14 SCL15 ST6",
    sql_with(*_AUDIT_PARTS, body=" UNION ALL ".join(
        f"""SELECT split, '{f}' AS feature, '{DISPLAY[f]}' AS display_name, count(*) AS "rows", count(*) - count({f}) AS missing_observations,
          (count(*) - count({f})) / count(*) AS missing_share, avg(CASE WHEN {f} IS NULL THEN label END) AS delay_rate_when_missing,
          avg(CASE WHEN {f} IS NOT NULL THEN label END) AS delay_rate_when_present, '{MISSING_REASON[_kinds[f]]}' AS structural_reason,
          '{MISSING_HANDLING[_kinds[f]]}' AS logistic_handling, '{TREE_HANDLING[_kinds[f]]}' AS xgboost_handling,
          '{ADDITIVE_HANDLING[_kinds[f]]}' AS ebm_handling FROM audited GROUP BY split"""
        for f in _AUDITED)),
)
def feature_missingness(spark, sf_dir):
    table = R.missingness(audited(spark, sf_dir), "split", _AUDITED, "arrival_delay_15min")
    kind = missing_kind(F.col("feature"))
    return table.withColumns({
        "display_name": V.display_name(F.col("feature"), DISPLAY),
        "structural_reason": V.lookup(kind, MISSING_REASON, F.lit(None)),
        "logistic_handling": V.lookup(kind, MISSING_HANDLING, F.lit(None)),
        "xgboost_handling": V.lookup(kind, TREE_HANDLING, F.lit(None)),
        "ebm_handling": V.lookup(kind, ADDITIVE_HANDLING, F.lit(None)),
    })


@query(
    "rows_with_missing_features", "AG19 FLT6",
    sql_with(*_AUDIT_PARTS, body="SELECT split, count(*) AS \"rows\", count(*) FILTER (" + " OR ".join(f"{f} IS NULL" for f in _AUDITED)
             + ") AS rows_with_any_feature_missing, count(*) FILTER (" + " OR ".join(f"{f} IS NULL" for f in _AUDITED)
             + ") / count(*) AS share_with_any_feature_missing FROM audited GROUP BY split"),
)
def rows_with_missing_features(spark, sf_dir):
    return R.missing_rows(audited(spark, sf_dir), "split", _AUDITED)


_NUMERIC = ["CRSElapsedTime", "Distance", "departure_hour", "disc", "score_b"]


@query(
    "variance_screen", "AG20 ST6",
    sql_with(RAW_SQL, body=" UNION ALL ".join(
        f"""SELECT '{f}' AS feature, round(var_samp({x}), 6) AS variance, coalesce(var_samp({x}), 0) < 1e-10 AS zero_or_near_zero_variance
        FROM flights""" for f, x in [*((f, f'"{f}"') for f in _NUMERIC), ("constant", "1.0")])),
)
def variance_screen(spark, sf_dir):
    df = labelled_flights(spark, sf_dir, *_NUMERIC).withColumn("constant", F.lit(1.0))
    return R.variance_screen(df, [*_NUMERIC, "constant"]).withColumn("variance", F.round("variance", 6))


# --- association audit ------------------------------------------------------------------

_PAIRS = [(a, b) for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1:]]
_filled = ", ".join(f'coalesce(CAST("{c}" AS DOUBLE), (SELECT quantile_cont(CAST("{c}" AS DOUBLE), 0.5) FROM flights)) AS "{c}"' for c in _NUMERIC)
FILLED_SQL = f"filled AS (SELECT {_filled} FROM flights)"
RANKED_SQL = "ranked_values AS (SELECT " + ", ".join(
    f'rank() OVER (ORDER BY "{c}") + (count(*) OVER (PARTITION BY "{c}") - 1) / 2.0 AS "{c}"' for c in _NUMERIC) + " FROM filled)"


def _corr_sql(source: str, name: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr("{a}", "{b}"), 6) AS {name},
        round(abs(corr("{a}", "{b}")), 6) AS absolute_correlation FROM {source}""" for a, b in _PAIRS)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _numbers(spark, sf_dir):
    return labelled_flights(spark, sf_dir, *_NUMERIC)


@query("spearman_pairs", "AS1 AS2 ST5", sql_with(RAW_SQL, FILLED_SQL, RANKED_SQL, body=_corr_sql("ranked_values", "spearman_correlation")))
def spearman_pairs(spark, sf_dir):
    return _rounded(A.spearman_pairs(_numbers(spark, sf_dir), _NUMERIC), "spearman_correlation", "absolute_correlation")


@query("pearson_pairs", "AS1 AS3 ST5", sql_with(RAW_SQL, FILLED_SQL, body=_corr_sql("filled", "pearson_correlation")))
def pearson_pairs(spark, sf_dir):
    filled = A.fill_medians(_numbers(spark, sf_dir), _NUMERIC)
    return _rounded(A.pearson_pairs(filled, _NUMERIC), "pearson_correlation", "absolute_correlation")


@query(
    "variance_inflation", "AS4",
    sql_with(RAW_SQL, FILLED_SQL, body="""SELECT unnest(['CRSElapsedTime', 'Distance']) AS feature, round(1 / (1 - power(r, 2)), 4) AS vif
      FROM (SELECT corr("CRSElapsedTime", "Distance") AS r FROM filled)"""),
)
def variance_inflation(spark, sf_dir):
    two = ["CRSElapsedTime", "Distance"]
    filled = A.fill_medians(labelled_flights(spark, sf_dir, *two), two)
    return A.variance_inflation(filled, two).withColumn("vif", F.round("vif", 4))


_CATEGORIES = ["Reporting_Airline", "Origin", "Dest", "day_of_week"]
_CAT_PAIRS = [(a, b) for i, a in enumerate(_CATEGORIES) for b in _CATEGORIES[i + 1:]]
CELLS_SQL = "cells AS (" + " UNION ALL ".join(
    f"""SELECT '{a}' AS feature_1, '{b}' AS feature_2, CAST("{a}" AS VARCHAR) AS x, CAST("{b}" AS VARCHAR) AS y, count(*) AS observed
    FROM flights WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL GROUP BY ALL""" for a, b in _CAT_PAIRS) + ")"


@query("contingency_cells", "AS5", sql_with(RAW_SQL, CELLS_SQL, body="SELECT * FROM cells"))
def contingency_cells(spark, sf_dir):
    return A.contingency(labelled_flights(spark, sf_dir, *_CATEGORIES), _CATEGORIES)


@query(
    "cramers_v", "AS6",
    sql_with(RAW_SQL, CELLS_SQL, """expected AS (
      SELECT *, CAST(sum(observed) OVER (PARTITION BY feature_1, feature_2, x) AS DOUBLE) AS rt, CAST(sum(observed) OVER (PARTITION BY feature_1, feature_2, y) AS DOUBLE) AS ct FROM cells
    ), sums AS (SELECT feature_1, feature_2, sum(observed * observed / (rt * ct)) - 1 AS phi2, CAST(sum(observed) AS DOUBLE) AS n,
      count(DISTINCT x) AS r, count(DISTINCT y) AS c FROM expected GROUP BY ALL
    ), corrected AS (SELECT *, greatest(0, phi2 - (r - 1) * (c - 1) / (n - 1)) AS p, r - (r - 1) * (r - 1) / (n - 1) - 1 AS rr, c - (c - 1) * (c - 1) / (n - 1) - 1 AS cc FROM sums)""",
             body="SELECT feature_1, feature_2, round(CASE WHEN least(rr, cc) > 0 THEN sqrt(p / least(rr, cc)) ELSE 0 END, 6) AS corrected_cramers_v FROM corrected"),
)
def cramers_v(spark, sf_dir):
    return _rounded(A.cramers_v(labelled_flights(spark, sf_dir, *_CATEGORIES), _CATEGORIES), "corrected_cramers_v")


_MIXED = ["CRSElapsedTime", "ArrDelay", "disc"]


@query(
    "correlation_ratio", "AS7 ST5",
    sql_with(RAW_SQL, body=" UNION ALL ".join(
        f"""SELECT '{c}' AS categorical_feature, '{v}' AS numeric_feature, round(sqrt(sum(n * (m - g) * (m - g)) / max(t)), 6) AS correlation_ratio_eta
        FROM (SELECT "{c}", count("{v}") AS n, avg("{v}") AS m FROM flights GROUP BY ALL HAVING count("{v}") > 0),
             (SELECT avg("{v}") AS g, var_pop("{v}") * count("{v}") AS t FROM flights)""" for c in _CATEGORIES for v in _MIXED)),
)
def correlation_ratio(spark, sf_dir):
    df = labelled_flights(spark, sf_dir, *_CATEGORIES, *_MIXED)
    return _rounded(A.correlation_ratio(df, _CATEGORIES, _MIXED), "correlation_ratio_eta")


@query(
    "audit_summary", "AS8",
    sql_with(RAW_SQL, FILLED_SQL, RANKED_SQL, CELLS_SQL, "rho AS (" + _corr_sql("ranked_values", "r") + ")", """
    expected AS (
      SELECT *, CAST(sum(observed) OVER (PARTITION BY feature_1, feature_2, x) AS DOUBLE) AS rt, CAST(sum(observed) OVER (PARTITION BY feature_1, feature_2, y) AS DOUBLE) AS ct FROM cells
    ), sums AS (SELECT feature_1, feature_2, sum(observed * observed / (rt * ct)) - 1 AS phi2, CAST(sum(observed) AS DOUBLE) AS n,
      count(DISTINCT x) AS r, count(DISTINCT y) AS c FROM expected GROUP BY ALL
    ), v AS (SELECT sqrt(greatest(0, phi2 - (r - 1) * (c - 1) / (n - 1)) / least(r - (r - 1) * (r - 1) / (n - 1) - 1, c - (c - 1) * (c - 1) / (n - 1) - 1)) AS v FROM sums
    ), two AS (SELECT 1 / (1 - power(corr("CRSElapsedTime", "Distance"), 2)) AS vif FROM filled)""",
             body="""SELECT (SELECT round(vif, 4) FROM two) AS maximum_numeric_vif, (SELECT max(absolute_correlation) FROM rho) AS maximum_absolute_numeric_spearman,
      (SELECT round(max(v), 6) FROM v) AS maximum_corrected_cramers_v, (SELECT count(*) FROM rho WHERE absolute_correlation >= 0.7) AS numeric_pairs_above_0_7,
      (SELECT CAST(CASE WHEN vif >= 5 THEN 2 ELSE 0 END AS BIGINT) FROM two) AS vif_above_5"""),
)
def audit_summary(spark, sf_dir):
    # Three audits read the flights several times each, so their narrow columns are joined and stored once.
    df = materialize(labelled_flights(spark, sf_dir, *dict.fromkeys([*_NUMERIC, *_CATEGORIES])), "audited")
    two = ["CRSElapsedTime", "Distance"]
    out = A.audit_summary(
        A.variance_inflation(A.fill_medians(df, two), two), A.spearman_pairs(df, _NUMERIC), A.cramers_v(df, _CATEGORIES)
    )
    out = out.withColumn("maximum_numeric_vif", F.round("maximum_numeric_vif", 4))
    return _rounded(out, "maximum_absolute_numeric_spearman", "maximum_corrected_cramers_v")


# --- sampling and permutation --------------------------------------------------------


@query(
    "exact_sample", "TK6 SRC3",
    sql_with(RAW_SQL, body="""SELECT row_key, "year", "ArrDel15" FROM flights WHERE primary_eligible = 1 AND "year" IN (1998, 1999, 2000)
      ORDER BY md5(row_key || '-42') LIMIT 1500"""),
)
def exact_sample(spark, sf_dir):
    df = eligible_flights(spark, sf_dir, "row_key", "year", "ArrDel15").where(F.col("year").isin(1998, 1999, 2000))
    return sampling.exact_sample(df.drop("primary_eligible"), 1500, "row_key", 42)


@query(
    "row_sample", "TK7",
    sql_with(RAW_SQL, body="""SELECT row_key FROM flights ORDER BY md5(row_key || '-7') LIMIT 5000"""),
)
def row_sample(spark, sf_dir):
    df = labelled_flights(spark, sf_dir, "row_key")
    return sampling.exact_sample(df, 5000, "row_key", 7, allow_fewer=True)


def _permuted_sql(partition: str) -> str:
    window = lambda order: f"row_number() OVER ({partition} ORDER BY {order})"
    return f"""receivers AS (SELECT *, {window('row_key')} AS rn FROM flights WHERE primary_eligible = 1),
      givers AS (SELECT "Origin" AS o, disc AS given, {window("md5(row_key || '-808'), row_key")} AS rn FROM flights WHERE primary_eligible = 1)"""


@query(
    "permuted_within_origin", "AS9",
    sql_with(RAW_SQL, _permuted_sql('PARTITION BY "Origin"'), body='SELECT row_key, "Origin", given AS disc FROM receivers r JOIN givers g ON r.rn = g.rn AND r."Origin" = g.o'),
)
def permuted_within_origin(spark, sf_dir):
    df = eligible_flights(spark, sf_dir, "row_key", "Origin", "disc").select("row_key", "Origin", "disc")
    return sampling.permute(df, "disc", "row_key", 808, ["Origin"])


@query(
    "permuted_globally", "AS10",
    sql_with(RAW_SQL, _permuted_sql(""), body="SELECT row_key, given AS disc FROM receivers JOIN givers USING (rn)"),
)
def permuted_globally(spark, sf_dir):
    return sampling.permute(eligible_flights(spark, sf_dir, "row_key", "disc").select("row_key", "disc"), "disc", "row_key", 808)


# --- evaluation ------------------------------------------------------------------------


def metrics_sql(source: str, key: str = "model") -> str:
    """CTEs that evaluate (key, label, score) rows of ``source`` into ``evaluated``."""
    return f"""ties AS (
  SELECT {key}, score, CAST(sum(label) AS DOUBLE) AS pos, CAST(count(*) - sum(label) AS DOUBLE) AS neg, count(*) AS n FROM {source} GROUP BY {key}, score
), ranks AS (
  SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg, sum(n) OVER w AS cum_n, sum(pos) OVER t AS total_pos, sum(neg) OVER t AS total_neg
  FROM ties WINDOW w AS (PARTITION BY {key} ORDER BY score DESC), t AS (PARTITION BY {key})
), ranking AS (
  SELECT {key}, sum(neg * (cum_pos - pos / 2)) / max(total_pos * total_neg) AS roc_auc, sum(pos * cum_pos / cum_n) / max(total_pos) AS average_precision FROM ranks GROUP BY {key}
), cuts AS (SELECT {key}, quantile_cont(score, 0.9) AS cutoff FROM {source} GROUP BY {key}
), losses AS (
  SELECT {key}, avg(-CASE WHEN label = 1 THEN ln(greatest(least(score, 1 - 1e-7), 1e-7)) ELSE ln(1 - greatest(least(score, 1 - 1e-7), 1e-7)) END) AS log_loss,
         avg((score - label) * (score - label)) AS brier_score, avg(label) AS base_rate,
         avg(label) FILTER (score >= cutoff) AS top_rate, sum(label) FILTER (score >= cutoff) / sum(label) AS capture
  FROM {source} JOIN cuts USING ({key}) GROUP BY {key}
), evaluated AS (
  SELECT {key}, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(log_loss, 6) AS log_loss, round(brier_score, 6) AS brier_score,
         round(base_rate, 6) AS base_rate, round(top_rate, 6) AS top_decile_delay_rate, round(top_rate / base_rate, 6) AS top_decile_lift,
         round(capture, 6) AS share_delays_captured_top_decile FROM ranking JOIN losses USING ({key})
)"""


SCORED_SQL = """scored AS (
  SELECT 'score_a' AS model, row_key, CAST("ArrDel15" AS INTEGER) AS label, score_a AS score FROM flights WHERE primary_eligible = 1
  UNION ALL SELECT 'score_b', row_key, CAST("ArrDel15" AS INTEGER), score_b FROM flights WHERE primary_eligible = 1
)"""
_METRICS = ["roc_auc", "average_precision", "log_loss", "brier_score", "base_rate", "top_decile_delay_rate", "top_decile_lift",
            "share_delays_captured_top_decile"]


def scored(spark, sf_dir):
    return M.model_scores(eligible_flights(spark, sf_dir, "ArrDel15", "score_a", "score_b"), "ArrDel15", ["score_a", "score_b"])


@query("model_comparison", "EV1 EV2 EV3 EV4 EV5 EV9", sql_with(RAW_SQL, SCORED_SQL, metrics_sql("scored"), body="SELECT * FROM evaluated"))
def model_comparison(spark, sf_dir):
    return _rounded(M.evaluate(scored(spark, sf_dir)), *_METRICS).orderBy(F.desc("average_precision"))


@query(
    "roc_curve", "EV6",
    sql_with(RAW_SQL, SCORED_SQL, metrics_sql("scored"), body="""SELECT model, score AS threshold, cum_neg / total_neg AS false_positive_rate,
      cum_pos / total_pos AS true_positive_rate FROM ranks"""),
)
def roc_curve(spark, sf_dir):
    return M.roc_points(scored(spark, sf_dir))


@query(
    "precision_recall_curve", "EV7",
    sql_with(RAW_SQL, SCORED_SQL, metrics_sql("scored"), body="""SELECT model, score AS threshold, cum_pos / cum_n AS precision, cum_pos / total_pos AS recall
      FROM ranks WHERE cum_pos / total_pos >= 0.001"""),
)
def precision_recall_curve(spark, sf_dir):
    return M.pr_points(scored(spark, sf_dir))


@query(
    "calibration_bins", "EV8",
    sql_with(RAW_SQL, SCORED_SQL, "edges AS (" + " UNION ALL ".join(
        f"SELECT model, quantile_cont(score, {i / 12}) AS edge FROM scored GROUP BY model" for i in range(1, 12)) + ")", """binned AS (
      SELECT model, label, score, CAST((SELECT count(*) FROM edges e WHERE e.model = s.model AND e.edge < s.score) AS INTEGER) AS bin FROM scored s)""",
             body="""SELECT model, bin, count(*) AS "rows", round(avg(score), 6) AS mean_predicted, avg(label) AS observed_rate FROM binned GROUP BY model, bin"""),
)
def calibration_bins(spark, sf_dir):
    return _rounded(M.calibration_bins(scored(spark, sf_dir)), "mean_predicted")


@query(
    "paired_log_loss_gain", "AS11 SCL11",
    sql_with(RAW_SQL, body="""SELECT round(g, 6) AS log_loss_gain, round(g - h, 6) AS ci_low, round(g + h, 6) AS ci_high, g - h > 0 AS statistically_detectable FROM (
      SELECT avg(d) AS g, 1.96 * stddev_samp(d) / sqrt(count(*)) AS h FROM (
        SELECT CASE WHEN "ArrDel15" = 1 THEN ln(score_a) - ln(score_b) ELSE ln(1 - score_a) - ln(1 - score_b) END AS d FROM flights WHERE primary_eligible = 1))"""),
)
def paired_log_loss_gain(spark, sf_dir):
    df = eligible_flights(spark, sf_dir, "ArrDel15", "score_a", "score_b")
    return _rounded(M.paired_gain(df, "ArrDel15", "score_a", "score_b"), "log_loss_gain", "ci_low", "ci_high")


THRESHOLD_SQL = "by_threshold AS (" + " UNION ALL ".join(
    f"""SELECT {t} AS delay_threshold_minutes, CASE WHEN "ArrDelay" >= {t} THEN 1 ELSE 0 END AS label, score_a AS score
    FROM flights WHERE primary_eligible = 1""" for t in (15, 30, 60, 120)) + ")"


@query(
    "threshold_summary", "EV10 ML10",
    sql_with(RAW_SQL, THRESHOLD_SQL, metrics_sql("by_threshold", "delay_threshold_minutes"), body="""SELECT delay_threshold_minutes, base_rate, roc_auc,
      average_precision, log_loss, brier_score FROM evaluated"""),
)
def threshold_summary(spark, sf_dir):
    df = eligible_flights(spark, sf_dir, "ArrDelay", "score_a")
    labels = F.array(*[F.struct(F.lit(t).alias("delay_threshold_minutes"), (F.col("ArrDelay") >= t).cast("int").alias("label")) for t in (15, 30, 60, 120)])
    rows = df.select(F.col("score_a").alias("score"), F.inline(labels))
    out = M.evaluate(rows, ["delay_threshold_minutes"])
    return _rounded(out, *_METRICS).select("delay_threshold_minutes", *_METRICS[:5]).orderBy("delay_threshold_minutes")


@query(
    "coherent_severity", "SCL17",
    sql_with(RAW_SQL, body="""SELECT row_key, score_a AS p15, least(score_a, score_b) AS p30, least(score_a, score_b, disc / 20.0::DOUBLE) AS p60 FROM flights"""),
)
def coherent_severity(spark, sf_dir):
    df = labelled_flights(spark, sf_dir, "row_key", "score_a", "score_b", "disc").withColumn("d", F.col("disc") / F.lit(20.0))
    p15, p30, p60 = V.running_minimum(["score_a", "score_b", "d"])
    return df.select("row_key", p15.alias("p15"), p30.alias("p30"), p60.alias("p60"))


@query(
    "conditional_permutation", "AS9 EV2 SCL14 ML14",
    sql_with(RAW_SQL, _permuted_sql('PARTITION BY "Origin"'), """scored AS (
      SELECT m.model, CAST(r."ArrDel15" AS INTEGER) AS label, CASE m.model WHEN 'baseline' THEN score_a ELSE (round(400 * score_a) - 8 * r.disc + 8 * g.given) / 400 END AS score
      FROM receivers r JOIN givers g ON r.rn = g.rn AND r."Origin" = g.o, (VALUES ('baseline'), ('permuted')) m(model)
    )""", metrics_sql("scored"), body="""SELECT b.average_precision AS baseline_average_precision, p.average_precision AS conditional_permutation_average_precision,
      round((b.average_precision - p.average_precision) * 10000, 1) AS average_precision_drop_basis_points, round(p.log_loss - b.log_loss, 5) AS log_loss_increase,
      CASE WHEN b.average_precision - p.average_precision >= 0.0001 THEN 'Retains within-airport incremental signal'
        ELSE 'Mostly an airport-identity proxy; remove or residualize' END AS interpretation
      FROM evaluated b, evaluated p WHERE b.model = 'baseline' AND p.model = 'permuted'"""),
)
def conditional_permutation(spark, sf_dir):
    df = eligible_flights(spark, sf_dir, "row_key", "Origin", "disc", "score_a", "ArrDel15").withColumnRenamed("score_a", "baseline")
    rest = F.round(F.col("baseline") * 400) - 8 * F.col("disc")
    shuffled = sampling.permute(df.withColumn("rest", rest), "disc", "row_key", 808, ["Origin"])
    both = shuffled.withColumn("permuted", (F.col("rest") + 8 * F.col("disc")) / 400)
    table = M.evaluate(M.model_scores(both, "ArrDel15", ["baseline", "permuted"]))
    table = _rounded(table, "average_precision", "log_loss")
    of = lambda model, c: F.max(F.when(F.col("model") == model, F.col(c)))
    ap0, ap1 = of("baseline", "average_precision"), of("permuted", "average_precision")
    return table.agg(
        ap0.alias("baseline_average_precision"), ap1.alias("conditional_permutation_average_precision"),
        F.round((ap0 - ap1) * 10_000, 1).alias("average_precision_drop_basis_points"),
        F.round(of("permuted", "log_loss") - of("baseline", "log_loss"), 5).alias("log_loss_increase"),
        M.permutation_verdict(ap0, ap1, PERMUTATION_VERDICT_AP).alias("interpretation"),
    )


# --- reading and writing -----------------------------------------------------------------


def _fresh(spark, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


_IO_COLUMNS = ["row_key", "FlightDate", "Origin", "CRSDepTime", "Cancelled", "ArrDelay"]
_IO_SCHEMA = "row_key STRING, FlightDate DATE, Origin STRING, CRSDepTime INT, Cancelled INT, ArrDelay DOUBLE"


@query(
    "csv_round_trip", "SRC1 SRC4 SNK5 SRC8",
    sql_with(RAW_SQL, body='SELECT row_key, "FlightDate", "CRSDepTime", "ArrDelay" FROM flights'),
)
def csv_round_trip(spark, sf_dir):
    # The file holds its columns in another order and more of them than are read.
    path, wide = _fresh(spark, "csv"), ["Dest", *reversed(_IO_COLUMNS), "Distance"]
    store.write_report(labelled_flights(spark, sf_dir, *wide).select(*wide), path)
    return store.read_csv(spark, path, _IO_SCHEMA, ["row_key", "FlightDate", "CRSDepTime", "ArrDelay"])


@query(
    "store_round_trip", "SNK1 SNK3 SRC2 SRC3 SRC4 SRC5 FLT2",
    sql_with(RAW_SQL, body='SELECT row_key, "year", "month", "ArrDelay" FROM flights WHERE "year" IN (1997, 1999)'),
)
def store_round_trip(spark, sf_dir):
    path = _fresh(spark, "store")
    flights = labelled_flights(spark, sf_dir, "row_key", "year", "month", "ArrDelay")
    store.write_store(flights, path)
    store.write_store(flights, path)
    stored = store.require_months(store.read_store(spark, path), [1997, 1999])
    stored.createOrReplaceTempView("stored_flights")
    return spark.sql("SELECT row_key, year, month, ArrDelay FROM stored_flights WHERE year IN (1997, 1999)")


@query(
    "resumed_store", "SNK1 SNK3 SRC3",
    sql_with(RAW_SQL, body='SELECT "year", "month", count(*) AS "rows" FROM flights GROUP BY ALL'),
)
def resumed_store(spark, sf_dir):
    """Months and rows of a store that a first run left half done and a second one finished."""
    path = _fresh(spark, "store")
    flights = labelled_flights(spark, sf_dir, "row_key", "year", "month", "ArrDelay")
    store.resume_store(flights.where("year < 1998"), path, at_a_time=48)
    store.resume_store(flights, path, at_a_time=48)
    return store.finished_parts(spark, path)


@query(
    "hub_traffic", "SRC6 JN4",
    sql_with(RAW_SQL, HUBS_SQL, body="""SELECT faa_hub_category, count(*) AS flights, count(DISTINCT "Origin") AS airports
      FROM flights LEFT JOIN hubs ON "Origin" = airport GROUP BY faa_hub_category"""),
)
def hub_traffic(spark, sf_dir):
    labelled_flights(spark, sf_dir, "Origin").createOrReplaceTempView("registered_flights")
    P.hub_dimension(B.hub_classes(spark, sf_dir)).createOrReplaceTempView("registered_hubs")
    return spark.sql("""SELECT faa_hub_category, count(*) AS flights, count(DISTINCT Origin) AS airports
        FROM registered_flights LEFT JOIN registered_hubs ON Origin = airport GROUP BY faa_hub_category""")


@query(
    "published_sample", "SNK2 SNK4 TK6",
    sql_with(RAW_SQL, body="""SELECT row_key, "ArrDelay" FROM flights WHERE primary_eligible = 1 ORDER BY md5(row_key || '-43') LIMIT 2000"""),
)
def published_sample(spark, sf_dir):
    path = _fresh(spark, "sample")
    df = eligible_flights(spark, sf_dir, "row_key", "ArrDelay").select("row_key", "ArrDelay")
    store.publish_exact(sampling.exact_sample(df, 2000, "row_key", 43), path, 2000)
    return store.read_store(spark, path)


@query(
    "json_report", "SNK6 SRC8",
    sql_with(RAW_SQL, body='SELECT "Origin", count(*) AS flights, avg("ArrDel15") AS delay_rate FROM flights WHERE primary_eligible = 1 GROUP BY "Origin"'),
)
def json_report(spark, sf_dir):
    path = _fresh(spark, "json")
    rates = eligible_flights(spark, sf_dir, "Origin", "ArrDel15").groupBy("Origin").agg(
        F.count(F.lit(1)).alias("flights"), F.avg("ArrDel15").alias("delay_rate"))
    store.write_report(rates, path, "json")
    return store.read_report(spark, path, "Origin STRING, flights BIGINT, delay_rate DOUBLE", "json")
