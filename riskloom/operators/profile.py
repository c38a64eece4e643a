"""Descriptive profiles, quality counters, anomaly ranking and null audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.functions.values import any_null, clipped_bin, joined_reasons, ratio
from riskloom.session import materialize

# Whole-minute delays have few distinct values, so the exact ``percentile``
# aggregate stays small per group; continuous columns use ordering.exact_quantiles.


def distribution(df: DataFrame, value: str = "ArrDelay", thresholds: Sequence[int] = (15, 30, 60, 120)) -> DataFrame:
    """One-row profile: count, mean, exact quantiles, maximum, threshold shares."""
    points = {"p01": 0.01, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    profile = df.agg(
        F.count(F.lit(1)).alias("eligible_flights"),
        F.avg(value).alias("mean_delay_minutes"),
        F.percentile(value, F.array(*[F.lit(p) for p in points.values()])).alias("_q"),
        F.max(value).alias("maximum"),
        *[F.avg((F.col(value) >= t).cast("int")).alias(f"delay_ge_{t}") for t in thresholds],
    )
    return profile.select(
        "eligible_flights", "mean_delay_minutes", *[F.col("_q")[i].alias(n) for i, n in enumerate(points)],
        "maximum", *[f"delay_ge_{t}" for t in thresholds],
    )


def histogram(df: DataFrame, value: str = "ArrDelay", width: int = 10, low: int = -60, high: int = 300) -> DataFrame:
    """Counts and shares per clipped bin."""
    bins = df.groupBy(clipped_bin(F.col(value), width, low, high).alias("delay_bin")).agg(
        F.count(F.lit(1)).alias("flights")
    )
    return share_of_total(bins, "flights", "share")


def share_of_total(summary: DataFrame, value: str, name: str, scale: float = 1.0) -> DataFrame:
    """Share of each row of a small aggregate in its total."""
    total = summary.agg(F.sum(value)).scalar()
    return summary.withColumn(name, F.try_divide(F.col(value) * float(scale), total))


def if_eligible(column: str) -> Column:
    return F.when(F.col("primary_eligible") == 1, F.col(column))


def group_profile(
    df: DataFrame, keys: Mapping[str, Column], min_rows: int = 0, rate_name: str = "delay_rate",
    quantiles: Mapping[str, float] | None = None, mean_name: str | None = None,
) -> DataFrame:
    """Volumes, cancellation and delay rates and delay quantiles per group."""
    extra = [F.percentile(if_eligible("ArrDelay"), F.lit(q)).alias(n) for n, q in (quantiles or {}).items()]
    if mean_name:
        extra.append(F.avg(if_eligible("ArrDelay")).alias(mean_name))
    out = df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
        F.count(F.lit(1)).alias("scheduled_flights"),
        F.avg("Cancelled").alias("cancellation_rate"),
        F.sum("primary_eligible").alias("eligible_flights"),
        F.avg(if_eligible("ArrDel15")).alias(rate_name),
        *extra,
    )
    return out.where(F.col("scheduled_flights") >= min_rows)


def hourly_profile(df: DataFrame) -> DataFrame:
    return df.where("primary_eligible = 1").groupBy("departure_hour").agg(
        F.count(F.lit(1)).alias("eligible_flights"),
        F.avg("ArrDel15").alias("delay_rate"),
        F.avg("ArrDelay").alias("mean_delay_minutes"),
    )


def yearly_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("year").agg(
        F.count(F.lit(1)).alias("flights"),
        F.avg("primary_eligible").alias("eligible_rate"),
        F.avg("Cancelled").alias("cancellation_rate"),
        F.avg("Diverted").alias("diversion_rate"),
        F.avg(if_eligible("ArrDel15")).alias("delay_rate"),
    )


def daily_series(df: DataFrame, min_eligible: int) -> DataFrame:
    """Daily volumes, rates, hazard exposure and holiday flag of well-populated days."""
    exposed = F.greatest("origin_hazard_forecast_any", "dest_hazard_forecast_any")
    return (
        df.groupBy(F.col("FlightDate").alias("flight_date"), F.month("FlightDate").alias("calendar_month"))
        .agg(
            F.count(F.lit(1)).alias("scheduled_flights"),
            F.sum("primary_eligible").alias("eligible_flights"),
            F.avg("Cancelled").alias("cancellation_rate"),
            F.avg(if_eligible("ArrDel15")).alias("delay_rate"),
            F.avg(F.when(F.col("primary_eligible") == 1, exposed)).alias("forecast_hazard_share"),
            F.max("within_3d_holiday").alias("holiday_window"),
        )
        .where(F.col("eligible_flights") >= min_eligible)
    )


def seasonal_zscore(daily: DataFrame, value: str, season: str, name: str) -> DataFrame:
    """Distance from the season's mean in sample standard deviations; one row per day goes in."""
    window = W.partitionBy(season)
    score = F.try_divide(F.col(value) - F.avg(value).over(window), F.stddev_samp(value).over(window))
    return daily.withColumn(name, score)


def flag_upper_tail(daily: DataFrame, columns: Mapping[str, str], q: float = 0.9) -> DataFrame:
    """Flag rows at or above the q-quantile of the column over all rows."""
    cuts = daily.agg(F.struct(*[F.percentile(c, F.lit(q)).alias(c) for c in columns])).scalar()
    return daily.withColumns({n: F.col(c) >= cuts.getField(c) for c, n in columns.items()})


def daily_anomalies(daily: DataFrame, n: int = 12) -> DataFrame:
    """The days that stand out most within their calendar month, with observed context.

    The daily table is stored first, as the cut-offs read it a second time.
    """
    name = "seasonally_standardized_anomaly"
    daily = materialize(daily, "daily")
    scored = seasonal_zscore(daily, "delay_rate", "calendar_month", name)
    flagged = flag_upper_tail(scored, {"forecast_hazard_share": "_hazard", "cancellation_rate": "_cancel"})
    context = joined_reasons(
        [
            (F.col("_hazard"), "elevated forecast-hazard exposure"),
            (F.col("_cancel"), "elevated cancellations"),
            (F.col("holiday_window") == 1, "federal-holiday window"),
        ],
        "no captured external indicator",
    )
    return (
        flagged.withColumn("observed_context_not_causal", context)
        .orderBy(F.desc_nulls_last(name), "flight_date")
        .limit(n)
        .select(
            "flight_date", "scheduled_flights", "delay_rate", "cancellation_rate", "forecast_hazard_share", name,
            "observed_context_not_causal",
        )
    )


# Checks and how each is treated, in report order.
QUALITY_TREATMENT = {
    "Canceled flights": "Retained for QA; excluded from the arrival-delay target",
    "Diverted flights": "Retained for QA; excluded from the arrival-delay target",
    "Canceled flights with missing arrival delay": "Expected structural missingness; never imputed as on-time",
    "Eligible flights missing arrival delay": "Must equal zero for the modeling cohort",
    "Invalid/nonpositive scheduled duration":
        "Converted to missing before modeling; model-specific missing handling applies",
    "Invalid/nonpositive distance": "Flagged before modeling",
    "Missing airline/origin/destination": "Flagged before modeling",
    "Arrival delays over 24 hours": "Valid but extreme BTS records; retained for binary endpoints",
    "Arrivals over 2 hours early":
        "Potential data-quality tail; retained because target classification is unaffected",
}


def quality_table(df: DataFrame) -> DataFrame:
    """Counts of questionable rows, one row per check, from one pass."""
    cancelled, chosen = F.col("Cancelled") == 1, F.col("primary_eligible") == 1
    delay = F.col("ArrDelay")
    conditions = {
        "Canceled flights": cancelled,
        "Diverted flights": F.col("Diverted") == 1,
        "Canceled flights with missing arrival delay": cancelled & delay.isNull(),
        "Eligible flights missing arrival delay": chosen & delay.isNull(),
        "Invalid/nonpositive scheduled duration": F.col("CRSElapsedTime").isNull() | (F.col("CRSElapsedTime") <= 0),
        "Invalid/nonpositive distance": F.col("Distance").isNull() | (F.col("Distance") <= 0),
        "Missing airline/origin/destination": any_null(["Reporting_Airline", "Origin", "Dest"]),
        "Arrival delays over 24 hours": chosen & (delay > 1440),
        "Arrivals over 2 hours early": chosen & (delay < -120),
    }
    counts = df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(f"_{i}") for i, c in enumerate(conditions.values())]
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(check).alias("check"), F.col(f"_{i}").alias("rows"), F.lit(QUALITY_TREATMENT[check]).alias("treatment")
            )
            for i, check in enumerate(conditions)
        ]
    )
    return counts.select("total", F.inline(lines)).select(
        "check", "rows", "treatment", ratio(F.col("rows"), F.col("total")).alias("share_of_all_rows")
    )


def missingness(df: DataFrame, split: str, features: Sequence[str], label: str) -> DataFrame:
    """Missing count and label rate with and without each feature, per split, in one pass."""
    out = df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(f).isNull()).alias(f"_m{i}") for i, f in enumerate(features)],
        *[F.avg(F.when(F.col(f).isNull(), F.col(label))).alias(f"_a{i}") for i, f in enumerate(features)],
        *[F.avg(F.when(F.col(f).isNotNull(), F.col(label))).alias(f"_p{i}") for i, f in enumerate(features)],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"), F.col(f"_m{i}").alias("missing_observations"),
                F.col(f"_a{i}").alias("delay_rate_when_missing"), F.col(f"_p{i}").alias("delay_rate_when_present"),
            )
            for i, f in enumerate(features)
        ]
    )
    return out.select(split, "rows", F.inline(lines)).select(
        split, "feature", "rows", "missing_observations",
        ratio(F.col("missing_observations"), F.col("rows")).alias("missing_share"),
        "delay_rate_when_missing", "delay_rate_when_present",
    )


def missing_rows(df: DataFrame, split: str, features: Sequence[str]) -> DataFrame:
    counts = df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(any_null(features)).alias("rows_with_any_feature_missing")
    )
    share = ratio(F.col("rows_with_any_feature_missing"), F.col("rows"))
    return counts.withColumn("share_with_any_feature_missing", share)


def variance_screen(df: DataFrame, features: Sequence[str], floor: float = 1e-10) -> DataFrame:
    """Sample variance per numeric feature and whether it is practically constant."""
    stats = df.agg(*[F.var_samp(f).alias(f) for f in features])
    lines = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("variance")) for f in features])
    flag = F.coalesce(F.col("variance"), F.lit(0.0)) < floor
    return stats.select(F.inline(lines)).withColumn("zero_or_near_zero_variance", flag)


def band_summary(df: DataFrame, band: str, value: str) -> DataFrame:
    return df.where(F.col(band).isNotNull()).groupBy(band).agg(
        F.count(F.lit(1)).alias("sample_flights"), F.avg(value).alias("mean_risk_change_percentage_points")
    )
