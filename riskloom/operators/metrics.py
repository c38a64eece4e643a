"""Evaluation of probabilities, tie-aware and distributed.

Everything starts from one compact table: positives and negatives per distinct
score. Equal scores collapse before the shuffle, and running totals over the
table give the ranking metrics without sorting the rows in one place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.values import log_loss, ratio
from riskloom.operators.joins import broadcast_if_small
from riskloom.operators.ordering import pick_quantiles, running_totals
from riskloom.session import materialize


def model_scores(
    df: DataFrame, label: str, models: Sequence[str] | Mapping[str, str], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per model and event: ``model``, ``label``, ``score``.

    ``models`` are score columns, or names mapped to score columns.
    """
    columns = models if isinstance(models, Mapping) else {m: m for m in models}
    pairs = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score")) for m, c in columns.items()]
    )
    return df.select(*keep, F.col(label).cast("int").alias("label"), F.inline(pairs))


def ranked_scores(scores: DataFrame, by: Sequence[str] = ("model",), label: str = "label", score: str = "score") -> DataFrame:
    """Distinct scores from high to low with running and total positives, negatives and rows."""
    counts = scores.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    ).withColumn("n", F.col("pos") + F.col("neg"))
    return running_totals(counts, [F.desc("score")], ["pos", "neg", "n"], by)


def _at_least(q: float) -> Column:
    """Marks the rows that hold the two positions around the q-quantile, counted from the top."""
    place = (F.col("total_n") - 1) * F.lit(float(q))
    low, high = F.col("total_n") - 1 - F.floor(place), F.col("total_n") - 1 - F.ceil(place)
    start = F.col("cum_n") - F.col("n")
    holds = lambda position: (position >= start) & (position < F.col("cum_n"))
    return F.struct(
        F.when(holds(low), F.col("score")).alias("low"),
        F.when(holds(high), F.col("score")).alias("high"),
        (place - F.floor(place)).alias("part"),
    )


def upper_cutoff(ranked: DataFrame, by: Sequence[str], q: float = 0.9) -> DataFrame:
    """The linear q-quantile of the scores, one row per group."""
    ends = ranked.select(*by, _at_least(q).alias("e")).groupBy(*by).agg(
        F.max("e.low").alias("low"), F.max("e.high").alias("high"), F.max("e.part").alias("part")
    )
    return ends.select(*by, (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("cutoff"))


def evaluate(
    scores: DataFrame, by: Sequence[str] = ("model",), label: str = "label", score: str = "score", eps: float = 1e-7
) -> DataFrame:
    """ROC AUC, average precision, log loss, Brier score and top-decile metrics per group."""
    by = list(by)
    # Scores are clipped before anything is ranked, so those beyond the ends tie.
    clipped = scores.withColumn(score, F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps)))
    ranked = materialize(ranked_scores(clipped, by, label, score), "ranked")
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    all_pos, all_neg = F.max("total_pos").cast("double"), F.max("total_neg").cast("double")
    rows = F.max("total_n").cast("double")
    p = F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1 - eps))
    precision = F.col("cum_pos") / F.col("cum_n")
    overall = ranked.groupBy(*by).agg(
        F.try_divide(F.sum(neg * (F.col("cum_pos") - pos / 2)), all_pos * all_neg).alias("roc_auc"),
        F.try_divide(F.sum(pos * precision), all_pos).alias("average_precision"),
        (F.sum(pos * log_loss(F.lit(1), F.col("score"), eps) + neg * log_loss(F.lit(0), F.col("score"), eps)) / rows).alias("log_loss"),
        (F.sum(pos * (p - 1) * (p - 1) + neg * p * p) / rows).alias("brier_score"),
        (all_pos / rows).alias("base_rate"),
        all_pos.alias("_positives"),
    )
    cut = upper_cutoff(ranked, by)
    # One row per model or threshold; a hot key in a shuffled join would be the whole table.
    top = (
        ranked.join(broadcast_if_small(cut).select(*[F.col(c).alias(f"_{c}") for c in by], "cutoff"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
        if by else ranked.withColumn("cutoff", cut.scalar())
    )
    tops = top.where(F.col("score") >= F.col("cutoff")).groupBy(*by).agg(
        F.sum("pos").alias("_top_pos"), F.sum("n").alias("_top_n")
    )
    if by:
        joined = overall.join(
            tops.select(*[F.col(c).alias(f"_{c}") for c in by], "_top_pos", "_top_n"),
            [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by],
        )
    else:
        both = tops.select(F.struct("_top_pos", "_top_n")).scalar()
        joined = overall.withColumns({c: both.getField(c) for c in ("_top_pos", "_top_n")})
    top_rate = ratio(F.col("_top_pos"), F.col("_top_n"))
    return joined.select(
        *by, "roc_auc", "average_precision", "log_loss", "brier_score", "base_rate",
        top_rate.alias("top_decile_delay_rate"),
        F.try_divide(top_rate, F.col("base_rate")).alias("top_decile_lift"),
        ratio(F.col("_top_pos"), F.col("_positives")).alias("share_delays_captured_top_decile"),
    )


def roc_points(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """False and true positive rate at every distinct threshold."""
    return ranked_scores(scores, by).select(
        *by, F.col("score").alias("threshold"),
        ratio(F.col("cum_neg"), F.col("total_neg")).alias("false_positive_rate"),
        ratio(F.col("cum_pos"), F.col("total_pos")).alias("true_positive_rate"),
    )


def pr_points(scores: DataFrame, by: Sequence[str] = ("model",), min_recall: float = 0.001) -> DataFrame:
    """Precision and recall at every distinct threshold, without the unstable start."""
    points = ranked_scores(scores, by).select(
        *by, F.col("score").alias("threshold"),
        ratio(F.col("cum_pos"), F.col("cum_n")).alias("precision"),
        ratio(F.col("cum_pos"), F.col("total_pos")).alias("recall"),
    )
    return points.where(F.col("recall") >= min_recall)


def calibration_bins(scores: DataFrame, by: Sequence[str] = ("model",), bins: int = 12) -> DataFrame:
    """Mean prediction and observed rate in quantile bins; an edge belongs to the lower bin."""
    counts = scores.groupBy(*by, "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")
    )
    totals = materialize(running_totals(counts, [F.col("score")], ["n"], by), "calibration")
    edges = pick_quantiles(totals, "score", "n", [i / bins for i in range(1, bins)], by)
    # At most bins - 1 edges per group reach one row.
    edge_list = edges.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.collect_list("quantile").alias("edges"))
    binned = totals.join(broadcast_if_small(edge_list), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).withColumn(
        "bin", F.size(F.filter("edges", lambda e: e < F.col("score")))
    )
    return binned.groupBy(*by, "bin").agg(
        F.sum("n").alias("rows"),
        (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean_predicted"),
        ratio(F.sum("pos"), F.sum("n")).alias("observed_rate"),
    )


def paired_gain(df: DataFrame, label: str, reference: str, alternative: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean extra log loss of the alternative with a 95 % interval; positive favours the reference."""
    delta = log_loss(F.col(label), F.col(alternative)) - log_loss(F.col(label), F.col(reference))
    stats = df.groupBy(*by).agg(
        F.avg(delta).alias("log_loss_gain"),
        (1.96 * F.stddev_samp(delta) / F.sqrt(F.count(delta).cast("double"))).alias("_half"),
    )
    gain, half = F.col("log_loss_gain"), F.col("_half")
    return stats.select(
        *by, gain, (gain - half).alias("ci_low"), (gain + half).alias("ci_high"),
        (gain - half > 0).alias("statistically_detectable"),
    )


def block_decisions(metrics: DataFrame, full: str, min_gain: float, required: Sequence[str]) -> DataFrame:
    """Keep a feature block when leaving it out costs at least ``min_gain`` average precision."""
    whole = metrics.where(F.col("model") == full).select(F.struct("average_precision", "roc_auc")).scalar()
    reduced = metrics.where(F.col("model") != full)
    gain = whole.getField("average_precision") - F.col("average_precision")
    must = F.col("model").isin(*required) if required else F.lit(False)
    return reduced.select(
        F.col("model").alias("feature_group"),
        F.col("average_precision").alias("validation_ap_without_group"),
        gain.alias("validation_ap_gain"),
        (whole.getField("roc_auc") - F.col("roc_auc")).alias("validation_auc_gain"),
        (must | (gain >= min_gain)).alias("included"),
        F.when(must, "Required task definition").when(gain >= min_gain, "Included")
        .otherwise("Excluded: no material validation lift").alias("decision"),
    )


def permutation_verdict(baseline_ap: Column, permuted_ap: Column, min_drop: float) -> Column:
    """Reading of a within-group permutation of a congestion feature."""
    return F.when(baseline_ap - permuted_ap >= min_drop, "Retains within-airport incremental signal").otherwise(
        "Mostly an airport-identity proxy; remove or residualize"
    )
