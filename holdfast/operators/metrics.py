"""Quality of binary scores: curves, thresholds, calibration. One shuffle by score, whatever the table size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numeric import present, ratio_or_null, share
from holdfast.plans.running import running_totals

EPSILON = 2.220446049250313e-16


def score_counts(df: DataFrame, label: str, prob: str, groups: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score: tied scores become one point before the shuffle."""
    known = df.where(present(F.col(prob).cast("double")) & F.col(label).isNotNull())
    return known.groupBy(*groups, F.col(prob).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )


def score_points(df: DataFrame, label: str, prob: str, groups: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Distinct scores in descending order with running true and false positives."""
    counts = score_counts(df, label, prob, groups).withColumn("descending", -F.col("score"))
    return running_totals(counts, "descending", ["pos", "neg"], groups, parts=parts)


def curve_points(df: DataFrame, label: str, prob: str, groups: Sequence[str] = ()) -> DataFrame:
    """Points of the ROC and precision-recall curves, one row per distinct score."""
    p = score_points(df, label, prob, groups)
    return p.select(
        *groups,
        F.col("score").alias("threshold"),
        F.col("cum_pos").alias("true_positives"),
        F.col("cum_neg").alias("false_positives"),
        ratio_or_null(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
        ratio_or_null(F.col("cum_pos"), F.col("total_pos")).alias("recall"),
        share(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
    )


def classification_metrics(
    df: DataFrame, label: str, prob: str, group_cols: Sequence[str] = (), threshold: float = 0.5, parts: int | None = None
) -> DataFrame:
    """All score metrics for the table, or for every group, in one pass.

    The areas are trapezoids over distinct scores; the precision-recall curve
    ends at (recall 0, precision 1). Groups with one class keep their row, with
    null areas.
    """
    points = score_points(df, label, prob, group_cols, parts)
    pos, neg, score = F.col("pos"), F.col("neg"), F.col("score")
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    tp_before, fp_before = tp - pos, fp - neg
    all_pos, all_neg = F.col("total_pos"), F.col("total_neg")
    precision_here = share(tp, tp + fp)
    precision_before = F.when(tp_before + fp_before > 0, share(tp_before, tp_before + fp_before)).otherwise(F.lit(1.0))
    clipped = F.greatest(F.lit(EPSILON), F.least(score, F.lit(1.0 - EPSILON)))
    chosen = score >= threshold

    def tally(condition, count):
        return F.coalesce(F.sum(F.when(condition, count)), F.lit(0)).cast("bigint")

    sums = points.groupBy(*group_cols).agg(
        F.sum(pos + neg).cast("bigint").alias("count"),
        F.max(all_pos).alias("_pos"),
        F.max(all_neg).alias("_neg"),
        F.sum(neg * (tp_before + tp) / 2.0).alias("_roc"),
        F.sum(pos * (precision_here + precision_before) / 2.0).alias("_pr"),
        F.sum(-(pos * F.ln(clipped) + neg * F.ln(F.lit(1.0) - clipped))).alias("_loss"),
        F.sum(pos * (1.0 - score) * (1.0 - score) + neg * score * score).alias("_brier"),
        tally(~chosen, neg).alias("true_negatives"),
        tally(chosen, neg).alias("false_positives"),
        tally(~chosen, pos).alias("false_negatives"),
        tally(chosen, pos).alias("true_positives"),
    )
    hit, miss, false_alarm = F.col("true_positives"), F.col("false_negatives"), F.col("false_positives")
    both = (F.col("_pos") > 0) & (F.col("_neg") > 0)
    return sums.select(
        *group_cols,
        "count",
        ratio_or_null(F.col("_pos"), F.col("count")).alias("positive_rate"),
        F.when(both, ratio_or_null(F.col("_pr"), F.col("_pos"))).alias("pr_auc"),
        F.when(both, ratio_or_null(F.col("_roc"), F.col("_pos") * F.col("_neg").cast("double"))).alias("roc_auc"),
        share(2 * hit, 2 * hit + miss + false_alarm).alias("f1_score"),
        share(hit, hit + false_alarm).alias("precision"),
        share(hit, hit + miss).alias("recall"),
        ratio_or_null(F.col("_loss"), F.col("count")).alias("log_loss"),
        ratio_or_null(F.col("_brier"), F.col("count")).alias("brier_score"),
        F.lit(float(threshold)).alias("threshold_used"),
        "true_negatives", "false_positives", "false_negatives", "true_positives",
    )


def confusion(df: DataFrame, label: str, prob: str, threshold: float = 0.5) -> DataFrame:
    """Counts at a threshold only: one aggregate, no order needed."""
    yes, chosen = F.col(label) == 1, F.col(prob) >= threshold
    return df.agg(
        F.count_if(~yes & ~chosen).alias("true_negatives"),
        F.count_if(~yes & chosen).alias("false_positives"),
        F.count_if(yes & ~chosen).alias("false_negatives"),
        F.count_if(yes & chosen).alias("true_positives"),
    )


def calibration_curve(df: DataFrame, label: str, prob: str, n_bins: int = 10) -> DataFrame:
    """Mean label and mean score per uniform bin; a score on an inner edge belongs to the lower bin."""
    p = F.col(prob)
    below = sum((F.when(p > i / n_bins, 1).otherwise(0) for i in range(1, n_bins)), F.lit(0))
    return (
        df.where(present(p))
        .groupBy(below.alias("bin"))
        .agg(F.avg(F.col(label).cast("double")).alias("prob_true"), F.avg(p).alias("prob_pred"), F.count(F.lit(1)).alias("n"))
    )


def min_max_score(df: DataFrame, score: str, out: str = "churn_probability") -> DataFrame:
    """Decision values scaled to [0, 1) for models without probabilities."""
    bounds = df.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi")).alias("b")).scalar()
    return df.withColumn("_b", bounds).withColumn(
        out, (F.col(score) - F.col("_b.lo")) / (F.col("_b.hi") - F.col("_b.lo") + F.lit(1e-8))
    ).drop("_b")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive, the positive-class weight of boosted models."""
    positives = F.count_if(F.col(label) == 1)
    return df.agg(((F.count(F.lit(1)) - positives) / F.greatest(positives, F.lit(1))).alias("scale_pos_weight"))
