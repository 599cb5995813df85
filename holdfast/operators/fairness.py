"""Metrics per customer segment and disparity alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.functions.scores import percent_text
from holdfast.operators.features import add_tenure_band
from holdfast.operators.metrics import classification_metrics
from holdfast.plans.running import long_form

OVERALL = "overall"


def segment_fairness(
    df: DataFrame,
    segments: Sequence[str] | None = None,
    label: str = fixed.TARGET,
    prob: str = fixed.PROBABILITY,
    min_rows: int = 20,
    overall: bool = False,
) -> DataFrame:
    """One row per segment value with at least ``min_rows`` rows; all segment columns in one job.

    With ``overall`` the whole table is one more segment, ``overall`` = ``all``, however few rows it has.
    """
    banded = add_tenure_band(df)
    columns = [c for c in (segments or fixed.SEGMENTS) if c in banded.columns]
    if overall:
        banded, columns = banded.withColumn(OVERALL, F.lit("all")), [OVERALL, *columns]
    long = long_form(banded, columns, [label, prob], "segment_column", "segment_value", "string")
    known = long.where(F.col("segment_value").isNotNull())
    per_segment = classification_metrics(known, label, prob, ["segment_column", "segment_value"])
    return per_segment.where((F.col("count") >= min_rows) | (F.col("segment_column") == OVERALL)).select(
        "segment_column", "segment_value", "count", F.col("positive_rate").alias("actual_churn_rate"),
        "pr_auc", "roc_auc", "f1_score", "precision", "recall",
        (F.lit(1.0) - F.col("f1_score")).alias("error_rate"),
    )


def fairness_report(
    df: DataFrame,
    segments: Sequence[str] | None = None,
    label: str = fixed.TARGET,
    prob: str = fixed.PROBABILITY,
    min_rows: int = 20,
    ratio: float = 1.5,
) -> DataFrame:
    """Metrics of the whole table and of every segment, and whether a segment's error is out of proportion: one job."""
    rows = segment_fairness(df, segments, label, prob, min_rows, overall=True)
    # one row per segment value: few, so they meet in one window
    whole = F.max(F.when(F.col("segment_column") == OVERALL, F.col("error_rate"))).over(Window.partitionBy(F.lit(0)))
    told = rows.withColumn("_whole", whole)
    unfair = (F.col("_whole") > 0) & (F.col("error_rate") > ratio * F.col("_whole"))
    return told.withColumn("disparity", F.coalesce(unfair, F.lit(False))).drop("_whole")


def overall_error(df: DataFrame, label: str = fixed.TARGET, prob: str = fixed.PROBABILITY):
    """Scalar subquery: 1 - F1 of the whole table."""
    return classification_metrics(df, label, prob).select((F.lit(1.0) - F.col("f1_score")).alias("e")).scalar()


def disparity_alerts(
    df: DataFrame,
    segments: Sequence[str] | None = None,
    label: str = fixed.TARGET,
    prob: str = fixed.PROBABILITY,
    min_rows: int = 20,
    ratio: float = 1.5,
) -> DataFrame:
    """Segments whose error exceeds ``ratio`` times the overall error."""
    audited = segment_fairness(df, segments, label, prob, min_rows).withColumn("overall_error", overall_error(df, label, prob))
    flagged = audited.where((F.col("overall_error") > 0) & (F.col("error_rate") > ratio * F.col("overall_error")))
    return flagged.select(
        "segment_column", "segment_value", "error_rate", "overall_error",
        F.concat(
            F.lit("SEGMENT DISPARITY ALERT: Segment '"), F.col("segment_column"), F.lit("="), F.col("segment_value"),
            F.lit("' error rate ("), percent_text(F.col("error_rate"), 2),
            F.lit(f") exceeds {ratio:g}x aggregate error rate ("), percent_text(F.col("overall_error"), 2), F.lit(")."),
        ).alias("alert"),
    )


def fairness_verdict(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count(F.lit(1)).alias("alert_count")).withColumn("audit_passed", F.col("alert_count") == 0)
