"""Feature drift, performance decay and the decision to retrain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.functions.numeric import half_even, ratio_or_null
from holdfast.operators.metrics import classification_metrics
from holdfast.plans.running import long_form, pick_quantiles, running_totals
from holdfast.plans.slices import position
from holdfast.plans.storage import stored

NUMERIC_KINDS = ("int", "bigint", "smallint", "tinyint", "double", "float")


def shared_numeric(ref: DataFrame, cur: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Numeric columns both tables have, or the wanted ones among them."""
    wanted = list(cols) if cols else [c for c, k in ref.dtypes if k in NUMERIC_KINDS or k.startswith("decimal")]
    return [c for c in wanted if c in ref.columns and c in cur.columns]


def side_counts(df: DataFrame, is_current: Column, cols: Sequence[str]) -> DataFrame:
    """Rows per (feature, value) on each side of a flag (null: on neither): one scan and one pre-aggregated shuffle for all features."""
    flagged = df.where(is_current.isNotNull()).select(is_current.alias("_current"), *cols)
    sides = long_form(flagged, cols, ["_current"])
    known = sides.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return known.groupBy("feature", "value").agg(
        F.count_if(~F.col("_current")).alias("ref_n"), F.count_if(F.col("_current")).alias("cur_n")
    )


def paired_counts(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per (feature, value) in two tables, each read once."""
    both = ref.select(F.lit(False).alias("_side"), *cols).unionByName(cur.select(F.lit(True).alias("_side"), *cols))
    return side_counts(both, F.col("_side"), cols)


def _points(counts: DataFrame, parts: int | None) -> DataFrame:
    """Running counts of both sides. The counts are written first: marks, sums and statistics read them, not the tables."""
    return running_totals(stored(counts, "drift-counts"), "value", ["ref_n", "cur_n"], ["feature"], parts=parts)


def _psi(points: DataFrame, bins: int, eps: float, edge_digits: int | None) -> DataFrame:
    found = pick_quantiles(points, "value", "ref_n", [i / bins for i in range(bins + 1)], ["feature"])
    raw = F.col("quantiles")
    rounded = raw if edge_digits is None else F.transform(raw, lambda e: F.round(e, edge_digits))
    edges = found.select("feature", F.array_sort(F.array_distinct(rounded)).alias("edges"))
    at, value = F.col("edges"), F.col("value")
    # one row per feature: bounded by the number of columns, so the copy on every task is small
    placed = points.join(F.broadcast(edges), "feature").where(F.size(at) >= 2)
    last = F.size(at)
    # edges at or below the value; the top edge closes the last bin
    at_or_below = sum((F.when(F.try_element_at(at, F.lit(i + 1)) <= value, 1).otherwise(0) for i in range(bins + 1)), F.lit(0))
    bin_no = F.when((value < at[0]) | (value > F.element_at(at, -1)), F.lit(None)).otherwise(F.least(at_or_below, last - 1))
    per_bin = placed.select("feature", bin_no.alias("bin"), (last - 1).alias("bins"), "ref_n", "cur_n", "total_ref_n", "total_cur_n")
    tallies = []
    for b in range(1, bins + 1):
        inside = F.col("bin") == b
        tallies += [
            F.coalesce(F.sum(F.when(inside, F.col("ref_n"))), F.lit(0)).alias(f"r{b}"),
            F.coalesce(F.sum(F.when(inside, F.col("cur_n"))), F.lit(0)).alias(f"c{b}"),
        ]
    wide = per_bin.groupBy("feature").agg(
        F.max("bins").alias("bins"), F.max("total_ref_n").alias("nr"), F.max("total_cur_n").alias("nc"), *tallies
    )

    def smoothed(count: Column, total: Column) -> Column:
        part = ratio_or_null(count, total)
        return F.when(part == 0, F.lit(eps)).otherwise(part)

    total = F.lit(0.0)
    for b in range(1, bins + 1):
        r, c = smoothed(F.col(f"r{b}"), F.col("nr")), smoothed(F.col(f"c{b}"), F.col("nc"))
        total = total + F.when(F.col("bins") >= b, (c - r) * F.ln(c / r)).otherwise(0.0)
    return wide.select("feature", F.coalesce(half_even(total, 4), F.lit(0.0)).alias("psi"))


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample p-value with the small-sample correction of the statistic."""
    root = F.sqrt(n * m / (n + m))
    scaled = (root + 0.12 + F.lit(0.11) / root) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda total, k: total + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * k * k * scaled * scaled),
    )
    return F.when(scaled < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def _ks(points: DataFrame, alpha: float) -> DataFrame:
    gap = F.abs(
        ratio_or_null(F.col("cum_ref_n"), F.col("total_ref_n")) - ratio_or_null(F.col("cum_cur_n"), F.col("total_cur_n"))
    )
    largest = points.groupBy("feature").agg(
        F.max(gap).alias("d"),
        F.max("total_ref_n").cast("double").alias("n"),
        F.max("total_cur_n").cast("double").alias("m"),
    )
    some = (F.col("n") > 0) & (F.col("m") > 0)
    p = F.when(some, ks_p_value(F.col("d"), F.col("n"), F.col("m"))).otherwise(1.0)
    return largest.select(
        "feature",
        F.when(some, half_even(F.col("d"), 4)).otherwise(0.0).alias("ks_statistic"),
        half_even(p, 6).alias("p_value"),
        (p < alpha).alias("ks_drift_detected"),
    )


def _all_features(df: DataFrame, cols: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Keep a row for features without any value."""
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return names.join(df, "feature", "left").fillna(defaults)


def psi(ref: DataFrame, cur: DataFrame, cols: Sequence[str] | None = None, bins: int = 10, eps: float = 1e-4,
        edge_digits: int | None = None, parts: int | None = None) -> DataFrame:
    """Population stability index per feature over reference-quantile bins.

    Rows outside the reference range count in the denominator only; ``edge_digits``
    rounds the edges, which makes results comparable across engines.
    """
    cols = shared_numeric(ref, cur, cols)
    return _all_features(_psi(_points(paired_counts(ref, cur, cols), parts), bins, eps, edge_digits), cols, {"psi": 0.0})


def ks_two_sample(ref: DataFrame, cur: DataFrame, cols: Sequence[str] | None = None, alpha: float = 0.05,
                  parts: int | None = None) -> DataFrame:
    """Largest distance between the two empirical distributions per feature, with its p-value."""
    cols = shared_numeric(ref, cur, cols)
    found = _ks(_points(paired_counts(ref, cur, cols), parts), alpha)
    return _all_features(found, cols, {"ks_statistic": 0.0, "p_value": 1.0, "ks_drift_detected": False})


def drift_status(value: Column, high: float = fixed.PSI_HIGH, moderate: float = fixed.PSI_MODERATE) -> Column:
    return F.when(value >= high, fixed.DRIFT_HIGH).when(value >= moderate, fixed.DRIFT_MODERATE).otherwise(fixed.DRIFT_NONE)


def _audit(counts: DataFrame, cols: Sequence[str], high: float, moderate: float, edge_digits: int | None, parts: int | None) -> DataFrame:
    points = _points(counts, parts)
    both = _psi(points, 10, 1e-4, edge_digits).join(_ks(points, 0.05), "feature", "full_outer")
    full = _all_features(both, cols, {"psi": 0.0, "ks_statistic": 0.0, "p_value": 1.0, "ks_drift_detected": False})
    return full.withColumn("drift_status", drift_status(F.col("psi"), high, moderate))


def drift_audit(ref: DataFrame, cur: DataFrame, cols: Sequence[str] | None = None, high: float = fixed.PSI_HIGH,
                moderate: float = fixed.PSI_MODERATE, edge_digits: int | None = None, parts: int | None = None) -> DataFrame:
    """PSI, KS and status per feature; both statistics read the same running counts."""
    cols = shared_numeric(ref, cur, cols)
    return _audit(paired_counts(ref, cur, cols), cols, high, moderate, edge_digits, parts)


def drift_audit_within(df: DataFrame, is_current: Column, cols: Sequence[str], high: float = fixed.PSI_HIGH,
                       moderate: float = fixed.PSI_MODERATE, edge_digits: int | None = None, parts: int | None = None) -> DataFrame:
    """The same for two parts of one table, which is read once."""
    return _audit(side_counts(df, is_current, cols), list(cols), high, moderate, edge_digits, parts)


def drift_verdict(audit: DataFrame) -> DataFrame:
    """One row: features audited, the drifted ones, and whether any drifted."""
    is_high = F.col("drift_status") == fixed.DRIFT_HIGH
    return audit.agg(
        F.count(F.lit(1)).alias("total_features_audited"),
        F.count_if(is_high).alias("high_drift_feature_count"),
        F.array_sort(F.collect_list(F.when(is_high, F.col("feature")))).alias("high_drift_features"),
        F.coalesce(F.bool_or(is_high), F.lit(False)).alias("dataset_drift_detected"),
    )


def performance_decay(df: DataFrame, label: str = fixed.TARGET, prob: str = fixed.PROBABILITY,
                      baseline: float = fixed.PR_AUC_BASELINE, floor: float = fixed.PR_AUC_FLOOR) -> DataFrame:
    metrics = classification_metrics(df, label, prob)
    return metrics.select(
        F.lit(float(baseline)).alias("baseline_pr_auc"),
        F.col("pr_auc").alias("current_pr_auc"),
        F.col("roc_auc").alias("current_roc_auc"),
        F.col("f1_score").alias("current_f1_score"),
        half_even(F.lit(float(baseline)) - F.col("pr_auc"), 4).alias("performance_decay"),
        (F.col("pr_auc") < floor).alias("concept_drift_detected"),
    )


def retrain_decision(audit: DataFrame, decay: DataFrame, floor: float = fixed.PR_AUC_FLOOR, high: float = fixed.PSI_HIGH) -> DataFrame:
    """Retrain when features drifted or quality decayed, with the reasons. ``audit`` is per feature, ``decay`` one row."""
    verdict = drift_verdict(audit).select(
        F.struct("dataset_drift_detected", "high_drift_feature_count").alias("v")
    ).scalar()
    row = decay.withColumn("_v", verdict)
    drifted = F.coalesce(F.col("_v.dataset_drift_detected"), F.lit(False))
    decayed = F.coalesce(F.col("concept_drift_detected"), F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(
                drifted,
                F.concat(F.lit(f"Feature distribution PSI >= {high} in "), F.col("_v.high_drift_feature_count").cast("string"), F.lit(" features.")),
            ),
            F.when(
                decayed,
                F.concat(F.lit("Model PR AUC ("), F.format_string("%.4f", "current_pr_auc"), F.lit(f") fell below threshold ({floor:.4f}).")),
            ),
        )
    )
    return row.select(
        (drifted | decayed).alias("retraining_required"),
        drifted.alias("feature_drift_flag"),
        decayed.alias("concept_drift_flag"),
        reasons.alias("trigger_reasons"),
        F.when(drifted | decayed, fixed.ACTION_RETRAIN).otherwise(fixed.ACTION_KEEP).alias("recommended_action"),
    )


def histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Counts per bin of given ascending edges; the last bin is closed, values outside are left out."""
    v = F.col(value).cast("double")
    marks = F.array(*[F.lit(float(e)) for e in edges])
    inside = df.where((v >= float(edges[0])) & (v <= float(edges[-1])))
    strictly_below = position(marks, v, len(edges))
    on_edge = F.when(F.array_contains(marks, v), 1).otherwise(0)
    bin_no = F.least(strictly_below + on_edge, F.lit(len(edges) - 1))
    return inside.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
