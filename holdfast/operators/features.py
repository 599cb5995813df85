"""Domain features of customer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import features
from holdfast.operators.leakage import strip_leakage


def add_domain_features(df: DataFrame, guard: bool = True) -> DataFrame:
    """Add ratios, flags and the risk index; with ``guard`` leakage columns are dropped first."""
    if guard:
        df = strip_leakage(df)
    known = df.columns
    wide = df.withColumns({**features.ratio_features(known), **features.flag_features(known)})
    return wide.withColumn("risk_score_index", features.risk_score_index())


def add_tenure_band(df: DataFrame) -> DataFrame:
    if "tenure_months" not in df.columns:
        return df
    return df.withColumn("tenure_band", features.tenure_band(F.col("tenure_months")))
