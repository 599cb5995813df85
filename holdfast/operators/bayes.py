"""Gaussian naive Bayes as one aggregate and one projection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.functions.numeric import sigmoid


def fit_gaussian_nb(df: DataFrame, cols: Sequence[str], label: str = fixed.TARGET, smoothing: float = 1e-9) -> DataFrame:
    """One row: class shares, means and smoothed population variances."""
    x = {c: F.col(c).cast("double") for c in cols}
    is_one = F.col(label) == 1

    def per_class(f, test):
        return F.array(*[f(F.when(test, v)) for v in x.values()])

    stats = df.agg(
        (F.count_if(is_one) / F.count(F.lit(1))).alias("share"),
        per_class(F.avg, is_one).alias("mean1"), per_class(F.avg, ~is_one).alias("mean0"),
        per_class(F.var_pop, is_one).alias("raw1"), per_class(F.var_pop, ~is_one).alias("raw0"),
        F.greatest(*[F.var_pop(v) for v in x.values()], F.lit(0.0)).alias("largest"),
    )
    extra = F.col("largest") * F.lit(smoothing)
    return stats.select(
        "share", "mean1", "mean0",
        F.transform("raw1", lambda v: v + extra).alias("var1"),
        F.transform("raw0", lambda v: v + extra).alias("var0"),
    )


def apply_gaussian_nb(df: DataFrame, params: DataFrame, cols: Sequence[str], out: str = "churn_probability") -> DataFrame:
    fitted = params.select(F.struct("*").alias("p")).scalar()
    with_params = df.withColumn("_nb", fitted)

    def log_density(k: int):
        total = F.ln(F.col("_nb.share")) if k == 1 else F.ln(F.lit(1.0) - F.col("_nb.share"))
        for i, c in enumerate(cols):
            mean, var = F.col(f"_nb.mean{k}")[i], F.col(f"_nb.var{k}")[i]
            gap = F.col(c).cast("double") - mean
            total = total - F.lit(0.5) * F.ln(F.lit(2.0 * math.pi) * var) - F.lit(0.5) * gap * gap / var
        return total

    odds = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), log_density(1) - log_density(0)))
    return with_params.withColumn(out, sigmoid(odds)).drop("_nb")
