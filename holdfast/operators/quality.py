"""Data quality profile as long tables: one row per column, value or alert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.functions.numeric import half_even, known, share
from holdfast.plans.running import approx_quantiles, long_form, quantile_row


def having(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")


def _missing(df: DataFrame, name: str):
    missing = F.col(name).isNull()
    return missing | F.isnan(F.col(name)) if dict(df.dtypes)[name] in ("double", "float") else missing


def quality_nulls(df: DataFrame) -> DataFrame:
    """Null count and percentage per column, from one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(_missing(df, c)).alias(c) for c in df.columns],
    )
    long = counts.unpivot(["_rows"], df.columns, "column", "null_count")
    return long.select(
        "column",
        "null_count",
        half_even(share(F.col("null_count"), F.col("_rows")) * 100.0, 2).alias("null_pct"),
        F.col("_rows").alias("total_rows"),
    )


def quality_numeric(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Mean, sample deviation, minimum, quartiles and maximum per column.

    The moments come from one wide pass without unpivoting. The quartiles need an
    order: exact through sliced running counts, or one sketch pass.
    """
    cols = list(cols or having(df, fixed.NUMERICAL))
    values = {c: known(F.col(c).cast("double")) for c in cols}
    moments = df.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"), F.max(v).alias("max"),
            ).alias(c)
            for c, v in values.items()
        ]
    ).select(F.inline(F.array(*cols)))
    qs = [0.25, 0.5, 0.75]
    quartiles = quantile_row(df, cols, qs) if exact else approx_quantiles(long_form(df, cols), "value", qs, ["feature"])
    at = F.col("quantiles")
    return moments.join(quartiles, "feature", "left").select(
        "feature", "mean", "std", "min", at[0].alias("p25"), at[1].alias("median"), at[2].alias("p75"), "max"
    )


def quality_categorical(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Value counts per categorical column, nulls left out."""
    cols = list(cols or having(df, fixed.CATEGORICAL))
    long = long_form(df, cols, kind="string")
    return long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def quality_target(df: DataFrame, target: str = fixed.TARGET) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.sum(F.col(target)).cast("bigint").alias("churn_count"),
        F.avg(target).alias("churn_rate"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier whole row.

    Only 8-byte hashes are shuffled for the whole table. Rows whose hash occurs
    once are unique; the others are compared column by column, so a collision
    cannot count.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*df.columns))
    repeated = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    suspects = hashed.join(repeated.select("_hash"), "_hash", "left_semi")
    groups = suspects.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def quality_alerts(df: DataFrame) -> DataFrame:
    """One row per alert: duplicates first, then every predictor with missing cells."""
    repeats = duplicate_rows(df).where("duplicate_rows > 0").select(
        F.lit("").alias("column"),
        F.format_string("Found %d duplicate customer rows.", "duplicate_rows").alias("alert"),
    )
    nulls = quality_nulls(df).where((F.col("null_count") > 0) & ~F.col("column").isin(*fixed.LEAKAGE))
    gaps = nulls.select(
        "column",
        F.concat(
            F.lit("Predictor column '"), F.col("column"), F.lit("' has "), F.col("null_count").cast("string"),
            F.lit(" ("), F.col("null_pct").cast("string"), F.lit("%) missing values."),
        ).alias("alert"),
    )
    return repeats.unionByName(gaps)


def quality_summary(df: DataFrame) -> DataFrame:
    nulls = quality_nulls(df)
    repeats = duplicate_rows(df).scalar()
    gaps = F.count_if((F.col("null_count") > 0) & ~F.col("column").isin(*fixed.LEAKAGE))
    return (
        nulls.agg(F.max("total_rows").alias("total_rows"), F.count(F.lit(1)).alias("total_columns"), gaps.alias("_gaps"))
        .withColumn("duplicate_rows", repeats)
        .select(
            "total_rows", "total_columns", "duplicate_rows",
            (F.col("_gaps") + F.when(F.col("duplicate_rows") > 0, 1).otherwise(0)).alias("alert_count"),
        )
    )


def signal_check(df: DataFrame, features: Sequence[str], group: str, high: str, low: str, target: str = fixed.TARGET) -> DataFrame:
    """Correlation of features with the label and the label-rate contrast of two groups, in one pass."""
    label = F.col(target).cast("double")
    row = df.agg(
        *[F.corr(F.col(c).cast("double"), label).alias(f"correlation:{c}") for c in features],
        (F.avg(F.when(F.col(group) == high, label)) - F.avg(F.when(F.col(group) == low, label))).alias(
            f"rate contrast:{group}"
        ),
    )
    return row.unpivot([], row.columns, "signal", "strength")
