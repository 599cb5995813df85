"""Inputs that queries and tests derive from the profile: leaky, shifted and messy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.sources.profile import customer_profile


def add_leakage_columns(df: DataFrame, cancelled_on: Column | None = None, reason: Column | None = None) -> DataFrame:
    """Fields that exist only after churn, as functions of the label."""
    churned = F.col(fixed.TARGET) == 1
    return df.withColumns(
        {
            "cancellation_processed_date": F.when(churned, F.lit("2001-06-01") if cancelled_on is None else cancelled_on),
            "final_invoice_flag": F.when(churned, 1).otherwise(0),
            "account_status_deactivated": F.when(churned, 1).otherwise(0),
            "churn_reason_recorded": F.when(churned, F.lit("Relocation") if reason is None else reason),
        }
    )


def scaled_columns(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Multiply columns by constants: a simulated drift of the serving table."""
    return df.withColumns({c: F.col(c) * F.lit(float(k)) for c, k in factors.items()})


def raw_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The profile as a messy text table: padding, unparsable amounts, repeated customers, arrival order."""
    text = add_leakage_columns(customer_profile(spark, folder)).drop(fixed.PROBABILITY)
    key = F.col(fixed.ID)
    messy = text.select(
        key,
        *[
            (
                F.when(key % 7 == 0, F.concat(F.lit(" "), F.col(c).cast("string"), F.lit(" \t"))).otherwise(F.col(c))
                if c in ("partner", "dependents")
                else F.when(key % 11 == 0, "n/a").otherwise(F.col(c).cast("string"))
                if c == "monthly_charges"
                else F.col(c).cast("string")
            ).alias(c)
            for c in text.columns
            if c != fixed.ID
        ],
    )
    copies = F.when(key % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return messy.select("*", F.explode(copies).alias("arrival"))
