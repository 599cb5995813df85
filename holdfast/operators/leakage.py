"""Guard against columns that are known only after churn. All checks read the schema, none runs a job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import fixed


class TargetLeakageError(ValueError):
    """Post-churn columns found where features are expected."""


def audit_leakage(df: DataFrame | Iterable[str]) -> list[str]:
    """Names of leakage columns present, in registry order."""
    columns = set(df.columns if isinstance(df, DataFrame) else df)
    return [c for c in fixed.LEAKAGE if c in columns]


def assert_no_leakage(df: DataFrame) -> DataFrame:
    found = audit_leakage(df)
    if found:
        raise TargetLeakageError(fixed.LEAKAGE_MESSAGE.format(found=found))
    return df


def strip_leakage(df: DataFrame) -> DataFrame:
    return df.drop(*audit_leakage(df))


def leakage_semantics(df: DataFrame, target: str = fixed.TARGET) -> DataFrame:
    """Violations per rule: each leakage field must be set exactly for churned customers."""
    churned = F.col(target) == 1
    rules = {
        "cancellation_processed_date": F.col("cancellation_processed_date").isNotNull(),
        "final_invoice_flag": F.coalesce(F.col("final_invoice_flag") == 1, F.lit(False)),
        "account_status_deactivated": F.coalesce(F.col("account_status_deactivated") == 1, F.lit(False)),
        "churn_reason_recorded": F.col("churn_reason_recorded").isNotNull(),
    }
    counts = df.agg(
        *[
            F.struct(
                F.lit(name).alias("field"),
                F.count_if(churned & ~is_set).alias("missing_for_churned"),
                F.count_if(~churned & is_set).alias("set_for_retained"),
            ).alias(name)
            for name, is_set in rules.items()
        ]
    )
    return counts.select(F.inline(F.array(*rules)))
