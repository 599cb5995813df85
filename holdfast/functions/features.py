"""Derived customer features as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.fixed import FEATURE_DEFAULTS
from holdfast.functions.numeric import at_least, flag, half_even, known


def column_or_default(name: str, columns: Sequence[str], *aliases: str) -> Column:
    """The column, else the first alias the table has, else the documented constant."""
    for candidate in (name, *aliases):
        if candidate in columns:
            return F.col(candidate)
    return F.lit(FEATURE_DEFAULTS[name])


def ratio_features(columns: Sequence[str]) -> dict[str, Column]:
    tenure = at_least(column_or_default("tenure_months", columns), 1)
    if "total_charges" in columns:
        total = F.col("total_charges")
    else:
        total = F.col("monthly_charges") * F.col("tenure_months")
    recent = column_or_default("support_tickets_30d", columns)
    quarter = F.col("support_tickets_90d") if "support_tickets_90d" in columns else recent * 3
    days = at_least(column_or_default("active_days_per_month", columns), 1)
    traffic = column_or_default("avg_monthly_gb_download", columns)
    return {
        "charges_per_tenure": half_even(total / tenure, 2),
        "monthly_to_total_ratio": half_even(F.col("monthly_charges") / at_least(total, 1.0), 4),
        "support_tickets_per_tenure": half_even(quarter / tenure, 3),
        "gb_per_active_day": half_even(traffic / days, 2),
    }


def flag_features(columns: Sequence[str]) -> dict[str, Column]:
    days = at_least(known(column_or_default("active_days_per_month", columns)), 1)
    logins = known(column_or_default("login_frequency_30d", columns, "app_logins_30d"))
    failures = known(column_or_default("payment_failures_90d", columns))
    late = known(column_or_default("late_payments_12m", columns))
    return {
        "has_high_support_tickets": flag(known(column_or_default("support_tickets_30d", columns)) >= 3),
        "is_dissatisfied": flag(known(column_or_default("resolution_satisfaction_score", columns)) <= 2),
        "severe_usage_drop": flag(known(column_or_default("change_in_usage_pct", columns)) < -0.25),
        "low_engagement_flag": flag((days <= 5) & (logins <= 3)),
        "has_payment_issue": flag((failures > 0) | (late > 0)),
        "is_month_to_month": flag(column_or_default("contract_type", columns) == "Month-to-month"),
    }


def risk_score_index() -> Column:
    """0..9; reads the flags above, so they must be columns already."""
    doubled = ["has_high_support_tickets", "is_dissatisfied", "severe_usage_drop", "has_payment_issue"]
    return sum((F.col(c) * 2 for c in doubled), F.col("is_month_to_month"))


def tenure_band(tenure: Column) -> Column:
    """Half-open bands (-1,6], (6,12], (12,24], (24,72]; null outside."""
    return (
        F.when((tenure > -1) & (tenure <= 6), "0-6 Months")
        .when((tenure > 6) & (tenure <= 12), "6-12 Months")
        .when((tenure > 12) & (tenure <= 24), "12-24 Months")
        .when((tenure > 24) & (tenure <= 72), "24+ Months")
    )
