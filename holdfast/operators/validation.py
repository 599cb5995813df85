"""Scoring requests: defaults, bounds and allowed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import fixed

WHOLE = ["senior_citizen", "tenure_months", "support_tickets_30d", "app_logins_30d", "payment_failures_90d"]


def with_request_defaults(df: DataFrame) -> DataFrame:
    """Every field of the request contract; a field that is absent or null takes its default."""
    defaults = {n: d for n, (_, d) in fixed.REQUEST_CHOICES.items()}
    defaults |= {n: d for n, (_, _, d) in fixed.REQUEST_BOUNDS.items()}
    kinds = dict(df.dtypes)

    def filled(name: str, default) -> Column:
        if name not in kinds:
            return F.lit(default)
        return F.coalesce(F.col(name), F.lit(str(default) if kinds[name] == "string" else default))

    return df.withColumns({n: filled(n, d) for n, d in defaults.items()})


def _choice_reason(name: str, allowed: list[str]) -> Column:
    return F.when(~F.col(name).isin(*allowed), F.lit(f"{name}: not one of {', '.join(allowed)}"))


def _bound_reasons(name: str, low, high, text: bool) -> list[Column]:
    value = F.expr(f"try_cast(`{name}` as double)") if text else F.col(name)
    reasons = [F.when(value < low, F.lit(f"{name}: below {low}")), F.when(value > high, F.lit(f"{name}: above {high}"))]
    if text:
        reasons.append(F.when(value.isNull(), F.lit(f"{name}: not a number")))
    if name in WHOLE:
        reasons.append(F.when(value != F.floor(value), F.lit(f"{name}: not a whole number")))
    return reasons


def validate_requests(df: DataFrame) -> DataFrame:
    """Fill defaults and add ``reasons``: an empty array means the request is valid."""
    full = with_request_defaults(df)
    kinds = dict(full.dtypes)
    checks = [_choice_reason(n, allowed) for n, (allowed, _) in fixed.REQUEST_CHOICES.items()]
    for name, (low, high, _) in fixed.REQUEST_BOUNDS.items():
        checks += _bound_reasons(name, low, high, kinds[name] == "string")
    return full.withColumn("reasons", F.array_compact(F.array(*checks)))


def valid_requests(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") == 0).drop("reasons")


def rejected_requests(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") > 0)
