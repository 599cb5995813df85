"""Rule-based scores, tiers, money and texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.functions.numeric import at_least, flag, half_even, sigmoid


def clv(
    monthly: Column,
    tenure: Column,
    lifespan: float = fixed.LIFESPAN_MONTHS,
    margin: float = fixed.GROSS_MARGIN,
) -> Column:
    """Lifetime value: monthly charge x remaining months (one at least) x margin."""
    remaining = at_least(F.lit(float(lifespan)) - tenure, 1.0)
    return half_even(monthly * remaining * F.lit(margin), 2)


def dollar_risk(probability: Column, value: Column) -> Column:
    return half_even(probability * value, 2)


def risk_tier(probability: Column, high: float = fixed.TIER_HIGH, medium: float = fixed.TIER_MEDIUM) -> Column:
    return F.when(probability >= high, "High Risk").when(probability >= medium, "Medium Risk").otherwise("Low Risk")


def tier_action(tier: Column) -> Column:
    pairs = [F.lit(x) for pair in fixed.TIER_ACTIONS.items() for x in pair]
    return F.create_map(*pairs)[tier]


def heuristic_score(contract: Column, tickets: Column, price_increase: Column) -> Column:
    score = (
        F.lit(0.1)
        + F.when(contract == "Month-to-month", 0.3).otherwise(0.0)
        + F.when(tickets >= 2, 0.3).otherwise(0.0)
        + F.when(price_increase == "Yes", 0.2).otherwise(0.0)
    )
    return F.least(F.lit(0.99), score)


def stream_score(tickets: Column, failures: Column) -> Column:
    return F.when((tickets >= 2) | (failures >= 1), 0.85).otherwise(0.25)


def alert_severity(probability: Column, critical: float = fixed.ALERT_CRITICAL) -> Column:
    return F.when(probability >= critical, "CRITICAL").otherwise("WARNING")


def call_action(contract: Column, tickets: Column, price_increase: Column) -> Column:
    return (
        F.when((contract == "Month-to-month") & (tickets >= 2), fixed.CALL_CONTRACT)
        .when(price_increase == "Yes", fixed.CALL_PRICE)
        .otherwise(fixed.CALL_REVIEW)
    )


def log_odds_terms() -> dict[str, Column]:
    """Inputs of the documented log-odds, one column per coefficient name."""
    return {
        "is_month_to_month": flag(F.col("contract_type") == "Month-to-month"),
        "support_tickets_30d": F.col("support_tickets_30d"),
        "payment_failures_90d": F.col("payment_failures_90d"),
        "is_dissatisfied": flag(F.col("resolution_satisfaction_score") <= 2),
        "severe_usage_drop": flag(F.col("change_in_usage_pct") < -0.25),
        "price_increase": flag(F.col("price_increase_applied_30d") == "Yes"),
        "competitor_viewed": flag(F.col("competitor_offer_viewed") == "Yes"),
        "low_nps": flag(F.col("nps_score") <= 4),
        "tenure_months": F.col("tenure_months"),
        "auto_pay": flag(F.col("auto_pay_enabled") == "Yes"),
        "retention_accepted": flag(F.col("retention_offer_accepted") == "Yes"),
    }


def ground_truth_score() -> Column:
    """Probability of the documented log-odds, without noise."""
    terms = log_odds_terms()
    total = F.lit(fixed.LOG_ODDS_INTERCEPT)
    for name, weight in fixed.LOG_ODDS.items():
        total = total + F.lit(weight) * terms[name]
    return sigmoid(total)


def percent_text(value: Column, places: int) -> Column:
    """0.1234 as '12.3%', halves to the even digit."""
    return F.format_string(f"%.{places}f%%", half_even(value * 100.0, places))


def title_case(text: Column) -> Column:
    """Capital at the start of every run of letters ('30d asia-pacific' -> '30D Asia-Pacific')."""
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def feature_reason(name: Column, impact: Column) -> Column:
    """Business sentence for a feature; the first known name contained in it decides."""
    direction = F.when(impact > 0, "increasing").otherwise("decreasing")
    percent = percent_text(F.abs(impact), 1)
    plain = title_case(F.regexp_replace(F.regexp_replace(name, "num__|cat__", ""), "_", " "))
    text = None
    for key, sentence in fixed.FEATURE_REASONS.items():
        reason = F.concat(F.lit(f"{sentence} ("), direction, F.lit(" risk by "), percent, F.lit(")"))
        hit = name.contains(key)
        text = F.when(hit, reason) if text is None else text.when(hit, reason)
    return text.otherwise(F.concat(plain, F.lit(" behavior ("), direction, F.lit(" churn risk by "), percent, F.lit(")")))
