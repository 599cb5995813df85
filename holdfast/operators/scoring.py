"""Scoring whole tables of customers or requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.functions import scores
from holdfast.functions.numeric import half_even, money_sum
from holdfast.operators.explain import explain_model, tie_column
from holdfast.operators.features import add_domain_features
from holdfast.operators.prep import helper_columns
from holdfast.operators.validation import with_request_defaults


def add_decision(df: DataFrame, prob: str = "_p") -> DataFrame:
    """Prediction, tier, lifetime value and action for a probability column."""
    p = F.col(prob)
    tier = scores.risk_tier(p)
    return df.withColumns(
        {
            "churn_probability": half_even(p, 4),
            "churn_prediction": F.when(p >= 0.5, 1).otherwise(0),
            "risk_level": tier,
            "estimated_clv": scores.clv(F.col("monthly_charges"), F.col("tenure_months")),
            "recommended_retention_action": scores.tier_action(tier),
        }
    )


def score_customers(df: DataFrame, model: PipelineModel | None = None, version: str | None = None, importances: DataFrame | None = None,
                    own_reasons: bool = False, means: Sequence[float] | None = None) -> DataFrame:
    """Score every row: with the fitted pipeline, else with the rule-based fallback.

    A pure projection: no shuffle, the key stays on its row. Fields of the request
    contract that are absent or null take their defaults first. With
    ``importances`` (feature, importance) the reasons are the three strongest
    features, the same for all rows; with ``own_reasons`` they are those that
    moved the row's own score most (``means``: see ``explain_model``).
    """
    full = with_request_defaults(df)
    if model is None:
        p = scores.heuristic_score(F.col("contract_type"), F.col("support_tickets_30d"), F.col("price_increase_applied_30d"))
        reasons = F.array(*[F.lit(r) for r in fixed.HEURISTIC_REASONS])
        version = version or fixed.HEURISTIC_VERSION
        scored = full.withColumn("_p", p)
    else:
        featured = add_domain_features(full)
        if own_reasons:
            explained = explain_model(featured, model, 3, means)
            featured = explained.withColumn("_reasons", F.col("top_drivers.business_reason"))
            featured = featured.drop("contributions", "base_value", "top_drivers", "summary_narrative")
        scored = model.transform(featured)
        scored = scored.withColumn("_p", vector_to_array("probability")[1]).drop(*helper_columns(scored))
        if own_reasons:
            reasons = F.col("_reasons")
        else:
            reasons = F.array().cast("array<string>") if importances is None else top_reasons(importances, 3)
    decided = add_decision(scored).withColumns(
        {"top_business_reasons": reasons, "model_version": F.lit(version or "unversioned")}
    )
    return decided.drop("_p", "_reasons", "features", "rawPrediction", "probability", "prediction")


def top_reasons(importances: DataFrame, top_k: int):
    """Scalar subquery with the reason texts of the strongest features (one row per model feature: bounded)."""
    tie = tie_column(importances)
    texts = (
        importances.select("importance", F.col(tie).alias("tie"), scores.feature_reason(F.col("feature"), F.col("importance")).alias("reason"))
        .orderBy(F.desc(F.abs("importance")), "tie")
        .limit(top_k)
        .agg(F.array_sort(F.collect_list(F.struct((-F.abs("importance")).alias("o"), "tie", "reason"))).alias("r"))
    )
    return texts.select(F.col("r.reason").alias("r")).scalar()


def batch_summary(scored: DataFrame) -> DataFrame:
    predicted = F.col("churn_prediction") == 1
    return scored.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(predicted).alias("predicted_churn_count"),
        F.count_if(F.col("churn_probability") >= fixed.TIER_HIGH).alias("high_risk_count"),
        F.coalesce(money_sum(F.when(predicted, F.col("estimated_clv"))), F.lit(0.0)).alias("total_revenue_at_risk"),
    )


def scoring_counters(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("requests_total"),
        F.count(F.lit(1)).alias("predictions_total"),
        F.count_if(F.col("risk_level") == "High Risk").alias("high_risk_total"),
    )


def customer_detail(scored: DataFrame, customer_id) -> DataFrame:
    """Key figures and profile fields of one stored customer (the filter reaches the scan)."""
    p, value = F.col("churn_probability"), F.col("clv")
    return scored.where(F.col(fixed.ID) == customer_id).select(
        fixed.ID, "churn_probability", "clv", scores.dollar_risk(p, value).alias("expected_revenue_risk"),
        "tenure_months", "contract_type", "monthly_charges", "support_tickets_30d",
        F.when(p >= 0.5, 1).otherwise(0).alias("churn_prediction"),
    )


def first_ids(df: DataFrame, n: int = 50, key: str = fixed.ID) -> DataFrame:
    """The first ``n`` customer ids, for a picker: top-n per task, then one merge."""
    return df.select(key).orderBy(key).limit(n)


def highest_risk(df: DataFrame, prob: str = fixed.PROBABILITY, key: str = fixed.ID) -> DataFrame:
    """The row with the highest probability (lowest key among equals): top-1 per task, then one merge."""
    return df.orderBy(F.desc(prob), key).limit(1)


def what_if(df: DataFrame, scenarios: dict[str, dict[str, object]]) -> DataFrame:
    """Score every row under each named change of inputs: rows are expanded by the few scenarios in place."""
    changed = sorted({c for change in scenarios.values() for c in change})
    options = [
        F.struct(F.lit(name).alias("scenario"), *[
            (change[c] if not isinstance(change.get(c), (int, float, str)) and c in change else F.lit(change[c]) if c in change else F.col(c)).alias(c)
            for c in changed
        ])
        for name, change in scenarios.items()
    ]
    rest = [c for c in df.columns if c not in changed]
    return score_customers(df.select(*rest, F.inline(F.array(*options))))
