"""From counted events to alerts. Every step is a projection or a filter, for tables and streams alike."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.functions import scores
from holdfast.functions.numeric import half_even
from holdfast.operators.explain import explain_model
from holdfast.operators.features import add_domain_features
from holdfast.operators.prep import helper_columns
from holdfast.streaming.counts import last_n_counts, last_n_counts_stream
from holdfast.streaming.last_events import LastEvents


def event_overrides() -> dict[str, Column]:
    """What the recent events say about the customer."""
    tickets = F.col("tickets")
    return {
        "support_tickets_30d": F.greatest(F.lit(1), tickets).cast("int"),
        "support_tickets_90d": F.greatest(F.lit(2), tickets * 2).cast("int"),
        "resolution_satisfaction_score": F.when(tickets > 1, 1.5).otherwise(3.5),
        "payment_failures_90d": F.col("payment_failures").cast("int"),
        "change_in_usage_pct": F.when(F.col("usage_drops") > 0, -0.45).otherwise(0.0),
        "competitor_offer_viewed": F.when(F.col("competitor_views") > 0, "Yes").otherwise("No"),
        "price_increase_applied_30d": F.when(F.col("event_type") == "price_increase_notified", "Yes").otherwise("No"),
    }


def profile_template(**overrides: Any) -> dict[str, Column]:
    """The standard profile as columns, with overrides (constants or columns)."""
    values = {**fixed.EVENT_PROFILE, **overrides}
    return {n: v if isinstance(v, Column) else F.lit(v) for n, v in values.items()}


def event_profiles(counted: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """One profile row per event: the overrides, over the stored profile if there is one, over the template."""
    derived = counted.withColumns({f"_{n}": c for n, c in event_overrides().items()})
    own = {n: F.col(f"_{n}") for n in event_overrides()}
    kept = ["event_id", "customer_id", "ts", "event_type", "tickets", "payment_failures"]
    if profiles is None:
        full = derived.select(*kept, *[c.alias(n) for n, c in profile_template(**own).items()])
        return full
    known = [c for c in fixed.EVENT_PROFILE if c in profiles.columns and c not in own]
    stored = profiles.select("customer_id", *[F.col(c).alias(f"_p_{c}") for c in known])
    joined = derived.join(stored, "customer_id", "left")
    mixed = {c: F.coalesce(F.col(f"_p_{c}"), F.lit(fixed.EVENT_PROFILE[c])) for c in known}
    return joined.select(*kept, *[c.alias(n) for n, c in profile_template(**mixed, **own).items()])


def score_events(counted: DataFrame, profiles: DataFrame | None = None, model: PipelineModel | None = None) -> DataFrame:
    """Features, probability and lifetime value per event."""
    featured = add_domain_features(event_profiles(counted, profiles))
    if model is None:
        p = scores.stream_score(F.col("tickets"), F.col("payment_failures"))
        scored = featured.withColumn("churn_probability", p)
    else:
        scored = model.transform(featured).withColumn("churn_probability", vector_to_array("probability")[1])
        scored = scored.drop("features", "rawPrediction", "probability", "prediction", *helper_columns(scored))
    return scored.withColumn("clv", scores.clv(F.col("monthly_charges"), F.col("tenure_months")))


def alert_payload(scored: DataFrame, threshold: float = fixed.ALERT_THRESHOLD, reasons: Column | None = None) -> DataFrame:
    """Alerts for events at or above the threshold. Id and time come from the event, so a replay repeats them."""
    p, value = F.col("churn_probability"), F.col("clv")
    texts = F.array(*[F.lit(r) for r in fixed.ALERT_REASONS]) if reasons is None else reasons
    return scored.where(p >= threshold).select(
        F.concat(F.lit("ALT-"), F.col("event_id").cast("string")).alias("alert_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        scores.alert_severity(p).alias("severity"),
        "customer_id",
        half_even(p, 4).alias("churn_probability"),
        half_even(value, 2).alias("estimated_clv"),
        half_even(p * value, 2).alias("revenue_at_risk"),
        texts.alias("primary_churn_reasons"),
        F.lit(fixed.TIER_ACTIONS["High Risk"]).alias("recommended_action"),
        F.lit(fixed.ALERT_CHANNEL).alias("channel"),
    )


def alerts_of(counted: DataFrame, threshold: float = fixed.ALERT_THRESHOLD, profiles: DataFrame | None = None,
              model: PipelineModel | None = None, means: Sequence[float] | None = None) -> DataFrame:
    """Alerts from counted events. With a model, each alert carries the three features that moved its own score most.

    Only events at the threshold are explained. ``means`` of the training table (``explain.feature_means``) are the
    background of a linear model; trees need none.
    """
    scored = score_events(counted, profiles, model)
    if model is None:
        return alert_payload(scored, threshold)
    if means is None and hasattr(model.stages[-1], "coefficients"):
        raise ValueError("alerts of a linear model need the means of its training table")
    explained = explain_model(scored.where(F.col("churn_probability") >= threshold), model, 3, means)
    return alert_payload(explained, threshold, F.col("top_drivers.business_reason"))


def event_alerts(events: DataFrame, threshold: float = fixed.ALERT_THRESHOLD, last_n: int = fixed.BUFFER_EVENTS, profiles: DataFrame | None = None,
                 model: PipelineModel | None = None, means: Sequence[float] | None = None, **options) -> DataFrame:
    """Alerts from customer events, as a table or as a stream with keyed state (see ``watch_alerts`` for busy customers)."""
    counted = last_n_counts_stream(events, last_n, **options) if events.isStreaming else last_n_counts(events, last_n, **options)
    return alerts_of(counted, threshold, profiles, model, means)


def watch_alerts(path: str, threshold: float = fixed.ALERT_THRESHOLD, last_n: int = fixed.BUFFER_EVENTS, profiles: DataFrame | None = None,
                 model: PipelineModel | None = None, means: Sequence[float] | None = None, **options) -> LastEvents:
    """Alerts of a stream whose state is a table below ``path``: no task holds a whole customer."""
    return LastEvents(path, last_n, then=lambda counted: alerts_of(counted, threshold, profiles, model, means), **options)


def alert_totals(events: DataFrame, alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count(F.lit(1)).alias("alert_count")).withColumn(
        "event_count", events.agg(F.count(F.lit(1)).alias("n")).scalar()
    )
