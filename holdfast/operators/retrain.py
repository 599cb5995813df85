"""One retraining cycle: clean, derive, split, fit, register, compare with the champion, promote."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.operators import models, registry
from holdfast.operators.cleaning import clean_customers
from holdfast.operators.features import add_domain_features
from holdfast.operators.prep import apply_preprocessor, fit_preprocessor
from holdfast.operators.splits import stratified_split


def retrain_cycle(df: DataFrame, path: str, margin: float = fixed.GATE_MARGIN, seed: int = 42, tag: str | None = None,
                  estimator: Estimator | None = None, rounds: int = 20, max_rounds: int = 500, order_col: str | None = None) -> DataFrame:
    """Fit a challenger on 75 % of a customer table and promote it if it passes the gate. Returns the decision.

    Of repeated customers the first by ``order_col`` stays; without one, the first by all columns.
    """
    spark = df.sparkSession
    if order_col is None:
        order_col = "_order"
        df = df.withColumn(order_col, F.to_json(F.struct(*sorted(df.columns))))
    featured = add_domain_features(clean_customers(df, order_col=order_col)).drop("_order")
    with models.kept(stratified_split(featured, 0.25, seed=seed)) as parts:
        train, valid = parts.where("is_test = 0"), parts.where("is_test = 1")
        prep = fit_preprocessor(train)
        table, held_out = (apply_preprocessor(t, prep).select(fixed.TARGET, "features") for t in (train, valid))
        if estimator is None:
            classifier = models.fit_early_stop(table, held_out, rounds=rounds, preset="ordered", max_rounds=max_rounds, seed=seed)
        else:
            classifier = models.fit_estimator(models.add_balanced_weight(table), estimator)
        found = models.measure(models.add_probability(classifier, held_out))
    metrics = {m: float(found[m]) for m in [*models.CURVE, "brier_score"]}
    tag = tag or f"v1_{datetime.now(timezone.utc).strftime('%Y%m%d%H%M%S%f')}"
    model = PipelineModel(stages=[*prep.stages, classifier])
    registry.register_model(spark, path, model, tag, metrics, "Challenger model candidate")
    decision = registry.challenge(spark, path, tag, margin=margin)
    active = registry.active_versions(spark, path)[0]
    return decision.withColumn("active_champion_version", F.lit(active))
