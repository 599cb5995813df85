"""Explanations: global drivers, per-row contributions, partial dependence."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.functions.numeric import half_even
from holdfast.functions.scores import feature_reason, risk_tier, tier_action
from holdfast.operators.prep import feature_names, helper_columns
from holdfast.plans.running import exact_quantiles


def global_importances(model: PipelineModel) -> DataFrame:
    """(feature, importance, position) of the fitted classifier, strongest first, equal ones by vector position."""
    from pyspark.sql import SparkSession

    names, classifier = feature_names(model), model.stages[-1]
    if hasattr(classifier, "featureImportances"):
        values = classifier.featureImportances.toArray()
    elif hasattr(classifier, "coefficients"):
        values = classifier.coefficients.toArray()
    else:
        values = [1.0] * len(names)
    rows = [(n, float(v), i) for i, (n, v) in enumerate(zip(names, values))]
    spark = SparkSession.getActiveSession()
    table = spark.createDataFrame(rows, "feature string, importance double, position int")
    return table.orderBy(F.desc(F.abs("importance")), "position")


def tie_column(importances: DataFrame) -> str:
    """What orders equal importances: the position in the model, or the name where none is given."""
    return "position" if "position" in importances.columns else "feature"


def top_drivers(importances: DataFrame, top_k: int) -> Column:
    """Scalar subquery: array of (feature, importance), strongest first."""
    tie = tie_column(importances)
    strongest = importances.orderBy(F.desc(F.abs("importance")), tie).limit(top_k)
    ordered = F.array_sort(F.collect_list(F.struct((-F.abs("importance")).alias("o"), F.col(tie).alias("t"), "feature", "importance")))
    return strongest.agg(ordered.alias("d")).scalar()


def narrative(reasons: Column) -> Column:
    return F.concat(F.lit("Primary churn drivers: "), F.array_join(F.slice(reasons, 1, 3), "; "), F.lit("."))


def explain_global(df: DataFrame, importances: DataFrame, values: Sequence[str], top_k: int = 4) -> DataFrame:
    """The model's strongest features with every row's own values, reasons and a narrative.

    The drivers are the same for all rows (they are global); ``explain_linear`` and
    ``explain_trees`` give real per-row contributions.
    """
    own = F.create_map(*[x for c in values for x in (F.lit(c), F.col(c).cast("string"))])
    wide = df.withColumns({"_top": top_drivers(importances, top_k), "_own": own})
    drivers = F.transform(
        "_top",
        lambda t: F.struct(
            t["feature"].alias("feature"),
            F.try_element_at(F.col("_own"), t["feature"]).alias("value"),
            t["importance"].alias("impact_score"),
            feature_reason(t["feature"], t["importance"]).alias("business_reason"),
        ),
    )
    out = wide.withColumn("top_drivers", drivers).drop("_top", "_own")
    return out.withColumn("summary_narrative", narrative(F.col("top_drivers.business_reason")))


def rank_drivers(df: DataFrame, contributions: str, top_k: int) -> DataFrame:
    """Turn an array of (feature, value, impact_score) into the ``top_k`` drivers with reasons; equal ones in array order."""
    ordered = F.sort_array(
        F.transform(
            contributions,
            lambda c, i: F.struct(
                (-F.abs(c["impact_score"])).alias("o"), i.alias("i"), c["feature"].alias("feature"), c["value"].alias("value"), c["impact_score"].alias("impact_score")
            ),
        )
    )
    drivers = F.transform(
        F.slice(ordered, 1, top_k),
        lambda c: F.struct(
            c["feature"].alias("feature"), c["value"].alias("value"), c["impact_score"].alias("impact_score"),
            feature_reason(c["feature"], c["impact_score"]).alias("business_reason"),
        ),
    )
    out = df.withColumn("top_drivers", drivers)
    return out.withColumn("summary_narrative", narrative(F.col("top_drivers.business_reason")))


def linear_contributions(df: DataFrame, weights: Mapping[str, float], terms: Mapping[str, Column], digits: int | None = None) -> DataFrame:
    """Add ``contributions``: weight x (value - mean) per term, the exact attribution of a linear score."""
    means = df.agg(F.struct(*[F.avg(t.cast("double")).alias(n) for n, t in terms.items()]).alias("m")).scalar()
    parts = []
    for name, weight in weights.items():
        impact = F.lit(float(weight)) * (terms[name].cast("double") - F.col("_means")[name])
        impact = impact if digits is None else F.round(impact, digits)
        parts.append(F.struct(F.lit(name).alias("feature"), terms[name].cast("double").alias("value"), impact.alias("impact_score")))
    return df.withColumn("_means", means).withColumn("contributions", F.array(*parts)).drop("_means")


def explain_linear(df: DataFrame, weights: Mapping[str, float], terms: Mapping[str, Column], top_k: int = 4, digits: int | None = None) -> DataFrame:
    return rank_drivers(linear_contributions(df, weights, terms, digits), "contributions", top_k)


def mean_abs_contribution(df: DataFrame, names: Sequence[str], contributions: str = "contributions") -> DataFrame:
    """Mean absolute contribution per feature: one wide aggregate, rows are not exploded."""
    row = df.agg(
        *[
            F.struct(F.lit(n).alias("feature"), F.avg(F.abs(F.col(contributions)[i]["impact_score"])).alias("importance")).alias(f"c{i}")
            for i, n in enumerate(names)
        ]
    )
    table = row.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(names))])))
    return table.orderBy(F.desc("importance"), "feature")


def feature_means(df: DataFrame, model: PipelineModel) -> list[float]:
    """Mean of every vector position: the background that linear contributions are measured from."""
    prepared = PipelineModel(stages=model.stages[:-1]).transform(df)
    return [float(v) for v in prepared.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()]


def explain_model(df: DataFrame, model: PipelineModel, top_k: int = 4, means: Sequence[float] | None = None) -> DataFrame:
    """Per-row contributions of a fitted pipeline whose classifier is linear or made of trees.

    Linear contributions are measured from ``means`` (of the training table, say), else from the means of ``df``. With
    ``means`` given, and for trees, every row is explained on its own, so streams and single rows get the same reasons.
    """
    names = feature_names(model)
    classifier = model.stages[-1]
    if hasattr(classifier, "coefficients"):
        prepared = PipelineModel(stages=model.stages[:-1]).transform(df)
        prepared = prepared.drop(*helper_columns(prepared))
        weights = [float(w) for w in classifier.coefficients.toArray()]
        if means is None:
            background = prepared.agg(vector_to_array(Summarizer.mean(F.col("features"))).alias("m")).scalar()
        else:
            background = F.array(*[F.lit(float(m)) for m in means])
        x = vector_to_array("features")
        wide = prepared.withColumns({"_x": x, "_means": background, "_w": F.array(*[F.lit(w) for w in weights]), "_n": F.array(*[F.lit(n) for n in names])})
        impact = F.zip_with(F.zip_with("_x", "_means", lambda a, m: a - m), "_w", lambda gap, w: gap * w)
        wide = wide.withColumn("contributions", F.transform(
            F.arrays_zip(F.col("_n").alias("feature"), F.col("_x").alias("value"), impact.alias("impact_score")),
            lambda z: F.struct(z["feature"].alias("feature"), z["value"].alias("value"), z["impact_score"].alias("impact_score")),
        )).drop("_x", "_means", "_w", "_n", "features")
        return rank_drivers(wide, "contributions", top_k)
    from holdfast.operators.trees import tree_contributions

    return rank_drivers(tree_contributions(df, model), "contributions", top_k)


def explain_customer(explained: DataFrame, customer_id) -> DataFrame:
    """The stored explanation of one customer; the filter is pushed below the explanation."""
    return explained.where(F.col(fixed.ID) == customer_id)


def explanation_record(explained: DataFrame, prob: str = fixed.PROBABILITY, key: str = fixed.ID) -> DataFrame:
    """What a retention desk sees of every explained customer: probability, tier, action, narrative and drivers."""
    tier = risk_tier(F.col(prob))
    reasons = F.array_join(F.slice(F.col("top_drivers.business_reason"), 1, 3), "; ")
    return explained.select(
        key,
        half_even(F.col(prob), 4).alias("churn_probability"),
        tier.alias("risk_level"),
        tier_action(tier).alias("recommended_retention_action"),
        F.concat(F.lit("Primary churn drivers for customer "), F.col(key).cast("string"), F.lit(": "), reasons, F.lit(".")).alias("summary_narrative"),
        "top_drivers",
    )


def grid_values(df: DataFrame, feature: str, resolution: int = 20) -> list[float]:
    """Distinct values if there are few, else even steps between the 5 % and 95 % quantile. A bounded fit step."""
    value = F.col(feature).cast("double")
    known = df.select(value.alias("v")).where(value.isNotNull())
    few = known.distinct().limit(resolution).collect()
    if len(few) < resolution:
        return sorted(r["v"] for r in few)
    low, high = exact_quantiles(known, "v", [0.05, 0.95], rule="mquantiles").first()["quantiles"]
    step = (high - low) / (resolution - 1)
    return [low + i * step for i in range(resolution - 1)] + [high]


def partial_dependence(df: DataFrame, score: Callable[[DataFrame], Column], feature: str, resolution: int = 20,
                       grid: Sequence[float] | None = None) -> DataFrame:
    """Average score when ``feature`` is set to each grid value for every row.

    Rows are repeated for the grid inside the scan task and averaged before the
    shuffle: no join, and what is shuffled is one row per task and grid value.
    """
    points = list(grid) if grid is not None else grid_values(df, feature, resolution)
    kind = dict(df.dtypes)[feature]
    kind = "double" if kind in ("int", "bigint") and any(p != int(p) for p in points) else kind
    repeated = df.withColumn("_grid", F.explode(F.array(*[F.lit(float(p)) for p in points])))
    changed = repeated.withColumn(feature, F.col("_grid").cast(kind))
    return changed.groupBy(F.lit(feature).alias("feature"), F.col("_grid").alias("grid_value")).agg(
        F.avg(score(changed)).alias("average_predicted_probability")
    )
