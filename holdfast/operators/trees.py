"""Per-row contributions of tree models: how each split on a row's path moved the prediction."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.prep import feature_names, helper_columns
from holdfast.plans.storage import new_path, stored

GROUP_NODES = 500_000


def node_table(spark: SparkSession, classifier) -> DataFrame:
    """Nodes of every tree, read from the model's own saved form."""
    path = new_path(spark, "trees")
    classifier.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    single = "nodeData" not in nodes.columns
    node = nodes if single else nodes.select("treeID", "nodeData.*")
    needed = {"id", "prediction", "impurityStats", "leftChild", "rightChild", "split"}
    if not needed <= set(node.columns):
        raise ValueError(f"saved trees of Spark {spark.version} lack {sorted(needed - set(node.columns))}")
    tree = F.lit(0) if single else F.col("treeID")
    split = F.col("split")
    return node.select(
        tree.alias("tree"), "id", "prediction", "impurityStats", "leftChild", "rightChild",
        split["featureIndex"].alias("feature"), split["leftCategoriesOrThreshold"].alias("threshold"),
        split["numCategories"].alias("categories"),
    )


def tree_groups(sizes: Mapping[int, int], most: int) -> list[list[int]]:
    """Consecutive trees of about ``most`` nodes together; a larger tree is a group of its own."""
    groups: list[list[int]] = []
    held = 0
    for tree in sorted(sizes):
        if not groups or held + sizes[tree] > most:
            groups.append([])
            held = 0
        groups[-1].append(tree)
        held += sizes[tree]
    return groups


def _arrays(rows: list[dict], use_class_share: bool) -> list[tuple[np.ndarray, ...]]:
    by_tree: dict[int, dict[int, dict]] = {}
    for r in rows:
        by_tree.setdefault(r["tree"], {})[r["id"]] = r
    trees = []
    for mine in (by_tree[t] for t in sorted(by_tree)):
        size = max(mine) + 1
        feature, threshold, flipped = np.full(size, -1), np.zeros(size), np.zeros(size, bool)
        left, right, value = np.zeros(size, int), np.zeros(size, int), np.zeros(size)
        for i, r in mine.items():
            stats = r["impurityStats"]
            value[i] = stats[1] / sum(stats) if use_class_share else r["prediction"]
            if r["leftChild"] >= 0:
                categories = -1 if r["categories"] is None else r["categories"]
                if categories > 2:
                    raise ValueError("splits over more than two categories do not occur after one-hot encoding")
                feature[i] = r["feature"]
                if categories == 2:  # a one-hot position: 0 or 1 goes left
                    threshold[i], flipped[i] = 0.5, r["threshold"] == [1.0]
                else:
                    threshold[i] = r["threshold"][0]
                left[i], right[i] = r["leftChild"], r["rightChild"]
        trees.append((feature, threshold, flipped, left, right, value))
    return trees


def _moves(width: int, shared):
    """Column function: how each position moved the prediction over the shared trees."""

    @F.pandas_udf("array<double>")
    def path_moves(features: pd.Series) -> pd.Series:
        trees, weights = shared.value
        x = np.vstack(features.to_numpy())
        moved = np.zeros((len(x), width))
        every = np.arange(len(x))
        for (feature, threshold, flipped, left, right, value), weight in zip(trees, weights):
            at = np.zeros(len(x), int)
            active = every[feature[at] >= 0]
            while len(active):
                here = at[active]
                split_on = feature[here]
                goes_left = (x[active, split_on] <= threshold[here]) != flipped[here]
                below = np.where(goes_left, left[here], right[here])
                moved[active, split_on] += weight * (value[below] - value[here])
                at[active] = below
                active = active[feature[below] >= 0]
        return pd.Series(list(moved))

    return path_moves


def tree_contributions(df: DataFrame, model: PipelineModel, group_nodes: int = GROUP_NODES) -> DataFrame:
    """Add ``contributions`` and ``base_value``; their sum is the model output (probability, or margin if boosted).

    Trees go to the tasks in groups of about ``group_nodes`` nodes. A model of one group (the usual case) takes one
    projection; of more, one pass after the other, each adding its moves to a written table, so that driver and tasks
    hold one group at a time.
    """
    spark, classifier = df.sparkSession, model.stages[-1]
    names = feature_names(model)
    boosted = classifier.__class__.__name__.startswith("GBT")
    nodes = node_table(spark, classifier)
    sizes = {r["tree"]: r["count"] for r in nodes.groupBy("tree").count().collect()}
    given = list(classifier.treeWeights) if boosted else [1.0 / len(sizes)] * len(sizes)
    weights = dict(zip(sorted(sizes), given))
    groups = tree_groups(sizes, group_nodes)

    prepared = PipelineModel(stages=model.stages[:-1]).transform(df)
    prepared = prepared.drop(*helper_columns(prepared))
    wide = prepared.withColumns({"_x": vector_to_array("features"), "_n": F.array(*[F.lit(n) for n in names])}).drop("features")
    base = 0.0
    for at, group in enumerate(groups):
        trees = _arrays([r.asDict() for r in nodes.where(F.col("tree").isin(group)).collect()], not boosted)
        base += float(sum(weights[t] * arrays[5][0] for t, arrays in zip(group, trees)))
        shared = spark.sparkContext.broadcast((trees, [weights[t] for t in group]))
        moved = _moves(len(names), shared)("_x")
        if at == 0:
            wide = wide.withColumn("_moves", moved)
        else:
            wide = wide.withColumn("_more", moved).withColumn("_moves", F.zip_with("_moves", "_more", lambda a, b: a + b)).drop("_more")
        if at + 1 < len(groups):
            wide = stored(wide, "tree-moves")
            shared.destroy()
    zipped = F.arrays_zip(F.col("_n").alias("feature"), F.col("_x").alias("value"), F.col("_moves").alias("impact_score"))
    return wide.withColumns({"contributions": zipped, "base_value": F.lit(base)}).drop("_x", "_n", "_moves")
