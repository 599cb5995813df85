"""Model versions as an append-only log; champion and predecessor are derived, never stored."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import fixed
from holdfast.functions.numeric import half_even
from holdfast.functions.scores import percent_text
from holdfast.plans.storage import create_file

REGISTER, PROMOTE, ROLLBACK = "register", "promote", "rollback"

SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("version_tag", T.StringType()),
        T.StructField("filepath", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("description", T.StringType()),
    ]
)


def registry_state(log: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Active and previous version after all actions, per registry.

    A promotion pushes the active version down; a rollback swaps the two (and does
    nothing while there is no previous one). So the version under a promotion is
    the last promotion that was not swapped away: one followed by an even number
    of rollbacks, or the very first one. ``groups`` name registries whose logs are
    short; without groups the log is one registry.
    """
    order = Window.partitionBy(*groups).orderBy("seq")
    is_promotion = F.when(F.col("action") == PROMOTE, 1).otherwise(0)
    moves = log.where(F.col("action").isin(PROMOTE, ROLLBACK))
    numbered = moves.withColumn("_stint", F.sum(is_promotion).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    stints = (
        numbered.where(F.col("_stint") > 0)
        .groupBy(*groups, "_stint")
        .agg(
            F.max(F.when(F.col("action") == PROMOTE, F.col("version_tag"))).alias("version"),
            F.count_if(F.col("action") == ROLLBACK).alias("swaps"),
        )
    )
    earlier = Window.partitionBy(*groups).orderBy("_stint").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.when((F.col("swaps") % 2 == 0) | (F.col("_stint") == 1), F.col("version"))
    below = stints.withColumn("below", F.last(kept, ignorenulls=True).over(earlier))
    swapped = (F.col("swaps") % 2 == 1) & F.col("below").isNotNull()
    final = below.select(
        *groups,
        "_stint",
        F.when(swapped, F.col("below")).otherwise(F.col("version")).alias("active_version"),
        F.when(swapped, F.col("version")).otherwise(F.col("below")).alias("previous_version"),
    )
    last = final.groupBy(*groups).agg(F.max_by(F.struct("active_version", "previous_version"), "_stint").alias("s"))
    return last.where(F.col("s").isNotNull()).select(*groups, "s.active_version", "s.previous_version")


def gate(pairs: DataFrame, margin: float = fixed.GATE_MARGIN, champion: str = "champion_pr_auc", challenger: str = "challenger_pr_auc") -> DataFrame:
    """Champion against challenger: the first model wins, later ones need a relative gain of ``margin``."""
    old, new = F.col(champion), F.col(challenger)
    gain = (new - old) / F.greatest(old, F.lit(1e-6))
    passed = F.when(old.isNull(), True).otherwise(gain >= margin)
    required = f"{margin * 100:.1f}%"
    reason = (
        F.when(old.isNull(), fixed.GATE_FIRST)
        .when(
            gain >= margin,
            F.concat(F.lit("Challenger outperformed Champion by "), percent_text(gain, 2), F.lit(f" (Threshold >= {required}).")),
        )
        .otherwise(
            F.concat(F.lit("Challenger failed gate (Gain: "), percent_text(gain, 2), F.lit(f" vs Required: {required}). Champion retained."))
        )
    )
    return pairs.withColumns(
        {
            "gate_passed": passed,
            "relative_gain_pct": F.when(old.isNull(), 0.0).otherwise(half_even(gain, 4) * 100.0),
            "gate_reason": reason,
        }
    )


# ---- the stored registry ------------------------------------------------------------------------------


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """All actions: one small file each, named by its number."""
    try:
        return spark.read.schema(SCHEMA).json(f"{path}/log")
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


def commit(spark: SparkSession, path: str, decide: Callable[[DataFrame], Mapping | None]) -> Mapping | None:
    """Append one action, decided on the log as it stands.

    ``decide`` sees all earlier actions and returns the fields of the new one, or None for no action. The action becomes
    the file of the next number, which can be created once: if another writer was faster, the log is read again and
    ``decide`` is asked again. So numbers are unique and every action was decided knowing all actions before it.
    """
    while True:
        log = read_registry(spark, path)
        seq = (log.agg(F.max("seq")).first()[0] or 0) + 1
        action = decide(log)
        if action is None:
            return None
        stamp = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        row = {"seq": seq, "timestamp": stamp, **action}
        if create_file(spark, f"{path}/log/{seq:012d}.json", json.dumps(row) + "\n"):
            return row


def files_digest(spark: SparkSession, folder: str) -> str:
    """SHA-256 over the sorted digests of all files below a saved model."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    digests = files.select(F.sha2("content", 256).alias("h"))
    return digests.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256)).first()[0]


def register_model(spark: SparkSession, path: str, model: PipelineModel, tag: str, metrics: Mapping[str, float],
                   description: str = "Candidate model version") -> DataFrame:
    """Save the whole pipeline (preprocessing included) and append its registration."""
    file = f"{path}/models/{tag}"
    model.write().overwrite().save(file)
    entry = {
        "action": REGISTER, "version_tag": tag, "filepath": file, "sha256": files_digest(spark, file),
        "metrics": {k: float(v) for k, v in metrics.items()}, "description": description,
    }
    commit(spark, path, lambda log: entry)
    return read_registry(spark, path)


def _registered(log: DataFrame, tag: str) -> DataFrame:
    return log.where((F.col("action") == REGISTER) & (F.col("version_tag") == tag))


def promote(spark: SparkSession, path: str, tag: str) -> DataFrame:
    def decide(log: DataFrame) -> Mapping:
        if _registered(log, tag).isEmpty():
            raise ValueError(f"Version '{tag}' not found in model registry!")
        return {"action": PROMOTE, "version_tag": tag}

    commit(spark, path, decide)
    return read_registry(spark, path)


def challenge(spark: SparkSession, path: str, tag: str, metric: str = "pr_auc", margin: float = fixed.GATE_MARGIN) -> DataFrame:
    """Put a registered version through the gate against the champion and promote it if it passes. Returns the decision.

    If the champion changes meanwhile, the gate is asked again with the new one: two challengers never both beat the
    same champion.
    """
    decisions: list[DataFrame] = []

    def decide(log: DataFrame) -> Mapping | None:
        new = latest_metrics(log, tag).first()
        if new is None:
            raise ValueError(f"Version '{tag}' not found in model registry!")
        state = registry_state(log).first()
        old = latest_metrics(log, state["active_version"]).first() if state else None
        pair = spark.createDataFrame(
            [(tag, old["metrics"][metric] if old else None, new["metrics"][metric])],
            "version_tag string, champion_pr_auc double, challenger_pr_auc double",
        )
        decisions.append(gate(pair, margin))
        return {"action": PROMOTE, "version_tag": tag} if decisions[-1].first()["gate_passed"] else None

    commit(spark, path, decide)
    return decisions[-1]


def active_versions(spark: SparkSession, path: str) -> tuple[str | None, str | None]:
    row = registry_state(read_registry(spark, path)).first()
    return (row["active_version"], row["previous_version"]) if row else (None, None)


def rollback(spark: SparkSession, path: str) -> bool:
    """Swap active and previous version; False when there is nothing to go back to."""

    def decide(log: DataFrame) -> Mapping | None:
        state = registry_state(log).first()
        return {"action": ROLLBACK} if state and state["previous_version"] is not None else None

    return commit(spark, path, decide) is not None


def resolve_model(spark: SparkSession, path: str, fallbacks: Sequence[str] = ()) -> PipelineModel | None:
    """The champion, else the first registered fallback, else none (the rule-based score applies)."""
    log = read_registry(spark, path)
    for tag in [active_versions(spark, path)[0], *fallbacks]:
        if tag is None:
            continue
        row = _registered(log, tag).orderBy(F.desc("seq")).select("filepath").first()
        if row:
            return PipelineModel.load(row["filepath"])
    return None


def latest_metrics(log: DataFrame, tag: str) -> DataFrame:
    return _registered(log, tag).orderBy(F.desc("seq")).select("metrics").limit(1)
