"""Starting streams: sinks with checkpoints in the shared folder, drift checks per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from holdfast.operators.drift_profile import audit_tally, fit_drift_profile, merged, tally
from holdfast.plans.storage import new_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Sessions of a micro-batch are combined in the scan tasks, so a busy customer sends few rows.
MERGE_FIRST = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting that a query takes over when it starts; the session's own choice is put back afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def rocks_state(spark: SparkSession):
    """Keyed list state needs the RocksDB store."""
    return setting(spark, PROVIDER, ROCKS)


def start_sink(stream: DataFrame, path: str, checkpoint: str | None = None, kind: str = "parquet", available_now: bool = False,
               interval: str = "30 seconds") -> StreamingQuery:
    """Append a stream to files; the checkpoint makes every row appear exactly once."""
    spark = stream.sparkSession
    checkpoint = checkpoint or new_path(spark, "stream-checkpoint")
    writer = stream.writeStream.format(kind).outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    with rocks_state(spark), setting(spark, MERGE_FIRST, "true"):
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def drain(stream: DataFrame, label: str = "stream") -> DataFrame:
    """Run a stream over what is available now and return its output as a table."""
    spark = stream.sparkSession
    path = new_path(spark, label)
    start_sink(stream, path, available_now=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def start_alert_sink(alerts: DataFrame, path: str, checkpoint: str | None = None, **options) -> StreamingQuery:
    """Alerts as JSON files, one object per alert."""
    return start_sink(alerts, path, checkpoint, kind="json", **options)


def start_drift_watch(scored: DataFrame, reference: DataFrame, path: str, cols: Sequence[str] | None = None,
                      checkpoint: str | None = None, available_now: bool = False,
                      on_audit: Callable[[DataFrame, int], None] | None = None, **profile_options) -> StreamingQuery:
    """Audit every micro-batch of scored rows against a reference.

    ``reference`` is a table, which is read once to fit and store its profile, or a profile that was fitted before.
    A micro-batch is counted into the profile's cells and audited from its tally. A replayed micro-batch overwrites its
    own report and tally, so both are exactly once; :func:`watched_drift` adds the tallies up.
    """
    spark = scored.sparkSession
    fitted = "cells" in reference.columns
    profile = reference if fitted else fit_drift_profile(reference, cols, **profile_options)
    profile.write.mode("overwrite").parquet(f"{path}/_profile")
    kept = spark.read.parquet(f"{path}/_profile")
    names = [r["feature"] for r in kept.select("feature").collect() if r["feature"] in scored.columns]
    most = kept.agg(F.max(F.size("grid"))).first()[0] or 1

    def audit(batch: DataFrame, epoch: int) -> None:
        tally(batch, kept, names, most).write.mode("overwrite").parquet(f"{path}/_tallies/epoch={epoch}")
        report = audit_tally(kept, spark.read.parquet(f"{path}/_tallies/epoch={epoch}")).withColumn("epoch", F.lit(epoch).cast("long"))
        report.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        if on_audit:
            on_audit(report, epoch)

    checkpoint = checkpoint or new_path(scored.sparkSession, "drift-checkpoint")
    writer = scored.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def watched_drift(spark: SparkSession, path: str) -> DataFrame:
    """The audit of everything a watch has seen: its tallies added up."""
    return audit_tally(spark.read.parquet(f"{path}/_profile"), merged(spark.read.parquet(f"{path}/_tallies")))
