"""The last n events of every customer on a stream, with the state as a table.

Every micro-batch is counted like a table: the events that came before are read from stored state, customers with very
many events in a micro-batch are cut into runs, so no task ever holds a whole customer. The state of a micro-batch is a
folder with the last n-1 events of the customers it touched; every ``full_every`` micro-batches a folder holds all
customers and older folders go. What a micro-batch reads depends on its number only, and a repeated micro-batch writes
the same folders again: results appear once, whatever fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from holdfast import fixed
from holdfast.plans.storage import new_path, remove
from holdfast.streaming.counts import HOT_ROWS, counted_events, latest_events, placed

EVENT = ["event_id", "customer_id", "ts", "event_type"]


class LastEvents:
    """Counts over the last ``n`` events, one micro-batch after the other."""

    def __init__(
        self, path: str, n: int = fixed.BUFFER_EVENTS, hot_rows: int = HOT_ROWS, full_every: int = 20, idle_days: int | None = None,
        then: Callable[[DataFrame], DataFrame] | None = None,
    ):
        """``then`` turns counted events into the rows to store (alerts, say). ``idle_days`` drops customers whose last
        event is that much older than the newest one, whenever a full state is written."""
        self.path, self.n, self.hot_rows, self.full_every, self.idle_days, self.then = path, n, hot_rows, full_every, idle_days, then

    def output(self, epoch: int | None = None) -> str:
        return f"{self.path}/events" if epoch is None else f"{self.path}/events/epoch={epoch}"

    def _folder(self, epoch: int) -> str:
        return f"{self.path}/state/epoch={epoch}"

    def state_before(self, spark: SparkSession, epoch: int) -> DataFrame | None:
        """The last events of all customers before a micro-batch: the newest row set of each since the last full state."""
        first = max(0, epoch // self.full_every * self.full_every - 1)
        if epoch == 0:
            return None
        folders = [self._folder(e) for e in range(first, epoch)]
        states = spark.read.option("basePath", f"{self.path}/state").parquet(*folders)
        newest = F.max("epoch").over(Window.partitionBy("customer_id"))
        return states.withColumn("_newest", newest).where(F.col("epoch") == F.col("_newest")).drop("_newest", "epoch")

    def take(self, batch: DataFrame, epoch: int) -> None:
        """Count one micro-batch; also what ``foreachBatch`` calls."""
        spark = batch.sparkSession
        fresh = placed(batch.select(*EVENT), self.hot_rows).persist()
        try:
            before = self.state_before(spark, epoch)
            earlier = None if before is None else before.join(fresh.select("customer_id").distinct(), "customer_id", "left_semi").select(*EVENT, "place")
            counted = counted_events(fresh, self.n, self.hot_rows, earlier=earlier)
            rows = counted if self.then is None else self.then(counted)
            rows.write.mode("overwrite").parquet(self.output(epoch))
            state = latest_events(fresh, self.n, earlier)
            if (epoch + 1) % self.full_every == 0:
                if before is not None:
                    untouched = before.join(fresh.select("customer_id").distinct(), "customer_id", "left_anti")
                    state = state.unionByName(untouched.select(*state.columns))
                if self.idle_days is not None:
                    last = F.max("ts").over(Window.partitionBy("customer_id"))
                    newest = fresh.agg(F.max("ts")).scalar()
                    state = state.withColumn("_last", last).where(F.col("_last") >= newest - F.expr(f"interval {self.idle_days} days")).drop("_last")
            state.write.mode("overwrite").parquet(self._folder(epoch))
        finally:
            fresh.unpersist()
        full = epoch // self.full_every * self.full_every - 1
        if epoch == full + 1:
            for old in range(max(0, full - self.full_every), full):
                remove(spark, self._folder(old))

    def start(self, events: DataFrame, checkpoint: str | None = None, available_now: bool = False, interval: str = "30 seconds") -> StreamingQuery:
        checkpoint = checkpoint or new_path(events.sparkSession, "last-events-checkpoint")
        writer = events.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()

    def drain(self, events: DataFrame) -> DataFrame:
        """Take all events that are there now and return everything counted so far."""
        self.start(events, available_now=True).awaitTermination()
        return events.sparkSession.read.parquet(self.output()).drop("epoch")
