"""Event counts per customer: over the last n events, and over event-time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.plans.running import ranked_through_ties
from holdfast.plans.salted import join_salted
from holdfast.plans.slices import SLICE, add_slice, default_parts

COUNTED = {
    "tickets": "support_ticket_opened",
    "usage_drops": "usage_drop_detected",
    "payment_failures": "payment_failed",
    "competitor_views": "competitor_viewed",
}
HOT_ROWS = 1_000_000


def _counts(window=None) -> list[Column]:
    out = []
    for name, kind in COUNTED.items():
        count = F.count_if(F.col("event_type") == kind)
        out.append((count.over(window) if window is not None else count).alias(name))
    return out


def _hot_keys(df: DataFrame, hot_rows: int, key: str) -> DataFrame | None:
    """The keys with more than ``hot_rows`` rows, None if there are none (one pass of pre-aggregated counts): the usual
    table then needs no plan for them. A key that grows later is still counted right, in one task."""
    keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(key, F.lit(True).alias("_hot"))
    return None if keys.isEmpty() else keys


def placed(events: DataFrame, hot_rows: int = HOT_ROWS, key: str = "customer_id", time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Add ``place`` and ``of``: rank and number of events where a customer has more than ``hot_rows`` of them, else null."""
    hot_keys = _hot_keys(events, hot_rows, key)
    unplaced = {"place": F.lit(None).cast("long"), "of": F.lit(None).cast("long")}
    if hot_keys is None:
        return events.withColumns(unplaced)
    marked = join_salted(events, hot_keys, [key], [tie])
    hot = ranked_through_ties(marked.where(F.col("_hot")).drop("_hot"), time, tie, [key], hot_rows)
    plain = marked.where(F.col("_hot").isNull()).drop("_hot").withColumns(unplaced)
    return plain.unionAll(hot.withColumnsRenamed({"rank": "place", "group_rows": "of"}).select(*plain.columns))


def last_n_counts(
    events: DataFrame,
    n: int = fixed.BUFFER_EVENTS,
    hot_rows: int = HOT_ROWS,
    key: str = "customer_id",
    time: str = "ts",
    tie: str = "event_id",
    earlier: DataFrame | None = None,
) -> DataFrame:
    """Counts by type over the last ``n`` events of the customer, the current one included (table form).

    Ordinary customers take one shuffle by key. A customer with more than
    ``hot_rows`` events is cut into runs of ``hot_rows`` consecutive events; each
    run also receives the n-1 events before it, from however many runs they are
    in, so its counts are exact and no task holds more than one run and those.
    Ranks of a hot customer come from slices of (time, tie), so equal time stamps
    do not gather in a task either.

    ``earlier`` are the events that came before all of ``events``, as
    :func:`latest_events` returns them; they are counted but not returned.
    """
    return counted_events(placed(events, hot_rows, key, time, tie), n, hot_rows, key, time, tie, earlier)


def counted_events(ordered: DataFrame, n: int, hot_rows: int, key: str = "customer_id", time: str = "ts", tie: str = "event_id",
                   earlier: DataFrame | None = None) -> DataFrame:
    """:func:`last_n_counts` of events that :func:`placed` has put in order."""
    names = [c for c in ordered.columns if c not in ("place", "of")]
    first = F.coalesce(F.floor((F.col("place") - 1) / hot_rows), F.lit(0))
    last = F.coalesce(F.floor((F.col("place") + (n - 2)) / hot_rows), F.lit(0))
    every = ordered.select(*names, F.coalesce("place", F.lit(1)).alias("_place"), first.alias("_own"), F.explode(F.sequence(first, last)).alias("_run"))
    if earlier is not None:
        # a run also needs what came before the batch: the events up to n-1 places ahead of its own
        runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("place") + (n - 2)) / hot_rows))
        lead = earlier.where(F.col("place") + n > 1).select(
            *[F.col(c) if c in earlier.columns else F.lit(None).alias(c) for c in names],
            F.col("place").alias("_place"), F.lit(-1).cast("long").alias("_own"), F.explode(runs).alias("_run"),
        )
        every = every.unionAll(lead)
    recent = Window.partitionBy(key, "_run").orderBy("_place", time, tie).rowsBetween(-(n - 1), 0)
    return every.select("*", *_counts(recent)).where(F.col("_own") == F.col("_run")).drop("_place", "_run", "_own")


def latest_events(ordered: DataFrame, n: int, earlier: DataFrame | None = None, key: str = "customer_id", time: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last n-1 events of every customer in ``earlier`` and then ``ordered`` (from :func:`placed`), with ``place``
    (0 the newest, -1 before it ...)."""
    names = [c for c in ordered.columns if c not in ("place", "of")]
    newest = F.col("of").isNull() | (F.col("place") > F.col("of") - (n - 1))
    every = ordered.where(newest).select(*names, F.coalesce("place", F.lit(1)).alias("_place"))
    if earlier is not None:
        every = every.unionAll(earlier.select(*names, F.col("place").alias("_place")))
    back = Window.partitionBy(key).orderBy(F.desc("_place"), F.desc(time), F.desc(tie))
    numbered = every.withColumn("_back", F.row_number().over(back)).where(F.col("_back") < n)
    return numbered.select(*names, (1 - F.col("_back")).cast("long").alias("place"))


def last_n_counts_stream(events: DataFrame, n: int = fixed.BUFFER_EVENTS, idle_days: int | None = None) -> DataFrame:
    """The same counts on a stream: one output row per event, keyed state of at most ``n`` event kinds.

    State is partitioned by customer, checkpointed, and dropped after
    ``idle_days`` without events. Inside a micro-batch a customer's events are
    taken in (ts, event_id) order; across micro-batches in arrival order.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    kinds = list(COUNTED.values())
    names = list(COUNTED)
    ttl = idle_days * 86_400_000 if idle_days else None

    class LastEvents(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.recent = handle.getListState("recent", "kind int", ttl)

        def handleInputRows(self, key, rows, timerValues):
            import numpy as np

            arrived = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
            before = [r[0] for r in self.recent.get()]
            codes = {k: i for i, k in enumerate(kinds)}
            new = [codes.get(t, -1) for t in arrived["event_type"]]
            line = np.array([*before, *new], dtype=int)
            last = np.arange(len(before) + 1, len(line) + 1)
            first = np.maximum(0, last - n)
            out = arrived[["event_id", "customer_id", "ts", "event_type"]].copy()
            for i, name in enumerate(names):
                total = np.concatenate([[0], np.cumsum(line == i)])
                out[name] = total[last] - total[first]
            self.recent.put([(int(k),) for k in line[-n:]])
            yield out

        def close(self) -> None:
            pass

    schema = "event_id {e}, customer_id {c}, ts timestamp, event_type string, {n}".format(
        e=dict(events.dtypes)["event_id"], c=dict(events.dtypes)["customer_id"], n=", ".join(f"{x} bigint" for x in names)
    )
    slim = events.select("event_id", "customer_id", "ts", "event_type")
    return slim.groupBy("customer_id").transformWithStateInPandas(
        LastEvents(), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ttl else "None"
    )


def windowed_counts(
    events: DataFrame,
    length: str = "5 minutes",
    slide: str | None = "1 minute",
    lateness: str = "10 minutes",
    keys: Sequence[str] = ("customer_id",),
) -> DataFrame:
    """Counts per customer in sliding (or, without ``slide``, tumbling) event-time windows.

    On a stream the watermark bounds the state and drops events that are too late.
    Counts are combined before the shuffle, so a busy customer costs little.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", lateness)
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        events.groupBy(span.alias("span"), *keys)
        .agg(F.count(F.lit(1)).alias("events"), *_counts())
        .select(*keys, F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "events", *COUNTED)
    )


def session_counts(
    events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes", key: str = "customer_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Counts per activity session of a customer (events closer than ``gap``)."""
    if not events.isStreaming:
        return sessions_of_table(events, gap, key, hot_rows)
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap).alias("span"), key)
        .agg(F.count(F.lit(1)).alias("events"), *_counts())
        .select(key, F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "events", *COUNTED)
    )


def sessions_of_table(events: DataFrame, gap: str = "30 minutes", key: str = "customer_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sessions by a segmented scan.

    Events of one customer and time stamp are combined first. Customers with more than ``hot_rows`` time stamps are cut
    into slices of time; gaps are looked for inside a slice only. What a session can share with a neighbouring slice is
    the first and last stretch of a slice: those, two rows per slice at most, are joined up as (first, last, counts).
    """
    names = ["events", *COUNTED]
    wide = F.expr(f"interval {gap}")
    moments = events.where(F.col("ts").isNotNull()).groupBy(key, "ts").agg(F.count(F.lit(1)).alias("events"), *_counts())
    hot_keys = _hot_keys(moments, hot_rows, key)
    if hot_keys is None:
        cut = moments.withColumns({"_hot": F.lit(None).cast("boolean"), SLICE: F.lit(0)})
    else:
        marked = join_salted(moments, hot_keys, [key], ["ts"])
        hot = add_slice(marked.where(F.col("_hot")), "ts", default_parts(events))
        cut = marked.where(F.col("_hot").isNull()).withColumn(SLICE, F.lit(0)).unionByName(hot)
    inside = Window.partitionBy(key, SLICE).orderBy("ts")
    starts = F.when(F.col("ts") < F.lag("ts").over(inside) + wide, 0).otherwise(1)
    numbered = cut.withColumn("_starts", starts).withColumn("_stretch", F.sum("_starts").over(inside))
    stretches = numbered.groupBy(key, SLICE, "_stretch").agg(
        F.first("_hot").alias("_hot"), F.min("ts").alias("first"), F.max("ts").alias("last"), *[F.sum(c).alias(c) for c in names]
    )
    shown = [key, F.col("first").alias("window_start"), (F.col("last") + wide).alias("window_end"), *names]
    if hot_keys is None:
        return stretches.select(*shown)
    edge = F.col("_hot").isNotNull() & ((F.col("_stretch") == 1) | (F.col("_stretch") == F.max("_stretch").over(Window.partitionBy(key, SLICE))))
    told = stretches.withColumn("_edge", edge)
    along = Window.partitionBy(key).orderBy("first")
    joins_up = F.when(F.col("first") < F.lag("last").over(along) + wide, 0).otherwise(1)
    edges = told.where("_edge").withColumn("_starts", joins_up).withColumn("_session", F.sum("_starts").over(along))
    joined = edges.groupBy(key, "_session").agg(F.min("first").alias("first"), F.max("last").alias("last"), *[F.sum(c).alias(c) for c in names])
    return told.where(~F.col("_edge")).select(*shown).unionAll(joined.select(*shown))


def once_per_event(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Drop repeated deliveries of an event."""
    if events.isStreaming:
        return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])
