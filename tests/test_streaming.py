"""Streams against their table form: several micro-batches, repeats, late rows, hot customers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.sources.events import RAW_EVENTS, customer_events, parse_events, read_event_stream
from holdfast.sources.tables import read_table
from holdfast.streaming import alerts, counts, jobs


def plain_counts(events, n):
    """Counts of the last n events per customer, one event at a time."""
    seen, out = {}, {}
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        line = seen.setdefault(e["customer_id"], [])
        line.append(e["event_type"])
        recent = line[-n:]
        out[e["event_id"]] = tuple(recent.count(k) for k in counts.COUNTED.values())
    return out


@pytest.fixture(scope="module")
def events(spark, folder):
    return customer_events(read_table(spark, folder, "events")).cache()


def as_dict(df):
    return {r.event_id: tuple(r[c] for c in counts.COUNTED) for r in df.collect()}


def test_hot_customers_are_cut_exactly(spark):
    rng = np.random.default_rng(2)
    kinds = [*counts.COUNTED.values(), "app_login"]
    rows = [(i, int(rng.choice([1, 1, 1, 2, 3])), kinds[rng.integers(0, 5)], i // 3) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id long, customer_id long, event_type string, s long").select(
        "event_id", "customer_id", "event_type", F.timestamp_seconds("s").alias("ts")
    )
    want = plain_counts([r.asDict() for r in df.collect()], 50)
    for hot_rows in (7, 20, 49, 50, 73, 200, 10_000):
        assert as_dict(counts.last_n_counts(df, 50, hot_rows)) == want


def split_files(spark, folder, tmp_path, pieces):
    """The events as files in time order, one micro-batch each."""
    raw = read_table(spark, folder, "events").orderBy("ts", "event_id").toPandas()
    for i, part in enumerate(np.array_split(raw, pieces)):
        spark.createDataFrame(part, RAW_EVENTS).coalesce(1).write.parquet(str(tmp_path / f"part{i:02d}"))
    return str(tmp_path / "part*")


@pytest.mark.parametrize("pieces", [1, 2, 5])
def test_stream_counts_equal_table_counts(spark, folder, tmp_path, events, pieces):
    source = split_files(spark, folder, tmp_path, pieces)
    stream = customer_events(read_event_stream(spark, source, files_per_batch=1))
    got = as_dict(jobs.drain(counts.last_n_counts_stream(stream)))
    assert got == as_dict(counts.last_n_counts(events))


def test_stream_alerts_equal_table_alerts(spark, folder, tmp_path, events, profile):
    source = split_files(spark, folder, tmp_path, 3)
    stream = customer_events(read_event_stream(spark, source, files_per_batch=1))
    out = str(tmp_path / "alerts")
    live = alerts.event_alerts(stream, profiles=profile)
    jobs.start_alert_sink(live, out, available_now=True).awaitTermination()
    got = {(r.alert_id, r.estimated_clv) for r in spark.read.json(out).collect()}
    want = {(r.alert_id, r.estimated_clv) for r in alerts.event_alerts(events, profiles=profile).collect()}
    assert got == want and got


def test_idle_state_can_expire(spark, folder, tmp_path):
    """With expiring state a stream keeps ticking, so it is stopped once its rows are out."""
    source = split_files(spark, folder, tmp_path, 1)
    stream = customer_events(read_event_stream(spark, source))
    out, want = str(tmp_path / "out"), read_table(spark, folder, "events").count()
    running = jobs.start_sink(counts.last_n_counts_stream(stream, idle_days=30), out, interval="1 second")
    try:
        for _ in range(40):
            running.awaitTermination(1)
            if sum(p["numInputRows"] for p in running.recentProgress) >= want:
                break
    finally:
        running.stop()
    assert spark.read.parquet(out).count() == want


def test_repeats_are_dropped_once(spark, folder, tmp_path, events):
    source = split_files(spark, folder, tmp_path, 2)
    twice = customer_events(read_event_stream(spark, source).select("*", F.explode(F.array(F.lit(0), F.lit(1)))))
    drained = jobs.drain(counts.once_per_event(twice, "40 days"))
    assert drained.count() == events.count() == drained.select("event_id").distinct().count()
    assert counts.once_per_event(events.union(events)).count() == events.count()


def test_sliding_windows_closed_by_the_watermark(spark, folder, tmp_path, events):
    source = split_files(spark, folder, tmp_path, 5)
    stream = customer_events(read_event_stream(spark, source, files_per_batch=1))
    live = {tuple(r) for r in jobs.drain(counts.windowed_counts(stream)).collect()}
    table = counts.windowed_counts(events)
    last = events.agg(F.max("ts")).first()[0]
    closed = table.where(F.col("window_end") <= F.lit(last) - F.expr("interval 10 minutes"))
    assert live == {tuple(r) for r in closed.collect()}


def test_late_events_are_ignored(spark, tmp_path):
    def batch(i, rows):
        df = spark.createDataFrame(rows, "event_id long, customer_id long, event_type string, s long")
        df.select("event_id", "customer_id", "event_type", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))

    batch(0, [(1, 1, "payment_failed", 0), (2, 1, "app_login", 7200)])
    batch(1, [(5, 1, "app_login", 7201)])
    batch(2, [(3, 1, "payment_failed", 1)])
    batch(3, [(4, 1, "app_login", 20000)])
    schema = "event_id long, customer_id long, event_type string, ts timestamp"
    stream = read_event_stream(spark, str(tmp_path / "b*"), schema=schema, files_per_batch=1)
    got = jobs.drain(counts.windowed_counts(stream, slide=None)).orderBy("window_start").collect()
    assert [(r.events, r.payment_failures) for r in got] == [(1, 1), (2, 0)]


def test_sessions_close_after_the_gap(spark, folder, tmp_path, events):
    source = split_files(spark, folder, tmp_path, 3)
    stream = customer_events(read_event_stream(spark, source, files_per_batch=1))
    live = jobs.drain(counts.session_counts(stream))
    assert 0 < live.count() <= counts.session_counts(events).count()


def test_drift_watch(spark, profile, tmp_path):
    scored = profile.select("monthly_charges", "tenure_months")
    scored.withColumn("monthly_charges", F.col("monthly_charges") * 3).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(scored.schema).parquet(str(tmp_path / "in"))
    jobs.start_drift_watch(stream, scored, str(tmp_path / "reports"), available_now=True).awaitTermination()
    report = {r.feature: r.drift_status for r in spark.read.parquet(str(tmp_path / "reports")).collect()}
    assert report["monthly_charges"].startswith("High Drift") and report["tenure_months"] == "No Drift"


def test_overrides_of_one_event(spark):
    df = spark.createDataFrame([(1, 7, "price_increase_notified", 2, 1, 0, 1)], "event_id long, customer_id long, event_type string, tickets long, usage_drops long, payment_failures long, competitor_views long")
    row = df.select(*[c.alias(n) for n, c in alerts.event_overrides().items()]).first()
    assert (row.support_tickets_30d, row.support_tickets_90d, row.resolution_satisfaction_score) == (2, 4, 1.5)
    assert (row.change_in_usage_pct, row.competitor_offer_viewed, row.price_increase_applied_30d) == (-0.45, "Yes", "Yes")


def test_alert_levels(spark):
    df = spark.createDataFrame([(1, 0.85), (2, 0.80), (3, 0.79)], "event_id long, churn_probability double").select(
        "*", F.lit("C1").alias("customer_id"), F.lit(2351.25).alias("clv"), F.timestamp_seconds(F.lit(0)).alias("ts")
    )
    rows = {r.alert_id: r for r in alerts.alert_payload(df).collect()}
    assert {k: r.severity for k, r in rows.items()} == {"ALT-1": "CRITICAL", "ALT-2": "WARNING"}
    assert rows["ALT-1"].timestamp == "1970-01-01T00:00:00Z" and len(rows["ALT-1"].asDict()) == 10
    assert rows["ALT-1"].revenue_at_risk == 1998.56


def test_producer_format(spark):
    df = spark.createDataFrame([("E1", "C1", "app_login", "2026-01-02T03:04:05Z", {})], "event_id string, customer_id string, event_type string, timestamp string, attributes map<string,string>")
    row = alerts.event_alerts(parse_events(df))
    assert row.count() == 0 and str(parse_events(df).first().ts) == "2026-01-02 03:04:05"
