"""Customer events: counts over the last events, alerts, event-time windows; as tables and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.catalog.customers import even
from holdfast.catalog.profile_sql import EVENTS, PROFILE
from holdfast.catalog.registry import events_sql, query
from holdfast.plans.storage import new_path
from holdfast.sources.events import customer_events, read_event_stream
from holdfast.sources.profile import customer_profile
from holdfast.sources.tables import read_table
from holdfast.streaming import alerts, counts, jobs
from holdfast.streaming.last_events import LastEvents

COUNT_SQL = ", ".join(f"count(*) filter (event_type = '{k}') {{over}} as {n}" for n, k in counts.COUNTED.items())
LAST50 = (
    ", l as (select event_id, customer_id, ts, event_type, " + COUNT_SQL.format(over="over w")
    + " from ev window w as (partition by customer_id order by ts, event_id rows between 49 preceding and current row))"
)
COLUMNS = ["event_id", "customer_id", "event_type", *counts.COUNTED]


def batch_events(spark, folder):
    return customer_events(read_table(spark, folder, "events"))


def stream_events(spark, folder):
    return customer_events(read_event_stream(spark, folder, glob="events.parquet"))


LAST50_SQL = events_sql(LAST50 + f" select {', '.join(COLUMNS)} from l")


@query("event_last50", LAST50_SQL)
def _last50(spark, folder):
    return counts.last_n_counts(batch_events(spark, folder)).select(*COLUMNS)


@query("event_last50_hot", LAST50_SQL)
def _last50_hot(spark, folder):
    """The same counts with every busy customer cut into runs of 60 events."""
    return counts.last_n_counts(batch_events(spark, folder), hot_rows=60).select(*COLUMNS)


@query("stream_last50", LAST50_SQL)
def _stream_last50(spark, folder):
    return LastEvents(new_path(spark, "last50")).drain(stream_events(spark, folder)).select(*COLUMNS)


@query("stream_last50_hot", LAST50_SQL)
def _stream_last50_hot(spark, folder):
    """The same with every busy customer of a micro-batch cut into runs of 60 events."""
    return LastEvents(new_path(spark, "last50"), hot_rows=60).drain(stream_events(spark, folder)).select(*COLUMNS)


@query("event_overrides", events_sql(LAST50 + """
    select event_id, greatest(1, tickets)::int as support_tickets_30d, greatest(2, tickets * 2)::int as support_tickets_90d,
    case when tickets > 1 then 1.5e0 else 3.5e0 end as resolution_satisfaction_score, payment_failures::int as payment_failures_90d,
    case when usage_drops > 0 then -0.45e0 else 0e0 end as change_in_usage_pct,
    case when competitor_views > 0 then 'Yes' else 'No' end as competitor_offer_viewed,
    case when event_type = 'price_increase_notified' then 'Yes' else 'No' end as price_increase_applied_30d from l"""))
def _overrides(spark, folder):
    counted = counts.last_n_counts(batch_events(spark, folder))
    return counted.select("event_id", *[c.alias(n) for n, c in alerts.event_overrides().items()])


ALERT_SQL = (
    "select 'ALT-' || event_id as alert_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as timestamp, 'CRITICAL' as severity, customer_id,"
    f" 0.85e0 as churn_probability, clv as estimated_clv, {even('0.85e0 * clv', 2)} as revenue_at_risk,"
    f" '{'; '.join(fixed.ALERT_REASONS)}' as primary_churn_reasons,"
    f" '{fixed.TIER_ACTIONS['High Risk']}' as recommended_action, '{fixed.ALERT_CHANNEL}' as channel"
)
RAISED = "tickets >= 2 or payment_failures >= 1"
ALERTS_SQL = events_sql(LAST50 + f", a as (select *, 2351.25e0 as clv from l where {RAISED}) {ALERT_SQL} from a")


def readable(df):
    return df.withColumn("primary_churn_reasons", F.array_join("primary_churn_reasons", "; "))


@query("event_alerts", ALERTS_SQL)
def _alerts(spark, folder):
    return readable(alerts.event_alerts(batch_events(spark, folder)))


@query("stream_alerts", ALERTS_SQL)
def _stream_alerts(spark, folder):
    return readable(alerts.watch_alerts(new_path(spark, "alerts")).drain(stream_events(spark, folder)))


@query("event_alerts_profiled", (
    f"with profile as ({PROFILE}), ev as ({EVENTS}) {LAST50}"
    + ", a as (select l.*, " + even(
        "coalesce(monthly_charges, 95e0) * greatest(36e0 - coalesce(tenure_months, 3), 1e0) * 0.75e0", 2)
    + f" as clv from l left join profile using (customer_id) where {RAISED}) {ALERT_SQL} from a"))
def _alerts_profiled(spark, folder):
    return readable(alerts.event_alerts(batch_events(spark, folder), profiles=customer_profile(spark, folder)))


@query("alert_totals", events_sql(
    LAST50 + f" select count(*) filter ({RAISED}) as alert_count, count(*) as event_count from l"))
def _alert_totals(spark, folder):
    events = batch_events(spark, folder)
    return alerts.alert_totals(events, alerts.event_alerts(events))


def _window_sql(start: str, minutes: int) -> str:
    return (
        f", s as (select ev.*, {start} as st from ev{', range(0, 5) t(k)' if '(k)' in start else ''})"
        " select customer_id, strftime(st, '%Y-%m-%d %H:%M:%S') as window_start,"
        f" strftime(st + interval {minutes} minute, '%Y-%m-%d %H:%M:%S') as window_end, count(*) as events, "
        + COUNT_SQL.format(over="") + " from s group by customer_id, st"
    )


SLIDING_SQL = events_sql(_window_sql("date_trunc('minute', ts) - to_minutes(k)", 5))
TUMBLING_SQL = events_sql(_window_sql("time_bucket(interval 5 minute, ts)", 5))


def stamped(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")})


@query("event_sliding", SLIDING_SQL)
def _sliding(spark, folder):
    return stamped(counts.windowed_counts(batch_events(spark, folder)))


@query("event_tumbling", TUMBLING_SQL)
def _tumbling(spark, folder):
    return stamped(counts.windowed_counts(batch_events(spark, folder), slide=None))


CLOSED = " where s.window_end <= strftime((select max(ts) from ev) - interval 10 minute, '%Y-%m-%d %H:%M:%S')"


@query("stream_sliding", events_sql(
    _window_sql("date_trunc('minute', ts) - to_minutes(k)", 5).replace(" select customer_id,", ", w as (select customer_id,") + ") select * from w s" + CLOSED))
def _stream_sliding(spark, folder):
    """Windows the watermark has closed: those that end ten minutes or more before the last event."""
    return stamped(jobs.drain(counts.windowed_counts(stream_events(spark, folder)), "sliding"))


SESSIONS_SQL = events_sql(
    ", g as (select *, case when ts - lag(ts) over (partition by customer_id order by ts, event_id) < interval 30 minute then 0 else 1 end as fresh from ev)"
    ", s as (select *, sum(fresh) over (partition by customer_id order by ts, event_id) as session from g)"
    " select customer_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as window_start,"
    " strftime(max(ts) + interval 30 minute, '%Y-%m-%d %H:%M:%S') as window_end, count(*) as events, "
    + COUNT_SQL.format(over="") + " from s group by customer_id, session")


@query("event_sessions", SESSIONS_SQL)
def _sessions(spark, folder):
    return stamped(counts.session_counts(batch_events(spark, folder)))


@query("event_sessions_hot", SESSIONS_SQL)
def _sessions_hot(spark, folder):
    """The same with every customer of more than 20 moments cut into slices of time."""
    return stamped(counts.session_counts(batch_events(spark, folder), hot_rows=20))
