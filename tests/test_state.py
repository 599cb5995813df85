"""Stream state as a table, sessions over slices, ranks through ties, drift profiles, registry races."""

import datetime
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from holdfast.operators import drift, drift_profile, explain, models, registry
from holdfast.operators.features import add_domain_features
from holdfast.plans import storage
from holdfast.plans.running import ranked_through_ties
from holdfast.sources.events import customer_events, read_event_stream
from holdfast.sources.tables import read_table
from holdfast.streaming import alerts, counts, jobs
from holdfast.streaming.last_events import LastEvents

KINDS = [*counts.COUNTED.values(), "app_login"]
STREAM = "event_id string, customer_id long, event_type string, ts timestamp"


def made_events(spark, rows):
    """(event_id, customer_id, kind, second) as events with text ids."""
    df = spark.createDataFrame(rows, "event_id string, customer_id long, event_type string, s long")
    return df.select("event_id", "customer_id", "event_type", F.timestamp_seconds("s").alias("ts"))


def plain_counts(batches, n):
    """Counts over the last n events: batch after batch, inside a batch by (second, id)."""
    seen, out = {}, {}
    for rows in batches:
        for e, c, kind, _ in sorted(rows, key=lambda r: (r[3], r[0])):
            line = seen.setdefault(c, [])
            line.append(kind)
            out[e] = tuple(line[-n:].count(k) for k in counts.COUNTED.values())
    return out


def as_dict(df):
    return {r.event_id: tuple(r[c] for c in counts.COUNTED) for r in df.collect()}


def busy_batches(rng, batches=3, rows=120):
    """Customer 1 has most events, many of them at one second."""
    out, at = [], 0
    for b in range(batches):
        part = []
        for _ in range(rows):
            customer = int(rng.choice([1, 1, 1, 1, 2, 3 + b]))
            part.append((f"E{at:06d}" if at % 3 else f"E{at:06d}x", customer, KINDS[rng.integers(0, 5)], 100 * b + (7 if customer == 1 else int(rng.integers(0, 40)))))
            at += 1
        out.append(part)
    return out


@pytest.mark.parametrize("hot_rows, full_every", [(1_000_000, 20), (10, 2)])
def test_busy_customer_over_several_files(spark, tmp_path, hot_rows, full_every):
    batches = busy_batches(np.random.default_rng(hot_rows))
    for b, rows in enumerate(batches):
        made_events(spark, rows).coalesce(1).write.parquet(str(tmp_path / f"in{b}"))
    stream = read_event_stream(spark, str(tmp_path / "in*"), schema=STREAM, files_per_batch=1)
    state = LastEvents(str(tmp_path / "state"), 50, hot_rows, full_every)
    assert as_dict(state.drain(stream)) == plain_counts(batches, 50)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    batches = busy_batches(np.random.default_rng(3), 3, 40)
    state = LastEvents(str(tmp_path / "state"), 8, 6, 2)
    for b, rows in enumerate([*batches[:2], batches[1], batches[2]]):
        state.take(made_events(spark, rows), b - (b > 1))
    got = spark.read.parquet(state.output()).drop("epoch")
    assert got.count() == 120 and as_dict(got) == plain_counts(batches, 8)
    held = state.state_before(spark, 3).collect()
    newest = {}
    for rows in batches:
        for e, c, _, _ in sorted(rows, key=lambda r: (r[3], r[0])):
            newest.setdefault(c, []).append(e)
    assert Counter((r.customer_id, r.event_id, r.place) for r in held) == Counter(
        (c, e, -k) for c, line in newest.items() for k, e in enumerate(reversed(line[-7:]))
    )


def test_idle_customers_leave_the_state(spark, tmp_path):
    state = LastEvents(str(tmp_path / "state"), 5, full_every=2, idle_days=1)
    state.take(made_events(spark, [("a", 1, "payment_failed", 0), ("b", 2, "payment_failed", 0)]), 0)
    state.take(made_events(spark, [("c", 2, "payment_failed", 3 * 86_400)]), 1)
    assert {r.customer_id for r in state.state_before(spark, 2).collect()} == {2}


def test_one_customer_one_time_stamp(spark):
    n, hot = 60_000, 2_000
    rows = spark.range(n).select(
        F.concat(F.lit("E"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("event_id"), F.lit(1).cast("long").alias("customer_id"),
        F.when(F.col("id") % 3 == 0, "payment_failed").otherwise("app_login").alias("event_type"), F.timestamp_seconds(F.lit(5)).alias("ts"),
    )
    ranked = ranked_through_ties(rows, "ts", "event_id", ["customer_id"], hot, parts=8)
    assert ranked.where(F.col("rank") != F.substring("event_id", 2, 7).cast("int") + 1).count() == 0
    assert ranked.where(F.col("group_rows") == n).count() == n
    counted = counts.last_n_counts(rows, 50, hot).withColumn("task", F.spark_partition_id())
    place = F.substring("event_id", 2, 7).cast("int") + 1
    first = F.greatest(F.lit(1), place - 49)
    thirds = F.floor((place + 2) / 3) - F.floor((first + 1) / 3)
    assert counted.where(F.col("payment_failures") != thirds).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = [r["n"] for r in counted.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum("payment_failures")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(tasks) < 0.6 * n


def test_ranks_through_ties_equal_sorting(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(v), f"t{t:04d}") for t, (g, v) in enumerate(zip(rng.integers(0, 3, 900), rng.choice([1, 1, 1, 2, 5], 900)))]
    df = spark.createDataFrame(rows, "g long, v long, t string")
    got = {(r.g, r.t): (r["rank"], r.group_rows) for r in ranked_through_ties(df, "v", "t", ["g"], 20, parts=4).collect()}
    want = {}
    for g in range(3):
        line = sorted((v, t) for h, v, t in rows if h == g)
        want |= {(g, t): (i + 1, len(line)) for i, (_, t) in enumerate(line)}
    assert got == want


def plain_sessions(rows, gap):
    out, open_ = [], {}
    for _, c, kind, s in sorted(rows, key=lambda r: r[3]):
        if c in open_ and s < open_[c][1] + gap:
            open_[c][1] = s
            open_[c][2].append(kind)
        else:
            if c in open_:
                out.append((c, *open_[c]))
            open_[c] = [s, s, [kind]]
    out += [(c, *o) for c, o in open_.items()]
    return Counter((c, a, b + gap, len(k), *[k.count(x) for x in counts.COUNTED.values()]) for c, a, b, k in out)


@pytest.mark.parametrize("hot_rows", [1_000_000, 30, 1])
def test_sessions_over_slices(spark, hot_rows):
    rng = np.random.default_rng(8)
    rows = [(f"e{i}", int(rng.choice([1, 1, 1, 1, 2, 3])), KINDS[rng.integers(0, 5)], int(rng.integers(0, 20_000)) // 7 * 7) for i in range(500)]
    rows += [(f"l{i}", 9, "app_login", 50 * i) for i in range(200)]  # one long session over all slices
    found = counts.session_counts(made_events(spark, rows), "70 seconds", hot_rows=hot_rows)
    got = Counter(
        (r.customer_id, int(r.window_start.replace(tzinfo=datetime.UTC).timestamp()), int(r.window_end.replace(tzinfo=datetime.UTC).timestamp()), r.events, *[r[c] for c in counts.COUNTED])
        for r in found.select("customer_id", F.to_timestamp_ntz(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).alias("window_start"),
                              F.to_timestamp_ntz(F.date_format("window_end", "yyyy-MM-dd HH:mm:ss")).alias("window_end"), "events", *counts.COUNTED).collect()
    )
    assert got == plain_sessions(rows, 70)


def test_closed_sessions_of_a_stream_equal_the_table(spark, folder, tmp_path):
    raw = read_table(spark, folder, "events").orderBy("ts").toPandas()
    for i, part in enumerate(np.array_split(np.arange(len(raw)), 3)):
        spark.createDataFrame(raw.iloc[part], read_table(spark, folder, "events").schema).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    live = jobs.drain(counts.session_counts(customer_events(read_event_stream(spark, str(tmp_path / "p*"), files_per_batch=1))))
    events = customer_events(read_table(spark, folder, "events"))
    closed = F.col("window_end") <= events.agg(F.max("ts")).scalar() - F.expr("interval 10 minutes")
    want = counts.session_counts(events).where(closed)
    assert live.count() == want.count() > 0 and live.exceptAll(want.select(*live.columns)).count() == 0


@pytest.fixture(scope="module")
def fitted(spark, profile):
    table = add_domain_features(profile).drop("churn_probability").cache()
    common = {"labelCol": "churn_label", "featuresCol": "features"}
    linear = models.fit_scoring_model(table, LogisticRegression(maxIter=10, **common))
    trees = models.fit_scoring_model(table, GBTClassifier(maxIter=3, maxDepth=3, seed=1, **common))
    return {"linear": (linear, explain.feature_means(table, linear)), "trees": (trees, None)}


@pytest.mark.parametrize("kind", ["linear", "trees"])
def test_alerts_carry_the_models_own_reasons(spark, folder, tmp_path, profile, fitted, kind):
    model, means = fitted[kind]
    events = customer_events(read_table(spark, folder, "events"))
    table = alerts.event_alerts(events, 0.5, profiles=profile, model=model, means=means)
    watch = alerts.watch_alerts(str(tmp_path / "alerts"), 0.5, profiles=profile, model=model, means=means, hot_rows=40)
    live = watch.drain(customer_events(read_event_stream(spark, folder, glob="events.parquet")))
    want = {r.alert_id: (r.churn_probability, tuple(r.primary_churn_reasons)) for r in table.collect()}
    assert want and {r.alert_id: (r.churn_probability, tuple(r.primary_churn_reasons)) for r in live.collect()} == want
    assert len({reasons for _, reasons in want.values()}) > 1 and all(len(r) == 3 for _, r in want.values())


def test_linear_alerts_need_a_background(spark, folder, fitted):
    with pytest.raises(ValueError, match="means"):
        alerts.event_alerts(customer_events(read_table(spark, folder, "events")), model=fitted["linear"][0])


def test_profile_equals_the_audit(spark):
    rng = np.random.default_rng(42)
    ref = {"normal": rng.normal(100, 15, 3000), "whole": rng.poisson(3, 3000).astype(float), "constant": np.full(3000, 3.0)}
    cur = {"normal": rng.normal(120, 25, 2000), "whole": rng.poisson(4, 2000).astype(float), "constant": rng.normal(0, 1, 2000)}
    cur["normal"][:5] = np.nan
    frames = [spark.createDataFrame([tuple(map(float, r)) for r in zip(*side.values())], "normal double, whole double, constant double") for side in (ref, cur)]
    profile = drift_profile.fit_drift_profile(frames[0], parts=4)
    parts = [drift_profile.tally(part, profile, list(ref)) for part in frames[1].randomSplit([0.3, 0.7], 1)]
    got = {r.feature: r for r in drift_profile.audit_tally(profile, drift_profile.merged(parts)).collect()}
    want = {r.feature: r for r in drift.drift_audit(*frames, parts=4).collect()}
    for name in ref:
        assert got[name].psi == pytest.approx(want[name].psi, abs=1e-4)
        assert want[name].ks_statistic - 1 / drift_profile.MARKS - 1e-4 <= got[name].ks_statistic <= want[name].ks_statistic + 1e-4
        assert got[name].drift_status == want[name].drift_status
    assert got["whole"].ks_statistic == want["whole"].ks_statistic
    more = drift_profile.extended(profile, drift_profile.tally(frames[0], profile, list(ref)))
    before = {r.feature: r["cells"] for r in profile.collect()}
    assert {r.feature: r["cells"] for r in more.collect()} == {f: [2 * n for n in cells] for f, cells in before.items()}


def test_watch_adds_up_over_batches(spark, tmp_path):
    rng = np.random.default_rng(4)
    frame = lambda values: spark.createDataFrame([(float(v),) for v in values], "x double")
    ref, cur = rng.normal(0, 1, 800), rng.normal(0.7, 1, 600)
    for i, part in enumerate(np.array_split(cur, 4)):
        frame(part).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema("x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    path = str(tmp_path / "watch")
    jobs.start_drift_watch(stream, frame(ref), path, available_now=True).awaitTermination()
    assert spark.read.parquet(path).select("epoch").distinct().count() == 4
    row, exact = jobs.watched_drift(spark, path).first(), drift.drift_audit(frame(ref), frame(cur)).first()
    assert row.psi == pytest.approx(exact.psi, abs=1e-4) and abs(row.ks_statistic - exact.ks_statistic) <= 1 / drift_profile.MARKS + 1e-4


def test_files_are_created_once(spark, tmp_path):
    path = str(tmp_path / "log" / "1.json")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: storage.create_file(spark, path, f'{{"writer": {i}}}\n'), range(8)))
    assert sum(won) == 1 and spark.read.json(str(tmp_path / "log")).collect()[0].writer == won.index(True)
    storage.remove(spark, path)
    storage.remove(spark, path)
    assert storage.create_file(spark, path, "{}")


def test_writers_race_for_the_registry(spark, tmp_path):
    path = str(tmp_path / "registry")
    entry = lambda tag, value: {"action": registry.REGISTER, "version_tag": tag, "metrics": {"pr_auc": value}}
    tags = [f"v{i}" for i in range(6)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: registry.commit(spark, path, lambda log: entry(tags[i], 0.80 + 0.001 * i)), range(6)))
        list(pool.map(lambda tag: registry.challenge(spark, path, tag, margin=0.0101).collect(), tags))
    log = registry.read_registry(spark, path).orderBy("seq").collect()
    assert [r.seq for r in log] == list(range(1, len(log) + 1))
    promoted = [r.version_tag for r in log if r.action == registry.PROMOTE]
    assert len(promoted) == 1 and registry.active_versions(spark, path)[0] == promoted[0]
