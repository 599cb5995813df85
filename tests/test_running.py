"""Sliced running totals, ranks and quantiles against plain computations."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.plans.running import exact_quantiles, long_form, ranked, running_totals, value_counts
from holdfast.plans.salted import join_salted
from holdfast.plans.slices import add_slice, position


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, and one group holds most rows."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        group = "hot" if i % 10 else f"g{i % 4}"
        value = 5.0 if i % 3 == 0 else float(np.round(rng.normal(0, 10), 1))
        rows.append((i, group, value))
    return spark.createDataFrame(rows, "id long, g string, v double").cache()


@pytest.mark.parametrize("parts", [1, 2, 7, 64])
def test_running_totals_equal_a_plain_window(skewed, parts):
    counts = value_counts(skewed, "v", ["g"])
    got = {(r.g, r.v): (r.cum_n, r.total_n) for r in running_totals(counts, "v", ["n"], ["g"], parts=parts).collect()}
    frame = skewed.toPandas()
    for g, part in frame.groupby("g"):
        sizes = part.groupby("v").size()
        for v, c in sizes.cumsum().items():
            assert got[(g, v)] == (c, len(part))
    assert len(got) == frame.groupby(["g", "v"]).ngroups


@pytest.mark.parametrize("parts", [1, 5])
def test_ranks_are_a_permutation_and_ordered(skewed, parts):
    rows = ranked(skewed, "v", [], ["id"], parts=parts).collect()
    by_rank = sorted(rows, key=lambda r: r["rank"])
    assert [r["rank"] for r in by_rank] == list(range(1, 3001))
    assert [(r.v, r.id) for r in by_rank] == sorted((r.v, r.id) for r in rows)
    assert {r.group_rows for r in rows} == {3000}


def test_quantiles_equal_numpy(skewed):
    qs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.quantiles for r in exact_quantiles(skewed, "v", qs, ["g"], parts=6).collect()}
    for g, part in skewed.toPandas().groupby("g"):
        assert got[g] == pytest.approx(np.percentile(part["v"], [100 * q for q in qs]), abs=0)


def test_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert exact_quantiles(df, "v", [0.5]).first()["quantiles"] == [2.0]


def test_slices_respect_ties_and_balance(skewed):
    counted = add_slice(skewed.groupBy("v").agg(F.count("*").alias("n")), "v", 8, ["n"])
    sizes = counted.groupBy("_slice").count().toPandas()["count"]
    distinct = counted.count()
    assert counted.select("v").distinct().count() == distinct
    assert sizes.max() <= 2 * distinct / 8 + 2


def test_position_counts_marks_below(spark):
    marks = [1.0, 2.0, 2.5, 9.0]
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 2.0, 2.5, 8.9, 9.0, 10.0)], "v double")
    got = df.select("v", position(F.array(*[F.lit(m) for m in marks]), F.col("v"), 4).alias("p")).collect()
    assert all(r.p == sum(m < r.v for m in marks) for r in got)


def test_long_form_keeps_types_and_keys(spark):
    df = spark.createDataFrame([(1, 2, 3.5)], "id long, a int, b double")
    rows = {(r.id, r.feature): r.value for r in long_form(df, ["a", "b"], ["id"]).collect()}
    assert rows == {(1, "a"): 2.0, (1, "b"): 3.5}


def test_many_slices_are_planned_in_no_time(spark):
    """The steps of the search, 3 to the power of 11 if written out, stay out of what follows a join key."""
    counts = spark.range(100).select((F.col("id") * 0.5 + 1).alias("v"), F.lit(1).cast("long").alias("n"))
    plan = running_totals(counts, "v", ["n"], parts=1500)
    start = time.perf_counter()
    plan._jdf.queryExecution().optimizedPlan()
    assert time.perf_counter() - start < 20
    assert {r.v: r.cum_n for r in plan.collect()} == {i * 0.5 + 1: i + 1 for i in range(100)}

def test_copies_of_hot_keys_are_not_broadcast(spark):
    rows = spark.range(200).select((F.col("id") % 7).alias("k"), "id")
    few = spark.createDataFrame([(1, True), (4, True)], "k long, _hot boolean")
    joined = join_salted(rows, few, ["k"], ["id"])
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.k, r["_hot"]) for r in joined.collect()) == [(i, i % 7, True if i % 7 in (1, 4) else None) for i in range(200)]
