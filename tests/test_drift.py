"""Drift statistics against plain formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.operators import drift


def plain_psi(ref, cur, bins=10, eps=1e-4):
    edges = np.unique(np.percentile(ref, np.linspace(0, 100, bins + 1)))
    if len(edges) < 2:
        return 0.0
    r = np.histogram(ref, edges)[0] / len(ref)
    c = np.histogram(cur, edges)[0] / len(cur)
    r, c = np.where(r == 0, eps, r), np.where(c == 0, eps, c)
    return round(float(((c - r) * np.log(c / r)).sum()), 4)


def plain_ks(ref, cur):
    grid = np.unique(np.r_[ref, cur])
    f = np.searchsorted(np.sort(ref), grid, "right") / len(ref)
    g = np.searchsorted(np.sort(cur), grid, "right") / len(cur)
    return float(np.abs(f - g).max())


def column(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(42)
    return {
        "normal": rng.normal(100, 15, 1000),
        "shifted": rng.normal(150, 25, 1000),
        "whole": rng.poisson(1.5, 800).astype(float),
        "constant": np.full(50, 3.0),
        "half zero": np.where(rng.random(900) < 0.5, 0.0, rng.normal(0, 1, 900)),
    }


@pytest.mark.parametrize("ref, cur", [("normal", "normal"), ("normal", "shifted"), ("whole", "normal"), ("constant", "whole"), ("half zero", "normal"), ("whole", "half zero")])
def test_psi_and_ks(spark, samples, ref, cur):
    a, b = samples[ref], samples[cur]
    row = drift.drift_audit(column(spark, a), column(spark, b), parts=5).first()
    assert row.psi == pytest.approx(plain_psi(a, b), abs=1e-4)
    assert row.ks_statistic == pytest.approx(plain_ks(a, b), abs=6e-5)


def test_equal_and_shifted_tables(spark, samples):
    same = drift.psi(column(spark, samples["normal"]), column(spark, samples["normal"])).first().psi
    moved = drift.psi(column(spark, samples["normal"]), column(spark, samples["shifted"])).first().psi
    assert same == 0.0 and moved >= 0.25


def test_ks_detects_a_shift(spark):
    rng = np.random.default_rng(1)
    row = drift.ks_two_sample(column(spark, rng.normal(50, 5, 500)), column(spark, rng.normal(70, 5, 500))).first()
    assert row.ks_drift_detected and row.p_value < 0.05
    same = drift.ks_two_sample(column(spark, range(500)), column(spark, range(500))).first()
    assert (same.ks_statistic, same.p_value, same.ks_drift_detected) == (0.0, 1.0, False)


def test_empty_sides(spark):
    some, none = column(spark, [1, 2, 3]), column(spark, []).union(column(spark, [float("nan")]))
    for ref, cur in ((some, none), (none, some), (none, none)):
        row = drift.drift_audit(ref, cur).first()
        assert (row.psi, row.ks_statistic, row.p_value, row.ks_drift_detected, row.drift_status) == (0.0, 0.0, 1.0, False, fixed.DRIFT_NONE)


def test_only_shared_numeric_columns(spark):
    a = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string")
    assert drift.shared_numeric(a, a.select("b", "c")) == ["b"]
    assert drift.shared_numeric(a, a, ["b", "zz"]) == ["b"]


def test_thresholds_are_arguments(spark, samples):
    audit = drift.drift_audit(column(spark, samples["normal"]), column(spark, samples["shifted"]), high=99.0, moderate=98.0)
    assert audit.first().drift_status == fixed.DRIFT_NONE


def decision(spark, drifted, pr_auc):
    audit = spark.createDataFrame([("x", fixed.DRIFT_HIGH if drifted else fixed.DRIFT_NONE)], "feature string, drift_status string")
    decay = spark.createDataFrame([(pr_auc, pr_auc < 0.8)], "current_pr_auc double, concept_drift_detected boolean")
    return drift.retrain_decision(audit, decay).first()


def test_retrain_decision(spark):
    calm = decision(spark, False, 0.88)
    assert not calm.retraining_required and calm.trigger_reasons == [] and calm.recommended_action == fixed.ACTION_KEEP
    moved = decision(spark, True, 0.88)
    assert moved.retraining_required and moved.trigger_reasons == ["Feature distribution PSI >= 0.25 in 1 features."]
    both = decision(spark, True, 0.75)
    assert both.trigger_reasons[1] == "Model PR AUC (0.7500) fell below threshold (0.8000)." and both.recommended_action == fixed.ACTION_RETRAIN


def test_histogram_edges(spark):
    df = column(spark, [0, 1, 1.5, 2, 3, 3.1, -1])
    assert {r.bin: r.n for r in drift.histogram(df, "x", [0, 1, 2, 3]).collect()} == {1: 1, 2: 2, 3: 2}


def test_drift_of_the_profile(spark, profile):
    from holdfast.catalog.fixtures import scaled_columns

    shifted = scaled_columns(profile, {"support_tickets_30d": 2.5, "monthly_charges": 1.3})
    verdict = drift.drift_verdict(drift.drift_audit(profile, shifted, fixed.NUMERICAL)).first()
    assert verdict.total_features_audited == 19 and verdict.dataset_drift_detected
    assert "support_tickets_30d" in verdict.high_drift_features
    assert profile.select(F.count("*")).first()[0] > 0
