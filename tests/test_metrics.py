"""Score metrics against literal values and a plain computation."""

import numpy as np
import pytest

from holdfast.operators import compare, fairness, metrics

SCHEMA = "y int, p double"


def plain_metrics(y, p):
    """Textbook curves over distinct thresholds."""
    order = np.unique(p)[::-1]
    pos, neg = y.sum(), len(y) - y.sum()
    tp = np.array([0] + [((p >= t) & (y == 1)).sum() for t in order])
    fp = np.array([0] + [((p >= t) & (y == 0)).sum() for t in order])
    roc = np.trapezoid(tp / pos, fp / neg)
    precision = np.r_[1.0, tp[1:] / (tp[1:] + fp[1:])]
    pr = np.trapezoid(precision, tp / pos)
    c = np.clip(p, metrics.EPSILON, 1 - metrics.EPSILON)
    loss = -(y * np.log(c) + (1 - y) * np.log(1 - c)).mean()
    return pr, roc, loss, ((p - y) ** 2).mean()


def test_perfect_scores(spark):
    rows = list(zip([0, 0, 0, 0, 1, 1, 1, 1], [0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9]))
    m = metrics.classification_metrics(spark.createDataFrame(rows, SCHEMA), "y", "p").first()
    assert (m.roc_auc, m.pr_auc, m.precision, m.recall, m.f1_score) == (1.0, 1.0, 1.0, 1.0, 1.0)
    assert (m.true_positives, m.true_negatives, m.false_positives, m.false_negatives) == (4, 4, 0, 0)


@pytest.mark.parametrize("parts", [1, 3, 16])
@pytest.mark.parametrize("digits", [1, 2, 6])
def test_random_scores_with_ties(spark, parts, digits):
    rng = np.random.default_rng(digits)
    y = rng.integers(0, 2, 400)
    p = np.round(np.clip(0.3 * y + rng.random(400) * 0.8, 0, 1), digits)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], SCHEMA)
    m = metrics.classification_metrics(df, "y", "p", parts=parts).first()
    assert (m.pr_auc, m.roc_auc, m.log_loss, m.brier_score) == pytest.approx(plain_metrics(y, p), abs=1e-12)


def test_extreme_probabilities(spark):
    m = metrics.classification_metrics(spark.createDataFrame([(1, 0.0), (0, 1.0), (1, 1.0), (0, 0.0)], SCHEMA), "y", "p").first()
    assert np.isfinite(m.log_loss) and m.roc_auc == 0.5


def test_one_class_group_keeps_its_row(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.2), ("b", 0, 0.3)], "g string, y int, p double")
    rows = {r.g: r for r in metrics.classification_metrics(df, "y", "p", ["g"]).collect()}
    assert rows["a"].roc_auc == 1.0
    assert rows["b"].roc_auc is None and rows["b"].pr_auc is None and rows["b"].precision == 0.0
    assert rows["b"].true_negatives == 1


def test_hot_group_and_hot_score(spark):
    """One score holds a third of all rows, one group two thirds."""
    rng = np.random.default_rng(9)
    rows = [("hot" if i % 3 else "rest", int(rng.integers(0, 2)), 0.5 if i % 3 == 1 else float(rng.random())) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    got = {r.g: r for r in metrics.classification_metrics(df, "y", "p", ["g"], parts=8).collect()}
    for g in ("hot", "rest"):
        y = np.array([r[1] for r in rows if r[0] == g])
        p = np.array([r[2] for r in rows if r[0] == g])
        assert (got[g].pr_auc, got[g].roc_auc) == pytest.approx(plain_metrics(y, p)[:2], abs=1e-12)


def test_missing_scores_are_left_out(spark):
    df = spark.createDataFrame([(1, 0.9), (0, None), (0, float("nan")), (0, 0.1)], SCHEMA)
    assert metrics.classification_metrics(df, "y", "p").first()["count"] == 2


def test_calibration_edge_goes_to_the_lower_bin(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.11), (1, 1.0)], SCHEMA)
    bins = {r.bin: r.prob_true for r in metrics.calibration_curve(df, "y", "p").collect()}
    assert bins == {0: 0.0, 1: 1.0, 9: 1.0}


def test_min_max_scaling(spark):
    df = spark.createDataFrame([(0, -2.0), (1, 2.0)], SCHEMA)
    scaled = metrics.min_max_score(df, "p", "s").orderBy("s").collect()
    assert scaled[0].s == 0.0 and scaled[1].s == pytest.approx(1.0)


def test_class_balance_without_positives(spark):
    assert metrics.class_balance(spark.createDataFrame([(0, 0.1)] * 3, SCHEMA), "y").first()[0] == 3.0


def test_segments_need_twenty_rows(spark):
    rows = [(i, i % 48, "A" if i < 81 else "B", i % 2, (i % 10) / 10) for i in range(100)]
    df = spark.createDataFrame(rows, "customer_id int, tenure_months int, contract_type string, churn_label int, churn_probability double")
    found = fairness.segment_fairness(df)
    assert {r.segment_column for r in found.collect()} == {"tenure_band", "contract_type"}
    assert found.where("segment_value = 'B'").count() == 0
    verdict = fairness.fairness_verdict(fairness.disparity_alerts(df)).first()
    assert isinstance(verdict.audit_passed, bool)


def test_comparison_reads_either_name(spark):
    evals = spark.createDataFrame(
        [("a", 0.8, None, 0.7), ("b", None, 0.9, 0.6)], "model_name string, pr_auc double, pr_auc_mean double, roc_auc double"
    )
    rows = compare.comparison_matrix(evals).collect()
    assert [(r.model_name, r.pr_auc, r.f1_score) for r in rows] == [("b", 0.9, 0.0), ("a", 0.8, 0.0)]
    assert compare.select_champion(compare.comparison_matrix(evals)).first().model_name == "b"


def test_report_lines(spark, tmp_path):
    from holdfast.sources.tables import write_lines

    evals = spark.createDataFrame([("a", 0.81234), ("b", 0.9)], "model_name string, pr_auc double")
    lines = compare.report_lines(compare.comparison_matrix(evals))
    write_lines(lines, str(tmp_path / "report"), "line_no")
    text = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert "- **Champion Model:** `b`" in text and any(t.startswith("| **a** | `0.8123`") for t in text)
