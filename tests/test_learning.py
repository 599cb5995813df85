"""Splits, preprocessing, models, explanations, neighbours, registry."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.operators import bayes, explain, models, neighbours, prep, registry, scoring, splits
from holdfast.operators.features import add_domain_features

COMMON = {"labelCol": "churn_label", "featuresCol": "features", "weightCol": "weight"}


@pytest.fixture(scope="module")
def featured(profile):
    return add_domain_features(profile).drop("churn_probability").cache()


def test_split_sizes_and_repeatability(profile):
    split = splits.stratified_split(profile.select("customer_id", "churn_label"), 0.2)
    rows = split.collect()
    for label in (0, 1):
        part = [r.is_test for r in rows if r.churn_label == label]
        assert sum(part) == round(len(part) * 0.2)
    again = splits.stratified_split(profile.select("customer_id", "churn_label").repartition(5), 0.2).collect()
    assert sorted(rows) == sorted(again)
    other = splits.stratified_split(profile.select("customer_id", "churn_label"), 0.2, seed=7).collect()
    assert sorted(rows) != sorted(other)


def test_folds_cover_every_class(profile):
    folds = splits.stratified_folds(profile.select("customer_id", "churn_label"), 4)
    sizes = folds.groupBy("churn_label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r.churn_label == label]
        assert len(counts) == 4 and max(counts) - min(counts) <= 1


def toy(spark):
    rows = [(1.0, "b", 1), (2.0, "a", 0), (3.0, "a", 0), (None, None, 1), (10.0, "b", 0)]
    return spark.createDataFrame(rows, "x double, c string, churn_label int")


def test_imputation(spark):
    params = {r.feature: r for r in prep.fit_impute(toy(spark), ["x"], ["c"]).collect()}
    assert params["x"].number == 2.5 and params["c"].text == "a"
    filled = prep.apply_impute(toy(spark), prep.fit_impute(toy(spark), ["x"], ["c"], "mean"), ["x"], ["c"])
    assert filled.where("c = 'a'").count() == 3 and filled.where("x = 4.0").count() == 1


def test_scaling_of_constant_columns(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    for params in (prep.fit_robust(df, ["x"]), prep.fit_standard(df, ["x"])):
        assert [r.x for r in prep.apply_scale(df, params, ["x"]).collect()] == [0.0, 0.0]


def test_clipping(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]] + [(None,)], "x double")
    clipped = sorted(r.x for r in prep.clip_outliers(df, prep.fit_clip_bounds(df), ["x"]).collect() if r.x is not None)
    assert clipped == [1.0, 2.0, 3.0, 4.0, 7.0]
    assert prep.clip_outliers(df, prep.fit_clip_bounds(df), ["x"]).where("x is null").count() == 1


def test_class_weights(spark):
    weights = {r.churn_label: r.weight for r in prep.class_weights(toy(spark)).collect()}
    assert weights == {0: pytest.approx(5 / 6), 1: pytest.approx(5 / 4)}
    rows = prep.add_balanced_weight(toy(spark)).collect()
    assert {r.churn_label: r.weight for r in rows} == weights


@pytest.mark.parametrize("scaler", ["robust", "standard"])
def test_preprocessor_is_fitted_on_train_only(spark, scaler, tmp_path):
    train = toy(spark)
    model = prep.fit_preprocessor(train, ["x"], ["c"], scaler)
    fresh = spark.createDataFrame([(1.0, "a", 0), (1.0, "zzz", 0), (None, None, 0)], "x double, c string, churn_label int")
    got = [list(r.v) for r in prep.apply_preprocessor(fresh, model).select(vector_to_array("features").alias("v")).collect()]
    filled = np.array([1, 2, 3, 2.5, 10.0])
    centre, scale = (np.median(filled), np.subtract(*np.percentile(filled, [75, 25]))) if scaler == "robust" else (filled.mean(), filled.std())
    assert got[0] == pytest.approx([(1 - centre) / scale, 1, 0])
    assert got[1] == pytest.approx([(1 - centre) / scale, 0, 0])
    assert got[2] == pytest.approx([(2.5 - centre) / scale, 1, 0])
    assert prep.feature_names(model) == ["num__x", "cat__c_a", "cat__c_b"]
    prep.save_model(model, str(tmp_path / "prep"))
    loaded = prep.load_model(str(tmp_path / "prep"))
    one = prep.apply_preprocessor(fresh.limit(1), loaded).select(vector_to_array("features").alias("v")).first().v
    assert list(one) == got[0]


def test_missing_model_raises(spark, tmp_path):
    with pytest.raises(Exception):
        prep.load_model(str(tmp_path / "nothing"))


def plain_nearest(stored, asked, k, same):
    out = {}
    for q, v in asked:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in stored if not (same and i == q))
        out[q] = [i for _, i in d[:k]]
    return out


@pytest.mark.parametrize("pivots, block", [(1, 1000), (8, 40), (30, 7)])
@pytest.mark.parametrize("same", [True, False])
def test_neighbours_equal_brute_force(spark, pivots, block, same):
    """A third of the stored rows are copies of one vector."""
    rng = np.random.default_rng(pivots)
    stored = [(i, [0.25, 0.5, -1.0] if i % 3 == 0 else [float(x) for x in rng.normal(0, 1, 3)]) for i in range(150)]
    asked = stored if same else [(1000 + i, [float(x) for x in rng.normal(0, 2, 3)]) for i in range(40)]
    schema = "id bigint, vec array<double>"
    found = neighbours.nearest(
        spark.createDataFrame(stored, schema), spark.createDataFrame(asked, schema), 7, pivots, block, exclude_same_id=same
    ).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == plain_nearest(stored, asked, 7, same)


def test_bayes_separates(spark):
    rng = np.random.default_rng(0)
    rows = [(float(rng.normal(3 * y, 1)), 1.0, y) for y in (0, 1) for _ in range(100)]
    df = spark.createDataFrame(rows, "x double, flat double, churn_label int")
    scored = bayes.apply_gaussian_nb(df, bayes.fit_gaussian_nb(df, ["x", "flat"]), ["x", "flat"])
    assert models.evaluate(scored).first().roc_auc > 0.95


def test_stop_round():
    assert models.stop_round([5, 4, 3, 3.5, 3.6, 2.0], 2) == 2
    assert models.stop_round([5, 4, 3, 3.5, 3.6, 2.0], 3) == 5
    assert models.stop_round([1.0], 2) == 0


def test_search_draws_are_distinct_and_seeded():
    space = models.SEARCH_SPACE["ordered"]
    draws = models.search_draws(space, 8, 42)
    assert draws == models.search_draws(space, 8, 42) and len({str(d) for d in draws}) == 8


def test_early_stop_and_tuning(spark, featured):
    parts = splits.stratified_split(featured, 0.3)
    model = prep.fit_preprocessor(parts.where("is_test = 0"), ["tenure_months", "support_tickets_30d"], ["contract_type"])
    table = prep.apply_preprocessor(parts, model).select("customer_id", "churn_label", "features", "is_test").cache()
    fitted = models.fit_early_stop(table.where("is_test = 0"), table.where("is_test = 1"), {"maxDepth": 2}, rounds=2, max_rounds=6)
    assert 1 <= fitted.getNumTrees <= 6
    best, results = models.tune(table.drop("is_test"), "ordered", {"maxDepth": [1, 2], "stepSize": [0.1], "positive_weight": [1.0, 2.0]}, n_iter=2, folds=2, rounds=2)
    assert results.count() == 2 and best["stepSize"] == 0.1


def test_cross_validation_summary(spark, featured):
    chosen = {"Decision Tree": models.baseline_estimators()["Decision Tree"], models.NEAREST: models.NEAREST}
    table = models.benchmark_baselines(featured, folds=2, estimators=chosen)
    rows = table.collect()
    assert {r.model_name for r in rows} == set(chosen)
    assert all(0 <= r.pr_auc_mean <= 1 and r.pr_auc_std >= 0 for r in rows)
    assert rows[0].pr_auc_mean >= rows[1].pr_auc_mean


def test_eight_baselines():
    assert len(models.baseline_estimators()) == 8


@pytest.mark.parametrize("kind", ["forest", "tree", "boosted", "linear"])
def test_row_contributions_add_up(spark, featured, kind):
    estimator = {
        "forest": RandomForestClassifier(numTrees=3, maxDepth=4, seed=1, **COMMON),
        "tree": DecisionTreeClassifier(maxDepth=4, **COMMON),
        "boosted": GBTClassifier(maxIter=3, maxDepth=3, seed=1, **COMMON),
        "linear": LogisticRegression(maxIter=20, **COMMON),
    }[kind]
    model = models.fit_scoring_model(featured, estimator)
    importances = explain.global_importances(model).collect()
    assert len(importances) == len(prep.feature_names(model))
    explained = explain.explain_model(featured, model, top_k=3)
    scored = model.transform(featured).select(
        "customer_id", vector_to_array("probability")[1].alias("p"), vector_to_array("rawPrediction")[1].alias("raw")
    )
    total = F.aggregate("contributions.impact_score", F.lit(0.0), lambda a, x: a + x).alias("moved")
    base = "base_value" if kind != "linear" else F.lit(0.0).alias("base_value")
    rows = explained.select("customer_id", total, base, "top_drivers", "summary_narrative").join(scored, "customer_id").collect()
    if kind == "linear":
        shift = {round(r.raw - r.moved, 6) for r in rows}
        assert len(shift) == 1
    elif kind == "boosted":
        assert all(r.base_value + r.moved == pytest.approx(r.raw, abs=1e-9) for r in rows)
    else:
        assert all(r.base_value + r.moved == pytest.approx(r.p, abs=1e-9) for r in rows)
    assert all(len(r.top_drivers) == 3 and r.summary_narrative.startswith("Primary churn drivers: ") for r in rows)


def test_global_drivers(spark):
    imp = spark.createDataFrame([("support_tickets_30d", 0.45), ("tenure_months", -0.30), ("monthly_charges", 0.10)], "feature string, importance double")
    df = spark.createDataFrame([(4, 3, 99.5)], "support_tickets_30d int, tenure_months int, monthly_charges double")
    row = explain.explain_global(df, imp, df.columns, top_k=2).first()
    assert [d.feature for d in row.top_drivers] == ["support_tickets_30d", "tenure_months"]
    assert row.top_drivers[0].value == "4" and "(increasing risk by 45.0%)" in row.summary_narrative


def test_partial_dependence_grid(spark):
    df = spark.createDataFrame([(float(i % 3), float(i)) for i in range(100)], "few double, many double")
    assert explain.grid_values(df, "few") == [0.0, 1.0, 2.0]
    grid = explain.grid_values(df, "many", 10)
    assert len(grid) == 10 and grid[0] == pytest.approx(4.41) and grid[-1] == pytest.approx(94.59)
    rows = explain.partial_dependence(df, lambda d: F.col("many") / 100.0, "many", 10).collect()
    assert len(rows) == 10 and all(r.average_predicted_probability == pytest.approx(r.grid_value / 100) for r in rows)


def test_scoring_with_and_without_model(spark, profile):
    plain = scoring.score_customers(profile)
    assert plain.where(F.col("model_version") != fixed.HEURISTIC_VERSION).count() == 0
    model = models.fit_scoring_model(add_domain_features(profile), LogisticRegression(maxIter=20, **COMMON))
    scored = scoring.score_customers(profile.drop("churn_probability"), model, "v1", explain.global_importances(model))
    assert scored.count() == profile.count() and scored.select("customer_id").distinct().count() == profile.count()
    row = scored.first()
    assert row.model_version == "v1" and len(row.top_business_reasons) == 3
    one = scoring.score_customers(profile.drop("churn_probability").where(F.col("customer_id") == row.customer_id), model, "v1").first()
    assert one.churn_probability == row.churn_probability


def test_registry_life(spark, tmp_path):
    path = str(tmp_path)
    model = prep.fit_preprocessor(toy(spark), ["x"], ["c"])
    registry.register_model(spark, path, model, "v1.0", {"pr_auc": 0.85})
    log = registry.register_model(spark, path, model, "v1.1", {"pr_auc": 0.88})
    assert log.count() == 2 and all(len(r.sha256) == 64 for r in log.collect())
    assert registry.active_versions(spark, path) == (None, None) and registry.resolve_model(spark, path) is None
    assert registry.rollback(spark, path) is False
    registry.promote(spark, path, "v1.0")
    assert registry.rollback(spark, path) is False
    registry.promote(spark, path, "v1.1")
    assert registry.active_versions(spark, path) == ("v1.1", "v1.0")
    assert registry.rollback(spark, path) is True
    assert registry.active_versions(spark, path) == ("v1.0", "v1.1")
    assert registry.rollback(spark, path) is True
    assert registry.active_versions(spark, path) == ("v1.1", "v1.0")
    with pytest.raises(ValueError, match="not found in model registry"):
        registry.promote(spark, path, "v9")
    assert registry.resolve_model(spark, path) is not None
    assert registry.latest_metrics(registry.read_registry(spark, path), "v1.1").first().metrics == {"pr_auc": 0.88}


def test_registry_state_equals_a_state_machine(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for name in range(40):
        active = previous = None
        for seq in range(int(rng.integers(1, 15))):
            if rng.random() < 0.5:
                tag = f"v{seq}"
                rows.append((f"r{name}", seq, "promote", tag))
                active, previous = tag, active
            else:
                rows.append((f"r{name}", seq, "rollback", None))
                if previous is not None:
                    active, previous = previous, active
        if active:
            want[f"r{name}"] = (active, previous)
    log = spark.createDataFrame(rows, "r string, seq int, action string, version_tag string")
    got = {x.r: (x.active_version, x.previous_version) for x in registry.registry_state(log, ["r"]).collect()}
    assert got == want


@pytest.mark.parametrize("old, new, passed, gain", [(None, 0.5, True, 0.0), (0.80, 0.81, True, 1.25), (0.80, 0.805, False, 0.63), (0.0, 0.1, True, 10000000.0)])
def test_gate(spark, old, new, passed, gain):
    row = registry.gate(spark.createDataFrame([(old, new)], "champion_pr_auc double, challenger_pr_auc double")).first()
    assert row.gate_passed is passed and row.relative_gain_pct == pytest.approx(gain, abs=0.011)


def test_retrain_cycle(spark, profile, tmp_path):
    from holdfast.operators.retrain import retrain_cycle
    from holdfast.catalog.fixtures import add_leakage_columns

    raw = add_leakage_columns(profile).drop("churn_probability")
    tree = DecisionTreeClassifier(maxDepth=3, **COMMON)
    first = retrain_cycle(raw, str(tmp_path), tag="a", estimator=tree).first()
    assert first.gate_passed and first.active_champion_version == "a" and first.gate_reason == fixed.GATE_FIRST
    second = retrain_cycle(raw, str(tmp_path), tag="b", estimator=tree).first()
    assert not second.gate_passed and second.active_champion_version == "a" and second.relative_gain_pct == 0.0
    model = registry.resolve_model(spark, str(tmp_path))
    assert scoring.score_customers(profile.drop("churn_probability"), model, "a").count() == profile.count()
