"""Early stopping, parallel search, tree groups, category shares, neighbours by labels and probes, explanation records."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.operators import explain, models, neighbours, prep, scoring, splits, trees
from holdfast.plans.parallel import in_parallel

COMMON = {"labelCol": "churn_label", "featuresCol": "features"}


@pytest.fixture(scope="module")
def table(spark):
    """600 rows, three numbers and a category; the label hangs on two of them."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(600):
        a, b, c = rng.normal(size=3)
        kind = ["x", "y", "z"][i % 3]
        p = 1 / (1 + np.exp(-(1.5 * a - b + (kind == "x"))))
        rows.append((i, float(a), float(b), float(c), kind, int(rng.random() < p)))
    df = spark.createDataFrame(rows, "customer_id long, a double, b double, c double, kind string, churn_label int").cache()
    model = prep.fit_preprocessor(df, ["a", "b", "c"], ["kind"])
    prepared = prep.apply_preprocessor(df, model).select("customer_id", "churn_label", "features").cache()
    return df, model, prepared


def probabilities(model, rows):
    return {r.customer_id: r.churn_probability for r in models.add_probability(model, rows).select("customer_id", "churn_probability").collect()}


def test_stopped_model_is_a_prefix(spark, table):
    parts = splits.stratified_split(table[2], 0.3)
    train, valid = (parts.where(f"is_test = {k}").drop("is_test").cache() for k in (0, 1))
    settings = {"maxDepth": 3, "stepSize": 0.3}
    full = models.boosted_estimator("level_wise", maxIter=24, **settings).setWeightCol("weight").fit(models.add_positive_weight(train, 1.0))
    best = models.stop_round(full.evaluateEachIteration(models.add_positive_weight(valid, 1.0)), 3)
    cut = models.fit_early_stop(train, valid, settings, rounds=3, max_rounds=24)
    assert cut.getNumTrees == best + 1 < 24
    again = models.boosted_estimator("level_wise", maxIter=best + 1, **settings).setWeightCol("weight").fit(models.add_positive_weight(train, 1.0))
    assert probabilities(cut, valid) == pytest.approx(probabilities(again, valid), abs=1e-12)
    assert probabilities(models.first_rounds(full, 24), valid) == probabilities(full, valid)


def test_learners_tables_have_partitions_by_rows(spark, table, monkeypatch):
    """40 slices and tasks for 600 rows are 40 tasks for every pass of every learner."""
    seen = []
    monkeypatch.setattr(models, "fit_early_stop", lambda train, valid, *rest: seen.extend([train.rdd.getNumPartitions(), train.count() + valid.count()]))
    monkeypatch.setattr(models, "_fold_rows", lambda folded, *rest: seen.extend([folded.rdd.getNumPartitions(), folded.groupBy("fold").count().count()]) or spark.createDataFrame([("a", 0, 0.0, *[0.5] * 6)], "model_name string, fold int, training_time_sec double, " + ", ".join(f"{m} double" for m in models.CURVE)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        models.stopped_early()(models.add_positive_weight(table[2], 1.0))
        models.benchmark_baselines(table[2], folds=3)
        assert seen == [1, 600, 1, 3] and models.fit_parts(table[2]) == 1
        monkeypatch.setattr(models, "FIT_ROWS", 250)
        assert models.fit_parts(table[2]) == 3
        monkeypatch.setattr(models, "FIT_ROWS", 1)
        assert models.fit_parts(table[2]) == 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_folds_do_not_hang_on_slices(spark, table):
    rows = lambda d: sorted(map(tuple, d.select("customer_id", "fold").collect()))
    assert rows(splits.stratified_folds(table[2], 3, parts=1)) == rows(splits.stratified_folds(table[2], 3, parts=7)) == rows(splits.stratified_folds(table[2], 3))


def test_learner_stops_by_itself(spark, table):
    parts = splits.stratified_split(table[2], 0.3)
    train, valid = (parts.where(f"is_test = {k}").drop("is_test") for k in (0, 1))
    fitted = models.fit_early_stop(train, valid, {"maxDepth": 3, "stepSize": 0.5}, rounds=None, max_rounds=30)
    assert 1 <= fitted.getNumTrees < 30


def test_cut_model_can_be_saved(spark, table, tmp_path):
    train = table[2]
    fitted = GBTClassifier(maxIter=4, maxDepth=2, seed=1, **COMMON).fit(train)
    cut = models.first_rounds(fitted, 2)
    cut.write().save(str(tmp_path / "cut"))
    assert cut.load(str(tmp_path / "cut")).getNumTrees == cut.getNumTrees == 2


def test_search_side_by_side_equals_one_after_the_other(spark, table):
    space = {"maxDepth": [1, 2], "stepSize": [0.3], "featureSubsetStrategy": ["0.6", "all"], "positive_weight": [1.0, 2.0]}
    found = [models.tune(table[2], "level_wise", space, n_iter=3, folds=2, rounds=3, threads=t) for t in (1, 4)]
    assert found[0][0] == found[1][0]
    assert [tuple(r) for r in found[0][1].collect()] == [tuple(r) for r in found[1][1].collect()]
    assert [r.best for r in found[0][1].collect()].count(True) == 1


def test_jobs_in_parallel_keep_their_order(spark):
    assert in_parallel(spark, [lambda k=k: spark.range(k).count() for k in range(7)], 3) == list(range(7))
    with pytest.raises(ZeroDivisionError):
        in_parallel(spark, [lambda: 1, lambda: 1 // 0], 2)


def test_tasks_of_learners_carry_short_plans(spark):
    """A learner's table is read from files, whatever it took to make it, and fits side by side have fewer tasks each."""
    table = spark.range(300).select(F.col("id").alias("customer_id"), (F.col("id") % 3 == 0).cast("int").alias("churn_label"))
    folded = models.dealt(splits.stratified_folds(table, 3), "customer_id")
    plan = folded._jdf.queryExecution().optimizedPlan().toString()
    assert folded.count() == 300 and not [step for step in ("Window", "Join", "Range") if step in plan]
    assert models.fit_parts(table, 90_000, 8) == 1 and models.fit_parts(table, 1, 8) == 1


def test_folds_are_measured_together(spark, monkeypatch):
    """Metrics of every model and fold are those of its own held-out rows, from one pass over the scores of all."""
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.normal(i % 2, 1)), i % 2) for i in range(200)]
    df = splits.stratified_folds(spark.createDataFrame(rows, "customer_id long, x double, churn_label int"), 2)
    asked = []
    monkeypatch.setattr(models, "evaluate", lambda *a, f=models.evaluate: asked.append(1) or f(*a))
    tree = models.baseline_estimators()["Decision Tree"]
    options = {"num_cols": ["x"], "cat_cols": []}
    found = {(r.model_name, r.fold): r for r in models._fold_rows(df, {"a": tree, "b": models.NEAREST}, "fold", "customer_id", **options).collect()}
    assert len(asked) == 1 and set(found) == {(m, f) for m in "ab" for f in (0, 1)}
    model = prep.fit_preprocessor(df.where("fold <> 1"), **options)
    table = models._model_table(df, model, ["customer_id", "fold"])
    want = models.measure(models.neighbour_scores(table.where("fold <> 1"), table.where("fold = 1"), "customer_id"))
    assert [found["b", 1][m] for m in models.CURVE] == pytest.approx([want[m] for m in models.CURVE])


@pytest.mark.parametrize("boosted", [False, True])
def test_tree_groups_add_up(spark, table, boosted):
    df, prepared, _ = table
    estimator = GBTClassifier(maxIter=5, maxDepth=3, seed=1, **COMMON) if boosted else RandomForestClassifier(numTrees=5, maxDepth=4, seed=1, **COMMON)
    model = models.fit_scoring_model(df, estimator, num_cols=["a", "b", "c"], cat_cols=["kind"])
    whole, parts = (trees.tree_contributions(df, model, n) for n in (500_000, 20))
    moved = lambda d: {r.customer_id: r.s for r in d.select("customer_id", (F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["impact_score"])).alias("s")).collect()}
    output = vector_to_array("rawPrediction")[1] if boosted else vector_to_array("probability")[1]
    want = {r.customer_id: r.o for r in model.transform(df).select("customer_id", output.alias("o")).collect()}
    assert moved(whole) == pytest.approx(want, abs=1e-9) and moved(parts) == pytest.approx(want, abs=1e-9)


def test_groups_of_trees():
    assert trees.tree_groups({0: 5, 1: 4, 2: 20, 3: 1, 4: 1}, 10) == [[0, 1], [2], [3, 4]]


def test_rare_categories_have_no_position(spark):
    many = spark.range(30_000).select((F.col("id") % 2).cast("int").alias("churn_label"), F.when(F.col("id") % 3 == 0, "common").otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("c"))
    model = prep.fit_preprocessor(many, [], ["c"])
    assert prep.feature_names(model) == ["cat__c_common"]
    got = [list(r.v) for r in prep.apply_preprocessor(many.limit(3), model).select(vector_to_array("features").alias("v")).collect()]
    assert sorted(got) == [[0.0], [0.0], [1.0]]


def test_missing_numbers_of_any_kind(spark):
    df = spark.createDataFrame([(1.0, 0), (float("nan"), 1), (None, 0), (5.0, 1)], "x double, churn_label int")
    for scaler in ("robust", "standard"):
        model = prep.fit_preprocessor(df, ["x"], [], scaler)
        got = [r.v[0] for r in prep.apply_preprocessor(df, model).select(vector_to_array("features").alias("v")).collect()]
        assert got[1] == got[2] and all(np.isfinite(got)) and got[0] < got[1] < got[3]


def vectors(spark, values, label=False):
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    return df if label else df.drop("label")


@pytest.mark.parametrize("same", [True, False])
def test_labelled_neighbours_equal_brute_force(spark, same):
    rng = np.random.default_rng(2)
    stored = rng.normal(size=(90, 4))
    stored[::3] = stored[0]
    asked = stored if same else rng.normal(size=(40, 4))
    found = neighbours.nearest_labelled(vectors(spark, stored, True).repartition(3), vectors(spark, asked).repartition(5), "label", 5, exclude_same_id=same)
    assert "Exchange" not in found.select("neighbours")._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        d = sorted((float(np.sqrt(((asked[r.query_id] - w) ** 2).sum())), i) for i, w in enumerate(stored) if not (same and i == r.query_id))[:5]
        assert [(n.id, n.label) for n in r.neighbours] == [(i, i % 2) for _, i in d]
    votes = neighbours.knn_vote(vectors(spark, stored, True), vectors(spark, asked), "label", 5, exclude_same_id=same)
    assert votes.groupBy("query_id").agg(F.sum("votes").alias("n")).where("n <> 5").count() == 0


@pytest.mark.parametrize("values", [1 << 22, 100_000])
def test_every_labelled_row_is_searched(spark, monkeypatch, values):
    """More than 50,000 labelled rows, sent to the tasks or in blocks: the closest are those beside each query."""
    monkeypatch.setattr(neighbours, "LABELLED_VALUES", values, raising=False)
    line = spark.range(60_000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"), (F.col("id") % 3).alias("label"))
    asked = line.where("id % 1000 = 7")
    found = neighbours.nearest_labelled(line, asked, "label", 4, exclude_same_id=True).collect()
    assert len(found) == 60
    for r in found:
        assert [(n.id - r.query_id, n.distance, n.label) for n in r.neighbours] == [(s, abs(s), (r.query_id + s) % 3) for s in (-1, 1, -2, 2)]
    votes = neighbours.knn_vote(line, asked, "label", 4, exclude_same_id=True).groupBy("query_id").agg(F.sum("votes").alias("n"))
    assert votes.where("n = 4").count() == 60


def test_neighbour_scores_use_every_training_row(spark):
    """Of 60,000 training rows, the seven beside each held-out one."""
    from pyspark.ml.functions import array_to_vector

    line = spark.range(60_000).select("id", array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), (F.col("id") % 10 == 0).cast("int").alias("churn_label"))
    rows = line.where("id % 1000 = 500").select((F.col("id") + 0.0).cast("bigint").alias("id"), "features")
    got = {r.id: r.churn_probability for r in models.neighbour_scores(line, rows, "id").collect()}
    assert got == {i: pytest.approx(1 / 7) for i in range(500, 60_000, 1000)}


@pytest.mark.parametrize("same", [True, False])
def test_blocks_of_neighbours_equal_brute_force(spark, monkeypatch, same):
    rng = np.random.default_rng(6)
    stored = rng.normal(size=(150, 4))
    stored[::3] = stored[0]
    asked = stored if same else rng.normal(size=(40, 4))
    given = vectors(spark, stored, True).withColumn("label", F.concat(F.lit("v"), F.col("label").cast("string")))
    monkeypatch.setattr(neighbours, "LEAST_QUERIES", 10)
    monkeypatch.setattr(neighbours, "LABELLED_VALUES", 100)
    found = neighbours.nearest_labelled(given, vectors(spark, asked), "label", 7, exclude_same_id=same).collect()
    assert len(found) == len(asked)
    for r in found:
        d = sorted((float(np.sqrt(((asked[r.query_id] - w) ** 2).sum())), i) for i, w in enumerate(stored) if not (same and i == r.query_id))[:7]
        assert [(n.distance, n.id, n.label) for n in r.neighbours] == [(x, i, f"v{i % 2}") for x, i in d]


def test_closest_rows_of_odd_vectors():
    """Copies, ties, large, tiny and unknown values: what single precision cannot tell apart is compared exactly."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 5))
    for x in (base, np.round(base), np.where(np.arange(300)[:, None] < 200, base[0], base), base * 1e18 + 1e20, base * 1e-25, base + 1e7,
              np.where(np.arange(300)[:, None] == 5, np.nan, base), base * 10.0 ** rng.integers(-8, 9, (300, 1))):
        ids = rng.permutation(900)[:300]
        at, row, distance = neighbours.k_closest(x[:40], ids[:40], x, ids, 6, True)
        for i in range(40):
            with np.errstate(invalid="ignore"):
                d = np.where(ids == ids[i], np.inf, np.sqrt(((x[i] - x) ** 2).sum(1)))
            best = [j for j in np.lexsort((ids, d))[:6] if np.isfinite(d[j])]
            assert row[at == i].tolist() == best and distance[at == i].tolist() == d[best].tolist()


def test_distances_held_at_once_are_bounded():
    import tracemalloc

    rng = np.random.default_rng(5)
    stored, ids = rng.normal(size=(40_000, 4)), np.arange(40_000)
    tracemalloc.start()
    at, row, _ = neighbours.k_closest(stored[:128], ids[:128], stored, ids, 3, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and at.tolist() == np.repeat(np.arange(128), 3).tolist() and row[::3].tolist() == list(range(128))


def test_labelled_rows_are_bounded(spark):
    rng = np.random.default_rng(3)
    stored = vectors(spark, rng.normal(size=(200, 3)), True)
    found = neighbours.nearest_labelled(stored, stored, "label", 3, max_rows=20).collect()
    assert len(found) == 200 and len({n.id for r in found for n in r.neighbours}) <= 20
    assert all(r.neighbours == [] for r in neighbours.nearest_labelled(stored.limit(0), stored, "label").collect())


def test_probes_find_nearly_all(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16)) * 4
    stored = centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 16))
    df = vectors(spark, stored)
    asked = df.where("id % 20 = 0")
    exact = neighbours.nearest(df, asked, 5, pivots=32, block_rows=200)
    found = neighbours.nearest(df, asked, 5, pivots=32, block_rows=200, probes=6)
    assert neighbours.recall(exact, exact) == 1.0 and neighbours.recall(found, exact) >= 0.9


def test_equal_importances_keep_model_order(spark):
    given = spark.createDataFrame([("zeta", 0.3, 0), ("alpha", -0.3, 1), ("mid", 0.5, 2)], "feature string, importance double, position int")
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "customer_id long, zeta double, alpha double, mid double")
    row = explain.explain_global(df, given, ["zeta", "alpha", "mid"], top_k=3).first()
    assert [d.feature for d in row.top_drivers] == ["mid", "zeta", "alpha"]
    moves = spark.createDataFrame([([("b", 1.0, 0.2), ("a", 1.0, -0.2), ("c", 1.0, 0.4)],)], "contributions array<struct<feature: string, value: double, impact_score: double>>")
    assert [d.feature for d in explain.rank_drivers(moves, "contributions", 3).first().top_drivers] == ["c", "b", "a"]


def test_scores_with_own_reasons(spark, profile):
    from pyspark.ml.classification import LogisticRegression

    from holdfast.operators.features import add_domain_features

    raw = profile.drop("churn_probability")
    featured = add_domain_features(raw)
    model = models.fit_scoring_model(featured, LogisticRegression(maxIter=10, **COMMON))
    means = explain.feature_means(featured, model)
    scored = scoring.score_customers(raw, model, "v1", own_reasons=True, means=means)
    assert not [c for c in scored.columns if c.startswith(("num__", "cat__", "ix__", "onehot__", "_"))]
    rows = scored.select("customer_id", "top_business_reasons").collect()
    assert len({tuple(r.top_business_reasons) for r in rows}) > 1 and all(len(r.top_business_reasons) == 3 for r in rows)
    one = scoring.score_customers(raw.where(F.col("customer_id") == rows[0].customer_id), model, "v1", own_reasons=True, means=means).first()
    assert one.top_business_reasons == rows[0].top_business_reasons
    bare = scoring.score_customers(raw.drop("contract_type").limit(3), model, "v1")
    assert {r.contract_type for r in bare.collect()} == {fixed.REQUEST_CHOICES["contract_type"][1]}
    record = explain.explanation_record(explain.explain_model(featured, model, 4, means).join(profile.select("customer_id", "churn_probability"), "customer_id")).first()
    assert record.summary_narrative.startswith(f"Primary churn drivers for customer {record.customer_id}: ") and len(record.top_drivers) == 4


def test_alerts_and_cycles_read_the_facts_once(spark, folder, monkeypatch):
    """What is fitted, scored and explained comes from one stored profile, not from the lines again each time."""
    from holdfast.catalog import training
    from holdfast.catalog.registry import QUERIES

    alerted = QUERIES["event_model_alerts"](spark, folder)
    assert not [f for f in alerted.inputFiles() if "lineitem" in f or "orders" in f]
    assert "array_sort" not in alerted._jdf.queryExecution().optimizedPlan().toString()

    class Seen(Exception):
        pass

    def look(raw, *args, **more):
        raise Seen(raw.inputFiles())

    monkeypatch.setattr(training.retrain, "retrain_cycle", look)
    with pytest.raises(Seen) as seen:
        QUERIES["retrain_cycle"](spark, folder)
    assert not [f for f in seen.value.args[0] if "lineitem" in f]
