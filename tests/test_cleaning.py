"""Cleaning, quality, leakage, versions, requests."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.operators import cleaning, features, leakage, quality, validation, versions
from holdfast.sources import tables
from holdfast.catalog.fixtures import add_leakage_columns


def test_duplicates_keep_the_first(spark):
    rows = [(i, 0, "first") for i in range(50)] + [(i, 1, "copy") for i in range(10)]
    df = spark.createDataFrame(rows, "customer_id long, arrival int, note string")
    kept = cleaning.dedup_by_key(df, order_col="arrival")
    assert kept.count() == 50 and kept.where("note = 'copy'").count() == 0
    assert cleaning.dedup_by_key(df).count() == 50


def test_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("customer_id"), F.col("id").alias("arrival"))
    plan = cleaning.dedup_by_key(df, order_col="arrival")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_rows_without_key(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, y string")
    assert cleaning.clean_customers(df).count() == 2


def test_coercion(spark):
    df = spark.createDataFrame([("C1", " 12.5 ", "\tYes \n", "1"), ("C2", "n/a", None, "0")], "customer_id string, monthly_charges string, partner string, churn_label string")
    rows = {r.customer_id: r for r in cleaning.clean_customers(df).collect()}
    assert (rows["C1"].monthly_charges, rows["C1"].partner, rows["C1"].churn_label) == (12.5, "Yes", 1)
    assert rows["C2"].monthly_charges is None and rows["C2"].partner is None


def test_missing_label_stops(spark):
    df = spark.createDataFrame([("C1", None)], "customer_id string, churn_label string")
    with pytest.raises(PySparkException):
        cleaning.clean_customers(df).collect()


def test_quality_of_gaps_and_copies(spark):
    df = spark.createDataFrame([("C1", 1.0, None), ("C1", 1.0, None), ("C2", None, "x")], "customer_id string, age double, churn_reason_recorded string")
    nulls = {r["column"]: (r.null_count, r.null_pct) for r in quality.quality_nulls(df).collect()}
    assert nulls == {"customer_id": (0, 0.0), "age": (1, 33.33), "churn_reason_recorded": (2, 66.67)}
    alerts = [r.alert for r in quality.quality_alerts(df).collect()]
    assert alerts == ["Found 1 duplicate customer rows.", "Predictor column 'age' has 1 (33.33%) missing values."]
    summary = quality.quality_summary(df).first()
    assert (summary.total_rows, summary.total_columns, summary.duplicate_rows, summary.alert_count) == (3, 3, 1, 2)


def test_duplicates_with_swapped_nulls_are_not_copies(spark):
    df = spark.createDataFrame([(None, 1), (1, None)], "a int, b int")
    assert quality.duplicate_rows(df).first().duplicate_rows == 0


def test_numeric_profile_exact_and_sketched(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 102)] + [(None,)], "age double")
    for exact in (True, False):
        row = quality.quality_numeric(df, ["age"], exact).first()
        assert (row["mean"], row["min"], row.p25, row.median, row.p75, row["max"]) == (51.0, 1.0, 26.0, 51.0, 76.0, 101.0)
    assert row["std"] == pytest.approx(29.3, abs=0.01)


def test_nan_is_missing(spark):
    from holdfast.functions.features import flag_features
    from holdfast.operators import cleaning, prep

    nan = float("nan")
    df = spark.createDataFrame([(1.0,), (3.0,), (nan,), (None,)], "age double")
    row = quality.quality_numeric(df, ["age"]).first()
    assert (row["mean"], row["min"], row["max"]) == (2.0, 1.0, 3.0)
    filled = prep.apply_impute(df, prep.fit_impute(df, ["age"], []), ["age"], [])
    assert sorted(r["age"] for r in filled.collect()) == [1.0, 2.0, 2.0, 3.0]
    clipped = prep.clip_outliers(df, prep.fit_clip_bounds(df, ["age"]), ["age"])
    assert sorted((r["age"] for r in clipped.collect()), key=str) == [1.0, 3.0, None, None]
    text = spark.createDataFrame([(" 4 ",), ("nan",), ("x",)], "age string")
    assert [r[0] for r in text.select(cleaning.coerce_number("age")).collect()] == [4.0, None, None]
    one = spark.createDataFrame([(nan, nan, nan)], "support_tickets_30d double, payment_failures_90d double, late_payments_12m double")
    flags = one.select(*[v.alias(k) for k, v in flag_features(one.columns).items() if k in ("has_high_support_tickets", "has_payment_issue")]).first()
    assert tuple(flags) == (0, 0)


def test_leakage_guard(spark, profile):
    leaky = add_leakage_columns(profile)
    assert leakage.audit_leakage(leaky) == fixed.LEAKAGE
    with pytest.raises(leakage.TargetLeakageError, match="CRITICAL DATA LEAKAGE VIOLATION"):
        leakage.assert_no_leakage(leaky)
    with pytest.raises(ValueError):
        leakage.assert_no_leakage(leaky)
    clean = leakage.strip_leakage(leaky)
    assert leakage.assert_no_leakage(clean) is clean
    assert not leakage.audit_leakage(features.add_domain_features(leaky).columns)
    assert leakage.audit_leakage(features.add_domain_features(leaky, guard=False)) == fixed.LEAKAGE


def test_leakage_semantics_counts_violations(spark):
    df = spark.createDataFrame(
        [(1, "2026-06-01", 1, 1, "Relocation"), (1, None, 1, 1, "Relocation"), (0, None, 1, 0, None)],
        "churn_label int, cancellation_processed_date string, final_invoice_flag int, account_status_deactivated int, churn_reason_recorded string",
    )
    found = {r.field: (r.missing_for_churned, r.set_for_retained) for r in leakage.leakage_semantics(df).collect()}
    assert found["cancellation_processed_date"] == (1, 0) and found["final_invoice_flag"] == (0, 1)


def test_checksum_ignores_order_and_files(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 1.5), (3, "", None)], "x int, y string, z double")
    a = versions.row_hash(df).first()
    b = versions.row_hash(df.orderBy(F.desc("x")).repartition(3)).first()
    assert a == b and len(a.sha256_checksum) == 64
    changed = versions.row_hash(df.withColumn("y", F.coalesce("y", F.lit("")))).first()
    assert changed.sha256_checksum != a.sha256_checksum
    moved = spark.createDataFrame([("ab", "c"), ("a", "bc")], "p string, q string")
    assert moved.select(versions.row_text(moved).alias("t")).distinct().count() == 2


def test_dataset_version(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a int, b int")
    row = versions.register_dataset_version(df, "toy", str(tmp_path), {"owner": "tests"}).first()
    assert (row.n_rows, row.n_columns, row.columns, row.custom_metadata) == (3, 2, ["a", "b"], {"owner": "tests"})
    assert len(row.sha256_checksum) == 64
    assert spark.read.parquet(row.filepath).count() == 3


def test_dataset_manifest_files(spark, profile, tmp_path):
    manifest = versions.write_dataset(profile, str(tmp_path), seed=42).first()
    assert manifest.n_samples == profile.count() and manifest.seed == 42
    assert spark.read.json(f"{tmp_path}/manifest").first().target_column == "churn_label"


def test_csv_round_trip(spark, profile, tmp_path):
    path = str(tmp_path / "customers.csv")
    tables.write_table(add_leakage_columns(profile).drop("churn_probability"), path, "csv")
    back = tables.read_customers(spark, path)
    assert back.count() == profile.count()
    kinds = dict(back.dtypes)
    assert (kinds["age"], kinds["monthly_charges"], kinds["churn_label"]) == ("int", "double", "int")
    raw = tables.read_customers(spark, path, raw=True)
    assert dict(raw.dtypes)["age"] == "string"
    assert cleaning.clean_customers(raw).agg(F.sum("age")).first()[0] == profile.agg(F.sum("age")).first()[0]


def test_reports_and_call_list_files(spark, tmp_path, profile):
    from holdfast.operators.business import call_list

    tables.write_report(quality.quality_target(profile), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().total_count == profile.count()
    tables.write_call_list(call_list(profile, top_n=5), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 5


def request(**changes):
    return {"customer_id": "C1", "monthly_charges": 95.5, "tenure_months": 3, **changes}


REQUEST_SCHEMA = "customer_id string, monthly_charges double, tenure_months int, plan_tier string, support_tickets_30d int"


@pytest.mark.parametrize(
    "changes, reasons",
    [
        ({}, []),
        ({"monthly_charges": -50.0}, ["monthly_charges: below 0.0"]),
        ({"monthly_charges": 1000.5, "tenure_months": 121}, ["tenure_months: above 120", "monthly_charges: above 1000.0"]),
        ({"plan_tier": "Gold"}, ["plan_tier: not one of Basic, Standard, Premium, Enterprise"]),
    ],
)
def test_request_bounds(spark, changes, reasons):
    from pyspark.sql.types import _parse_datatype_string

    df = tables.records(spark, [request(**changes)], _parse_datatype_string(REQUEST_SCHEMA))
    checked = validation.validate_requests(df)
    row = checked.first()
    assert row.reasons == reasons
    assert (row.support_tickets_30d, row.app_logins_30d) == (2, 8)
    assert validation.valid_requests(checked).count() == (0 if reasons else 1)
    assert validation.rejected_requests(checked).count() == (1 if reasons else 0)


def test_requests_as_text(spark):
    df = spark.createDataFrame([("C1", "abc", "3.5")], "customer_id string, monthly_charges string, tenure_months string")
    assert validation.validate_requests(df).first().reasons == ["tenure_months: not a whole number", "monthly_charges: not a number"]


def test_features_of_null_cells(spark):
    df = spark.createDataFrame([(None, None, None, None)], "monthly_charges double, total_charges double, tenure_months int, support_tickets_30d int")
    row = features.add_domain_features(df).first()
    assert row.charges_per_tenure is None and row.has_high_support_tickets == 0 and row.is_month_to_month == 1
