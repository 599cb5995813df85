"""Literal cases for money and call lists."""

import pytest
from pyspark.sql import functions as F

from holdfast.functions import scores
from holdfast.operators import business


def test_clv_values(spark):
    df = spark.createDataFrame([(100.0, 12), (50.0, 24)], "monthly_charges double, tenure_months int")
    assert [r.clv for r in business.add_clv(df).orderBy("tenure_months").collect()] == [1800.0, 450.0]


def test_clv_keeps_existing_column_and_nulls(spark):
    df = spark.createDataFrame([(100.0, None, 7.0)], "monthly_charges double, tenure_months int, clv double")
    assert business.add_clv(df).first().clv == 7.0
    assert business.add_clv(df.drop("clv")).first().clv is None


def test_remaining_months_are_one_at_least(spark):
    df = spark.createDataFrame([(100.0, 60)], "monthly_charges double, tenure_months int")
    assert business.add_clv(df).first().clv == 75.0


def portfolio(spark, probabilities):
    rows = [(f"C{i}", 100.0, 12, p) for i, p in enumerate(probabilities)]
    return spark.createDataFrame(rows, "customer_id string, monthly_charges double, tenure_months int, churn_probability double")


def test_campaign_return(spark):
    row = business.portfolio_impact(portfolio(spark, [0.9] * 5 + [0.1] * 5), cost=50.0, success_rate=0.2).first()
    assert row.high_risk_customer_count == 5
    assert row.total_revenue_at_risk == 9000.0
    assert row.total_campaign_cost == 250.0
    assert row.projected_saved_customers == 1
    assert row.gross_saved_revenue == 1800.0
    assert row.net_saved_revenue == 1550.0
    assert row.campaign_roi_pct == pytest.approx(620.0)


def test_campaign_without_targets(spark):
    row = business.portfolio_impact(portfolio(spark, [0.1, 0.2])).first()
    assert (row.high_risk_customer_count, row.gross_saved_revenue, row.campaign_roi_pct) == (0, 0.0, 0.0)


def test_portfolio_of_no_customers(spark):
    row = business.portfolio_impact(portfolio(spark, [0.5]).where("false")).first()
    assert (row.total_customers, row.total_portfolio_clv, row.high_risk_prevalence) == (0, 0.0, 0.0)


def test_saved_customers_round_half_to_even(spark):
    row = business.portfolio_impact(portfolio(spark, [0.9] * 10), success_rate=0.25).first()
    assert row.projected_saved_customers == 2


def test_call_list(spark):
    rows = [
        ("C1", 100.0, 12, 0.8, "Month-to-month", 3, "No"),
        ("C2", 200.0, 12, 0.9, "One year", 0, "Yes"),
        ("C3", 50.0, 12, 0.2, "Two year", 1, "No"),
    ]
    df = spark.createDataFrame(
        rows,
        "customer_id string, monthly_charges double, tenure_months int, churn_probability double, contract_type string,"
        " support_tickets_30d int, price_increase_applied_30d string",
    )
    got = business.call_list(df, top_n=2).orderBy("rank").collect()
    assert [(r["rank"], r.customer_id, r.expected_dollar_risk) for r in got] == [(1, "C2", 3240.0), (2, "C1", 1440.0)]
    assert got[0].action_recommendation.startswith("Offer price lock")
    assert got[1].action_recommendation.startswith("Offer 12-month")


def test_call_list_without_optional_columns(spark):
    row = business.call_list(portfolio(spark, [0.9])).first()
    assert (row.contract_type, row.support_tickets_30d) == ("N/A", 0)
    assert row.action_recommendation.startswith("Proactive")


def test_grid_has_every_combination(spark):
    grid = business.campaign_grid(portfolio(spark, [0.9] * 4))
    assert grid.count() == 200 and grid.select("cost", "success_rate_pct").distinct().count() == 200


@pytest.mark.parametrize("p, tier", [(0.7, "High Risk"), (0.69, "Medium Risk"), (0.4, "Medium Risk"), (0.39, "Low Risk")])
def test_tiers(spark, p, tier):
    assert spark.range(1).select(scores.risk_tier(F.lit(p)).alias("t")).first().t == tier


@pytest.mark.parametrize(
    "name, impact, text",
    [
        ("num__support_tickets_30d", 0.24, "Frequent support tickets opened in last 30 days (increasing risk by 24.0%)"),
        ("cat__contract_type_Month-to-month", -0.18, "Flexible Month-to-month contract structure (decreasing risk by 18.0%)"),
        ("num__late_payments_12m", 0.051, "Late Payments 12M behavior (increasing churn risk by 5.1%)"),
        ("cat__geography_Asia-Pacific", 0.0, "Geography Asia-Pacific behavior (decreasing churn risk by 0.0%)"),
    ],
)
def test_feature_reasons(spark, name, impact, text):
    assert spark.range(1).select(scores.feature_reason(F.lit(name), F.lit(impact)).alias("r")).first().r == text
