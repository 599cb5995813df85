"""Money: lifetime value, portfolio at risk, campaign return, call list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.functions import scores
from holdfast.functions.numeric import money_sum, share


def add_clv(df: DataFrame, lifespan: float = fixed.LIFESPAN_MONTHS, margin: float = fixed.GROSS_MARGIN) -> DataFrame:
    """Add ``clv`` unless the table already carries it."""
    if "clv" in df.columns:
        return df
    return df.withColumn("clv", scores.clv(F.col("monthly_charges"), F.col("tenure_months"), lifespan, margin))


def add_expected_loss(df: DataFrame, prob: str = fixed.PROBABILITY, threshold: float = 0.5) -> DataFrame:
    p = F.col(prob)
    return add_clv(df).withColumns(
        {
            "expected_loss": p * F.col("clv"),
            "expected_revenue_risk": scores.dollar_risk(p, F.col("clv")),
            "is_high_risk": F.when(p >= threshold, 1).otherwise(0),
        }
    )


def portfolio_totals(df: DataFrame, prob: str = fixed.PROBABILITY, threshold: float = 0.5) -> DataFrame:
    """Customers, portfolio value, high-risk count and share, revenue at risk: one aggregate row."""
    targeted = F.col(prob) >= threshold
    totals = add_clv(df).agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.coalesce(money_sum(F.col("clv")), F.lit(0.0)).alias("total_portfolio_clv"),
        F.count_if(targeted).alias("high_risk_customer_count"),
        F.coalesce(money_sum(F.when(targeted, F.col("clv"))), F.lit(0.0)).alias("total_revenue_at_risk"),
    )
    return totals.withColumn(
        "high_risk_prevalence", share(F.col("high_risk_customer_count"), F.col("total_customers"))
    )


def campaign_columns(cost: Column, rate: Column) -> dict[str, Column]:
    """Outcome of a campaign on the targeted customers of ``portfolio_totals``."""
    targeted = F.col("high_risk_customer_count")
    saved = F.rint(targeted * rate)
    spent = targeted * cost
    gross = share(F.col("total_revenue_at_risk"), targeted) * saved
    net = gross - spent
    return {
        "projected_saved_customers": saved.cast("bigint"),
        "total_campaign_cost": spent.cast("double"),
        "gross_saved_revenue": gross,
        "net_saved_revenue": net,
        "campaign_roi_pct": share(net, spent) * 100.0,
    }


def portfolio_impact(
    df: DataFrame,
    prob: str = fixed.PROBABILITY,
    threshold: float = 0.5,
    cost: float = fixed.CAMPAIGN_COST,
    success_rate: float = fixed.CAMPAIGN_SUCCESS,
) -> DataFrame:
    totals = portfolio_totals(df, prob, threshold)
    return totals.withColumns(campaign_columns(F.lit(float(cost)), F.lit(float(success_rate))))


def campaign_grid(
    df: DataFrame,
    prob: str = fixed.PROBABILITY,
    threshold: float = 0.5,
    costs: range = range(10, 201, 10),
    rates: range = range(5, 51, 5),
) -> DataFrame:
    """Campaign outcome for every cost and success rate (percent): the one totals row is expanded, not joined."""
    grid = portfolio_totals(df, prob, threshold).select(
        "*",
        F.explode(F.array(*[F.lit(float(c)) for c in costs])).alias("cost"),
    ).select("*", F.explode(F.array(*[F.lit(r) for r in rates])).alias("success_rate_pct"))
    return grid.withColumns(campaign_columns(F.col("cost"), F.col("success_rate_pct") / F.lit(100.0)))


def call_list(df: DataFrame, prob: str = fixed.PROBABILITY, top_n: int = 100, key: str = fixed.ID) -> DataFrame:
    """The ``top_n`` customers by expected dollar loss, with rank and offer.

    Top-n is taken per task before the merge; the rank window sees top_n rows only.
    """
    columns = df.columns

    def have(name: str, default) -> Column:
        return F.col(name) if name in columns else F.lit(default)

    contract, tickets = have("contract_type", "N/A"), have("support_tickets_30d", 0)
    risk = scores.dollar_risk(F.col(prob), F.col("clv"))
    top = (
        add_clv(df)
        .select(
            key,
            F.col(prob).cast("double").alias("churn_probability"),
            F.col("clv"),
            risk.alias("expected_dollar_risk"),
            contract.alias("contract_type"),
            tickets.alias("support_tickets_30d"),
            scores.call_action(contract, tickets, have("price_increase_applied_30d", "No")).alias("action_recommendation"),
        )
        .orderBy(F.desc("expected_dollar_risk"), key)
        .limit(top_n)
    )
    order = Window.orderBy(F.desc("expected_dollar_risk"), key)
    return top.select(F.row_number().over(order).alias("rank"), "*")
