"""The customer profile assembled from order, line and event facts.

One scan of each fact table. Lines are combined per order before they meet the
orders, orders per customer before they meet the customers, so every shuffle
carries partial aggregates, and a customer with very many orders is combined on
the map side. Small dimensions are broadcast by Spark's own size check
(``spark.sql.autoBroadcastJoinThreshold``), not by a hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.functions import scores
from holdfast.sources.tables import read_table

CUT_OFF = "2001-01-01 00:00:00"


def _at(text: str) -> Column:
    return F.expr(f"timestamp_ntz '{text}'")


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def order_lines(lineitem: DataFrame) -> DataFrame:
    """Return and payment indicators per order, from lines shipped before the cut-off."""
    shipped, tax = F.col("l_shipdate"), F.col("l_tax")
    returned = F.col("l_returnflag") == "R"
    failed = returned & (tax >= 0.07)
    return (
        lineitem.where(shipped < _at(CUT_OFF))
        .groupBy("l_orderkey")
        .agg(
            _count(returned & (shipped >= _at("2000-07-01 00:00:00"))).alias("t30"),
            _count(returned & (shipped >= _at("1999-07-01 00:00:00"))).alias("t90"),
            _count(failed & (shipped >= _at("1999-07-01 00:00:00"))).alias("pf"),
            _count(failed & (shipped >= _at("1998-01-01 00:00:00"))).alias("lp"),
            F.sum(F.when(shipped >= _at("2000-01-01 00:00:00"), F.col("l_quantity")).otherwise(0.0)).alias("qty"),
        )
    )


def order_history(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One row per ordering customer: latest terms, spend, order counts, line indicators, later orders."""
    date = F.col("o_orderdate")
    past = date < _at(CUT_OFF)
    lines = order_lines(lineitem)
    both = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    terms = F.max_by(
        F.struct("o_orderstatus", "o_orderpriority"), F.when(past, F.struct("o_orderdate", "o_orderkey"))
    )
    return (
        both.groupBy("o_custkey")
        .agg(
            terms.alias("terms"),
            F.sum(F.when(past, F.col("o_totalprice").cast("decimal(18,2)"))).cast("double").alias("total_raw"),
            _count(past & (date >= _at("2000-01-01 00:00:00"))).alias("n_cur"),
            _count((date >= _at("1999-01-01 00:00:00")) & (date < _at("2000-01-01 00:00:00"))).alias("n_prev"),
            *[F.sum(F.when(past, F.col(c))).alias(c) for c in ("t30", "t90", "pf", "lp", "qty")],
            F.max(F.when(~past, 1)).alias("later"),
        )
        .select("*", "terms.o_orderstatus", "terms.o_orderpriority")
        .drop("terms")
    )


def event_activity(events: DataFrame) -> DataFrame:
    kind, amount = F.col("event_type"), F.col("value")
    return events.groupBy("user_id").agg(
        F.count_distinct(F.col("ts").cast("date")).alias("days"),
        _count(kind.isin("view", "click")).alias("logins"),
        _count((kind == "error") & (amount >= 100)).alias("complaints"),
        _count((kind == "click") & (amount >= 100)).alias("chats"),
        F.sum(amount.cast("decimal(18,2)")).cast("double").alias("val"),
    )


def _yes_no(condition: Column) -> Column:
    return F.when(condition, "Yes").otherwise("No")


def _whole(value) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(value, F.lit(0)).cast("int")


def _real(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("double")


def profile_columns() -> dict[str, Column]:
    key = F.col("c_custkey")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    current, previous = F.coalesce("n_cur", F.lit(0)), F.coalesce("n_prev", F.lit(0))
    return {
        "customer_id": key,
        "age": (18 + (key * 13) % 57).cast("int"),
        "gender": F.when(key % 2 == 0, "Female").otherwise("Male"),
        "partner": _yes_no(key % 3 == 0),
        "dependents": _yes_no(key % 10 < 3),
        "geography": F.col("r_name"),
        "tenure_months": (1 + (key * 31) % 71).cast("int"),
        "contract_type": F.when(status == "F", "One year").when(status == "P", "Two year").otherwise("Month-to-month"),
        "payment_method": F.when(priority == "1-URGENT", "Credit card")
        .when(priority == "2-HIGH", "Bank transfer")
        .when(priority == "3-MEDIUM", "Mailed check")
        .otherwise("Electronic check"),
        "auto_pay_enabled": _yes_no(F.coalesce(priority.isin("1-URGENT", "2-HIGH"), F.lit(False))),
        "plan_tier": F.when(F.col("c_mktsegment") == "FURNITURE", "Standard")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "Premium")
        .when(F.col("c_mktsegment") == "MACHINERY", "Enterprise")
        .otherwise("Basic"),
        "monthly_charges": F.expr("cast(19.99 + cast(floor((c_acctbal + 1000) / 60) as decimal(10,2)) as double)"),
        "total_charges": F.round(_real("total_raw") / 1000, 2),
        "avg_monthly_gb_download": F.round(_real("qty") / 12, 1),
        "active_days_per_month": _whole("days"),
        "login_frequency_30d": _whole("logins"),
        "app_usage_hours": F.round(_real("val") / 10, 1),
        "feature_usage_score": ((key * 17) % 101).cast("double"),
        "change_in_usage_pct": F.round((current - previous) / F.greatest(previous, F.lit(1)).cast("double"), 3),
        "support_tickets_30d": _whole("t30"),
        "support_tickets_90d": _whole("t90"),
        "complaints_opened": _whole("complaints"),
        "resolution_satisfaction_score": (1 + (key * 7) % 5).cast("int"),
        "chat_interactions": _whole("chats"),
        "payment_failures_90d": _whole("pf"),
        "late_payments_12m": _whole("lp"),
        "price_increase_applied_30d": _yes_no(key % 5 == 0),
        "credit_card_expiring_soon": _yes_no(key % 12 == 3),
        "nps_score": ((key * 3) % 11).cast("int"),
        "competitor_offer_viewed": _yes_no(key % 4 == 1),
        "marketing_emails_opened_30d": (key % 15).cast("int"),
        "retention_offer_accepted": _yes_no(key % 8 == 2),
        "churn_label": F.when(F.col("later").isNull(), 1).otherwise(0).cast("int"),
    }


def customer_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Wide customer table, one row per customer, with the documented probability."""
    customer, nation, region, orders, lineitem, events = (
        read_table(spark, folder, t) for t in ("customer", "nation", "region", "orders", "lineitem", "events")
    )
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    history = order_history(orders, lineitem)
    activity = event_activity(events)
    facts = (
        customer.join(places, customer.c_nationkey == places.n_nationkey)
        .join(history, customer.c_custkey == history.o_custkey, "left")
        .join(activity, customer.c_custkey == activity.user_id, "left")
    )
    base = facts.select(*[c.alias(n) for n, c in profile_columns().items()])
    return base.withColumn(fixed.PROBABILITY, F.round(scores.ground_truth_score(), 6))


def base_charge(tier: Column) -> Column:
    pairs = [F.lit(x) for pair in fixed.BASE_CHARGE.items() for x in pair]
    return F.create_map(*pairs)[tier]


def pays_automatically(method: Column) -> Column:
    return method.isin(*fixed.AUTO_PAY_METHODS)
