"""Money, scores, metrics, fairness, comparison, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.catalog.customers import BAND, even, feature_sql
from holdfast.catalog.registry import profile_sql, query
from holdfast.functions import scores
from holdfast.operators import business, compare, drift, fairness, features, metrics, scoring
from holdfast.plans.running import exact_quantiles
from holdfast.plans.storage import new_path
from holdfast.sources.events import read_event_stream
from holdfast.sources.profile import customer_profile
from holdfast.sources.tables import read_table
from holdfast.streaming import jobs

CLV = even("monthly_charges * greatest(36.0e0 - tenure_months, 1.0e0) * 0.75e0", 2)
HEURISTIC = (
    "least(0.99e0, 0.1e0 + case when contract_type = 'Month-to-month' then 0.3e0 else 0e0 end"
    " + case when support_tickets_30d >= 2 then 0.3e0 else 0e0 end"
    " + case when price_increase_applied_30d = 'Yes' then 0.2e0 else 0e0 end)"
)


def tier_sql(p: str) -> str:
    return f"case when {p} >= 0.7e0 then 'High Risk' when {p} >= 0.4e0 then 'Medium Risk' else 'Low Risk' end"


def action_sql(tier: str) -> str:
    return f"case {tier} " + " ".join(f"when '{t}' then '{a}'" for t, a in fixed.TIER_ACTIONS.items()) + " end"


SCORED = (
    f", s as (select *, {CLV} as clv from profile)"
    f", h as (select customer_id, contract_type, support_tickets_30d, monthly_charges, tenure_months, {HEURISTIC} as p, {CLV} as clv from profile)"
)


def rounded(df, places, *columns):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("clv", profile_sql(SCORED + f" select customer_id, clv, {even('churn_probability * clv', 2)} as expected_revenue_risk,"
       " round(churn_probability * clv, 6) as expected_loss, case when churn_probability >= 0.5 then 1 else 0 end as is_high_risk from s"))
def _clv(spark, folder):
    valued = business.add_expected_loss(customer_profile(spark, folder))
    return rounded(valued, 6, "expected_loss").select("customer_id", "clv", "expected_revenue_risk", "expected_loss", "is_high_risk")


@query("heuristic_scores", profile_sql(
    SCORED + f" select customer_id, {even('p', 4)} as churn_probability, case when p >= 0.5 then 1 else 0 end as churn_prediction,"
    f" {tier_sql('p')} as risk_level, clv as estimated_clv, {action_sql(tier_sql('p'))} as recommended_retention_action,"
    f" '{fixed.HEURISTIC_VERSION}' as model_version, '{'; '.join(fixed.HEURISTIC_REASONS)}' as reasons from h"))
def _heuristic(spark, folder):
    scored = scoring.score_customers(customer_profile(spark, folder))
    return scored.select(
        "customer_id", "churn_probability", "churn_prediction", "risk_level", "estimated_clv",
        "recommended_retention_action", "model_version", F.array_join("top_business_reasons", "; ").alias("reasons"),
    )


@query("risk_tiers", profile_sql(
    f"select {tier_sql('churn_probability')} as risk_level, {action_sql(tier_sql('churn_probability'))} as action,"
    " count(*) as n from profile group by all"))
def _tiers(spark, folder):
    tiered = customer_profile(spark, folder).withColumn("risk_level", scores.risk_tier(F.col("churn_probability")))
    return tiered.groupBy("risk_level", scores.tier_action(F.col("risk_level")).alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("batch_summary", profile_sql(
    SCORED + " select count(*) as total_processed, count(*) filter (p >= 0.5) as predicted_churn_count,"
    " count(*) filter (p >= 0.7e0) as high_risk_count,"
    " coalesce(cast(sum(cast(clv as decimal(18,2))) filter (p >= 0.5) as double), 0) as total_revenue_at_risk from h"))
def _batch(spark, folder):
    return scoring.batch_summary(scoring.score_customers(customer_profile(spark, folder)))


@query("scoring_counters", profile_sql(
    SCORED + " select count(*) as requests_total, count(*) as predictions_total, count(*) filter (p >= 0.7e0) as high_risk_total from h"))
def _counters(spark, folder):
    return scoring.scoring_counters(scoring.score_customers(customer_profile(spark, folder)))


TOTALS = (
    SCORED + ", t as (select count(*) as total_customers, cast(sum(cast(clv as decimal(18,2))) as double) as total_portfolio_clv,"
    " count(*) filter (churn_probability >= 0.5) as high_risk_customer_count,"
    " cast(sum(cast(clv as decimal(18,2))) filter (churn_probability >= 0.5) as double) as total_revenue_at_risk from s)"
    ", u as (select *, high_risk_customer_count::double / total_customers as high_risk_prevalence from t)"
)


def outcome_sql(cost: str, rate: str) -> str:
    n = "high_risk_customer_count"
    return (
        f"cast(round_even({n} * {rate}, 0) as bigint) as projected_saved_customers,"
        f" {n} * {cost} as total_campaign_cost,"
        f" round(total_revenue_at_risk / {n} * round_even({n} * {rate}, 0), 6) as gross_saved_revenue,"
        f" round(total_revenue_at_risk / {n} * round_even({n} * {rate}, 0) - {n} * {cost}, 6) as net_saved_revenue,"
        f" round((total_revenue_at_risk / {n} * round_even({n} * {rate}, 0) - {n} * {cost}) / ({n} * {cost}) * 100, 6) as campaign_roi_pct"
    )


MONEY = ["gross_saved_revenue", "net_saved_revenue", "campaign_roi_pct"]


@query("portfolio_impact", profile_sql(
    TOTALS + " select * exclude (high_risk_prevalence), round(high_risk_prevalence, 9) as high_risk_prevalence, "
    + outcome_sql("50e0", "0.25e0") + " from u"))
def _impact(spark, folder):
    impact = business.portfolio_impact(customer_profile(spark, folder))
    return rounded(rounded(impact, 6, *MONEY), 9, "high_risk_prevalence")


@query("campaign_grid", profile_sql(
    TOTALS + ", g as (select c::double as cost, r::int as success_rate_pct from range(10, 201, 10) a(c), range(5, 51, 5) b(r))"
    " select cost, success_rate_pct, " + outcome_sql("cost", "(success_rate_pct / 100e0)") + " from u, g"))
def _grid(spark, folder):
    grid = business.campaign_grid(customer_profile(spark, folder))
    return rounded(grid, 6, *MONEY).select("cost", "success_rate_pct", "projected_saved_customers", "total_campaign_cost", *MONEY)


@query("call_list", profile_sql(
    SCORED + f", r as (select *, {even('churn_probability * clv', 2)} as expected_dollar_risk from s)"
    " select cast(row_number() over (order by expected_dollar_risk desc, customer_id) as int) as rank, customer_id, churn_probability, clv,"
    " expected_dollar_risk, contract_type, support_tickets_30d,"
    f" case when contract_type = 'Month-to-month' and support_tickets_30d >= 2 then '{fixed.CALL_CONTRACT}'"
    f" when price_increase_applied_30d = 'Yes' then '{fixed.CALL_PRICE}' else '{fixed.CALL_REVIEW}' end as action_recommendation"
    " from r order by rank limit 100"))
def _call_list(spark, folder):
    return business.call_list(customer_profile(spark, folder))


@query("customer_detail", profile_sql(
    SCORED + f" select customer_id, churn_probability, clv, {even('churn_probability * clv', 2)} as expected_revenue_risk, tenure_months,"
    " contract_type, monthly_charges, support_tickets_30d, case when churn_probability >= 0.5 then 1 else 0 end as churn_prediction"
    " from s where customer_id = (select customer_id from s order by churn_probability desc, customer_id limit 1)"))
def _detail(spark, folder):
    valued = business.add_clv(customer_profile(spark, folder))
    worst = scoring.highest_risk(valued).select("customer_id").scalar()
    return scoring.customer_detail(valued, worst)


@query("what_if", profile_sql(
    ", c as (select 'as is' as scenario, contract_type, support_tickets_30d, price_increase_applied_30d from profile"
    " union all select 'price increase', contract_type, support_tickets_30d, 'Yes' from profile"
    " union all select 'two more tickets', contract_type, support_tickets_30d + 2, price_increase_applied_30d from profile"
    " union all select 'yearly contract', 'One year', support_tickets_30d, price_increase_applied_30d from profile)"
    f", h as (select scenario, {HEURISTIC} as p from c)"
    f" select scenario, count(*) as customers, round(avg({even('p', 4)}), 6) as mean_probability,"
    f" count(*) filter (p >= 0.7e0) as high_risk from h group by scenario"))
def _what_if(spark, folder):
    scored = scoring.what_if(
        customer_profile(spark, folder),
        {
            "as is": {},
            "price increase": {"price_increase_applied_30d": "Yes"},
            "two more tickets": {"support_tickets_30d": F.col("support_tickets_30d") + 2},
            "yearly contract": {"contract_type": "One year"},
        },
    )
    return scored.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("customers"),
        F.round(F.avg("churn_probability"), 6).alias("mean_probability"),
        F.count_if(F.col("risk_level") == "High Risk").alias("high_risk"),
    )


@query("label_by_rate", profile_sql(
    ", q as (select round(quantile_cont(churn_probability, 0.82), 9) as cut from profile)"
    " select customer_id, case when churn_probability >= cut then 1 else 0 end as label from profile, q"))
def _label(spark, folder):
    profile = customer_profile(spark, folder)
    cut = exact_quantiles(profile.select("churn_probability"), "churn_probability", [0.82])
    threshold = cut.select(F.round(F.col("quantiles")[0], 9).alias("cut")).scalar()
    return profile.withColumn("_cut", threshold).select(
        "customer_id", F.when(F.col("churn_probability") >= F.col("_cut"), 1).otherwise(0).alias("label")
    )


CURVE = ["pr_auc", "roc_auc", "f1_score", "precision", "recall", "log_loss", "brier_score", "positive_rate"]


def metrics_sql(source: str, groups: str, label: str = "churn_label", prob: str = "churn_probability") -> str:
    """CTEs ``g`` (grouped scores), ``w`` (running sums), ``m`` (metrics)."""
    by = f"{groups}, " if groups else ""
    part = f"partition by {groups} " if groups else ""
    group = f" group by {groups}" if groups else ""
    return f"""
    , g as (select {by}{prob} as p, count(*) filter ({label} = 1) as pos, count(*) filter ({label} <> 1) as neg
        from {source} group by {by}{prob})
    , w as (select *, cast(sum(pos) over o as double) as tp, cast(sum(neg) over o as double) as fp,
        cast(sum(pos) over a as double) as np, cast(sum(neg) over a as double) as nn
        from g window o as ({part}order by p desc), a as ({part}))
    , x as (select {by} cast(sum(pos + neg) as bigint) as "count", max(np) as np, max(nn) as nn,
        sum(neg * (tp - pos + tp) / 2) as roc,
        sum(pos * (tp / (tp + fp) + case when tp - pos + fp - neg > 0 then (tp - pos) / (tp - pos + fp - neg) else 1 end) / 2) as pr,
        sum(-(pos * ln(greatest(p, 2.220446049250313e-16)) + neg * ln(1 - least(p, 1 - 2.220446049250313e-16)))) as loss,
        sum(pos * (1 - p) * (1 - p) + neg * p * p) as brier,
        coalesce(cast(sum(neg) filter (p < 0.5) as bigint), 0) as true_negatives,
        coalesce(cast(sum(neg) filter (p >= 0.5) as bigint), 0) as false_positives,
        coalesce(cast(sum(pos) filter (p < 0.5) as bigint), 0) as false_negatives,
        coalesce(cast(sum(pos) filter (p >= 0.5) as bigint), 0) as true_positives
        from w{group})
    , m as (select {by} "count", round(np / "count", 8) as positive_rate,
        case when np > 0 and nn > 0 then round(pr / np, 8) end as pr_auc,
        case when np > 0 and nn > 0 then round(roc / (np * nn), 8) end as roc_auc,
        round(case when 2 * true_positives + false_positives + false_negatives > 0
            then 2.0::double * true_positives / (2 * true_positives + false_positives + false_negatives) else 0 end, 8) as f1_score,
        round(case when true_positives + false_positives > 0 then true_positives::double / (true_positives + false_positives) else 0 end, 8) as precision,
        round(case when true_positives + false_negatives > 0 then true_positives::double / (true_positives + false_negatives) else 0 end, 8) as recall,
        round(loss / "count", 8) as log_loss, round(brier / "count", 8) as brier_score, 0.5::double as threshold_used,
        true_negatives, false_positives, false_negatives, true_positives from x)
    """


@query("confusion", profile_sql(
    "select count(*) filter (churn_label = 0 and churn_probability < 0.5) as true_negatives,"
    " count(*) filter (churn_label = 0 and churn_probability >= 0.5) as false_positives,"
    " count(*) filter (churn_label = 1 and churn_probability < 0.5) as false_negatives,"
    " count(*) filter (churn_label = 1 and churn_probability >= 0.5) as true_positives from profile"))
def _confusion(spark, folder):
    return metrics.confusion(customer_profile(spark, folder), "churn_label", "churn_probability")


@query("metrics_overall", profile_sql(metrics_sql("profile", "") + " select * from m"))
def _metrics(spark, folder):
    return rounded(metrics.classification_metrics(customer_profile(spark, folder), "churn_label", "churn_probability"), 8, *CURVE)


@query("curve_points", profile_sql(
    metrics_sql("profile", "") + " select p as threshold, cast(tp as bigint) as true_positives, cast(fp as bigint) as false_positives,"
    " round(fp / nn, 9) as fpr, round(tp / np, 9) as recall, round(tp / (tp + fp), 9) as precision from w"))
def _curve(spark, folder):
    points = metrics.curve_points(customer_profile(spark, folder), "churn_label", "churn_probability")
    return rounded(points, 9, "fpr", "recall", "precision")


DOCS = "d as (select quality, 1 - 1.0e0 / (1 + n_chars / 1000.0e0) as p, lang from labels join documents using (doc_id))"


@query("text_quality_metrics", "with " + DOCS + metrics_sql("d", "lang", "quality", "p") + " select * from m")
def _text_metrics(spark, folder):
    labels, documents = (read_table(spark, folder, t) for t in ("labels", "documents"))
    scored = labels.join(documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        "lang", "quality", (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.col("n_chars") / F.lit(1000.0))).alias("p")
    )
    return rounded(metrics.classification_metrics(scored, "quality", "p", ["lang"]), 8, *CURVE)


@query("calibration", profile_sql(
    ", b as (select *, " + " + ".join(f"case when churn_probability > {i / 10}e0 then 1 else 0 end" for i in range(1, 10))
    + " as bin from profile) select bin, round(avg(churn_label), 9) as prob_true, round(avg(churn_probability), 9) as prob_pred,"
    " count(*) as n from b group by bin"))
def _calibration(spark, folder):
    curve = metrics.calibration_curve(customer_profile(spark, folder), "churn_label", "churn_probability")
    return rounded(curve, 9, "prob_true", "prob_pred")


@query("min_max_score", profile_sql(
    ", t as (select customer_id, nps_score - support_tickets_30d as v from profile), b as (select min(v) as lo, max(v) as hi from t)"
    " select customer_id, round((v - lo) / (hi - lo + 1e-8), 9) as score from t, b"))
def _min_max(spark, folder):
    margin = customer_profile(spark, folder).select("customer_id", (F.col("nps_score") - F.col("support_tickets_30d")).alias("v"))
    return rounded(metrics.min_max_score(margin, "v", "score"), 9, "score").select("customer_id", "score")


SEGMENT = (
    f", b as (select *, {BAND} from profile), l as ("
    + " union all ".join(f"select '{c}' as segment_column, {c} as segment_value, churn_label, churn_probability from b where {c} is not null" for c in fixed.SEGMENTS)
    + ")"
)
FAIR = ["actual_churn_rate", "pr_auc", "roc_auc", "f1_score", "precision", "recall", "error_rate"]


@query("segment_fairness", profile_sql(
    SEGMENT + metrics_sql("l", "segment_column, segment_value")
    + ' select segment_column, segment_value, "count", positive_rate as actual_churn_rate, pr_auc, roc_auc, f1_score, precision, recall,'
    ' round(1 - f1_score, 8) as error_rate from m where "count" >= 20'))
def _fairness(spark, folder):
    return rounded(fairness.segment_fairness(customer_profile(spark, folder)), 8, *FAIR)


@query("fairness_report", profile_sql(
    SEGMENT + ", wl as (select * from l union all select 'overall', 'all', churn_label, churn_probability from b)"
    + metrics_sql("wl", "segment_column, segment_value")
    + ", seen as (select *, round(1 - f1_score, 8) as error_rate from m where \"count\" >= 20 or segment_column = 'overall')"
    + ', ov as (select error_rate as whole from seen where segment_column = \'overall\')'
    + ' select segment_column, segment_value, "count", positive_rate as actual_churn_rate, pr_auc, roc_auc, f1_score, precision, recall, error_rate,'
    " coalesce(whole > 0 and error_rate > 1.05 * whole, false) as disparity from seen, ov"))
def _fairness_report(spark, folder):
    return rounded(fairness.fairness_report(customer_profile(spark, folder), ratio=1.05), 8, *FAIR)


F1 = "2e0 * count(*) filter (churn_label = 1 and churn_probability >= 0.5) / (count(*) filter (churn_label = 1) + count(*) filter (churn_probability >= 0.5))"


def pct(expression: str) -> str:
    return f"printf('%.2f%%', round_even({expression} * 10000, 0) / 100)"


ALERTS = (
    SEGMENT + f", o as (select 1 - {F1} as e from profile)"
    f", s as (select segment_column, segment_value, 1 - coalesce({F1}, 0) as e, count(*) as n from l group by all having count(*) >= 20)"
    ", al as (select segment_column, segment_value, s.e as se, o.e as oe from s, o where o.e > 0 and s.e > 1.05 * o.e)"
)


@query("disparity_alerts", profile_sql(
    ALERTS + " select segment_column, segment_value, round(se, 8) as error_rate, round(oe, 8) as overall_error,"
    " 'SEGMENT DISPARITY ALERT: Segment ''' || segment_column || '=' || segment_value || ''' error rate (' || "
    + pct("se") + " || ') exceeds 1.05x aggregate error rate (' || " + pct("oe") + " || ').' as alert from al"))
def _alerts(spark, folder):
    return rounded(fairness.disparity_alerts(customer_profile(spark, folder), ratio=1.05), 8, "error_rate", "overall_error")


@query("fairness_verdict", profile_sql(ALERTS + " select count(*) as alert_count, count(*) = 0 as audit_passed from al"))
def _verdict(spark, folder):
    return fairness.fairness_verdict(fairness.disparity_alerts(customer_profile(spark, folder), ratio=1.05))


def evaluations(spark, folder):
    """Three scores of the same customers, evaluated as three models in one job."""
    featured = features.add_domain_features(customer_profile(spark, folder))
    scored = featured.select(
        "churn_label",
        F.col("churn_probability").alias("log odds"),
        scores.heuristic_score(F.col("contract_type"), F.col("support_tickets_30d"), F.col("price_increase_applied_30d")).alias("rules"),
        (F.col("risk_score_index") / F.lit(9.0)).alias("risk index"),
    )
    long = scored.unpivot(["churn_label"], ["log odds", "rules", "risk index"], "model_name", "p")
    measured = metrics.classification_metrics(long, "churn_label", "p", ["model_name"])
    return rounded(measured, 8, *CURVE)


EVALUATIONS = (
    f", f as ({feature_sql('profile')}), k as (select 'log odds' as model_name, churn_label, churn_probability from f"
    f" union all select 'rules', churn_label, {HEURISTIC} from f union all select 'risk index', churn_label, risk_score_index / 9.0e0 from f)"
    + metrics_sql("k", "model_name")
    + ", cm as (select model_name, pr_auc, roc_auc, f1_score, precision, recall, log_loss, 0e0 as training_time_sec, 0e0 as inference_latency_ms from m)"
)


@query("comparison_matrix", profile_sql(EVALUATIONS + " select * from cm"))
def _matrix(spark, folder):
    return compare.comparison_matrix(evaluations(spark, folder))


@query("champion", profile_sql(EVALUATIONS + " select * from cm order by pr_auc desc, model_name limit 1"))
def _champion(spark, folder):
    return compare.select_champion(compare.comparison_matrix(evaluations(spark, folder)))


def four(c: str) -> str:
    return f"printf('%.4f', {c})"


@query("comparison_report", profile_sql(
    EVALUATIONS + ", ch as (select * from cm order by pr_auc desc, model_name limit 1)"
    " select cast(row_number() over (order by pr_auc desc, model_name) + 20 as int) as line_no, '| **' || model_name || '** | ' || concat_ws(' | ', "
    + ", ".join(f"'`' || {four(m)} || '`'" for m in compare.METRICS) + ") || ' | `0.000s` | `0.0000ms` |' as line from cm"
    " union all select * from (values (1, '# How the models compare'), (2, ''), (3, '## Champion'),"
    " (4, '- Ranked by: `pr_auc`, the measure that copes with few churned customers'), (9, '- Measured on: `Apache Spark`'), (10, ''), (11, '## All models'), (12, ''),"
    f" (13, '| model | {' | '.join([*compare.METRICS, *compare.TIMES])} |'), (14, '|{' --- |' * 9}')) t(line_no, line)"
    " union all select 5, '- **Champion Model:** `' || model_name || '`' from ch"
    f" union all select 6, '- **Champion PR AUC:** `' || {four('pr_auc')} || '`' from ch"
    f" union all select 7, '- **Champion ROC AUC:** `' || {four('roc_auc')} || '`' from ch"
    f" union all select 8, '- **Champion F1 Score:** `' || {four('f1_score')} || '`' from ch"))
def _report(spark, folder):
    return compare.report_lines(compare.comparison_matrix(evaluations(spark, folder)))


# ---- drift: fact columns before and from 1998, two of them shifted ---------------------------------------
SPLIT = "1998-01-01 00:00:00"
LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def is_later():
    return F.col("l_shipdate") >= F.expr(f"timestamp_ntz '{SPLIT}'")


def shifted_lines(spark, folder, lines=None):
    """Lines, those of the current side with shifted columns."""
    lines = read_table(spark, folder, "lineitem") if lines is None else lines
    factors = {"l_quantity": 2.5, "l_extendedprice": 1.3}
    return lines.select("l_shipdate", *[
        (F.when(is_later(), F.col(c) * F.lit(factors[c])).otherwise(F.col(c)) if c in factors else F.col(c)).alias(c) for c in LINE_COLUMNS
    ])


def reference_and_current(spark, folder):
    lines = shifted_lines(spark, folder)
    return lines.where(~is_later()).drop("l_shipdate"), lines.where(is_later()).drop("l_shipdate")


SHIFTED = {"l_quantity": "l_quantity * 2.5e0", "l_extendedprice": "l_extendedprice * 1.3e0"}
PAIR = (
    "r as (" + " union all ".join(f"select '{c}' as feature, {c} as value from lineitem where l_shipdate < timestamp '{SPLIT}'" for c in LINE_COLUMNS)
    + "), c as (" + " union all ".join(f"select '{c}' as feature, {SHIFTED.get(c, c)} as value from lineitem where l_shipdate >= timestamp '{SPLIT}'" for c in LINE_COLUMNS)
    + ")"
)
EDGES = ", ".join(str(i / 10) for i in range(11))
PSI = f"""
, q as (select feature, unnest(quantile_cont(value, [{EDGES}])) as e from r group by feature)
, ed as (select distinct feature, round(e, 6) as e from q)
, lst as (select feature, list(e order by e) as edges, max(e) as top, min(e) as low from ed group by feature)
, nb as (select feature, unnest(range(1, len(edges))) as bin from lst)
, rb as (select feature, least(len(list_filter(edges, lambda z: z <= value)), len(edges) - 1) as bin, count(*) as n
    from r join lst using (feature) where value between low and top group by all)
, cb as (select feature, least(len(list_filter(edges, lambda z: z <= value)), len(edges) - 1) as bin, count(*) as n
    from c join lst using (feature) where value between low and top group by all)
, rn as (select feature, count(*) as n from r group by feature), cn as (select feature, count(*) as n from c group by feature)
, sh as (select nb.feature, nb.bin, coalesce(rb.n, 0) / rn.n::double as rp0, coalesce(cb.n, 0) / cn.n::double as cp0
    from nb join rn using (feature) join cn using (feature)
    left join rb on rb.feature = nb.feature and rb.bin = nb.bin left join cb on cb.feature = nb.feature and cb.bin = nb.bin)
, sm as (select feature, case when rp0 = 0 then 1e-4 else rp0 end as rp, case when cp0 = 0 then 1e-4 else cp0 end as cp from sh)
, psi as (select feature, {even("sum((cp - rp) * ln(cp / rp))", 4)} as psi from sm group by feature)
"""
KS = f"""
, v as (select feature, value, count(*) filter (side = 0) as rn, count(*) filter (side = 1) as cn
    from (select *, 0 as side from r union all select *, 1 from c) t group by feature, value)
, cdf as (select feature, sum(rn) over o / sum(rn) over a as fr, sum(cn) over o / sum(cn) over a as fc,
    cast(sum(rn) over a as double) as n, cast(sum(cn) over a as double) as m
    from v window o as (partition by feature order by value), a as (partition by feature))
, dd as (select feature, max(abs(fr - fc)) as d, max(n) as n, max(m) as m from cdf group by feature)
, lam as (select *, (sqrt(n * m / (n + m)) + 0.12e0 + 0.11e0 / sqrt(n * m / (n + m))) * d as la from dd)
, pv as (select *, case when la < 0.2 then 1e0 else greatest(0e0, least(1e0,
    (select sum(case when k % 2 = 1 then 2e0 else -2e0 end * exp(-2e0 * k * k * la * la)) from range(1, 101) t(k)))) end as p from lam)
, ks as (select feature, {even("d", 4)} as ks_statistic, {even("p", 6)} as p_value, p < 0.05 as ks_drift_detected from pv)
"""


@query("psi_features", "with " + PAIR + PSI + " select feature, psi from psi")
def _psi(spark, folder):
    return drift.psi(*reference_and_current(spark, folder), edge_digits=6)


@query("ks_features", "with " + PAIR + KS + " select * from ks")
def _ks(spark, folder):
    return drift.ks_two_sample(*reference_and_current(spark, folder))


AUDIT = (
    PAIR + PSI + KS + f", audit as (select feature, psi, ks_statistic, p_value, ks_drift_detected,"
    f" case when psi >= 0.25 then '{fixed.DRIFT_HIGH}' when psi >= 0.1 then '{fixed.DRIFT_MODERATE}' else '{fixed.DRIFT_NONE}' end as drift_status"
    " from psi join ks using (feature))"
)


@query("drift_audit", "with " + AUDIT + " select * from audit")
def _audit(spark, folder):
    return drift.drift_audit_within(shifted_lines(spark, folder), is_later(), LINE_COLUMNS, edge_digits=6)


PROFILE_COLUMNS = [*fixed.NUMERICAL]
LARGER = {"monthly_charges": 1.3, "tenure_months": 0.5}

def _profile_pair() -> str:
    side = " union all ".join(
        f"select '{c}' as feature, {c}::double{f' * {LARGER[c]}e0' if c in LARGER else ''} as value from profile where customer_id % 2 = 1 and {c} is not null"
        for c in PROFILE_COLUMNS
    )
    base = " union all ".join(f"select '{c}' as feature, {c}::double as value from profile where customer_id % 2 = 0 and {c} is not null" for c in PROFILE_COLUMNS)
    return f", r as ({base}), c as ({side})"


STATUS_SQL = f"case when psi >= 0.25 then '{fixed.DRIFT_HIGH}' when psi >= 0.1 then '{fixed.DRIFT_MODERATE}' else '{fixed.DRIFT_NONE}' end"


@query("drift_audit_profile", profile_sql(
    _profile_pair() + PSI + KS + f" select feature, coalesce(psi, 0e0) as psi, ks_statistic, p_value, ks_drift_detected, {STATUS_SQL} as drift_status"
    " from ks left join psi using (feature)"))
def _audit_profile(spark, folder):
    """All numeric columns of the profile; the odd customers are the current side, two of their columns shifted."""
    odd = F.col("customer_id") % 2 == 1
    profile = customer_profile(spark, folder)
    moved = profile.withColumns({c: F.when(odd, F.col(c).cast("double") * F.lit(k)).otherwise(F.col(c).cast("double")) for c, k in LARGER.items()})
    return drift.drift_audit_within(moved, odd, PROFILE_COLUMNS, edge_digits=6)


MARKED_KS = f"""
, rv as (select feature, value, count(*) as n from r group by all)
, rc as (select *, sum(n) over (partition by feature order by value) as cum, sum(n) over (partition by feature) as total from rv)
, grid as (select feature, value as g from rc where floor(cum * 200 / total::double) > floor((cum - n) * 200 / total::double) union select feature, e from ed)
, cv as (select feature, value, count(*) as n from c group by all)
, rg as (select grid.feature, g, coalesce(sum(n) filter (value <= g), 0) as le, coalesce(sum(n) filter (value < g), 0) as lt, sum(n) as t
    from grid join rv using (feature) group by all)
, cg as (select grid.feature, g, coalesce(sum(n) filter (value <= g), 0) as le, coalesce(sum(n) filter (value < g), 0) as lt, sum(n) as t
    from grid join cv using (feature) group by all)
, dd as (select feature, max(greatest(abs(rg.le / rg.t - cg.le / cg.t), abs(rg.lt / rg.t - cg.lt / cg.t))) as d,
    max(rg.t)::double as n, max(cg.t)::double as m from rg join cg using (feature, g) group by feature)
""" + KS[KS.index(", lam as"):]


@query("drift_watch", "with " + PAIR + PSI + MARKED_KS
       + f" select feature, psi, ks_statistic, p_value, ks_drift_detected, {STATUS_SQL} as drift_status from psi join ks using (feature)")
def _drift_watch(spark, folder):
    """The later lines arrive as a stream and are counted into the profile of the earlier ones."""
    schema = read_table(spark, folder, "lineitem").schema
    current = shifted_lines(spark, folder, read_event_stream(spark, folder, schema=schema, glob="lineitem.parquet")).where(is_later())
    reference, path = reference_and_current(spark, folder)[0], new_path(spark, "drift-watch")
    jobs.start_drift_watch(current, reference, path, LINE_COLUMNS, available_now=True, edge_digits=6).awaitTermination()
    return jobs.watched_drift(spark, path)


@query("drift_verdict", "with " + AUDIT + " select count(*) as total_features_audited, count(*) filter (psi >= 0.25) as high_drift_feature_count,"
       " coalesce(string_agg(case when psi >= 0.25 then feature end, ',' order by feature), '') as high_drift_features,"
       " bool_or(psi >= 0.25) as dataset_drift_detected from audit")
def _drift_verdict(spark, folder):
    audit = drift.drift_audit_within(shifted_lines(spark, folder), is_later(), LINE_COLUMNS, edge_digits=6)
    return drift.drift_verdict(audit).withColumn("high_drift_features", F.array_join("high_drift_features", ","))


DECAY = (
    metrics_sql("profile", "") + ", decay as (select 0.9e0 as baseline_pr_auc, pr_auc as current_pr_auc, roc_auc as current_roc_auc,"
    f" f1_score as current_f1_score, {even('0.9e0 - pr_auc', 4)} as performance_decay, pr_auc < 0.8 as concept_drift_detected from m)"
)


def decay(spark, folder):
    found = drift.performance_decay(customer_profile(spark, folder))
    return rounded(found, 8, "current_pr_auc", "current_roc_auc", "current_f1_score")


@query("performance_decay", profile_sql(DECAY + " select * from decay"))
def _decay(spark, folder):
    return decay(spark, folder)


@query("retrain_decision", profile_sql(
    DECAY + ", " + AUDIT + ", vd as (select count(*) filter (psi >= 0.25) as k from audit)"
    " select k > 0 or concept_drift_detected as retraining_required, k > 0 as feature_drift_flag, concept_drift_detected as concept_drift_flag,"
    " concat_ws('; ', case when k > 0 then 'Feature distribution PSI >= 0.25 in ' || k || ' features.' end,"
    f" case when concept_drift_detected then 'Model PR AUC (' || {four('current_pr_auc')} || ') fell below threshold (0.8000).' end) as trigger_reasons,"
    f" case when k > 0 or concept_drift_detected then '{fixed.ACTION_RETRAIN}' else '{fixed.ACTION_KEEP}' end as recommended_action from decay, vd"))
def _retrain(spark, folder):
    audit = drift.drift_audit_within(shifted_lines(spark, folder), is_later(), LINE_COLUMNS, edge_digits=6)
    decision = drift.retrain_decision(audit, decay(spark, folder))
    return decision.withColumn("trigger_reasons", F.array_join("trigger_reasons", "; "))


@query("histogram", profile_sql(
    "select cast(least(len(list_filter([0.1e0, 0.2e0, 0.35e0, 0.5e0, 0.8e0], lambda z: z <= churn_probability)), 4) as int) as bin, count(*) as n"
    " from profile where churn_probability between 0.1 and 0.8 group by 1"))
def _histogram(spark, folder):
    return drift.histogram(customer_profile(spark, folder), "churn_probability", [0.1, 0.2, 0.35, 0.5, 0.8])


