"""Splits, fitted preprocessing, explanations, registry and gate."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.catalog.customers import even, feature_sql, unpivot_sql
from holdfast.catalog.registry import profile_sql, query
from holdfast.catalog.reports import HEURISTIC, action_sql, tier_sql
from holdfast.functions import scores
from holdfast.operators import bayes, explain, features, neighbours, prep, registry, splits
from holdfast.sources.profile import customer_profile
from holdfast.sources.tables import read_table

NUM, CAT = fixed.NUMERICAL, fixed.CATEGORICAL

DRAWN = (
    ", r as (select customer_id, churn_label, row_number() over (partition by churn_label order by"
    " cast('0x' || substr(md5(customer_id || '#42'), 1, 15) as bigint), customer_id) as rank,"
    " count(*) over (partition by churn_label) as n from profile)"
)


@query("stratified_split", profile_sql(
    DRAWN + " select customer_id, churn_label, case when rank <= round_even(n * 0.2e0, 0) then 1 else 0 end as is_test from r"))
def _split(spark, folder):
    keyed = customer_profile(spark, folder).select("customer_id", "churn_label")
    return splits.stratified_split(keyed)


@query("train_valid_test", profile_sql(
    DRAWN + ", c as (select *, round_even(n * 0.2e0, 0) as t from r), d as (select *, t + round_even((n - t) * 0.15e0, 0) as v from c)"
    " select churn_label, case when rank <= t then 'test' when rank <= v then 'valid' else 'train' end as part, count(*) as n from d group by all"))
def _parts(spark, folder):
    keyed = customer_profile(spark, folder).select("customer_id", "churn_label")
    return splits.train_valid_test(keyed).groupBy("churn_label", "part").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_folds", profile_sql(DRAWN + " select customer_id, churn_label, cast((rank - 1) % 5 as int) as fold from r"))
def _folds(spark, folder):
    return splits.stratified_folds(customer_profile(spark, folder).select("customer_id", "churn_label"))


def _gap(place: int) -> int:
    """Every how many customers the column at this place lacks a value."""
    return 7 + place % 11


GAPS = ", g as (select customer_id, " + ", ".join(f"case when (customer_id + {i}) % {_gap(i)} <> 0 then {c} end as {c}" for i, c in enumerate([*NUM, *CAT])) + " from profile)"


def with_gaps(spark, folder):
    """The profile with missing cells in every column."""
    key = F.col("customer_id")
    gaps = {c: F.when((key + i) % _gap(i) != 0, F.col(c)) for i, c in enumerate([*NUM, *CAT])}
    return customer_profile(spark, folder).withColumns(gaps)


@query("impute_params", profile_sql(
    GAPS + f", n as ({unpivot_sql('g', NUM, 'double')}), t as ({unpivot_sql('g', CAT, 'varchar')})"
    ", c as (select feature, value, count(*) as k from t where value is not null group by all)"
    " select feature, round(quantile_cont(value, 0.5), 6) as number, null::varchar as text from n group by feature"
    " union all select feature, null, arg_min(value, row(-k, value)) from c group by feature"))
def _impute(spark, folder):
    return prep.fit_impute(with_gaps(spark, folder)).withColumn("number", F.round("number", 6))


@query("impute_apply", profile_sql(
    GAPS + ", m as (select " + ", ".join(f"quantile_cont({c}::double, 0.5) as m_{c}" for c in NUM) + " from g)"
    + f", t as ({unpivot_sql('g', CAT, 'varchar')}), c as (select feature, value, count(*) as k from t where value is not null group by all)"
    + ", b as (select feature, arg_min(value, row(-k, value)) as mode from c group by feature)"
    + ", w as (select " + ", ".join(f"max(mode) filter (feature = '{c}') as b_{c}" for c in CAT) + " from b)"
    + " select customer_id, " + ", ".join(f"round(coalesce({c}::double, m_{c}), 6) as {c}" for c in NUM) + ", "
    + ", ".join(f"coalesce({c}, b_{c}) as {c}" for c in CAT) + " from g, m, w"))
def _impute_apply(spark, folder):
    gaps = with_gaps(spark, folder).select("customer_id", *NUM, *CAT)
    filled = prep.apply_impute(gaps, prep.fit_impute(gaps))
    return filled.withColumns({c: F.round(c, 6) for c in NUM})


SCALED = NUM


def _scale_sql(center: str, scale: str) -> str:
    params = ", ".join(f"{center.format(c=c)} as m_{c}, {scale.format(c=c)} as s_{c}" for c in SCALED)
    out = ", ".join(f"round(({c} - m_{c}) / case when s_{c} = 0 then 1 else s_{c} end, 6) as {c}" for c in SCALED)
    return f", p as (select {params} from profile) select customer_id, {out} from profile, p"


@query("robust_scale", profile_sql(_scale_sql(
    "quantile_cont({c}::double, 0.5)", "quantile_cont({c}::double, 0.75) - quantile_cont({c}::double, 0.25)")))
def _robust(spark, folder):
    table = customer_profile(spark, folder).select("customer_id", *SCALED)
    scaled = prep.apply_scale(table, prep.fit_robust(table, SCALED), SCALED)
    return scaled.withColumns({c: F.round(c, 6) for c in SCALED})


@query("standard_scale", profile_sql(_scale_sql("avg({c})", "stddev_pop({c})")))
def _standard(spark, folder):
    table = customer_profile(spark, folder).select("customer_id", *SCALED)
    scaled = prep.apply_scale(table, prep.fit_standard(table, SCALED), SCALED)
    return scaled.withColumns({c: F.round(c, 6) for c in SCALED})


@query("clip_outliers", profile_sql(
    ", p as (select " + ", ".join(
        f"quantile_cont({c}::double, 0.25) as a_{c}, quantile_cont({c}::double, 0.75) as b_{c}" for c in SCALED)
    + " from profile) select customer_id, " + ", ".join(
        f"round(least(greatest({c}::double, a_{c} - 1.5e0 * (b_{c} - a_{c})), b_{c} + 1.5e0 * (b_{c} - a_{c})), 6) as {c}" for c in SCALED)
    + " from profile, p"))
def _clip(spark, folder):
    table = customer_profile(spark, folder).select("customer_id", *SCALED)
    clipped = prep.clip_outliers(table, prep.fit_clip_bounds(table, SCALED), SCALED)
    return clipped.withColumns({c: F.round(c, 6) for c in SCALED})


@query("class_weights", profile_sql(
    ", c as (select churn_label, count(*) as n from profile group by 1)"
    " select churn_label, n, round((select sum(n) from c) / (2e0 * n), 9) as weight from c"))
def _weights(spark, folder):
    return prep.class_weights(customer_profile(spark, folder)).withColumn("weight", F.round("weight", 9))


@query("class_balance", profile_sql(
    "select round(count(*) filter (churn_label = 0)::double / greatest(count(*) filter (churn_label = 1), 1), 9) as scale_pos_weight from profile"))
def _balance(spark, folder):
    from holdfast.operators.metrics import class_balance

    return class_balance(customer_profile(spark, folder), "churn_label").withColumn("scale_pos_weight", F.round("scale_pos_weight", 9))


def _nb_sql() -> str:
    stats = ", ".join(
        f"avg({c}) filter (churn_label = {k}) as m{k}_{c}, var_pop({c}) filter (churn_label = {k}) as v{k}_{c}" for c in SCALED for k in (0, 1)
    )
    biggest = "greatest(" + ", ".join(f"var_pop({c})" for c in SCALED) + ")"

    def density(k: int) -> str:
        terms = [
            f" - 0.5e0 * ln({2 * math.pi!r}::double * (v{k}_{c} + 1e-9 * big)) - 0.5e0 * ({c} - m{k}_{c}) * ({c} - m{k}_{c}) / (v{k}_{c} + 1e-9 * big)"
            for c in SCALED
        ]
        return (f"ln({'sh' if k else '(1 - sh)'})" + "".join(terms))

    return (
        f", p as (select avg(churn_label) as sh, {biggest} as big, {stats} from profile)"
        f" select customer_id, round(1 / (1 + exp(-greatest(-700e0, least(700e0, ({density(1)}) - ({density(0)}))))), 6) as churn_probability from profile, p"
    )


@query("gaussian_nb", profile_sql(_nb_sql()))
def _nb(spark, folder):
    table = customer_profile(spark, folder).select("customer_id", "churn_label", *SCALED)
    scored = bayes.apply_gaussian_nb(table, bayes.fit_gaussian_nb(table, SCALED), SCALED)
    return scored.select("customer_id", F.round("churn_probability", 6).alias("churn_probability"))


@query(
    "knn_vote",
    "with p as (select a.vec_id as query_id, b.vec_id as id, b.label, sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1),"
    " lambda i: (a.embedding[i]::double - b.embedding[i]::double) ** 2))) as d from embeddings a join embeddings b on a.vec_id <> b.vec_id)"
    ", r as (select *, row_number() over (partition by query_id order by d, id) as n from p)"
    " select query_id, label, count(*) as votes, count(*) / 7e0 as share from r where n <= 7 group by all",
)
def _knn(spark, folder):
    vectors = read_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )
    return neighbours.knn_vote(vectors, vectors, "label", 7, exclude_same_id=True)


# ---- explanations ------------------------------------------------------------------------------


def reason_sql(name: str, impact: str) -> str:
    direction = f"case when {impact} > 0 then 'increasing' else 'decreasing' end"
    percent = f"printf('%.1f%%', round_even(abs({impact}) * 1000, 0) / 10)"
    cases = " ".join(
        f"when contains({name}, '{key}') then '{text} (' || {direction} || ' risk by ' || {percent} || ')'"
        for key, text in fixed.FEATURE_REASONS.items()
    )
    plain = (
        f"array_to_string(list_transform(regexp_extract_all(replace(replace(replace({name}, 'num__', ''), 'cat__', ''), '_', ' '),"
        " '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"
    )
    return f"case {cases} else {plain} || ' behavior (' || {direction} || ' churn risk by ' || {percent} || ')' end"


PROFILE_FEATURES = [*NUM, "charges_per_tenure", "risk_score_index"]


def correlations(df, columns):
    """(feature, importance): correlation with the label."""
    row = df.agg(*[
        F.struct(F.lit(f"num__{c}").alias("feature"), F.round(F.corr(F.col(c).cast("double"), F.col("churn_label").cast("double")), 6).alias("importance")).alias(c)
        for c in columns
    ])
    return row.select(F.inline(F.array(*columns))).where(F.col("importance").isNotNull())


CORRELATED = (
    f", f as ({feature_sql('profile')}), imp as (select * from ("
    + " union all ".join(f"select 'num__{c}' as feature, round(corr({c}::double, churn_label::double), 6) as importance from f" for c in PROFILE_FEATURES)
    + ") t where importance is not null and not isnan(importance))"
)


@query("feature_reasons", profile_sql(CORRELATED + f" select feature, importance, {reason_sql('feature', 'importance')} as reason from imp"))
def _reasons(spark, folder):
    table = correlations(features.add_domain_features(customer_profile(spark, folder)), PROFILE_FEATURES)
    return table.withColumn("reason", scores.feature_reason(F.col("feature"), F.col("importance")))


@query("explain_global", profile_sql(
    CORRELATED + ", top as (select *, row_number() over (order by abs(importance) desc, feature) as n from imp qualify n <= 4)"
    f", t as (select string_agg(feature, ',' order by n) as drivers, 'Primary churn drivers: ' || string_agg(case when n <= 3 then {reason_sql('feature', 'importance')} end, '; ' order by n) || '.' as summary_narrative from top)"
    " select customer_id, drivers, summary_narrative from profile, t"))
def _explain_global(spark, folder):
    featured = features.add_domain_features(customer_profile(spark, folder))
    named = featured.select("customer_id", *[F.col(c).alias(f"num__{c}") for c in PROFILE_FEATURES])
    explained = explain.explain_global(named, correlations(featured, PROFILE_FEATURES), [f"num__{c}" for c in PROFILE_FEATURES])
    return explained.select("customer_id", F.array_join("top_drivers.feature", ",").alias("drivers"), "summary_narrative")


TERMS_SQL = {
    "is_month_to_month": "(contract_type = 'Month-to-month')::int",
    "support_tickets_30d": "support_tickets_30d",
    "payment_failures_90d": "payment_failures_90d",
    "is_dissatisfied": "(resolution_satisfaction_score <= 2)::int",
    "severe_usage_drop": "(change_in_usage_pct < -0.25)::int",
    "price_increase": "(price_increase_applied_30d = 'Yes')::int",
    "competitor_viewed": "(competitor_offer_viewed = 'Yes')::int",
    "low_nps": "(nps_score <= 4)::int",
    "tenure_months": "tenure_months",
    "auto_pay": "(auto_pay_enabled = 'Yes')::int",
    "retention_accepted": "(retention_offer_accepted = 'Yes')::int",
}
CONTRIBUTIONS = (
    ", z as (select customer_id, " + ", ".join(f"{e} as t_{n}" for n, e in TERMS_SQL.items()) + " from profile)"
    ", mu as (select " + ", ".join(f"avg(t_{n}) as m_{n}" for n in TERMS_SQL) + " from z)"
    ", co as (" + " union all ".join(
        f"select customer_id, {i} as pos, '{n}' as feature, t_{n}::double as value, round({w}e0 * (t_{n} - m_{n}), 6) as impact from z, mu" for i, (n, w) in enumerate(fixed.LOG_ODDS.items())) + ")"
)


@query("explain_linear", profile_sql(
    CONTRIBUTIONS + ", o as (select *, row_number() over (partition by customer_id order by abs(impact) desc, pos) as n from co qualify n <= 4)"
    " select customer_id, string_agg(feature, ',' order by n) as drivers, max(case when n = 1 then impact end) as first_impact,"
    f" 'Primary churn drivers: ' || string_agg(case when n <= 3 then {reason_sql('feature', 'impact')} end, '; ' order by n) || '.' as summary_narrative"
    " from o group by customer_id"))
def _explain_linear(spark, folder):
    explained = explain.explain_linear(customer_profile(spark, folder), fixed.LOG_ODDS, scores.log_odds_terms(), digits=6)
    return explained.select(
        "customer_id", F.array_join("top_drivers.feature", ",").alias("drivers"),
        F.col("top_drivers")[0]["impact_score"].alias("first_impact"), "summary_narrative",
    )


@query("mean_contribution", profile_sql(CONTRIBUTIONS + " select feature, round(avg(abs(impact)), 6) as importance from co group by feature"))
def _mean_contribution(spark, folder):
    rows = explain.linear_contributions(customer_profile(spark, folder), fixed.LOG_ODDS, scores.log_odds_terms(), digits=6)
    return explain.mean_abs_contribution(rows, list(fixed.LOG_ODDS)).withColumn("importance", F.round("importance", 6))


@query("partial_dependence", profile_sql(
    ", d as (select distinct support_tickets_30d as v from profile), c as (select count(*) as k from d)"
    ", s as (select cast(support_tickets_30d as double) as x, row_number() over (order by support_tickets_30d) - 1 as i, count(*) over () as n from profile)"
    ", e as (select max(case when i = floor(n * 0.05e0 + 0.41e0) - 1 then x end) * (1 - (max(n) * 0.05e0 + 0.41e0 - floor(max(n) * 0.05e0 + 0.41e0)))"
    " + max(case when i = floor(n * 0.05e0 + 0.41e0) then x end) * (max(n) * 0.05e0 + 0.41e0 - floor(max(n) * 0.05e0 + 0.41e0)) as lo,"
    " max(case when i = floor(n * 0.95e0 + 0.59e0) - 1 then x end) * (1 - (max(n) * 0.95e0 + 0.59e0 - floor(max(n) * 0.95e0 + 0.59e0)))"
    " + max(case when i = floor(n * 0.95e0 + 0.59e0) then x end) * (max(n) * 0.95e0 + 0.59e0 - floor(max(n) * 0.95e0 + 0.59e0)) as hi from s)"
    ", g as (select v::double as grid_value from d where (select k from c) < 20 union all"
    " select lo + i * (hi - lo) / 19 from e, range(0, 20) t(i) where (select k from c) >= 20)"
    f", h as (select grid_value, {HEURISTIC.replace('support_tickets_30d', 'grid_value')} as p from profile, g)"
    " select 'support_tickets_30d' as feature, round(grid_value, 6) as grid_value, round(avg(p), 6) as average_predicted_probability from h group by grid_value"))
def _pdp(spark, folder):
    def score(df):
        return scores.heuristic_score(F.col("contract_type"), F.col("support_tickets_30d"), F.col("price_increase_applied_30d"))

    found = explain.partial_dependence(customer_profile(spark, folder), score, "support_tickets_30d")
    return found.withColumns({c: F.round(c, 6) for c in ("grid_value", "average_predicted_probability")})


@query("pdp_grid", profile_sql(
    ", s as (select total_charges as x, row_number() over (order by total_charges) as i, count(*) over () as n from profile)"
    ", e as (select max(n) * 0.05e0 + 0.41e0 as a, max(n) * 0.95e0 + 0.59e0 as b from s)"
    ", q as (select max(case when i = floor(a) then x end) * (1 - (max(a) - floor(max(a)))) + max(case when i = floor(a) + 1 then x end) * (max(a) - floor(max(a))) as lo,"
    " max(case when i = floor(b) then x end) * (1 - (max(b) - floor(max(b)))) + max(case when i = floor(b) + 1 then x end) * (max(b) - floor(max(b))) as hi from s, e)"
    ", g as (select lo + k * (hi - lo) / 19 as grid_value from q, range(0, 20) t(k))"
    " select round(grid_value, 5) as grid_value, count(*) filter (total_charges <= grid_value - 1e-7) as customers_below from profile, g group by grid_value"))
def _pdp_grid(spark, folder):
    profile = customer_profile(spark, folder)
    grid = explain.grid_values(profile, "total_charges")
    return profile.agg(F.array(*[
        F.struct(F.round(F.lit(g), 5).alias("grid_value"), F.count_if(F.col("total_charges") <= F.lit(g - 1e-7)).alias("customers_below")) for g in grid
    ]).alias("a")).select(F.inline("a"))


REASON = reason_sql("feature", "impact")


@query("customer_explanation", profile_sql(
    CONTRIBUTIONS + ", o as (select *, row_number() over (partition by customer_id order by abs(impact) desc, pos) as n from co qualify n <= 4)"
    ", e as (select customer_id, string_agg(feature || ' ' || printf('%.6f', value) || ' ' || printf('%.6f', impact) || ' ' || " + REASON + ", '; ' order by n) as top_drivers,"
    f" string_agg(case when n <= 3 then {REASON} end, '; ' order by n) as reasons from o group by customer_id)"
    f" select customer_id, {even('churn_probability', 4)} as churn_probability, {tier_sql('churn_probability')} as risk_level,"
    f" {action_sql(tier_sql('churn_probability'))} as recommended_retention_action,"
    " 'Primary churn drivers for customer ' || customer_id || ': ' || reasons || '.' as summary_narrative, top_drivers"
    " from e join profile using (customer_id)"))
def _customer_explanation(spark, folder):
    """The explanation record of every customer."""
    explained = explain.explain_linear(customer_profile(spark, folder), fixed.LOG_ODDS, scores.log_odds_terms(), digits=6)
    told = F.transform("top_drivers", lambda d: F.format_string("%s %.6f %.6f %s", d["feature"], d["value"], d["impact_score"], d["business_reason"]))
    return explain.explanation_record(explained).withColumn("top_drivers", F.array_join(told, "; "))


@query("first_ids", profile_sql(" select customer_id from profile order by customer_id limit 50"))
def _first_ids(spark, folder):
    """The first fifty customers, as a picker shows them."""
    from holdfast.operators.scoring import first_ids

    return first_ids(customer_profile(spark, folder))


# ---- registry logs, one per market and region, one action per month ---------------------------------

LOG_SQL = (
    "log as (select c_mktsegment || '/' || r_name as registry, strftime(o_orderdate, '%Y%m') as month, count(*) as n"
    " from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by all)"
    ", acts as (select registry, cast(month as bigint) as seq, case when n % 3 = 0 then 'rollback' else 'promote' end as action,"
    " 'v' || month as version_tag, 0.5e0 + (n * 7 % 40) / 100e0 as pr_auc from log)"
)


def registry_log(spark, folder):
    """Months of orders as registry actions: at most one row per registry and calendar month."""
    orders, customer, nation, region = (read_table(spark, folder, t) for t in ("orders", "customer", "nation", "region"))
    month = F.date_format("o_orderdate", "yyyyMM")
    counts = (
        orders.groupBy("o_custkey", month.alias("month")).agg(F.count(F.lit(1)).alias("k"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(region, F.col("r_regionkey") == F.col("n_regionkey"))
        .groupBy(F.concat_ws("/", "c_mktsegment", "r_name").alias("registry"), "month")
        .agg(F.sum("k").alias("n"))
    )
    return counts.select(
        "registry",
        F.col("month").cast("bigint").alias("seq"),
        F.when(F.col("n") % 3 == 0, "rollback").otherwise("promote").alias("action"),
        F.concat(F.lit("v"), "month").alias("version_tag"),
        (F.lit(0.5) + (F.col("n") * 7 % 40) / F.lit(100.0)).alias("pr_auc"),
    )


@query("registry_state", (
    "with recursive " + LOG_SQL + ", num as (select *, row_number() over (partition by registry order by seq) as k from acts)"
    ", st as (select distinct registry, 0::bigint as k, null::varchar as active, null::varchar as previous from acts"
    " union all select num.registry, num.k,"
    " case when action = 'promote' then version_tag when previous is null then active else previous end,"
    " case when action = 'promote' then active when previous is null then previous else active end"
    " from st join num on num.registry = st.registry and num.k = st.k + 1)"
    " select registry, active as active_version, previous as previous_version from st"
    " qualify row_number() over (partition by registry order by k desc) = 1 and active is not null"))
def _registry_state(spark, folder):
    return registry.registry_state(registry_log(spark, folder), ["registry"])


def _gate_sql() -> str:
    gain = "((pr_auc - old) / greatest(old, 1e-6))"
    percent = f"printf('%.2f%%', round_even({gain} * 10000, 0) / 100)"
    return (
        "with " + LOG_SQL + ", p as (select *, lag(pr_auc) over (partition by registry order by seq) as old from acts where action = 'promote')"
        f" select registry, version_tag, round(old, 6) as champion_pr_auc, round(pr_auc, 6) as challenger_pr_auc, coalesce({gain} >= 0.01e0, true) as gate_passed,"
        f" coalesce(round({even(gain, 4)} * 100, 6), 0e0) as relative_gain_pct,"
        f" case when old is null then '{fixed.GATE_FIRST}' when {gain} >= 0.01e0 then 'Challenger outperformed Champion by ' || {percent} || ' (Threshold >= 1.0%).'"
        f" else 'Challenger failed gate (Gain: ' || {percent} || ' vs Required: 1.0%). Champion retained.' end as gate_reason from p"
    )


@query("gate", _gate_sql())
def _gate(spark, folder):
    from pyspark.sql import Window

    promotions = registry_log(spark, folder).where("action = 'promote'")
    before = Window.partitionBy("registry").orderBy("seq")
    pairs = promotions.select(
        "registry", "version_tag", F.lag("pr_auc").over(before).alias("champion_pr_auc"), F.col("pr_auc").alias("challenger_pr_auc")
    )
    return registry.gate(pairs).withColumns({c: F.round(c, 6) for c in ("champion_pr_auc", "challenger_pr_auc", "relative_gain_pct")})


