"""Profile, cleaning, quality, leakage, requests, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.catalog.fixtures import add_leakage_columns, raw_profile
from holdfast.catalog.registry import profile_sql, query
from holdfast.functions import scores
from holdfast.operators import cleaning, features, leakage, quality, validation, versions
from holdfast.sources.profile import base_charge, customer_profile, pays_automatically

NUM, CAT = fixed.NUMERICAL, fixed.CATEGORICAL
LEAK_SQL = """case when churn_label = 1 then '2001-06-01' end as cancellation_processed_date,
  case when churn_label = 1 then 1 else 0 end as final_invoice_flag,
  case when churn_label = 1 then 1 else 0 end as account_status_deactivated,
  case when churn_label = 1 then 'Relocation' end as churn_reason_recorded"""


def messy_sql() -> str:
    parts = []
    for c in [*CAT, *NUM]:
        if c in ("partner", "dependents"):
            parts.append(f"case when customer_id % 7 = 0 then ' ' || {c} || ' ' || chr(9) else {c} end as {c}")
        elif c == "monthly_charges":
            parts.append(f"case when customer_id % 11 = 0 then null else {c} end as {c}")
        else:
            parts.append(c)
    return (
        f", messy as (select customer_id, {', '.join(parts)}, churn_label, {LEAK_SQL}, arrival from profile,"
        " lateral (select unnest(case when customer_id % 50 = 0 then [0, 1] else [0] end) as arrival) t)"
    )


def unpivot_sql(source: str, columns: list[str], kind: str, keep: str = "") -> str:
    keep = f"{keep}, " if keep else ""
    return " union all ".join(
        f"select {keep}'{c}' as feature, cast({c} as {kind}) as value from {source}" for c in columns
    )


def even(expression: str, places: int) -> str:
    scale = f"1e{places}"
    return f"(round_even(({expression}) * {scale}, 0) / {scale})"


@query("customer_profile", profile_sql("select * from profile"))
def _profile(spark, folder):
    return customer_profile(spark, folder)


CLEAN_COLUMNS = ["customer_id", *CAT, *NUM, *fixed.LEAKAGE, "churn_label"]


def typed_sql() -> str:
    """All columns of the messy table as coercion leaves them."""
    parts = [
        f"trim({c}, ' ' || chr(9)) as {c}" if c in CAT else f"cast({c} as double) as {c}" if c in NUM else f"cast({c} as varchar) as {c}" if c in fixed.LEAKAGE else c
        for c in CLEAN_COLUMNS
    ]
    return ", ".join(parts)


@query(
    "clean_dedup",
    profile_sql(messy_sql() + f" select {typed_sql()}, arrival from messy qualify row_number() over (partition by customer_id order by arrival) = 1"),
)
def _clean_dedup(spark, folder):
    """The first copy of every customer, all columns (typed, so that engines write them alike)."""
    return cleaning.coerce_types(cleaning.dedup_by_key(raw_profile(spark, folder), order_col="arrival"))


@query("clean_rows", profile_sql(messy_sql() + f" select distinct {typed_sql()} from messy"))
def _clean_rows(spark, folder):
    return cleaning.coerce_types(cleaning.dedup_rows(raw_profile(spark, folder).drop("arrival")))


@query(
    "clean_coerce",
    profile_sql(
        messy_sql()
        + ", kept as (select * from messy qualify row_number() over (partition by customer_id order by arrival) = 1)"
        + f" select {typed_sql()} from kept"
    ),
)
def _clean_coerce(spark, folder):
    return cleaning.clean_customers(raw_profile(spark, folder), order_col="arrival").select(*CLEAN_COLUMNS)


def dirty(spark, folder):
    """Messy copies with coerced types but without deduplication."""
    return cleaning.coerce_types(raw_profile(spark, folder)).drop("arrival")


DIRTY_COLUMNS = ["customer_id", *CAT, *NUM, *fixed.LEAKAGE, "churn_label"]


@query(
    "quality_nulls",
    profile_sql(
        messy_sql()
        + ", n as (select count(*) as n from messy)"
        + ", c as ("
        + " union all ".join(f"select '{c}' as \"column\", count(*) - count({c}) as null_count from messy" for c in DIRTY_COLUMNS)
        + f") select \"column\", null_count, {even('null_count::double / n * 100', 2)} as null_pct, n as total_rows from c, n"
    ),
)
def _quality_nulls(spark, folder):
    return quality.quality_nulls(dirty(spark, folder))


@query(
    "quality_numeric",
    profile_sql(
        messy_sql()
        + f", long as ({unpivot_sql('messy', NUM, 'double')})"
        + " select feature, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value) as min,"
        + " round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as median,"
        + " round(quantile_cont(value, 0.75), 6) as p75, max(value) as max from long group by feature"
    ),
)
def _quality_numeric(spark, folder):
    profile = quality.quality_numeric(dirty(spark, folder))
    return profile.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "median", "p75")})


@query(
    "quality_categorical",
    profile_sql(
        f", long as ({unpivot_sql('profile', CAT, 'varchar')})"
        " select feature, value, count(*) as n from long where value is not null group by feature, value"
    ),
)
def _quality_categorical(spark, folder):
    return quality.quality_categorical(customer_profile(spark, folder))


@query(
    "quality_target",
    profile_sql(
        "select count(*) as total_count, cast(sum(churn_label) as bigint) as churn_count,"
        " round(avg(churn_label), 9) as churn_rate from profile"
    ),
)
def _quality_target(spark, folder):
    return quality.quality_target(customer_profile(spark, folder)).withColumn("churn_rate", F.round("churn_rate", 9))


TRIMMED = "trim(partner, ' ' || chr(9)) as partner, trim(dependents, ' ' || chr(9)) as dependents"
REPEATS = (
    f", tidy as (select * replace ({TRIMMED}) from messy)"
    ", d as (select (select count(*) from tidy) - (select count(*) from (select distinct * exclude (arrival) from tidy) u) as n)"
    ", m as (select count(*) as total, count(*) - count(monthly_charges) as missing from tidy)"
)


@query(
    "quality_alerts",
    profile_sql(
        messy_sql()
        + REPEATS
        + " select '' as \"column\", 'Found ' || n || ' duplicate customer rows.' as alert from d where n > 0"
        + " union all select 'monthly_charges', 'Predictor column ''monthly_charges'' has ' || missing || ' (' || "
        + even("missing::double / total * 100", 2)
        + " || '%) missing values.' from m where missing > 0"
    ),
)
def _quality_alerts(spark, folder):
    return quality.quality_alerts(dirty(spark, folder))


@query(
    "quality_summary",
    profile_sql(
        messy_sql()
        + REPEATS
        + f" select total as total_rows, {len(DIRTY_COLUMNS)}::bigint as total_columns, n as duplicate_rows,"
        + " (case when n > 0 then 1 else 0 end + case when missing > 0 then 1 else 0 end)::bigint as alert_count from d, m"
    ),
)
def _quality_summary(spark, folder):
    return quality.quality_summary(dirty(spark, folder))


@query(
    "dataset_manifest",
    profile_sql(
        "select count(*) as n_samples, 33 as n_features, round(avg(churn_label), 9) as churn_rate, 42 as seed,"
        " 'churn_label' as target_column, 'customer_id' as id_columns,"
        f" '{','.join(fixed.LEAKAGE)}' as leakage_fields, '{','.join(CAT)}' as categorical_features,"
        f" '{','.join(NUM)}' as numerical_features from profile"
    ),
)
def _manifest(spark, folder):
    manifest = versions.dataset_manifest(customer_profile(spark, folder), seed=42)
    lists = ["id_columns", "leakage_fields", "categorical_features", "numerical_features"]
    return manifest.withColumns({"churn_rate": F.round("churn_rate", 9), **{c: F.array_join(c, ",") for c in lists}})


HASHED = ["customer_id", *CAT, *NUM, "churn_label", "churn_probability"]
FRACTIONS = ["monthly_charges", "total_charges", "avg_monthly_gb_download", "app_usage_hours", "feature_usage_score", "change_in_usage_pct", "churn_probability"]


def _hash_sql() -> str:
    def text(c: str) -> str:
        v = f"cast({f'cast({c} as decimal(38,10))' if c in FRACTIONS else c} as varchar)"
        return f"coalesce(length({v}) || ':' || {v}, '-')"

    row = " || '|' || ".join(text(c) for c in HASHED)
    sums = ", ".join(f"sum(cast('0x' || substr(h, {1 + 16 * i}, 15) as bigint)) as s{i}" for i in range(4))
    return (
        f", h as (select sha256({row}) as h from profile), s as (select count(*) as n_rows, {sums} from h)"
        " select n_rows, sha256(n_rows || '-' || s0 || '-' || s1 || '-' || s2 || '-' || s3) as sha256_checksum from s"
    )


@query("dataset_row_hash", profile_sql(_hash_sql()))
def _row_hash(spark, folder):
    return versions.row_hash(customer_profile(spark, folder), HASHED)


@query("leakage_stripped", profile_sql("select * from profile"))
def _stripped(spark, folder):
    stripped = leakage.strip_leakage(add_leakage_columns(customer_profile(spark, folder)))
    return leakage.assert_no_leakage(stripped)


@query(
    "leakage_semantics",
    profile_sql(
        f", x as (select churn_label, {LEAK_SQL} from profile)"
        + " union all ".join(
            f" select '{c}' as field, count(*) filter (churn_label = 1 and not ({ok})) as missing_for_churned,"
            f" count(*) filter (churn_label <> 1 and {ok}) as set_for_retained from x"
            for c, ok in (
                ("cancellation_processed_date", "cancellation_processed_date is not null"),
                ("final_invoice_flag", "final_invoice_flag = 1"),
                ("account_status_deactivated", "account_status_deactivated = 1"),
                ("churn_reason_recorded", "churn_reason_recorded is not null"),
            )
        )
    ),
)
def _semantics(spark, folder):
    return leakage.leakage_semantics(add_leakage_columns(customer_profile(spark, folder)))


#: What each field of a request is in the profile (empty: absent), with every seventh or so null, wrong or out of bounds.
REQUEST_SQL = {
    "gender": "gender", "partner": "case when customer_id % 23 = 0 then 'maybe' else partner end", "dependents": "dependents",
    "phone_service": "case customer_id % 3 when 0 then 'Yes' when 1 then 'No' end", "multiple_lines": "case when customer_id % 29 = 0 then 'Many' end",
    "internet_service": "case customer_id % 4 when 0 then 'DSL' when 1 then 'Fibre' end", "online_security": "partner", "online_backup": "dependents",
    "device_protection": "case when customer_id % 31 = 0 then 'yes' else 'Yes' end", "tech_support": "case when customer_id % 5 = 0 then 'No internet service' end",
    "streaming_tv": "partner", "streaming_movies": "case when customer_id % 37 = 0 then '' else 'No' end", "contract_type": "case when customer_id % 41 <> 0 then contract_type end",
    "paperless_billing": "auto_pay_enabled", "payment_method": "case when payment_method in ('Credit card', 'Bank transfer') then payment_method || ' (automatic)' else payment_method end",
    "plan_tier": "case when customer_id % 17 = 0 then 'Gold' else plan_tier end", "geography": "case when customer_id % 2 = 0 then 'Europe' else geography end",
    "competitor_offer_viewed": "competitor_offer_viewed", "price_increase_applied_30d": "price_increase_applied_30d",
    "senior_citizen": "cast(customer_id % 3 as int)", "tenure_months": "case when customer_id % 43 = 0 then tenure_months + 100 else tenure_months end",
    "monthly_charges": "case when customer_id % 13 = 0 then -monthly_charges else monthly_charges end", "total_charges": "total_charges",
    "support_tickets_30d": "case when customer_id % 47 = 0 then support_tickets_30d + 51 else support_tickets_30d end",
    "resolution_satisfaction_score": "case when customer_id % 53 = 0 then 0.5e0 when customer_id % 59 = 0 then 6e0 else cast(resolution_satisfaction_score as double) end",
    "app_logins_30d": "case when customer_id % 61 = 0 then -1 when customer_id % 67 = 0 then 501 else login_frequency_30d end",
    "payment_failures_90d": "case when customer_id % 19 <> 0 then payment_failures_90d end",
    "change_in_usage_pct": "case when customer_id % 71 = 0 then -1.5e0 else least(change_in_usage_pct, 5.5e0) end",
}


def requests(spark, folder):
    """The profile in request form, all 28 fields, each rule broken by some."""
    profile = customer_profile(spark, folder)
    return profile.select("customer_id", *[F.expr(e.replace("e0 ", "D ").replace("e0)", "D)")).alias(n) for n, e in REQUEST_SQL.items()])


def _request_sql() -> str:
    """The requests with defaults filled, and the reasons against each."""
    fields = ", ".join(f"{e} as {n}" for n, e in REQUEST_SQL.items())

    def literal(v) -> str:
        return f"'{v}'" if isinstance(v, str) else f"{v}e0" if isinstance(v, float) else str(v)

    defaults = {n: d for n, (_, d) in fixed.REQUEST_CHOICES.items()} | {n: d for n, (_, _, d) in fixed.REQUEST_BOUNDS.items()}
    filled = ", ".join(f"coalesce({n}, {literal(d)}) as {n}" for n, d in defaults.items())
    checks = [
        f"case when {n} not in ({', '.join(literal(a) for a in allowed)}) then '{n}: not one of {', '.join(allowed)}' end" for n, (allowed, _) in fixed.REQUEST_CHOICES.items()
    ]
    for n, (low, high, _) in fixed.REQUEST_BOUNDS.items():
        checks += [f"case when {n} < {literal(low)} then '{n}: below {low}' end", f"case when {n} > {literal(high)} then '{n}: above {high}' end"]
    return (
        f", q as (select customer_id, {fields} from profile), f as (select customer_id, {filled} from q)"
        f", k as (select *, concat_ws('; ', {', '.join(checks)}) as reasons from f)"
    )


REQUEST_FIELDS = [*fixed.REQUEST_CHOICES, *fixed.REQUEST_BOUNDS]


@query("request_validation", profile_sql(_request_sql() + f" select customer_id, {', '.join(REQUEST_FIELDS)}, reasons from k"))
def _requests(spark, folder):
    checked = validation.validate_requests(requests(spark, folder))
    return checked.select("customer_id", *REQUEST_FIELDS, F.array_join("reasons", "; ").alias("reasons"))


@query("request_outcomes", profile_sql(
    _request_sql() + " select case when reasons = '' then 'valid' else 'rejected' end as outcome, count(*) as n from k group by 1"))
def _outcomes(spark, folder):
    checked = validation.validate_requests(requests(spark, folder))
    good = validation.valid_requests(checked).agg(F.lit("valid").alias("outcome"), F.count(F.lit(1)).alias("n"))
    bad = validation.rejected_requests(checked).agg(F.lit("rejected").alias("outcome"), F.count(F.lit(1)).alias("n"))
    return good.unionByName(bad).where("n > 0")


@query(
    "signal_check",
    profile_sql(
        "select 'correlation:support_tickets_30d' as signal, round(corr(support_tickets_30d::double, churn_label::double), 9) as strength from profile"
        " union all select 'correlation:payment_failures_90d', round(corr(payment_failures_90d::double, churn_label::double), 9) from profile"
        " union all select 'rate contrast:contract_type', round(avg(churn_label) filter (contract_type = 'Month-to-month')"
        " - avg(churn_label) filter (contract_type = 'Two year'), 9) from profile"
    ),
)
def _signal(spark, folder):
    checks = quality.signal_check(
        customer_profile(spark, folder), ["support_tickets_30d", "payment_failures_90d"], "contract_type", "Month-to-month", "Two year"
    )
    return checks.withColumn("strength", F.round("strength", 9))


FLAGS = [
    "has_high_support_tickets", "is_dissatisfied", "severe_usage_drop", "low_engagement_flag", "has_payment_issue",
    "is_month_to_month",
]
RATIOS = ["charges_per_tenure", "monthly_to_total_ratio", "support_tickets_per_tenure", "gb_per_active_day"]


def feature_sql(source: str, total="total_charges", quarter="support_tickets_90d", days="active_days_per_month",
                logins="login_frequency_30d", traffic="avg_monthly_gb_download", late="late_payments_12m") -> str:
    tenure = "greatest(tenure_months, 1)"
    return f"""select *, 2 * has_high_support_tickets + 2 * is_dissatisfied + 2 * severe_usage_drop
      + 2 * has_payment_issue + is_month_to_month as risk_score_index from (
      select *, {even(f"{total} / {tenure}", 2)} as charges_per_tenure,
      {even(f"monthly_charges / greatest({total}, 1.0::double)", 4)} as monthly_to_total_ratio,
      {even(f"({quarter})::double / {tenure}", 3)} as support_tickets_per_tenure,
      case when support_tickets_30d >= 3 then 1 else 0 end as has_high_support_tickets,
      case when resolution_satisfaction_score <= 2 then 1 else 0 end as is_dissatisfied,
      {even(f"{traffic} / greatest({days}, 1)", 2)} as gb_per_active_day,
      case when change_in_usage_pct < -0.25 then 1 else 0 end as severe_usage_drop,
      case when greatest({days}, 1) <= 5 and {logins} <= 3 then 1 else 0 end as low_engagement_flag,
      case when payment_failures_90d > 0 or {late} > 0 then 1 else 0 end as has_payment_issue,
      case when contract_type = 'Month-to-month' then 1 else 0 end as is_month_to_month from {source}) f"""


FEATURES = ["customer_id", *RATIOS, *FLAGS, "risk_score_index"]


@query(
    "domain_features",
    profile_sql(f", f as ({feature_sql('profile')}) select {', '.join(FEATURES)} from f"),
)
def _features(spark, folder):
    return features.add_domain_features(customer_profile(spark, folder)).select(*FEATURES)


@query(
    "default_columns",
    profile_sql(
        ", f as ("
        + feature_sql(
            "profile", total="(monthly_charges * tenure_months)", quarter="support_tickets_30d * 3", days="20",
            logins="10", traffic="100.0::double", late="0",
        )
        + f") select {', '.join(FEATURES)} from f"
    ),
)
def _defaults(spark, folder):
    narrow = customer_profile(spark, folder).drop(
        "total_charges", "support_tickets_90d", "active_days_per_month", "login_frequency_30d",
        "avg_monthly_gb_download", "late_payments_12m",
    )
    return features.add_domain_features(narrow).select(*FEATURES)


BAND = """case when tenure_months > -1 and tenure_months <= 6 then '0-6 Months'
  when tenure_months > 6 and tenure_months <= 12 then '6-12 Months'
  when tenure_months > 12 and tenure_months <= 24 then '12-24 Months'
  when tenure_months > 24 and tenure_months <= 72 then '24+ Months' end as tenure_band"""


@query("tenure_band", profile_sql(f"select customer_id, {BAND} from profile"))
def _band(spark, folder):
    return features.add_tenure_band(customer_profile(spark, folder)).select("customer_id", "tenure_band")


@query("ground_truth_score", profile_sql("select customer_id, churn_probability from profile"))
def _truth(spark, folder):
    return customer_profile(spark, folder).select("customer_id", F.round(scores.ground_truth_score(), 6).alias("churn_probability"))


@query(
    "plan_lookup",
    profile_sql(
        "select customer_id, case plan_tier when 'Basic' then 29.99e0 when 'Standard' then 59.99e0 when 'Premium' then 99.99e0"
        " when 'Enterprise' then 199.99e0 end as base_charge,"
        " payment_method in ('Bank transfer', 'Credit card') as pays_automatically from profile"
    ),
)
def _lookup(spark, folder):
    return customer_profile(spark, folder).select(
        "customer_id", base_charge(F.col("plan_tier")).alias("base_charge"),
        pays_automatically(F.col("payment_method")).alias("pays_automatically"),
    )
