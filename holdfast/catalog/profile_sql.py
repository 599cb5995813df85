"""SQL definitions of the two shared inputs: the customer profile and the customer events."""

PROFILE = """
with hist as (
  select o_custkey, o_orderkey, o_orderdate, o_orderstatus, o_orderpriority, o_totalprice
  from orders where o_orderdate < timestamp '2001-01-01 00:00:00'
), latest as (
  select o_custkey, o_orderstatus, o_orderpriority from (
    select h.*, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from hist h) t
  where rn = 1
), spend as (
  select o_custkey, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total_raw,
    sum(case when o_orderdate >= timestamp '2000-01-01 00:00:00' then 1 else 0 end) as n_cur,
    sum(case when o_orderdate >= timestamp '1999-01-01 00:00:00' and o_orderdate < timestamp '2000-01-01 00:00:00' then 1 else 0 end) as n_prev
  from hist group by o_custkey
), lines as (
  select o.o_custkey,
    sum(case when l_returnflag='R' and l_shipdate >= timestamp '2000-07-01 00:00:00' then 1 else 0 end) as t30,
    sum(case when l_returnflag='R' and l_shipdate >= timestamp '1999-07-01 00:00:00' then 1 else 0 end) as t90,
    sum(case when l_returnflag='R' and l_tax >= 0.07 and l_shipdate >= timestamp '1999-07-01 00:00:00' then 1 else 0 end) as pf,
    sum(case when l_returnflag='R' and l_tax >= 0.07 and l_shipdate >= timestamp '1998-01-01 00:00:00' then 1 else 0 end) as lp,
    sum(case when l_shipdate >= timestamp '2000-01-01 00:00:00' then l_quantity else 0 end) as qty
  from lineitem join hist o on o.o_orderkey = l_orderkey
  where l_shipdate < timestamp '2001-01-01 00:00:00' group by o.o_custkey
), ev as (
  select user_id, count(distinct cast(ts as date)) as days,
    sum(case when event_type in ('view','click') then 1 else 0 end) as logins,
    sum(case when event_type='error' and value >= 100 then 1 else 0 end) as complaints,
    sum(case when event_type='click' and value >= 100 then 1 else 0 end) as chats,
    cast(sum(cast(value as decimal(18,2))) as double) as val
  from events group by user_id
), future as (
  select distinct o_custkey from orders where o_orderdate >= timestamp '2001-01-01 00:00:00'
), base as (
  select c.c_custkey as customer_id,
    cast(18 + (c_custkey * 13) % 57 as int) as age,
    case when c_custkey % 2 = 0 then 'Female' else 'Male' end as gender,
    case when c_custkey % 3 = 0 then 'Yes' else 'No' end as partner,
    case when c_custkey % 10 < 3 then 'Yes' else 'No' end as dependents,
    r_name as geography,
    cast(1 + (c_custkey * 31) % 71 as int) as tenure_months,
    case l.o_orderstatus when 'F' then 'One year' when 'P' then 'Two year' else 'Month-to-month' end as contract_type,
    case l.o_orderpriority when '1-URGENT' then 'Credit card' when '2-HIGH' then 'Bank transfer' when '3-MEDIUM' then 'Mailed check' else 'Electronic check' end as payment_method,
    case when l.o_orderpriority in ('1-URGENT','2-HIGH') then 'Yes' else 'No' end as auto_pay_enabled,
    case c_mktsegment when 'FURNITURE' then 'Standard' when 'HOUSEHOLD' then 'Premium' when 'MACHINERY' then 'Enterprise' else 'Basic' end as plan_tier,
    cast(19.99 + cast(floor((c_acctbal + 1000) / 60) as decimal(10,2)) as double) as monthly_charges,
    round(coalesce(s.total_raw, 0) / 1000, 2) as total_charges,
    round(coalesce(li.qty, 0) / 12, 1) as avg_monthly_gb_download,
    cast(coalesce(ev.days, 0) as int) as active_days_per_month,
    cast(coalesce(ev.logins, 0) as int) as login_frequency_30d,
    round(coalesce(ev.val, 0) / 10, 1) as app_usage_hours,
    cast((c_custkey * 17) % 101 as double) as feature_usage_score,
    round((coalesce(s.n_cur, 0) - coalesce(s.n_prev, 0)) / cast(greatest(coalesce(s.n_prev, 0), 1) as double), 3) as change_in_usage_pct,
    cast(coalesce(li.t30, 0) as int) as support_tickets_30d,
    cast(coalesce(li.t90, 0) as int) as support_tickets_90d,
    cast(coalesce(ev.complaints, 0) as int) as complaints_opened,
    cast(1 + (c_custkey * 7) % 5 as int) as resolution_satisfaction_score,
    cast(coalesce(ev.chats, 0) as int) as chat_interactions,
    cast(coalesce(li.pf, 0) as int) as payment_failures_90d,
    cast(coalesce(li.lp, 0) as int) as late_payments_12m,
    case when c_custkey % 5 = 0 then 'Yes' else 'No' end as price_increase_applied_30d,
    case when c_custkey % 12 = 3 then 'Yes' else 'No' end as credit_card_expiring_soon,
    cast((c_custkey * 3) % 11 as int) as nps_score,
    case when c_custkey % 4 = 1 then 'Yes' else 'No' end as competitor_offer_viewed,
    cast(c_custkey % 15 as int) as marketing_emails_opened_30d,
    case when c_custkey % 8 = 2 then 'Yes' else 'No' end as retention_offer_accepted,
    cast(case when f.o_custkey is null then 1 else 0 end as int) as churn_label
  from customer c join nation n on n_nationkey = c_nationkey join region r on r_regionkey = n_regionkey
    left join latest l on l.o_custkey = c_custkey left join spend s on s.o_custkey = c_custkey
    left join lines li on li.o_custkey = c_custkey left join ev on ev.user_id = c_custkey
    left join future f on f.o_custkey = c_custkey
)
select base.*, round(1.0 / (1.0 + exp(-(-2.20
    + 1.35 * case when contract_type = 'Month-to-month' then 1 else 0 end
    + 0.55 * support_tickets_30d + 0.75 * payment_failures_90d
    + 0.60 * case when resolution_satisfaction_score <= 2 then 1 else 0 end
    + 0.80 * case when change_in_usage_pct < -0.25 then 1 else 0 end
    + 0.50 * case when price_increase_applied_30d = 'Yes' then 1 else 0 end
    + 0.65 * case when competitor_offer_viewed = 'Yes' then 1 else 0 end
    + 0.45 * case when nps_score <= 4 then 1 else 0 end
    - 0.035 * tenure_months
    - 0.40 * case when auto_pay_enabled = 'Yes' then 1 else 0 end
    - 0.35 * case when retention_offer_accepted = 'Yes' then 1 else 0 end))), 6) as churn_probability
from base
"""

EVENTS = """
select event_id, user_id as customer_id, ts,
  case when event_type = 'error' and k >= 90 then 'support_ticket_opened'
    when event_type = 'purchase' and k >= 98 then 'payment_failed'
    when event_type = 'click' and k >= 90 then 'competitor_viewed'
    when event_type = 'view' and k >= 90 then 'usage_drop_detected'
    when event_type = 'signup' and k >= 90 then 'price_increase_notified'
    else 'app_login' end as event_type
from (select event_id, user_id, ts, event_type, cast(json_extract_string(props, '$.k') as int) as k from events) t
"""
