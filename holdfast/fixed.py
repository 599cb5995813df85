"""Column roles, thresholds and texts that every operator agrees on.

They are data, not logic. Results must carry exactly these names, limits and
sentences, so they are written out plainly, in their natural order.
"""

# ---- column roles -----------------------------------------------------------
TARGET = "churn_label"
ID = "customer_id"
PROBABILITY = "churn_probability"

LEAKAGE = [
    "cancellation_processed_date",
    "final_invoice_flag",
    "account_status_deactivated",
    "churn_reason_recorded",
]

CATEGORICAL = [
    "gender",
    "partner",
    "dependents",
    "geography",
    "contract_type",
    "payment_method",
    "auto_pay_enabled",
    "plan_tier",
    "credit_card_expiring_soon",
    "price_increase_applied_30d",
    "competitor_offer_viewed",
    "retention_offer_accepted",
]

NUMERICAL = [
    "age",
    "tenure_months",
    "monthly_charges",
    "total_charges",
    "avg_monthly_gb_download",
    "active_days_per_month",
    "login_frequency_30d",
    "app_usage_hours",
    "feature_usage_score",
    "change_in_usage_pct",
    "support_tickets_30d",
    "support_tickets_90d",
    "complaints_opened",
    "resolution_satisfaction_score",
    "chat_interactions",
    "payment_failures_90d",
    "late_payments_12m",
    "nps_score",
    "marketing_emails_opened_30d",
]

MODEL_NUMERICAL = NUMERICAL + ["charges_per_tenure", "risk_score_index"]
SEGMENTS = ["tenure_band", "contract_type", "plan_tier", "geography"]

# ---- leakage message --------------------------------------------------------
LEAKAGE_MESSAGE = (
    "CRITICAL DATA LEAKAGE VIOLATION! Detected forbidden leakage fields in feature matrix: {found}. "
    "These fields exist only post-churn and MUST be stripped before any feature engineering or model training."
)

# ---- defaults for columns a table does not have ------------------------------
FEATURE_DEFAULTS = {
    "tenure_months": 12,
    "support_tickets_30d": 0,
    "resolution_satisfaction_score": 3.0,
    "avg_monthly_gb_download": 100.0,
    "active_days_per_month": 20,
    "change_in_usage_pct": 0.0,
    "login_frequency_30d": 10,
    "payment_failures_90d": 0,
    "late_payments_12m": 0,
    "contract_type": "Month-to-month",
}

# profile used for an event whose customer has no stored profile
EVENT_PROFILE = {
    "gender": "Female",
    "partner": "No",
    "dependents": "No",
    "geography": "North America",
    "contract_type": "Month-to-month",
    "payment_method": "Electronic check",
    "auto_pay_enabled": "No",
    "plan_tier": "Standard",
    "credit_card_expiring_soon": "No",
    "price_increase_applied_30d": "No",
    "competitor_offer_viewed": "No",
    "retention_offer_accepted": "No",
    "age": 42,
    "tenure_months": 3,
    "monthly_charges": 95.0,
    "total_charges": 285.0,
    "avg_monthly_gb_download": 120.0,
    "active_days_per_month": 15,
    "login_frequency_30d": 8,
    "app_usage_hours": 12.5,
    "feature_usage_score": 65.0,
    "change_in_usage_pct": 0.0,
    "support_tickets_30d": 1,
    "support_tickets_90d": 2,
    "complaints_opened": 0,
    "resolution_satisfaction_score": 3.5,
    "chat_interactions": 2,
    "payment_failures_90d": 0,
    "late_payments_12m": 0,
    "nps_score": 7,
    "marketing_emails_opened_30d": 3,
}

# ---- request contract: allowed values, bounds, default -------------------------
YES_NO = ["Yes", "No"]
NET_ADD_ON = ["Yes", "No", "No internet service"]
REQUEST_CHOICES = {
    "gender": (["Male", "Female"], "Female"),
    "partner": (YES_NO, "No"),
    "dependents": (YES_NO, "No"),
    "phone_service": (YES_NO, "Yes"),
    "multiple_lines": (["Yes", "No", "No phone service"], "No"),
    "internet_service": (["DSL", "Fiber optic", "No"], "Fiber optic"),
    "online_security": (NET_ADD_ON, "No"),
    "online_backup": (NET_ADD_ON, "Yes"),
    "device_protection": (NET_ADD_ON, "No"),
    "tech_support": (NET_ADD_ON, "No"),
    "streaming_tv": (NET_ADD_ON, "Yes"),
    "streaming_movies": (NET_ADD_ON, "Yes"),
    "contract_type": (["Month-to-month", "One year", "Two year"], "Month-to-month"),
    "paperless_billing": (YES_NO, "Yes"),
    "payment_method": (
        ["Electronic check", "Mailed check", "Bank transfer (automatic)", "Credit card (automatic)"],
        "Electronic check",
    ),
    "plan_tier": (["Basic", "Standard", "Premium", "Enterprise"], "Standard"),
    "geography": (["North America", "Europe", "Asia-Pacific", "Latin America"], "North America"),
    "competitor_offer_viewed": (YES_NO, "Yes"),
    "price_increase_applied_30d": (YES_NO, "Yes"),
}
REQUEST_BOUNDS = {
    "senior_citizen": (0, 1, 0),
    "tenure_months": (0, 120, 12),
    "monthly_charges": (0.0, 1000.0, 85.5),
    "total_charges": (0.0, 100000.0, 1026.0),
    "support_tickets_30d": (0, 50, 2),
    "resolution_satisfaction_score": (1.0, 5.0, 2.5),
    "app_logins_30d": (0, 500, 8),
    "payment_failures_90d": (0, 20, 1),
    "change_in_usage_pct": (-1.0, 5.0, -0.15),
}

# ---- the documented log-odds of churn --------------------------------------------
LOG_ODDS_INTERCEPT = -2.20
LOG_ODDS = {
    "is_month_to_month": 1.35,
    "support_tickets_30d": 0.55,
    "payment_failures_90d": 0.75,
    "is_dissatisfied": 0.60,
    "severe_usage_drop": 0.80,
    "price_increase": 0.50,
    "competitor_viewed": 0.65,
    "low_nps": 0.45,
    "tenure_months": -0.035,
    "auto_pay": -0.40,
    "retention_accepted": -0.35,
}
BASE_CHARGE = {"Basic": 29.99, "Standard": 59.99, "Premium": 99.99, "Enterprise": 199.99}
AUTO_PAY_METHODS = ["Bank transfer", "Credit card"]

# ---- money ---------------------------------------------------------------------------
LIFESPAN_MONTHS = 36.0
GROSS_MARGIN = 0.75
CAMPAIGN_COST = 50.0
CAMPAIGN_SUCCESS = 0.25

# ---- risk tiers and actions ------------------------------------------------------------
TIER_HIGH, TIER_MEDIUM = 0.70, 0.40
TIER_ACTIONS = {
    "High Risk": "Immediate priority call by VIP retention specialist + 12m contract lock offer.",
    "Medium Risk": "Automated email campaign with product feature walkthrough & satisfaction survey.",
    "Low Risk": "No intervention required. Continue standard engagement.",
}
CALL_CONTRACT = "Offer 12-month contract upgrade discount + priority support callback."
CALL_PRICE = "Offer price lock guarantee for 6 months."
CALL_REVIEW = "Proactive account review call by VIP retention specialist."

HEURISTIC_VERSION = "FallbackHeuristicV1"
HEURISTIC_REASONS = [
    "Month-to-month contract structure (+30% risk)",
    "Frequent support tickets in 30d (+30% risk)",
    "Recent price increase applied (+20% risk)",
]

# ---- feature reasons: the first name contained in the feature decides --------------------
FEATURE_REASONS = {
    "risk_score_index": "High overall churn risk indicator",
    "support_tickets_30d": "Frequent support tickets opened in last 30 days",
    "contract_type_Month-to-month": "Flexible Month-to-month contract structure",
    "tenure_months": "Customer account tenure length",
    "payment_failures_90d": "Recent payment failures in last 90 days",
    "price_increase_applied_30d": "Recent monthly price increase applied",
    "resolution_satisfaction_score": "Customer satisfaction rating with recent support",
    "change_in_usage_pct": "Significant drop in product usage/activity",
    "competitor_offer_viewed": "Customer viewed competitor retention offer",
}

# ---- stream --------------------------------------------------------------------------------
BUFFER_EVENTS = 50
ALERT_THRESHOLD, ALERT_CRITICAL = 0.80, 0.85
ALERT_CHANNEL = "#retention-urgent-alerts"
ALERT_REASONS = [
    "Support ticket surge in 5m window (+35% risk)",
    "Recent payment failure (+25% risk)",
]

# ---- drift and gate ----------------------------------------------------------------------------
PSI_HIGH, PSI_MODERATE = 0.25, 0.10
DRIFT_HIGH = "High Drift (Retrain Required)"
DRIFT_MODERATE = "Moderate Drift (Monitor)"
DRIFT_NONE = "No Drift"
PR_AUC_FLOOR, PR_AUC_BASELINE = 0.80, 0.90
ACTION_RETRAIN = "Trigger Automated Re-training Pipeline"
ACTION_KEEP = "Maintain Current Champion Model"
GATE_MARGIN = 0.01
GATE_FIRST = "No active Champion found. Initial Challenger automatically promoted."
