"""Column names of the customer table and the derived-feature definitions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

ID = "Customer_ID"
TARGET = "churn"

# Predictor names, as the data dictionary lists them.
NUMERIC_PREDICTORS = (
    "rev_Mean", "mou_Mean", "totmrc_Mean", "da_Mean", "ovrmou_Mean", "ovrrev_Mean",
    "vceovr_Mean", "datovr_Mean", "roam_Mean", "change_mou", "change_rev", "drop_vce_Mean",
    "drop_dat_Mean", "blck_vce_Mean", "blck_dat_Mean", "unan_vce_Mean", "unan_dat_Mean",
    "plcd_vce_Mean", "plcd_dat_Mean", "recv_vce_Mean", "recv_sms_Mean", "comp_vce_Mean",
    "comp_dat_Mean", "custcare_Mean", "ccrndmou_Mean", "cc_mou_Mean", "inonemin_Mean",
    "threeway_Mean", "mou_cvce_Mean", "mou_cdat_Mean", "mou_rvce_Mean", "owylis_vce_Mean",
    "mouowylisv_Mean", "iwylis_vce_Mean", "mouiwylisv_Mean", "peak_vce_Mean", "peak_dat_Mean",
    "mou_peav_Mean", "mou_pead_Mean", "opk_vce_Mean", "opk_dat_Mean", "mou_opkv_Mean",
    "mou_opkd_Mean", "drop_blk_Mean", "attempt_Mean", "complete_Mean", "callfwdv_Mean",
    "callwait_Mean", "months", "uniqsubs", "actvsubs", "totcalls", "totmou", "totrev", "adjrev",
    "adjmou", "adjqty", "avgrev", "avgmou", "avgqty", "avg3mou", "avg3qty", "avg3rev", "avg6mou",
    "avg6qty", "avg6rev", "hnd_price", "phones", "models", "truck", "rv", "lor", "adults",
    "income", "numbcars", "forgntvl", "eqpdays",
)
CATEGORICAL_PREDICTORS = (
    "new_cell", "crclscod", "asl_flag", "prizm_social_one", "area", "dualband", "refurb_new",
    "hnd_webcap", "ownrent", "dwlltype", "marital", "infobase", "HHstatin", "dwllsize", "ethnic",
    "kid0_2", "kid3_5", "kid6_10", "kid11_15", "kid16_17", "creditcd",
)
# Personal attributes that a deployment may want to leave out.
SENSITIVE = ("ethnic", "marital", "kid0_2", "kid3_5", "kid6_10", "kid11_15", "kid16_17")


def customer_schema(columns: list[str]) -> T.StructType:
    """Schema for a file holding ``columns``: doubles, strings, and an integer target."""
    def kind(name: str) -> T.DataType:
        if name in CATEGORICAL_PREDICTORS:
            return T.StringType()
        if name == TARGET:
            return T.IntegerType()
        return T.LongType() if name == ID else T.DoubleType()

    return T.StructType([T.StructField(c, kind(c)) for c in columns])


class Derived(NamedTuple):
    name: str
    kind: str  # "ratio" or "difference"
    left: str
    right: str
    times: float = 1.0
    over: float = 1.0


# The 34 derived features (30 ratios, 4 differences).
DERIVED_FEATURES = (
    Derived("call_completion_rate", "ratio", "complete_Mean", "attempt_Mean"),
    Derived("call_failure_rate", "ratio", "drop_blk_Mean", "attempt_Mean"),
    Derived("voice_drop_rate", "ratio", "drop_vce_Mean", "plcd_vce_Mean"),
    Derived("voice_block_rate", "ratio", "blck_vce_Mean", "plcd_vce_Mean"),
    Derived("voice_unanswered_rate", "ratio", "unan_vce_Mean", "plcd_vce_Mean"),
    Derived("data_drop_rate", "ratio", "drop_dat_Mean", "plcd_dat_Mean"),
    Derived("data_block_rate", "ratio", "blck_dat_Mean", "plcd_dat_Mean"),
    Derived("overage_usage_share", "ratio", "ovrmou_Mean", "mou_Mean"),
    Derived("overage_revenue_share", "ratio", "ovrrev_Mean", "rev_Mean"),
    Derived("recurring_revenue_share", "ratio", "totmrc_Mean", "rev_Mean"),
    Derived("customer_care_calls_per_100_calls", "ratio", "custcare_Mean", "attempt_Mean", times=100.0),
    Derived("customer_care_minutes_per_call", "ratio", "cc_mou_Mean", "custcare_Mean"),
    Derived("active_subscriber_share", "ratio", "actvsubs", "uniqsubs"),
    Derived("handsets_per_active_subscriber", "ratio", "phones", "actvsubs"),
    Derived("models_per_handset", "ratio", "models", "phones"),
    Derived("equipment_age_to_tenure", "ratio", "eqpdays", "months", over=30.0),
    Derived("current_to_3m_usage", "ratio", "mou_Mean", "avg3mou"),
    Derived("current_to_6m_usage", "ratio", "mou_Mean", "avg6mou"),
    Derived("current_to_lifetime_usage", "ratio", "mou_Mean", "avgmou"),
    Derived("current_to_3m_revenue", "ratio", "rev_Mean", "avg3rev"),
    Derived("current_to_6m_revenue", "ratio", "rev_Mean", "avg6rev"),
    Derived("current_to_lifetime_revenue", "ratio", "rev_Mean", "avgrev"),
    Derived("usage_vs_3m", "difference", "mou_Mean", "avg3mou"),
    Derived("usage_vs_6m", "difference", "mou_Mean", "avg6mou"),
    Derived("revenue_vs_3m", "difference", "rev_Mean", "avg3rev"),
    Derived("revenue_vs_6m", "difference", "rev_Mean", "avg6rev"),
    Derived("peak_voice_share", "ratio", "peak_vce_Mean", "attempt_Mean"),
    Derived("offpeak_voice_share", "ratio", "opk_vce_Mean", "attempt_Mean"),
    Derived("received_voice_share", "ratio", "recv_vce_Mean", "attempt_Mean"),
    Derived("lifetime_calls_per_month", "ratio", "totcalls", "months"),
    Derived("lifetime_minutes_per_month", "ratio", "totmou", "months"),
    Derived("lifetime_revenue_per_month", "ratio", "totrev", "months"),
    Derived("revenue_per_minute", "ratio", "rev_Mean", "mou_Mean"),
    Derived("minutes_per_call", "ratio", "mou_Mean", "attempt_Mean"),
)
