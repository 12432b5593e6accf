"""Parameters, vocabularies and table schemas.

Everything a job needs is carried by one frozen :class:`Params` value that
callers pass explicitly; nothing reads module-level mutable state.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for the same results)
# ---------------------------------------------------------------------------
# Data-tier routing labels and the history threshold for "known_full".
DATA_TIERS = ("known_full", "known_sparse", "unknown")
MIN_HISTORY_TXNS = 3
# Value-tier labels by rank of mean monthly spend (4th to 6th share "Low Value").
TIER_LABELS = ("High Value", "Medium-High Value", "Medium Value", "Low Value", "Low Value", "Low Value")
VALUE_TIERS = ("High Value", "Medium-High Value", "Medium Value", "Low Value")
# Experiment groups and delivery channels.
TREATMENT, HOLDOUT = "treatment", "holdout"
CHANNELS = ("app", "email", "sms")
NO_CHANNEL = "none"
# Wave names of the learning and the optimised wave.
LEARNING_WAVE = "WAVE_01_LEARNING"
OPTIMIZED_WAVE = "WAVE_02_OPTIMIZED"
# Hash split: a bucket in [0, 100000) from the salted id, "::" as separator.
HASH_BUCKETS = 100000
HASH_SEPARATOR = "::"
# Offer economics: p_redeem = clip(0.3 + uplift, 0.05, 0.9); roi denominator floor 1e-6.
REDEEM_BASE, REDEEM_MIN, REDEEM_MAX = 0.3, 0.05, 0.9
ROI_COST_FLOOR = 1e-6
# Champion rule: a run without a Qini metric counts as -1e9.
MISSING_QINI = -1e9
# Features used for clustering, log-transformed ones, and model inputs.
CLUSTER_FEATURES = (
    "recency_days", "frequency_per_month", "monetary_per_month",
    "avg_basket_value", "category_diversity", "avg_items",
)
LOG_FEATURES = ("monetary_per_month", "avg_basket_value")
NUM_FEATURES = (
    "recency_days", "tenure_days", "frequency_per_month", "monetary_per_month",
    "txn_count", "total_spend", "avg_basket_value", "max_basket_value",
    "avg_items", "category_diversity",
)
CAT_FEATURES = ("age_group", "city_tier", "channel_pref", "value_tier")
SNAPSHOT_COLUMNS = (
    "customer_id", "feature_ts",
    "recency_days", "tenure_days", "frequency_per_month", "monetary_per_month",
    "txn_count", "total_spend", "avg_basket_value", "max_basket_value",
    "avg_items", "category_diversity",
    "age_group", "city_tier", "channel_pref",
    "segment_id", "value_tier",
)


@dataclass(frozen=True)
class Params:
    """Business and modelling parameters of one run.

    Defaults are the reference's business values; :func:`testdata_params`
    rescales the money amounts for the supplied star-schema tables.
    """

    as_of: str = "2024-12-31"            # "today" for recency / tenure; history is strictly before
    seed: int = 42
    n_segments: int = 4                   # fallback k
    k_range: tuple[int, ...] = (3, 4, 5, 6)
    kmeans_restarts: int = 10
    final_restarts: int = 20
    kmeans_max_iter: int = 300            # iterations per k-means fit (scikit-learn's default)
    min_history_txns: int = MIN_HISTORY_TXNS
    treatment_fraction: float = 0.80
    coupon_value: float = 5.0
    coupon_cost_fraction: float = 1.0
    margin_rate: float = 0.30
    budget: float = 50_000.0
    max_offers_30d: int = 2
    cap_days: int = 30
    min_uplift: float = 0.0
    outcome_days: int = 90                # attribution window after assignment
    eval_fraction: float = 0.20
    hash_kind: str = "md5"                # "md5" (portable) or "murmur3" (the reference's)
    spend_is_net: bool = False            # add redeemed coupon value back before the lift
    cap_stage: str = "before"             # apply the frequency cap "before" or "after" allocation
    gbt_iters: int = 100                  # boosting rounds, depth and step: scikit-learn's defaults,
    gbt_depth: int = 3                    # which the reference keeps
    gbt_step: float = 0.1
    rows_per_bucket: int = 1_000_000      # target rows per range bucket of a global running order
    money_scale: int = 6                  # decimal scale of running money sums

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


def testdata_params(**kw) -> Params:
    """Parameters for the TPC-H-like test tables (amounts average ~250,000)."""
    base = Params(as_of="1997-01-01", coupon_value=20_000.0, budget=5_000_000.0)
    return base.with_(**kw) if kw else base


# ---------------------------------------------------------------------------
# Schemas (declared once; writers select/cast to them)
# ---------------------------------------------------------------------------
def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


TS = T.TimestampNTZType()
STR, DBL, LNG, INT = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()

TRANSACTIONS = _s(("customer_id", LNG), ("txn_date", TS), ("amount", DBL), ("n_items", LNG), ("category", STR))
CUSTOMERS = _s(("customer_id", LNG), ("age_group", STR), ("city_tier", STR), ("channel_pref", STR))
REDEMPTIONS = _s(("customer_id", LNG), ("redeemed_ts", TS))
SEGMENTS = _s(("customer_id", LNG), ("segment_id", INT), ("value_tier", STR))
ASSIGNMENTS = _s(("customer_id", LNG), ("segment_id", INT), ("value_tier", STR), ("group", STR),
                 ("campaign_id", STR), ("coupon_value", DBL), ("assigned_ts", TS))
OUTCOMES = _s(("customer_id", LNG), ("campaign_id", STR), ("group", STR), ("value_tier", STR),
              ("coupon_value", DBL), ("purchased", INT), ("redeemed", INT), ("spend", DBL))
SCORES = _s(("customer_id", LNG), ("value_tier", STR), ("uplift_score", DBL), ("scored_ts", TS))
OFFERS = _s(("customer_id", LNG), ("value_tier", STR), ("uplift_score", DBL), ("exp_incr_margin", DBL),
            ("exp_cost", DBL), ("roi_per_dollar", DBL), ("coupon_value", DBL), ("campaign_id", STR),
            ("decision_ts", TS))
LIFT = _s(("campaign_id", STR), ("n_treated", LNG), ("n_holdout", LNG), ("incr_purchase_rate", DBL),
          ("incr_spend_per_head", DBL), ("incr_margin_per_head", DBL), ("coupon_cost", DBL),
          ("total_incremental_margin", DBL), ("roi", DBL), ("measured_ts", TS))
RUNS = _s(("version", INT), ("campaign_id", STR), ("n_train", LNG), ("n_eval", LNG), ("qini_coef", DBL),
          ("qini_per_row", DBL), ("top_decile_uplift", DBL), ("bottom_decile_uplift", DBL))
