"""Experiment design and read-out: E1, E3, E6, PF3, A4, A5, A6.

Group membership is a column expression over a salted hash of the id: no
shuffle, identical across reruns and partitionings. The ``exact`` mode (and
the stratified evaluation split) ranks ids inside each stratum with the
bucketed global order of :mod:`liftlens.operators.ordering`, so a stratum
holding a third of all customers is still cut into bounded tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlens.functions.hashing import hash_bucket, hash_order_key
from liftlens.functions.time import ts
from liftlens.operators.ordering import global_rank
from liftlens.params import CHANNELS, HASH_BUCKETS, HOLDOUT, NO_CHANNEL, TREATMENT, Params

def wave(df: DataFrame, campaign_ids: str | Sequence[str]) -> DataFrame:
    """PF4: rows of the given wave(s); on a campaign_id-partitioned table this prunes partitions."""
    ids = [campaign_ids] if isinstance(campaign_ids, str) else list(campaign_ids)
    return df.filter(F.col("campaign_id").isin(ids))


def eligible_by_tier(segments: DataFrame, tiers: Sequence[str]) -> DataFrame:
    """PF3: customers whose value tier is targeted by the wave."""
    return (segments.filter(F.col("value_tier").isin(list(tiers)))
            .select("customer_id", "segment_id", "value_tier"))


def _uniform(kind: str, salt: str):
    return hash_bucket(kind, "customer_id", salt) / F.lit(float(HASH_BUCKETS))


def assign_groups(eligible: DataFrame, campaign_id: str, params: Params, *, mode: str = "bernoulli",
                  strata: Sequence[str] = ("value_tier",), hash_kind: str | None = None,
                  coupon_value: float | None = None, assigned_ts: str | None = None) -> DataFrame:
    """treatment/holdout split of the eligible customers for one wave (PF2 computed columns).

    ``bernoulli``: u = bucket(campaign_id::customer_id) / 100000, treatment iff
    u < fraction (the reference's rule; balanced in expectation).
    ``exact``: inside each stratum, the first floor(n*fraction + 0.5) ids in
    hash order are treated (balanced to within one customer).
    """
    kind = hash_kind or params.hash_kind
    frac = float(params.treatment_fraction)
    if mode == "bernoulli":
        treated = _uniform(kind, campaign_id) < F.lit(frac)
        df = eligible.withColumn("_treated", treated)
    elif mode == "exact":
        keyed = eligible.withColumn("_h", hash_order_key(kind, "customer_id", campaign_id))
        ranked = global_rank(keyed, [("_h", True), ("customer_id", True)], partition_by=list(strata),
                             rows_per_bucket=params.rows_per_bucket, row_number="_r", count_col="_n")
        df = ranked.withColumn("_treated", F.col("_r") <= F.floor(F.col("_n") * F.lit(frac) + F.lit(0.5)))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    value = float(params.coupon_value if coupon_value is None else coupon_value)
    return df.select(
        "customer_id", "segment_id", "value_tier",
        F.when(F.col("_treated"), F.lit(TREATMENT)).otherwise(F.lit(HOLDOUT)).alias("group"),
        F.lit(campaign_id).alias("campaign_id"),
        F.when(F.col("_treated"), F.lit(value)).otherwise(F.lit(0.0)).alias("coupon_value"),
        ts(assigned_ts or params.as_of).alias("assigned_ts"),
    )


def reserve_holdout(offers: DataFrame, wave: str, params: Params, *, hash_kind: str | None = None) -> DataFrame:
    """A second, wave-salted split of the offer list, plus the delivery channel.

    Holdout customers get channel ``none``; treated ones one of app/email/sms
    by the unsalted id hash modulo 3.
    """
    kind = hash_kind or params.hash_kind
    treated = _uniform(kind, wave) < F.lit(float(params.treatment_fraction))
    idx = (hash_bucket(kind, "customer_id", None) % F.lit(len(CHANNELS)) + F.lit(1)).cast("int")
    channel = F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), idx)
    return (offers
            .withColumn("group", F.when(treated, F.lit(TREATMENT)).otherwise(F.lit(HOLDOUT)))
            .withColumn("channel", F.when(F.col("group") == HOLDOUT, F.lit(NO_CHANNEL)).otherwise(channel)))


def stratified_split(df: DataFrame, params: Params, *, by: Sequence[str] = ("group",), salt: str = "SPLIT",
                     hash_kind: str | None = None) -> DataFrame:
    """Reproducible train/eval split per stratum; eval = the first ceil(n * eval_fraction) in hash order.

    The eval count is computed in integer basis points, so no float rounding
    enters the cut.
    """
    kind = hash_kind or params.hash_kind
    bp = int(round(params.eval_fraction * 10000))
    keyed = df.withColumn("_h", hash_order_key(kind, "customer_id", salt))
    ranked = global_rank(keyed, [("_h", True), ("customer_id", True)], partition_by=list(by),
                         rows_per_bucket=params.rows_per_bucket, row_number="_r", count_col="_n")
    n_eval = F.floor((F.col("_n") * F.lit(bp) + F.lit(9999)) / F.lit(10000))
    return (ranked.withColumn("split", F.when(F.col("_r") <= n_eval, F.lit("eval")).otherwise(F.lit("train")))
            .drop("_h", "_r", "_n"))


def balance_check(assignments: DataFrame, *, fill_zero: bool = False, by: str = "value_tier") -> DataFrame:
    """Counts per tier x group pivoted, and the treated share rounded to 3 places.

    The pivot values are given, so Spark plans no extra job to find them.
    ``fill_zero`` turns an absent cell into 0 (dashboard) instead of null (notebook).
    """
    pv = (assignments.groupBy(by).pivot("group", [TREATMENT, HOLDOUT]).agg(F.count(F.lit(1))))
    if fill_zero:
        pv = pv.fillna(0, subset=[TREATMENT, HOLDOUT])
    t, h = F.col(TREATMENT), F.col(HOLDOUT)
    return pv.select(by, t.cast("bigint").alias(TREATMENT), h.cast("bigint").alias(HOLDOUT),
                     F.round(t / (t + h), 3).alias("treatment_pct"))


def outcome_summary(outcomes: DataFrame, by: Sequence[str] = ("campaign_id", "group")) -> DataFrame:
    """A5: per group size, purchase rate, mean spend, redemption rate and count."""
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("purchased").alias("purchase_rate"),
        F.avg("spend").alias("avg_spend"),
        F.avg("redeemed").alias("redemption_rate"),
        F.sum("redeemed").cast("bigint").alias("redemptions"),
    )


def _group_avg(col: str, group: str):
    return F.avg(F.when(F.col("group") == group, F.col(col)))


def ate(outcomes: DataFrame, by: Sequence[str] = ("campaign_id",)) -> DataFrame:
    """Purchase rate of treatment minus holdout, one pass of conditional aggregation.

    A group with no rows gives null (no error).
    """
    return (outcomes.groupBy(*by)
            .agg(F.count(F.when(F.col("group") == TREATMENT, 1)).alias("n_treated"),
                 F.count(F.when(F.col("group") == HOLDOUT, 1)).alias("n_holdout"),
                 _group_avg("purchased", TREATMENT).alias("treatment_rate"),
                 _group_avg("purchased", HOLDOUT).alias("holdout_rate"))
            .withColumn("ate", F.col("treatment_rate") - F.col("holdout_rate")))


def delivered_assignments(delivered: DataFrame, params: Params, *, ts_col: str = "decision_ts") -> DataFrame:
    """An offer wave after ``reserve_holdout`` in assignment form (coupon only for the treated)."""
    return delivered.select(
        "customer_id", F.lit(None).cast("int").alias("segment_id"), "value_tier", "group", "campaign_id",
        F.when(F.col("group") == TREATMENT, F.lit(float(params.coupon_value))).otherwise(F.lit(0.0))
        .alias("coupon_value"),
        F.col(ts_col).alias("assigned_ts"))
