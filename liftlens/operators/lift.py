"""E4 incremental lift against the holdout, and W8 the newest lift row.

J9 (treatment row minus holdout row) is a conditional aggregation, not a join.

One conditional aggregation per wave gives both groups' figures; the lift
arithmetic then runs on that one row per wave, so all waves are measured in
a single pass and a missing group yields nulls rather than an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlens.functions.numeric import half_even
from liftlens.functions.time import ts, ts_plus_days
from liftlens.params import HOLDOUT, TREATMENT, Params

def incremental_lift(outcomes: DataFrame, params: Params, *, by: Sequence[str] = ("campaign_id",),
                     measured_ts: str | None = None) -> DataFrame:
    """Per wave: n treated/holdout, purchase-rate and spend-per-head lift, margin, coupon cost,
    total incremental margin and ROI (rounded to 4 / 2 places, half to even).

    ``spend_is_net`` adds the redeemed coupon value back to treated spend first.
    """
    is_t = F.col("group") == TREATMENT
    is_h = F.col("group") == HOLDOUT
    spend = F.col("spend")
    if params.spend_is_net:
        spend = spend + F.col("redeemed") * F.lit(float(params.coupon_value))
    g = outcomes.groupBy(*by).agg(
        F.count(F.when(is_t, 1)).alias("n_treated"),
        F.count(F.when(is_h, 1)).alias("n_holdout"),
        F.avg(F.when(is_t, F.col("purchased"))).alias("_rate_t"),
        F.avg(F.when(is_h, F.col("purchased"))).alias("_rate_h"),
        F.avg(F.when(is_t, spend)).alias("_spend_t"),
        F.avg(F.when(is_h, F.col("spend"))).alias("_spend_h"),
        F.sum(F.when(is_t, F.col("redeemed"))).alias("_red_t"),
    )
    rate = F.col("_rate_t") - F.col("_rate_h")
    spend_head = F.col("_spend_t") - F.col("_spend_h")
    margin_head = spend_head * F.lit(float(params.margin_rate))
    cost = (F.col("_red_t").cast("double") * F.lit(float(params.coupon_value))
            * F.lit(float(params.coupon_cost_fraction)))
    total = margin_head * F.col("n_treated") - F.col("_cost")
    if measured_ts is None:
        measured = ts_plus_days(ts(params.as_of), params.outcome_days)
    else:
        measured = ts(measured_ts)
    return (g.withColumn("_cost", cost)
            .select(*by, "n_treated", "n_holdout",
                    half_even(rate, 4).alias("incr_purchase_rate"),
                    half_even(spend_head, 2).alias("incr_spend_per_head"),
                    half_even(margin_head, 2).alias("incr_margin_per_head"),
                    half_even(F.col("_cost"), 2).alias("coupon_cost"),
                    half_even(total, 2).alias("total_incremental_margin"),
                    half_even(F.when(F.col("_cost") != 0, total / F.col("_cost")), 2).alias("roi"),
                    measured.alias("measured_ts")))


def latest_lift(lift: DataFrame) -> DataFrame:
    """W8 / SL2: the newest measured row (order + limit 1, planned as TakeOrderedAndProject)."""
    return lift.orderBy(F.col("measured_ts").desc(), F.col("campaign_id").desc()).limit(1)
