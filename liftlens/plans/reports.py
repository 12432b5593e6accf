"""Report frames behind the dashboard pages.

Each function returns a DataFrame; nothing is rendered and no rows are
collected.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlens.operators import allocate, evaluate, experiment, features, lift
from liftlens.params import Params


def report_join(left: DataFrame, right: DataFrame, key: str = "customer_id") -> DataFrame:
    """Inner join USING (customer_id), as the dashboard's report queries do."""
    return left.join(right, key, "inner")


def overview_counts(features_df: DataFrame, customers: DataFrame, params: Params) -> DataFrame:
    """Total customers, known (modelled) and unknown (cold start) in one aggregate over the routed master."""
    routed = features.route_customers(features_df, customers, params)
    unknown = F.col("data_tier") == "unknown"
    return routed.agg(F.count(F.lit(1)).alias("n_total"),
                      F.count(F.when(~unknown, 1)).alias("n_known"),
                      F.count(F.when(unknown, 1)).alias("n_unknown"))


def tier_profile(segments: DataFrame, features_df: DataFrame) -> DataFrame:
    """Per value tier size, recency, frequency, monthly spend and basket (SL1: spend desc)."""
    j = segments.select("customer_id", "value_tier").join(features_df, "customer_id")
    return (j.groupBy("value_tier")
            .agg(F.count(F.lit(1)).alias("n_customers"),
                 F.avg("recency_days").alias("avg_recency"),
                 F.avg("frequency_per_month").alias("avg_freq"),
                 F.avg("monetary_per_month").alias("avg_monthly_spend"),
                 F.avg("avg_basket_value").alias("avg_basket"))
            .orderBy(F.col("avg_monthly_spend").desc()))


def learning_wave(assignments: DataFrame, outcomes: DataFrame) -> dict[str, DataFrame]:
    """Balance (absent cells as 0), group summary and ATE."""
    return {"balance": experiment.balance_check(assignments, fill_zero=True),
            "summary": experiment.outcome_summary(outcomes, ("group",)),
            "ate": experiment.ate(outcomes, ())}


def uplift_model_page(scores: DataFrame, eval_frame: DataFrame, bins: int = 40) -> dict[str, DataFrame]:
    """Score distribution and Qini/decile checks of a scored evaluation frame."""
    curve = evaluate.qini_curve(eval_frame)
    deciles = evaluate.decile_lift(evaluate.uplift_deciles(eval_frame))
    return {"summary": evaluate.score_summary(scores),
            "histogram": evaluate.score_histogram(scores, bins=bins),
            "curve": evaluate.qini_curve_long(curve),
            "qini": evaluate.qini_coefficient(curve),
            "deciles": evaluate.top_bottom_lift(deciles)}


def optimisation_page(scored: DataFrame, lift_table: DataFrame | None, params: Params, *,
                      budget: float | None = None, margin_rate: float | None = None,
                      coupon_value: float | None = None) -> dict[str, DataFrame]:
    """What-if allocation at the slider values (PF5, E7, PF6, W7, A7) and the newest measured lift."""
    p = params.with_(**{k: v for k, v in (("budget", budget), ("margin_rate", margin_rate),
                                          ("coupon_value", coupon_value)) if v is not None})
    cand = allocate.profitable(allocate.offer_economics(allocate.above_threshold(scored, 0.0), p))
    out = {"allocation": allocate.allocation_summary(allocate.allocate_budget(cand, p))}
    if lift_table is not None:
        out["latest_lift"] = lift.latest_lift(lift_table)
    return out


def display(df: DataFrame, labels: Mapping[str, str], scale: int = 2) -> DataFrame:
    """PF10: a report frame with its averages rounded and the caller's display names."""
    rounded = df.select(*[F.round(c, scale).alias(c) if c.startswith("avg_") else F.col(c) for c in df.columns])
    return rounded.withColumnsRenamed(dict(labels))
