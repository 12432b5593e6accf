"""Offer economics and budget allocation: E7, PF5-PF8, J7, W7, A7, E8.

The greedy allocation is a prefix of the customers in ROI order whose
running expected cost stays within the budget. The running cost is a W0
running sum over ``DECIMAL`` values, so the cut-off does not depend on the
order in which floating-point partial sums are added. The frequency cap is
an anti join against the capped customers (no id list on the driver).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftlens.functions.numeric import clip
from liftlens.functions.time import ts
from liftlens.operators.ordering import prefix_sum
from liftlens.params import REDEEM_BASE, REDEEM_MAX, REDEEM_MIN, ROI_COST_FLOOR, Params


def money(c: Column, params: Params) -> Column:
    return c.cast(f"decimal(20,{params.money_scale})")


def above_threshold(scored: DataFrame, min_uplift: float) -> DataFrame:
    """PF5: strictly positive expected uplift (above the threshold)."""
    return scored.filter(F.col("uplift_score") > F.lit(float(min_uplift)))


def offer_economics(scored: DataFrame, params: Params, *, margin_rate: float | None = None,
                    coupon_value: float | None = None) -> DataFrame:
    """Expected incremental margin, redemption probability, expected cost and margin per dollar."""
    m = float(params.margin_rate if margin_rate is None else margin_rate)
    c = float(params.coupon_value if coupon_value is None else coupon_value)
    p_redeem = clip(F.lit(REDEEM_BASE) + F.col("uplift_score"), REDEEM_MIN, REDEEM_MAX)
    return (scored
            .withColumn("exp_incr_margin", F.col("uplift_score") * F.col("avg_basket_value") * F.lit(m))
            .withColumn("p_redeem", p_redeem)
            .withColumn("exp_cost", F.col("p_redeem") * F.lit(c))
            .withColumn("roi_per_dollar",
                        F.col("exp_incr_margin") / F.greatest(F.col("exp_cost"), F.lit(ROI_COST_FLOOR))))


def profitable(econ: DataFrame) -> DataFrame:
    """PF6: expected incremental margin strictly above expected cost."""
    return econ.filter(F.col("exp_incr_margin") > F.col("exp_cost"))


def recent_offers(ledger: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """PF7: offers decided on or after the calendar day ``days`` before ``as_of``."""
    since = F.date_sub(F.to_date(ts(as_of)), days)
    return ledger.filter(F.col("decision_ts") >= since.cast("timestamp_ntz"))


def at_cap(recent: DataFrame, max_offers: int) -> DataFrame:
    """PF8: customers with at least ``max_offers`` recent offers."""
    return (recent.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_recent_offers"))
            .filter(F.col("n_recent_offers") >= max_offers))


def apply_frequency_cap(offers: DataFrame, ledger: DataFrame | None, params: Params) -> DataFrame:
    """Drop customers at the cap (anti join; the capped set never reaches the driver)."""
    if ledger is None:
        return offers
    capped = at_cap(recent_offers(ledger, params.as_of, params.cap_days), params.max_offers_30d)
    return offers.join(capped.select("customer_id"), "customer_id", "left_anti")


def rank_by_roi(candidates: DataFrame, params: Params) -> DataFrame:
    """W0 over the candidates in ROI order (ties by customer_id): ``roi_rank`` and
    ``cum_cost`` (exact decimal running expected cost), plus ``cum_margin``."""
    return prefix_sum(candidates, [("roi_per_dollar", False), ("customer_id", True)],
                      {"cum_cost": money(F.col("exp_cost"), params),
                       "cum_margin": money(F.col("exp_incr_margin"), params)},
                      rows_per_bucket=params.rows_per_bucket, row_number="roi_rank",
                      count_col=None, totals=False)


def allocate_budget(candidates: DataFrame, params: Params, *, budget: float | None = None) -> DataFrame:
    """The greedy prefix: customers in ROI order while the running cost <= budget."""
    b = float(params.budget if budget is None else budget)
    ranked = rank_by_roi(candidates, params)
    return ranked.filter(F.col("cum_cost") <= money(F.lit(b), params))


def allocation_summary(selected: DataFrame) -> DataFrame:
    """Customers offered, expected spend and margin, ROI = margin / max(spend, 1)."""
    return (selected.agg(F.count(F.lit(1)).alias("customers_offered"),
                         F.coalesce(F.sum("exp_cost"), F.lit(0.0)).alias("expected_spend"),
                         F.coalesce(F.sum("exp_incr_margin"), F.lit(0.0)).alias("expected_margin"))
            .withColumn("expected_roi", F.col("expected_margin") / F.greatest(F.col("expected_spend"), F.lit(1.0))))


def _grid_index(value: Column, grid: list[float], params: Params) -> Column:
    """Index of the smallest grid budget >= value (len(grid) when above all)."""
    points = [money(F.lit(b), params) for b in grid]

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= points[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(grid))


def _accumulate(tagged: DataFrame, cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summary of every budget of a grid: the rows tagged with it (``_g``) and with smaller ones, per ``by``.

    ``cells`` holds one row per ``by`` and budget: the only rows that the window sees."""
    keys = [*by, "_g"]
    per_tag = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("exp_cost").alias("_cost"),
                                        F.sum("exp_incr_margin").alias("_margin"))
    w = Window.partitionBy(*by).orderBy("_g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    acc = cells.join(per_tag, keys, "left").select(
        *[c for c in cells.columns if c != "_g"],
        F.sum(F.coalesce(F.col("_n"), F.lit(0))).over(w).cast("bigint").alias("customers_offered"),
        F.sum(F.coalesce(F.col("_cost"), F.lit(0.0))).over(w).alias("expected_spend"),
        F.sum(F.coalesce(F.col("_margin"), F.lit(0.0))).over(w).alias("expected_margin"))
    return acc.withColumn("expected_roi", F.col("expected_margin") / F.greatest(F.col("expected_spend"), F.lit(1.0)))


def _grid(budgets: Sequence[float]) -> list[float]:
    grid = sorted(float(b) for b in budgets)
    if not grid:
        raise ValueError("a budget grid needs a budget")
    return grid


def budget_sweep(candidates: DataFrame, budgets: Sequence[float], params: Params) -> DataFrame:
    """The allocation summary for every budget of a grid, from ONE ranked pass.

    Each candidate is tagged with the smallest budget that still covers its
    running cost; per-tag totals (at most len(grid)+1 rows) are accumulated
    over the grid. No cross join and no per-budget rescan.
    """
    grid = _grid(budgets)
    ranked = rank_by_roi(candidates, params)
    tagged = ranked.withColumn("_g", _grid_index(F.col("cum_cost"), grid, params)).filter(F.col("_g") < len(grid))
    return _accumulate(tagged, candidates.sparkSession.createDataFrame(list(enumerate(grid)), "_g int, budget double"))


def what_if_grid(eligible: DataFrame, budgets: Sequence[float], margin_rates: Sequence[float],
                 coupon_values: Sequence[float], params: Params) -> DataFrame:
    """E8 over a (margin rate x coupon value x budget) grid, from ONE ranked pass over the eligible customers
    (PF5 output), whatever the size of the grid.

    Margin per dollar is (margin rate / coupon value) * uplift * basket / p_redeem, so the order of the
    customers is the same for every pair, a pair's profitable customers are a prefix of it, and their
    running cost is that of all customers before them. So one W0 pass with a running cost per coupon
    value answers all pairs. It holds where no cost falls below the ROI's cost floor, which is checked.
    """
    grid = _grid(budgets)
    margins, coupons = [float(m) for m in margin_rates], [float(c) for c in coupon_values]
    if min(margins) <= 0 or min(coupons) * REDEEM_MIN <= ROI_COST_FLOOR:
        raise ValueError("margin rates and coupon values must be positive, and every expected cost above the ROI's cost floor")
    unit = offer_economics(eligible, params, margin_rate=1.0, coupon_value=1.0)
    ranked = prefix_sum(unit.select("customer_id", "uplift_score", "avg_basket_value", "p_redeem", "roi_per_dollar"),
                        [("roi_per_dollar", False), ("customer_id", True)],
                        {f"cost_{i}": money(F.col("p_redeem") * F.lit(c), params) for i, c in enumerate(coupons)},
                        rows_per_bucket=params.rows_per_bucket, row_number="roi_rank", count_col=None, totals=False)
    pairs = F.array(*[F.struct(F.lit(m).alias("margin_rate"), F.lit(c).alias("coupon_value"), F.lit(i).alias("i"))
                      for m in margins for i, c in enumerate(coupons)])
    each = (ranked.withColumn("_cums", F.array(*[F.col(f"cost_{i}") for i in range(len(coupons))])).withColumn("_pair", F.explode(pairs))
            .select("_pair.margin_rate", "_pair.coupon_value", F.get("_cums", F.col("_pair.i")).alias("cum_cost"),
                    (F.col("uplift_score") * F.col("avg_basket_value") * F.col("_pair.margin_rate")).alias("exp_incr_margin"),
                    (F.col("p_redeem") * F.col("_pair.coupon_value")).alias("exp_cost")))
    tagged = profitable(each).withColumn("_g", _grid_index(F.col("cum_cost"), grid, params)).filter(F.col("_g") < len(grid))
    cells = eligible.sparkSession.createDataFrame([(m, c, g, b) for m in margins for c in coupons for g, b in enumerate(grid)],
                                                  "margin_rate double, coupon_value double, _g int, budget double")
    return _accumulate(tagged, cells, ("margin_rate", "coupon_value"))


def plan_offers(scored: DataFrame, params: Params, campaign_id: str, *, ledger: DataFrame | None = None,
                decision_ts: str | None = None) -> DataFrame:
    """Stage 3a chain: PF5 -> E7 -> PF6 -> J7 -> W7 (cap before allocation by default;
    ``cap_stage='after'`` reproduces the reference, where freed budget is not re-spent)."""
    cand = profitable(offer_economics(above_threshold(scored, params.min_uplift), params))
    if params.cap_stage == "before":
        selected = allocate_budget(apply_frequency_cap(cand, ledger, params), params)
    else:
        selected = apply_frequency_cap(allocate_budget(cand, params), ledger, params)
    return selected.select(
        "customer_id", "value_tier", "uplift_score", "exp_incr_margin", "exp_cost", "roi_per_dollar",
        F.lit(float(params.coupon_value)).alias("coupon_value"),
        F.lit(campaign_id).alias("campaign_id"),
        ts(decision_ts or params.as_of).alias("decision_ts"),
    )
