"""J11 attribution of later sales to a wave, and E5 feedback of outcomes.

A band join in time cells: the calendar is cut into cells as wide as the
window, each window [assigned_ts, +days) stands in the two or three cells that
it reaches, and each sale in one. Sales meet windows in an equi-join on
(customer_id, cell) and are tested against the exact bounds, so a sale sees
only windows that begin at most two cells before it, whatever the number of
assignment times: every customer may have an own time, and several that
overlap. The sums are pre-aggregated per assignment before they are shuffled.
A customer with a large share of all sales is spread over salts
(``operators/skew.py``). The first and last window bound, two values, prune the
scans; no list of times or customers is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlens.functions.time import ts_plus_days
from liftlens.operators import skew
from liftlens.params import OUTCOMES, TREATMENT, Params

ASSIGNMENT = ("campaign_id", "customer_id", "assigned_ts")


def _cell(ts: Column, width: int, margin: int = 0) -> Column:
    """Number of the cell of ``width`` days that the day of ``ts``, moved by ``margin`` days, lies in."""
    return F.floor((F.unix_date(ts.cast("date")) + F.lit(margin)) / F.lit(width))


def _events(txns: DataFrame, redemptions: DataFrame | None, lo: Column, hi: Column) -> DataFrame:
    sales = (txns.filter((F.col("txn_date") >= lo) & (F.col("txn_date") < hi))
             .select("customer_id", F.col("txn_date").alias("event_ts"), "amount",
                     F.lit(1).alias("is_sale"), F.lit(0).alias("is_redemption")))
    if redemptions is None:
        return sales
    red = (redemptions.filter((F.col("redeemed_ts") >= lo) & (F.col("redeemed_ts") < hi))
           .select("customer_id", F.col("redeemed_ts").alias("event_ts"), F.lit(0.0).alias("amount"),
                   F.lit(0).alias("is_sale"), F.lit(1).alias("is_redemption")))
    return sales.unionByName(red)


def attribute_outcomes(assignments: DataFrame, txns: DataFrame, redemptions: DataFrame | None,
                       params: Params, *, days: int | None = None, rows_per_salt: int = skew.ROWS) -> DataFrame:
    """Per assigned customer: purchased (any sale in [assigned_ts, +days)), spend (sum, else 0),
    redeemed (treated, purchased, and a redemption in the window).

    The windows are those of the assignments themselves, whatever ``params.as_of`` is. An
    assignment without a time or a customer has no purchases; assignments that repeat
    (campaign, customer, time) share theirs.
    """
    days = params.outcome_days if days is None else days
    windows = (assignments.select(*ASSIGNMENT).where("assigned_ts IS NOT NULL AND customer_id IS NOT NULL").distinct()
               .withColumn("_end", ts_plus_days(F.col("assigned_ts"), days)))
    # As Spark formats them, cast back with the column's own type: no Python time zones are involved.
    bounds = assignments.agg(F.min("assigned_ts").cast("string"), ts_plus_days(F.max("assigned_ts"), days).cast("string")).first()
    lo, hi = (F.lit(b).cast(assignments.schema["assigned_ts"].dataType) for b in bounds)
    events = _events(txns, redemptions, lo, hi)
    hot = skew.hot_keys(events, "customer_id", rows_per_salt=rows_per_salt)
    # A margin of a day: a zone whose clock steps back over midnight gives a later time an earlier date.
    cells = F.sequence(_cell(F.col("assigned_ts"), days, -1), _cell(F.col("_end"), days, 1))
    spans = skew.repeated(windows.withColumn("_cell", F.explode(cells)), "customer_id", hot)
    sold = skew.salted(events.where("customer_id IS NOT NULL").withColumn("_cell", _cell(F.col("event_ts"), days)), "customer_id", hot)
    per = (sold.join(spans, ["customer_id", "_cell", skew.SALT])
           .where((F.col("event_ts") >= F.col("assigned_ts")) & (F.col("event_ts") < F.col("_end")))
           .groupBy(*ASSIGNMENT)
           .agg(F.sum("is_sale").alias("_n_sales"), F.sum(F.col("amount") * F.col("is_sale")).alias("_spend"),
                F.max("is_redemption").alias("_any_redemption")))
    out = assignments.join(per, list(ASSIGNMENT), "left")
    purchased = F.coalesce(F.col("_n_sales"), F.lit(0)) > 0
    redeemed = ((F.col("group") == TREATMENT) & purchased
                & (F.coalesce(F.col("_any_redemption"), F.lit(0)) == 1))
    return out.select(
        "customer_id", "campaign_id", "group", "value_tier", "coupon_value",
        purchased.cast("int").alias("purchased"),
        redeemed.cast("int").alias("redeemed"),
        F.coalesce(F.col("_spend"), F.lit(0.0)).alias("spend"),
    )


def feed_back(outcomes: DataFrame, store, name: str = "campaign_outcomes") -> None:
    """E5: write a wave's outcomes for retraining; rewriting a wave replaces it (idempotent)."""
    store.write_wave(outcomes, name, OUTCOMES)
