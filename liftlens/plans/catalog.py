"""Registered queries: one per operator of the inventory, each over the whole test tables.

Every callable takes (spark, sf_dir) and returns a DataFrame whose column
names match the oracle SQL of the same key (``oracle_sql.ORACLE_SQL``).
Doubles are rounded to 4 places the same way on both sides
(:func:`stable_round`).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftlens.functions.lineage import materialize, shared_folder
from liftlens.functions.time import ts
from liftlens.operators import allocate, evaluate, experiment, lift, outcomes, segments, sketches, snapshots
from liftlens.operators import features as feat_ops
from liftlens.operators import runs as run_ops
from liftlens.operators import uplift as uplift_ops
from liftlens.operators.ordering import prefix_sum
from liftlens.params import (
    ASSIGNMENTS, CLUSTER_FEATURES, LEARNING_WAVE, OPTIMIZED_WAVE, OUTCOMES, RUNS, TIER_LABELS, VALUE_TIERS, Params,
)
from liftlens.plans import reports
from liftlens.plans.testbed import SNAPSHOT_DATES, WAVE2_AS_OF, TestBed, quartile_tiers, stand_in_score
from liftlens.sources.tables import TableStore, merge_by_key
from liftlens.sources.versions import VersionedTables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


ROUND_BIAS = 0.4999877  # just below one half: no exact decimal value sits on the cut


def stable_round(df: DataFrame, scale: int = 4) -> DataFrame:
    """floor(x * 10^s + bias) / 10^s on every double column (same IEEE steps as the oracle SQL)."""
    f = float(10 ** scale)
    return df.select(*[
        (F.floor(F.col(c.name) * F.lit(f) + F.lit(ROUND_BIAS)) / F.lit(f)).alias(c.name)
        if isinstance(c.dataType, T.DoubleType) else F.col(c.name)
        for c in df.schema.fields
    ])


def query(name: str):
    def deco(fn: Callable[[TestBed], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return stable_round(fn(TestBed(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn

    return deco


# --- stage 1: features and routing ------------------------------------------------

@query("rfm_features")
def _rfm(tb: TestBed) -> DataFrame:
    """A1: per-customer RFM features from the orders before the as-of date."""
    return feat_ops.rfm_features(tb.txns, tb.p)


@query("customers_enriched")
def _enriched(tb: TestBed) -> DataFrame:
    """A1 + J1 + E2: features with master attributes and the data tier."""
    return tb.features


@query("unknown_customers")
def _unknown(tb: TestBed) -> DataFrame:
    """Master customers without any order before the as-of date."""
    return feat_ops.unknown_customers(tb.customers, tb.features)


@query("routing_counts")
def _routing(tb: TestBed) -> DataFrame:
    """E2 + A2: customers per lane (known_full / known_sparse / unknown)."""
    return feat_ops.count_by(feat_ops.route_customers(tb.features, tb.customers, tb.p), "data_tier")


@query("data_tier_by_attribute")
def _tier_by_attr(tb: TestBed) -> DataFrame:
    """A2: lanes by market segment (age_group)."""
    return feat_ops.count_by(feat_ops.route_customers(tb.features, tb.customers, tb.p), "age_group", "data_tier")


# --- stage 1: tiers, profiles, lookups ------------------------------------------------


REVENUE_TIERS = ("High Value", "Medium-High Value")
# Budget grid of the dashboard slider (5,000 .. 200,000 step 5,000) at the test tables' money scale (x50).
SWEEP_BUDGETS = tuple(250_000.0 * i for i in range(1, 41))
# Prior offer waves of the frequency-cap ledger: (wave, decision day); 30 days before 1997-01-01 is 1996-12-02.
PRIOR_WAVES = (("PRIOR_A", "1996-11-15"), ("PRIOR_B", "1996-12-02"), ("PRIOR_C", "1996-12-20"))


@query("segment_profile")
def _segment_profile(tb: TestBed) -> DataFrame:
    """A3: profile of fixed segments (market segment) of the known customers."""
    return segments.segment_profile(tb.features, "age_group")


@query("value_tiers")
def _value_tiers(tb: TestBed) -> DataFrame:
    """Segments ranked by mean monthly spend and labelled High ... Low."""
    return segments.value_tiers(segments.segment_profile(tb.features, "age_group"), "age_group")


@query("tier_profile")
def _tier_profile(tb: TestBed) -> DataFrame:
    """Per value tier (J6 segments x features)."""
    return reports.tier_profile(tb.segments, tb.features)


@query("tier_lookup")
def _tier_lookup(tb: TestBed) -> DataFrame:
    """Every master customer's value tier, looked up by its segment among the ranked top segments (else the lowest)."""
    tiers = segments.value_tiers(segments.segment_profile(tb.features, "age_group"), "age_group").where("tier_rank <= 3")
    return segments.tier_lookup(tb.customers.select("customer_id", "age_group"), tiers, "age_group", "value_tier", TIER_LABELS[-1])


@query("overview_counts")
def _overview(tb: TestBed) -> DataFrame:
    """U2 + A2: total, known and unknown customers."""
    return reports.overview_counts(tb.features, tb.customers, tb.p)


@query("assign_nearest")
def _assign_nearest(tb: TestBed) -> DataFrame:
    """M4: nearest of fixed centres (per-label mean embedding) for every embedding."""
    emb = tb.tables.raw("embeddings")
    means = (emb.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
             .groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre")))
    return segments.assign_nearest(emb, "embedding", means).select("vec_id", "label", "centre_id")


# --- stage 2a: experiment design ------------------------------------------------------

@query("eligible_by_tier")
def _eligible(tb: TestBed) -> DataFrame:
    """PF3: customers of a revenue wave (top two tiers)."""
    return experiment.eligible_by_tier(tb.segments, REVENUE_TIERS)


@query("assign_groups_md5")
def _assign_md5(tb: TestBed) -> DataFrame:
    """Learning-wave split (md5 hash, Bernoulli 80/20)."""
    return tb.learning_assignments


@query("assign_groups_exact")
def _assign_exact(tb: TestBed) -> DataFrame:
    """E1 exact mode: per value tier exactly floor(0.8 n + 0.5) treated."""
    eligible = experiment.eligible_by_tier(tb.segments, VALUE_TIERS)
    return experiment.assign_groups(eligible, LEARNING_WAVE, tb.p, mode="exact")


@query("murmur_groups")
def _murmur(tb: TestBed) -> DataFrame:
    """E1 with Spark's Murmur3 hash, as the reference computes it (rows-only check)."""
    eligible = experiment.eligible_by_tier(tb.segments, VALUE_TIERS)
    return experiment.assign_groups(eligible, LEARNING_WAVE, tb.p, hash_kind="murmur3")


@query("balance_check")
def _balance(tb: TestBed) -> DataFrame:
    """A4: treated share per tier."""
    return experiment.balance_check(tb.learning_assignments)


# --- stage 2b: outcomes and lift -------------------------------------------------------

@query("attribute_outcomes")
def _attribute(tb: TestBed) -> DataFrame:
    """Purchases, spend and redemptions in the 90 days after assignment."""
    return tb.learning_outcomes


@query("outcome_summary")
def _outcome_summary(tb: TestBed) -> DataFrame:
    """A5: per group of the learning wave."""
    return experiment.outcome_summary(tb.learning_outcomes)


@query("ate")
def _ate(tb: TestBed) -> DataFrame:
    """Naive average treatment effect on the purchase rate."""
    return experiment.ate(tb.learning_outcomes)


@query("ate_by_tier")
def _ate_by_tier(tb: TestBed) -> DataFrame:
    """A6 per value tier."""
    return experiment.ate(tb.learning_outcomes, ("campaign_id", "value_tier"))


@query("incremental_lift")
def _incremental_lift(tb: TestBed) -> DataFrame:
    """Holdout-measured lift, margin, cost and ROI of the learning wave (flagship)."""
    return lift.incremental_lift(tb.learning_outcomes, tb.p)


def wave2(tb: TestBed) -> tuple[TestBed, DataFrame]:
    """The optimised wave at 1998-01-01: stand-in scores -> offers -> holdout reserve -> outcomes."""
    tb2 = tb.at(WAVE2_AS_OF)
    offers = allocate.plan_offers(tb2.scored(), tb2.p, OPTIMIZED_WAVE)
    delivered = experiment.reserve_holdout(offers, OPTIMIZED_WAVE, tb2.p)
    asg = materialize(experiment.delivered_assignments(delivered, tb2.p))
    out = outcomes.attribute_outcomes(asg, tb.tables.transactions(with_items=False), tb.redemptions, tb2.p)
    return tb2, out


def lift_by_wave(tb: TestBed) -> DataFrame:
    tb2, out2 = wave2(tb)
    return lift.incremental_lift(tb.learning_outcomes, tb.p).unionByName(lift.incremental_lift(out2, tb2.p))


@query("lift_by_wave")
def _lift_by_wave(tb: TestBed) -> DataFrame:
    """E4 for the learning wave and the optimised wave (E3 holdout, J11 outcomes)."""
    return lift_by_wave(tb)


@query("latest_lift")
def _latest_lift(tb: TestBed) -> DataFrame:
    """Newest lift row."""
    return lift.latest_lift(lift_by_wave(tb))


# Customers assigned at their own times: on one of 180 days and 1,440 minutes by their id; a second wave 45 days later.
OWN_TIMES = (("WAVE_OWN_A", 0), ("WAVE_OWN_B", 45))


@query("attribute_own_times")
def _own_times(tb: TestBed) -> DataFrame:
    """J11 where every customer has an own assignment time, in two waves whose windows overlap."""
    out = None
    for wave, later in OWN_TIMES:
        asg = experiment.assign_groups(tb.segments, wave, tb.p)
        own = F.make_dt_interval((F.col("customer_id") % 180 + later).cast("int"), F.lit(0), (F.col("customer_id") * 7919 % 1440).cast("int"))
        asg = asg.withColumn("assigned_ts", ts(tb.p.as_of) + own)
        out = asg if out is None else out.unionByName(asg)
    return outcomes.attribute_outcomes(materialize(out), tb.tables.transactions(with_items=False), tb.redemptions, tb.p)


# Second outcome log: the events table (users active before the wave, purchases in the next day).
EVENT_WAVE = "WAVE_EVENTS"
EVENT_AS_OF = "2024-01-15"
EVENT_DAYS = 1


def event_wave(tb: TestBed) -> tuple[Params, DataFrame]:
    ev = tb.tables.raw("events")
    p = Params(as_of=EVENT_AS_OF, outcome_days=EVENT_DAYS)
    users = (ev.filter((F.col("ts") < F.lit(EVENT_AS_OF).cast("timestamp_ntz"))
                       & F.col("event_type").isin("view", "click"))
             .select(F.col("user_id").alias("customer_id")).distinct()
             .select("customer_id", F.lit(None).cast("int").alias("segment_id"),
                     F.lit(None).cast("string").alias("value_tier")))
    asg = materialize(experiment.assign_groups(users, EVENT_WAVE, p))
    sales = (ev.filter(F.col("event_type") == "purchase")
             .select(F.col("user_id").alias("customer_id"), F.col("ts").alias("txn_date"),
                     F.col("value").alias("amount")))
    return p, outcomes.attribute_outcomes(asg, sales, None, p)


@query("event_outcomes")
def _event_outcomes(tb: TestBed) -> DataFrame:
    """J11 on the events log: purchases in the day after assignment of previously active users."""
    return event_wave(tb)[1]


@query("event_lift")
def _event_lift(tb: TestBed) -> DataFrame:
    """E4 on the events-log wave."""
    p, out = event_wave(tb)
    return lift.incremental_lift(out, p)


@query("stratified_split")
def _split(tb: TestBed) -> DataFrame:
    """80/20 train/eval split per group."""
    return experiment.stratified_split(tb.learning_outcomes.select("customer_id", "group"), tb.p)


# --- model evaluation on the stand-in score --------------------------------------------

def eval_frame(tb: TestBed) -> DataFrame:
    return tb.learning_outcomes.select("customer_id", "group", "purchased", stand_in_score())


@query("qini_data")
def _qini_data(tb: TestBed) -> DataFrame:
    """J6 + PF4: scores joined with the learning wave's outcomes (the dashboard's Qini input)."""
    scores = tb.scored().select("customer_id", "uplift_score")
    out = experiment.wave(tb.learning_outcomes, LEARNING_WAVE).select("customer_id", "group", "purchased")
    return reports.report_join(scores, out)


@query("qini_curve")
def _qini_curve(tb: TestBed) -> DataFrame:
    """W1 + W2: Qini curve and random diagonal."""
    return evaluate.qini_curve(eval_frame(tb), rows_per_bucket=tb.p.rows_per_bucket)


@query("qini_coefficient")
def _qini_coef(tb: TestBed) -> DataFrame:
    """Qini coefficient (closed-form trapezoid)."""
    return evaluate.qini_coefficient(evaluate.qini_curve(eval_frame(tb), rows_per_bucket=tb.p.rows_per_bucket))


@query("qini_curve_long")
def _qini_long(tb: TestBed) -> DataFrame:
    """Model and random series stacked."""
    return evaluate.qini_curve_long(evaluate.qini_curve(eval_frame(tb), rows_per_bucket=tb.p.rows_per_bucket))


@query("uplift_deciles")
def _deciles(tb: TestBed) -> DataFrame:
    """Score deciles (first-rank qcut)."""
    return evaluate.uplift_deciles(eval_frame(tb), rows_per_bucket=tb.p.rows_per_bucket)


@query("decile_lift")
def _decile_lift(tb: TestBed) -> DataFrame:
    """Observed uplift per decile."""
    return evaluate.decile_lift(evaluate.uplift_deciles(eval_frame(tb), rows_per_bucket=tb.p.rows_per_bucket))


@query("score_summary")
def _score_summary(tb: TestBed) -> DataFrame:
    """Mean, std, min, max, share positive and exact 0.9 quantile of the scores."""
    return evaluate.score_summary(tb.scored(), rows_per_bucket=tb.p.rows_per_bucket)


@query("score_histogram")
def _score_hist(tb: TestBed) -> DataFrame:
    """40 equal-width bins of the scores."""
    return evaluate.score_histogram(tb.scored())


# --- stage 3a: economics and allocation ------------------------------------------------

def candidates(tb: TestBed) -> DataFrame:
    return allocate.profitable(allocate.offer_economics(allocate.above_threshold(tb.scored(), tb.p.min_uplift), tb.p))


@query("offer_economics")
def _economics(tb: TestBed) -> DataFrame:
    """PF5 + E7: eligible customers with expected margin, cost and ROI."""
    return allocate.offer_economics(allocate.above_threshold(tb.scored(), tb.p.min_uplift), tb.p)


@query("allocate_budget")
def _allocate(tb: TestBed) -> DataFrame:
    """PF6 + W7: greedy ROI-ordered prefix within the budget."""
    sel = allocate.allocate_budget(candidates(tb), tb.p)
    return sel.select("customer_id", "value_tier", "uplift_score", "exp_incr_margin", "exp_cost",
                      "roi_per_dollar", "roi_rank", F.col("cum_cost").cast("double").alias("cum_cost"))


@query("allocation_summary")
def _alloc_summary(tb: TestBed) -> DataFrame:
    """Customers offered, expected spend, margin and ROI."""
    return allocate.allocation_summary(allocate.allocate_budget(candidates(tb), tb.p))


@query("budget_sweep")
def _sweep(tb: TestBed) -> DataFrame:
    """Allocation summary for 40 budgets from one ranked pass."""
    return allocate.budget_sweep(candidates(tb), SWEEP_BUDGETS, tb.p)


# What-if grid of the dashboard sliders (margin 0.10..0.50, coupon 1..20) at the test money scale:
# margins 0.2/0.3/0.4, coupons 10,000/20,000 (x50 of 200/400 would be off-scale), 8 budgets.
GRID_MARGINS = (0.2, 0.3, 0.4)
GRID_COUPONS = (10_000.0, 20_000.0)
GRID_BUDGETS = tuple(1_250_000.0 * i for i in range(1, 9))


@query("budget_sweep_grid")
def _what_if(tb: TestBed) -> DataFrame:
    """E8 over budget x margin x coupon: the dashboard's what-if sliders as one frame."""
    eligible = allocate.above_threshold(tb.scored(), tb.p.min_uplift)
    return allocate.what_if_grid(eligible, GRID_BUDGETS, GRID_MARGINS, GRID_COUPONS, tb.p)


def prior_ledger(tb: TestBed) -> DataFrame:
    """Offer ledger of three earlier waves: the allocation (PF5-W7) run at each prior decision day
    on the features as of that day (one history of all of them)."""
    days = [day for _, day in PRIOR_WAVES]
    history = materialize(tb.history(days).select("customer_id", "feature_ts", F.lit(None).cast("string").alias("value_tier"),
                                                  "avg_basket_value", stand_in_score()))
    out = None
    for wave, day in PRIOR_WAVES:
        scored = history.where(F.col("feature_ts") == ts(day)).drop("feature_ts")
        part = (allocate.plan_offers(scored, tb.p.with_(as_of=day), wave, decision_ts=day)
                .select("customer_id", "campaign_id", "decision_ts"))
        out = part if out is None else out.unionByName(part)
    return out


@query("recent_offers")
def _recent(tb: TestBed) -> DataFrame:
    """PF7 + PF8: customers with at least 2 offers in the 30 days before the as-of date."""
    return allocate.at_cap(allocate.recent_offers(prior_ledger(tb), tb.p.as_of, tb.p.cap_days),
                           tb.p.max_offers_30d)


@query("frequency_cap")
def _frequency_cap(tb: TestBed) -> DataFrame:
    """J7 + W7: allocation after removing capped customers (cap before allocation)."""
    offers = allocate.plan_offers(tb.scored(), tb.p, OPTIMIZED_WAVE, ledger=prior_ledger(tb))
    return offers


@query("reserve_holdout_channels")
def _reserve(tb: TestBed) -> DataFrame:
    """Wave-2 offers split again (md5, wave salt) with a delivery channel."""
    tb2 = tb.at(WAVE2_AS_OF)
    offers = allocate.plan_offers(tb2.scored(), tb2.p, OPTIMIZED_WAVE)
    return experiment.reserve_holdout(offers, OPTIMIZED_WAVE, tb2.p).select(
        "customer_id", "value_tier", "campaign_id", "group", "channel")


# --- snapshots -------------------------------------------------------------------------

def snapshot_history(tb: TestBed, dates=SNAPSHOT_DATES) -> DataFrame:
    """Snapshot rows of every date: features of one scan, tiers ranked per date."""
    h = materialize(tb.history(dates))
    return snapshots.snapshot_rows(h.join(quartile_tiers(h, tb.p, ("feature_ts",)), ["feature_ts", "customer_id"], "left"))


@query("feature_history")
def _feature_history(tb: TestBed) -> DataFrame:
    """A1 + J1 + E2 as of three dates from one scan of the orders."""
    return tb.history(SNAPSHOT_DATES)


@query("latest_snapshot")
def _latest_snapshot(tb: TestBed) -> DataFrame:
    """PF11: newest snapshot per customer from three snapshot dates."""
    return snapshots.latest_per_customer(snapshot_history(tb))


@query("asof_features")
def _asof(tb: TestBed) -> DataFrame:
    """Every order with the newest feature snapshot taken at or before it."""
    return asof(tb, SNAPSHOT_DATES)


# Mondays of three years.
WEEKS = tuple((dt.date(1996, 1, 1) + dt.timedelta(weeks=i)).isoformat() for i in range(157))


@query("asof_weekly_features")
def _asof_weekly(tb: TestBed) -> DataFrame:
    """J10 over weekly snapshots (157 dates of one scan): every order with its customer's features of that week's Monday."""
    return asof(tb, WEEKS)


def asof(tb: TestBed, dates) -> DataFrame:
    snaps = tb.history(dates).select("customer_id", "feature_ts", "recency_days", "txn_count", "monetary_per_month")
    events = tb.tables.transactions(with_items=False).select(
        F.col("txn_id").alias("o_orderkey"), "customer_id", "txn_date")
    return snapshots.asof_features(events, snaps, event_ts="txn_date")


@query("publish_snapshot_merge")
def _merge(tb: TestBed) -> DataFrame:
    """IO5 key-merge: snapshots (1997, 1998) merged with new ones (1998 known_full only, 1999)."""
    h = materialize(tb.history(SNAPSHOT_DATES).select("customer_id", "feature_ts", "txn_count", "monetary_per_month", "data_tier"))
    middle, newest = (F.col("feature_ts") == ts(d) for d in SNAPSHOT_DATES[1:])
    old = h.where(~newest).drop("data_tier").withColumn("source", F.lit("existing"))
    new = h.where(newest | (middle & (F.col("data_tier") == "known_full"))).drop("data_tier").withColumn("source", F.lit("new"))
    return merge_by_key(new, old, ["customer_id", "feature_ts"])


def _shared(tb: TestBed, name: str) -> str:
    """A new folder in the cluster's shared checkpoint folder."""
    return f"{shared_folder(tb.spark)}/liftlens-tables/{name}-{uuid.uuid4().hex}"


@query("published_snapshots")
def _published(tb: TestBed) -> DataFrame:
    """IO5: two publications (1997 and 1998; then 1998 known_full and 1999) as commits, read back from the newest version."""
    h = materialize(tb.history(SNAPSHOT_DATES).select("customer_id", "feature_ts", "txn_count", "monetary_per_month", "data_tier"))
    newest, full = F.col("feature_ts") == ts(SNAPSHOT_DATES[2]), F.col("data_tier") == "known_full"
    tables = VersionedTables(tb.spark, _shared(tb, "published"))
    tables.publish_snapshot(h.where(~newest).drop("data_tier").withColumn("source", F.lit("existing")), "snapshots")
    middle = F.col("feature_ts") == ts(SNAPSHOT_DATES[1])
    tables.publish_snapshot(h.where(newest | (middle & full)).drop("data_tier").withColumn("source", F.lit("new")), "snapshots")
    return tables.read("snapshots")


@query("rewritten_waves")
def _rewritten(tb: TestBed) -> DataFrame:
    """IO2, IO3, E5: assignments written whole, outcomes of the wave fed back twice, read back (a rerun adds nothing)."""
    store = TableStore(tb.spark, _shared(tb, "waves"))
    store.write_overwrite(tb.learning_assignments, "assignments", ASSIGNMENTS)
    out = outcomes.attribute_outcomes(store.read_table("assignments"), tb.tables.transactions(with_items=False), tb.redemptions, tb.p)
    for _ in range(2):
        outcomes.feed_back(out, store)
    return store.read_table("campaign_outcomes").select(*[f.name for f in OUTCOMES.fields])


@query("logged_runs")
def _logged(tb: TestBed) -> DataFrame:
    """M8 + A11 + IO4: three runs logged under claimed versions, the last one twice, with a column that only later runs have."""
    store, tables = TableStore(tb.spark, _shared(tb, "runs")), VersionedTables(tb.spark, _shared(tb, "claims"))
    sizes = tb.learning_outcomes.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n_train"), F.sum("purchased").alias("n_eval"))
    for again in (1, 1, 2):
        version = tables.claim("runs")
        run = materialize(sizes.select(F.lit(version).alias("version"), "campaign_id", "n_train", "n_eval",
                                       *[F.lit(None).cast("double").alias(f.name) for f in RUNS.fields[4:]]))
        for _ in range(again):
            run_ops.log_run(store, run)
    store.append_evolving(store.read_table("runs").where("version = 3").select("version", "n_train", F.lit("later").alias("note")), "notes")
    store.append_evolving(store.read_table("runs").where("version < 3").select("version", "n_train"), "notes")
    return store.read_table("notes", merge_schema=True).join(store.read_table("runs").select("version", "campaign_id", "n_eval"), "version")


@query("customers_sketch")
def _customers_sketch(tb: TestBed) -> DataFrame:
    """A10: distinct buyers before each date, exact and by sketches united over the dates, within three standard errors."""
    d = sketches.distinct_history(tb.tables.transactions(with_items=False), "customer_id", "txn_date", SNAPSHOT_DATES)
    error = sketches.distinct_error()
    return d.select("feature_ts", "n_exact", F.lit(error).alias("stated_error"),
                    (F.abs(F.col("n_estimate") - F.col("n_exact")) <= 3 * error * F.col("n_exact") + 1).alias("within"))


SKETCH_QUANTILES = (0.25, 0.5, 0.75, 0.9)


@query("score_quantile_sketch")
def _quantile_sketch(tb: TestBed) -> DataFrame:
    """Quantiles of the scores from one sketch per value tier, merged; their exact ranks are within the stated error."""
    scored = materialize(tb.scored())
    row = sketches.merged_quantiles(sketches.quantile_sketches(scored, "uplift_score", ["value_tier"]), SKETCH_QUANTILES).first()
    found = row["quantiles"] if row else [None] * len(SKETCH_QUANTILES)
    ranks = scored.agg(F.count("uplift_score").alias("n"), F.array(*[F.struct(
        F.lit(p).alias("p"), F.count_if(F.col("uplift_score") < F.lit(v)).alias("below"),
        F.count_if(F.col("uplift_score") <= F.lit(v)).alias("upto")) for p, v in zip(SKETCH_QUANTILES, found)]).alias("r"))
    each = ranks.select("n", F.inline("r"))
    slack = F.col("n") * F.lit(sketches.RANK_ERROR)
    return each.select("p", "n", F.lit(sketches.RANK_ERROR).alias("stated_error"),
                       ((F.col("below") <= F.col("p") * F.col("n") + slack) & (F.col("upto") >= F.col("p") * F.col("n") - slack)).alias("within"))


# --- W0 directly -----------------------------------------------------------------------

@query("prefix_sum")
def _prefix_sum(tb: TestBed) -> DataFrame:
    """Running order count and exact running total of all orders by price (bucketed, 4096 rows per bucket)."""
    o = tb.tables.raw("orders").select("o_orderkey", "o_totalprice")
    ps = prefix_sum(o, [("o_totalprice", False), ("o_orderkey", True)],
                    {"running_total": F.col("o_totalprice").cast("decimal(18,2)")},
                    rows_per_bucket=4096, row_number="row_idx", count_col="n_rows")
    return ps.select("o_orderkey", "row_idx", F.col("running_total").cast("double").alias("running_total"),
                     "n_rows")


# --- models (Spark ML) -----------------------------------------------------------------


CHAMPION_SCORERS = ((1, "SCORE"), (2, "SCORE_B"), (3, "SCORE_C"))


@query("cluster_vectors")
def _cluster_vectors(tb: TestBed) -> DataFrame:
    """M1: the six clustering features of every known customer, nulls to 0, log1p on money,
    standardised by the population std (one column per vector element)."""
    v = segments.cluster_vectors(tb.features)
    return v.select("customer_id", *[F.col(segments.VECTOR)[i].alias(f"z_{c}") for i, c in enumerate(CLUSTER_FEATURES)])


@query("kmeans_segments")
def _kmeans(tb: TestBed) -> DataFrame:
    """M1 + M3 + A3 + W6: k-means segments (k = n_segments) with value tiers (rows-only check)."""
    seg, _ = segments.segment_customers(tb.features, tb.p, k=tb.p.n_segments)
    return seg


@query("choose_k")
def _choose_k(tb: TestBed) -> DataFrame:
    """M2: silhouette for k = 3..6 over all known customers (rows-only check)."""
    return segments.choose_k(materialize(segments.cluster_vectors(tb.features)), tb.p)[1]


@query("kmeans_facts")
def _kmeans_facts(tb: TestBed) -> DataFrame:
    """M1 + M3 facts that hold for any converged fit: every known customer in one of k segments, whose own mean is the nearest."""
    vectors = materialize(segments.cluster_vectors(tb.features)).persist()
    try:
        seg = materialize(segments.fit_segments(vectors, tb.p.n_segments, tb.p).join(vectors, "customer_id"))
    finally:
        vectors.unpersist()
    means = (seg.select("segment_id", F.posexplode(segments.VECTOR).alias("i", "x")).groupBy("segment_id", "i").agg(F.avg("x").alias("m"))
             .groupBy("segment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean")))
    near = segments.assign_nearest(seg, segments.VECTOR, means, "nearest")
    return near.agg(F.count(F.lit(1)).alias("n_customers"), F.count_distinct("segment_id").alias("n_segments"),
                    (F.count_if(F.col("segment_id") != F.col("nearest")) * 1000 < F.count(F.lit(1))).alias("nearest_mean"))


def training_frame(tb: TestBed) -> DataFrame:
    """Learning-wave outcomes with the as-of features, and the train/eval split."""
    split = experiment.stratified_split(tb.learning_outcomes.select("customer_id", "group", "purchased"), tb.p)
    feats = tb.features.join(tb.segments, "customer_id", "left")
    return split.join(feats, "customer_id", "inner")


@query("t_learner_scores")
def _t_learner(tb: TestBed) -> DataFrame:
    """M5-M7: two GBT models (treated / holdout) fitted on the train split; uplift on the eval split."""
    frame = materialize(training_frame(tb))
    model = uplift_ops.fit_t_learner(frame.filter(F.col("split") == "train"), tb.p)
    ev = frame.filter(F.col("split") == "eval")
    return model.score(ev).select("customer_id", "group", "purchased", "p_treated", "p_control", "uplift_score")


@query("champion")
def _champion(tb: TestBed) -> DataFrame:
    """M8 + M9: Qini of three scorers on the eval split as runs; champion = best Qini, earliest version."""
    ev = (experiment.stratified_split(tb.learning_outcomes.select("customer_id", "group", "purchased"), tb.p)
          .filter(F.col("split") == "eval"))
    scored = None
    for version, salt in CHAMPION_SCORERS:
        part = ev.select(F.lit(version).alias("version"), "customer_id", "group", "purchased", stand_in_score(salt))
        scored = part if scored is None else scored.unionByName(part)
    curve = evaluate.qini_curve(scored, by=["version"], rows_per_bucket=tb.p.rows_per_bucket)
    qini = evaluate.qini_coefficient(curve, by=["version"])
    return run_ops.champion(qini)
