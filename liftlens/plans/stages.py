"""The three stages as jobs over named tables (what the notebooks do, kept on Spark).

Each function reads its inputs from a :class:`TableStore`, chains lazy
DataFrame operators and writes only at table boundaries. Wave tables are
partitioned by ``campaign_id`` and rewritten with dynamic partition
overwrite, so rerunning a step replaces its wave instead of duplicating or
erasing others. Only one-row metric frames ever reach the driver.

Order: ``stage1`` -> ``design_wave`` -> ``measure_wave`` -> ``learn`` ->
``score_and_allocate`` -> ``deliver_and_measure`` (-> ``learn`` again with
more waves).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlens.functions.lineage import materialize
from liftlens.functions.time import ts
from liftlens.operators import (
    allocate, evaluate, experiment, features, lift, outcomes, runs, segments, snapshots, uplift,
)
from liftlens.params import (
    ASSIGNMENTS, LIFT, OFFERS, SCORES, SEGMENTS, VALUE_TIERS, Params,
)
from liftlens.sources.tables import TableStore

T_FEATURES = "customer_features"
T_SEGMENTS = "customer_segments"
T_SNAPSHOTS = "customer_features_fs"
T_ASSIGN = "campaign_assignments"
T_OUTCOMES = "campaign_outcomes"
T_SCORES = "uplift_scores"
T_OFFERS = "offer_assignments"
T_LIFT = "incremental_lift"
T_RUNS = "runs"
T_SELECTION = "k_selection"


def stage1(store: TableStore, txns: DataFrame, customers: DataFrame, params: Params,
           k: int | None = None) -> DataFrame:
    """Features + routing (A1, J1, E2), segmentation (M1-M3, A3, W6), snapshot publish (IO5).

    Returns the routing counts (a tiny frame) for display.
    """
    feats = features.customer_features(txns, customers, params).withColumn("feature_ts", ts(params.as_of))
    store.write_overwrite(feats, T_FEATURES, bucket_by="customer_id")
    feats = store.read_table(T_FEATURES)                     # read back: the plan runs once
    seg, selection = segments.segment_customers(feats, params, k)
    store.write_overwrite(seg, T_SEGMENTS, SEGMENTS, bucket_by="customer_id")
    store.write_overwrite(selection, T_SELECTION)
    snap = snapshots.snapshot_frame(feats.drop("feature_ts"), store.read_table(T_SEGMENTS), params.as_of)
    store.publish_snapshot(snap, T_SNAPSHOTS)
    return features.count_by(features.route_customers(feats, customers, params), "data_tier")


def design_wave(store: TableStore, params: Params, campaign_id: str,
                tiers: Sequence[str] = VALUE_TIERS, mode: str = "bernoulli") -> DataFrame:
    """E1 over the eligible tiers (PF3); writes the wave (IO3). Returns the balance check (A4)."""
    eligible = experiment.eligible_by_tier(store.read_table(T_SEGMENTS), tiers)
    asg = experiment.assign_groups(eligible, campaign_id, params, mode=mode)
    store.write_wave(asg, T_ASSIGN, ASSIGNMENTS)
    return experiment.balance_check(store.read_table(T_ASSIGN).filter(F.col("campaign_id") == campaign_id))


def measure_wave(store: TableStore, txns: DataFrame, redemptions: DataFrame | None, params: Params,
                 campaign_id: str) -> DataFrame:
    """J11 on the wave's assignments (PF4 prunes to its partition); writes outcomes (E5). Returns A5."""
    asg = store.read_table(T_ASSIGN).filter(F.col("campaign_id") == campaign_id)
    out = outcomes.attribute_outcomes(asg, txns, redemptions, params)
    outcomes.feed_back(out, store, T_OUTCOMES)
    return experiment.outcome_summary(store.read_table(T_OUTCOMES).filter(F.col("campaign_id") == campaign_id))


def _assignment_times(store: TableStore, campaign_ids: Sequence[str]) -> DataFrame:
    frames = [store.read_table(T_ASSIGN).filter(F.col("campaign_id").isin(list(campaign_ids)))
              .select("campaign_id", "customer_id", "assigned_ts")]
    if store.exists(T_OFFERS):
        frames.append(store.read_table(T_OFFERS).filter(F.col("campaign_id").isin(list(campaign_ids)))
                      .select("campaign_id", "customer_id", F.col("decision_ts").alias("assigned_ts")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def training_frame(store: TableStore, campaign_ids: Sequence[str], params: Params) -> DataFrame:
    """J5 via J10: each outcome with the features of the newest snapshot at or before its assignment."""
    out = (store.read_table(T_OUTCOMES).filter(F.col("campaign_id").isin(list(campaign_ids)))
           .select("campaign_id", "customer_id", "group", "purchased"))
    when = _assignment_times(store, campaign_ids)
    events = out.join(when, ["campaign_id", "customer_id"], "inner")
    snaps = store.read_snapshots(T_SNAPSHOTS)
    cols = [c for c in snaps.columns if c not in ("customer_id", "feature_ts")]
    j = snapshots.asof_features(events, snaps, event_ts="assigned_ts", columns=cols)
    return j.filter(F.col("feature_ts").isNotNull())


def learn(store: TableStore, params: Params, campaign_ids: Sequence[str], version: int | None,
          model_path: str) -> DataFrame:
    """E6 split, M6 fit, M7 eval scores, W1-W5 metrics, M8 log, M9 champion. Returns the champion row.

    ``version=None`` takes the next free version number (A11).
    """
    if version is None:
        version = runs.next_version(store.read_table(T_RUNS, merge_schema=True) if store.exists(T_RUNS) else None)
    frame = experiment.stratified_split(training_frame(store, campaign_ids, params), params)
    frame = materialize(frame)                                # computed once before the fits
    model = uplift.fit_t_learner(frame.filter(F.col("split") == "train"), params)
    model.save(f"{model_path}/v{version}")
    ev = model.score(frame.filter(F.col("split") == "eval")).withColumn("wave", F.lit(",".join(campaign_ids)))
    curve = evaluate.qini_curve(ev, by=["wave"], rows_per_bucket=params.rows_per_bucket)
    qini = evaluate.qini_coefficient(curve, by=["wave"])
    deciles = evaluate.top_bottom_lift(
        evaluate.decile_lift(evaluate.uplift_deciles(ev, by=["wave"], rows_per_bucket=params.rows_per_bucket),
                             by=["wave"]), by=["wave"])
    sizes = (frame.withColumn("wave", F.lit(",".join(campaign_ids))).groupBy("wave")
             .agg(F.count(F.when(F.col("split") == "train", 1)).alias("n_train"),
                  F.count(F.when(F.col("split") == "eval", 1)).alias("n_eval")))
    runs.log_run(store, runs.run_rows(version, qini, deciles, sizes, by="wave"), T_RUNS)
    return runs.champion(store.read_table(T_RUNS, merge_schema=True))


def champion_model(store: TableStore, model_path: str) -> uplift.TLearner:
    row = runs.champion(store.read_table(T_RUNS, merge_schema=True)).first()  # one row
    return uplift.TLearner.load(f"{model_path}/v{row['champion_version']}")


def score_and_allocate(store: TableStore, params: Params, campaign_id: str, model_path: str) -> DataFrame:
    """PF11 latest snapshot, M7 scores (IO2), then PF5-E7-PF6-J7-W7 against the offer ledger (IO3)."""
    latest = snapshots.latest_per_customer(store.read_snapshots(T_SNAPSHOTS))
    scored = champion_model(store, model_path).score(latest)
    store.write_overwrite(scored.withColumn("scored_ts", ts(params.as_of)), T_SCORES, SCORES,
                          bucket_by="customer_id")
    scored = store.read_table(T_SCORES).join(latest.select("customer_id", "avg_basket_value"), "customer_id")
    ledger = store.read_table(T_OFFERS) if store.exists(T_OFFERS) else None
    if ledger is not None:
        ledger = ledger.filter(F.col("campaign_id") != campaign_id)     # a rerun does not cap itself
    offers = allocate.plan_offers(scored, params, campaign_id, ledger=ledger)
    store.write_wave(offers, T_OFFERS, OFFERS)
    return allocate.allocation_summary(store.read_table(T_OFFERS).filter(F.col("campaign_id") == campaign_id))


def deliver_and_measure(store: TableStore, txns: DataFrame, redemptions: DataFrame | None, params: Params,
                        wave: str) -> DataFrame:
    """E3 holdout reserve + channel, J11 outcomes, E5 feedback, E4 lift. Returns the newest lift row.

    Outcomes and lift rows are wave-partitioned tables: a rerun replaces its wave.
    """
    offers = store.read_table(T_OFFERS).filter(F.col("campaign_id") == wave)
    delivered = experiment.reserve_holdout(offers, wave, params)
    asg = experiment.delivered_assignments(delivered, params)
    out = outcomes.attribute_outcomes(asg, txns, redemptions, params)
    outcomes.feed_back(out, store, T_OUTCOMES)
    measured = store.read_table(T_OUTCOMES).filter(F.col("campaign_id") == wave)
    store.write_wave(lift.incremental_lift(measured, params), T_LIFT, LIFT)
    return lift.latest_lift(store.read_table(T_LIFT))
