"""Properties of the experiment, allocation and table operators on the test tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from liftlens.operators import allocate, evaluate, experiment
from liftlens.params import LEARNING_WAVE, VALUE_TIERS
from liftlens.plans.testbed import TestBed
from liftlens.sources.tables import TableStore, merge_by_key

from conftest import SF_SMALL


def test_assignment_stable_under_repartition(spark):
    tb = TestBed(spark, SF_SMALL)
    a = {r["customer_id"]: r["group"] for r in tb.learning_assignments.collect()}
    elig = experiment.eligible_by_tier(tb.segments, VALUE_TIERS).repartition(7, "value_tier")
    b = {r["customer_id"]: r["group"] for r in experiment.assign_groups(elig, LEARNING_WAVE, tb.p).collect()}
    assert a == b and len(a) > 100


def test_exact_mode_balanced(spark):
    tb = TestBed(spark, SF_SMALL)
    elig = experiment.eligible_by_tier(tb.segments, VALUE_TIERS)
    asg = experiment.assign_groups(elig, LEARNING_WAVE, tb.p.with_(rows_per_bucket=20), mode="exact")
    for r in asg.groupBy("value_tier").agg(F.count("*").alias("n"),
                                            F.sum((F.col("group") == "treatment").cast("int")).alias("t")).collect():
        assert abs(r["t"] - 0.8 * r["n"]) <= 0.5 + 1e-9


def test_allocation_within_budget_and_monotone(spark):
    tb = TestBed(spark, SF_SMALL)
    cand = allocate.profitable(allocate.offer_economics(allocate.above_threshold(tb.scored(), 0.0), tb.p))
    prev = -1
    for budget in (100_000.0, 500_000.0, 2_000_000.0):
        s = allocate.allocation_summary(allocate.allocate_budget(cand, tb.p, budget=budget)).first()
        assert s["expected_spend"] <= budget + 1e-6
        assert s["customers_offered"] >= prev
        prev = s["customers_offered"]
    sweep = {r["budget"]: r["customers_offered"]
             for r in allocate.budget_sweep(cand, [100_000.0, 500_000.0, 2_000_000.0], tb.p).collect()}
    for budget in (100_000.0, 500_000.0, 2_000_000.0):
        n = allocate.allocate_budget(cand, tb.p, budget=budget).count()
        assert sweep[budget] == n


def test_deciles_cover_everyone(spark):
    tb = TestBed(spark, SF_SMALL)
    ev = tb.learning_outcomes.withColumn("uplift_score", F.rand(3))
    dec = evaluate.decile_lift(evaluate.uplift_deciles(ev))
    assert dec.agg(F.sum("n")).first()[0] == tb.learning_outcomes.count()


def test_wave_write_is_idempotent(spark, tmpdir_path):
    tb = TestBed(spark, SF_SMALL)
    store = TableStore(spark, tmpdir_path)
    a1 = tb.learning_assignments
    a2 = experiment.assign_groups(experiment.eligible_by_tier(tb.segments, VALUE_TIERS), "W2", tb.p)
    store.write_wave(a1, "asg")
    store.write_wave(a2, "asg")
    store.write_wave(a1, "asg")        # rerun of wave 1 replaces only wave 1
    counts = {r["campaign_id"]: r["count"] for r in store.read_table("asg").groupBy("campaign_id").count().collect()}
    n = a1.count()
    assert counts == {LEARNING_WAVE: n, "W2": n}


def test_merge_by_key(spark):
    old = spark.createDataFrame([(1, 1, "old"), (2, 1, "old"), (1, 2, "old")], "customer_id long, feature_ts long, v string")
    new = spark.createDataFrame([(1, 2, "new"), (3, 2, "new")], "customer_id long, feature_ts long, v string")
    got = sorted(tuple(r) for r in merge_by_key(new, old, ["customer_id", "feature_ts"]).collect())
    assert got == [(1, 1, "old"), (1, 2, "new"), (2, 1, "old"), (3, 2, "new")]


def test_bucketed_tables_join_without_exchange(spark, tmpdir_path):
    import uuid

    tb = TestBed(spark, SF_SMALL)
    db = "lt_" + uuid.uuid4().hex[:8]
    store = TableStore(spark, tmpdir_path, database=db, buckets=4)
    store.write_overwrite(tb.features, "customer_features", bucket_by="customer_id")
    store.write_overwrite(tb.segments, "customer_segments", bucket_by="customer_id")
    j = store.read_table("customer_features").join(store.read_table("customer_segments"), "customer_id")
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan
    assert j.count() == tb.features.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j2 = store.read_table("customer_features").join(store.read_table("customer_segments"), "customer_id")
        plan2 = j2._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan2 and "Exchange" not in plan2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_asof_never_reads_a_later_snapshot(spark):
    from liftlens.plans.catalog import QUERIES

    df = QUERIES["asof_features"](spark, SF_SMALL)
    assert df.filter(F.col("feature_ts") > F.col("txn_date")).count() == 0
    before_first = df.filter(F.col("txn_date") < F.lit("1997-01-01").cast("timestamp_ntz"))
    assert before_first.filter(F.col("feature_ts").isNotNull()).count() == 0


def test_qini_end_value(spark):
    tb = TestBed(spark, SF_SMALL)
    from liftlens.plans.catalog import eval_frame

    ev = eval_frame(tb)
    curve = evaluate.qini_curve(ev)
    last = curve.orderBy(F.col("row_idx").desc()).first()
    g = {r["group"]: (r["n"], r["buyers"]) for r in
         ev.groupBy("group").agg(F.count("*").alias("n"), F.sum("purchased").alias("buyers")).collect()}
    (nt, t), (nc, c) = g["treatment"], g["holdout"]
    assert last["qini"] == t - c * (nt / nc)
    assert last["row_idx"] == nt + nc


def test_what_if_grid_equals_a_sweep_per_pair(spark):
    from liftlens.operators import allocate

    tb = TestBed(spark, SF_SMALL)
    p = tb.p.with_(rows_per_bucket=80)
    eligible = allocate.above_threshold(tb.scored(), 0.0)
    budgets, margins, coupons = [50_000.0 * i for i in range(1, 141)], (0.1, 0.6), (2_000.0, 30_000.0)
    got = {(r["margin_rate"], r["coupon_value"], r["budget"]): tuple(r)[3:]
           for r in allocate.what_if_grid(eligible, budgets, margins, coupons, p).collect()}
    assert len(got) == 140 * 4
    for m in margins:
        for c in coupons:
            q = p.with_(margin_rate=m, coupon_value=c)
            for r in allocate.budget_sweep(allocate.profitable(allocate.offer_economics(eligible, q)), budgets, q).collect():
                assert got[m, c, r["budget"]] == pytest.approx(tuple(r)[1:], abs=1e-6)
