"""Hand-worked mini-frames (FIXTURES.md §3)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from liftlens.operators import allocate, evaluate, features, lift, runs, snapshots
from liftlens.params import Params


def test_qini_golden(spark):
    rows = [(1, 0.9, "treatment", 1), (2, 0.8, "holdout", 0), (3, 0.7, "treatment", 1),
            (4, 0.6, "holdout", 1), (5, 0.5, "treatment", 0), (6, 0.4, "holdout", 0)]
    df = spark.createDataFrame(rows, "customer_id long, uplift_score double, group string, purchased int")
    curve = evaluate.qini_curve(df).orderBy("row_idx").collect()
    assert [r["qini"] for r in curve] == pytest.approx([1, 1, 2, 1, 0.5, 1])
    assert [r["random"] for r in curve] == pytest.approx([0, .2, .4, .6, .8, 1])
    coef = evaluate.qini_coefficient(evaluate.qini_curve(df)).first()
    assert coef["qini_coef"] == pytest.approx(0.5)


def test_qini_single_row(spark):
    df = spark.createDataFrame([(1, 0.1, "treatment", 1)], "customer_id long, uplift_score double, group string, purchased int")
    assert evaluate.qini_coefficient(evaluate.qini_curve(df)).first()["qini_coef"] == pytest.approx(0.0)


def test_deciles_golden(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 16)], "customer_id long, uplift_score double")
    got = [r["uplift_decile"] for r in evaluate.uplift_deciles(df).orderBy("score_rank").collect()]
    assert got == [0, 0, 1, 2, 2, 3, 4, 4, 5, 6, 7, 7, 8, 9, 9]


def test_allocation_golden(spark):
    p = Params(coupon_value=5.0, margin_rate=0.30, budget=10.0)
    rows = [("A", 0.5, 60.0), ("D", 0.9, 30.0), ("B", 0.2, 50.0), ("C", 0.1, 40.0), ("E", -0.05, 80.0)]
    df = spark.createDataFrame([(i, k, "T", u, b) for i, (k, u, b) in enumerate(rows)],
                               "customer_id long, name string, value_tier string, uplift_score double, avg_basket_value double")
    econ = allocate.offer_economics(allocate.above_threshold(df, 0.0), p)
    e = {r["name"]: r for r in econ.collect()}
    assert set(e) == {"A", "D", "B", "C"}
    assert e["A"]["exp_incr_margin"] == pytest.approx(9.0) and e["A"]["exp_cost"] == pytest.approx(4.0)
    assert e["D"]["p_redeem"] == pytest.approx(0.9) and e["D"]["roi_per_dollar"] == pytest.approx(1.8)
    cand = allocate.profitable(econ)
    assert {r["name"] for r in cand.collect()} == {"A", "D", "B"}
    sel = allocate.allocate_budget(cand, p)
    assert [r["name"] for r in sel.orderBy("roi_rank").collect()] == ["A", "D"]
    s = allocate.allocation_summary(sel).first()
    assert s["customers_offered"] == 2
    assert s["expected_spend"] == pytest.approx(8.5) and s["expected_margin"] == pytest.approx(17.1)
    assert s["expected_roi"] == pytest.approx(17.1 / 8.5)


def _outcomes(spark, rows):
    return spark.createDataFrame(rows, "customer_id long, campaign_id string, group string, purchased int, redeemed int, spend double")


def test_lift_golden(spark):
    rows = [(1, "W", "treatment", 1, 1, 50.0), (2, "W", "treatment", 0, 0, 0.0), (3, "W", "treatment", 1, 0, 40.0),
            (4, "W", "treatment", 0, 0, 0.0), (5, "W", "holdout", 1, 0, 30.0), (6, "W", "holdout", 0, 0, 0.0)]
    r = lift.incremental_lift(_outcomes(spark, rows), Params(coupon_value=5.0)).first()
    assert r["incr_purchase_rate"] == 0.0 and r["incr_spend_per_head"] == 7.5
    assert r["incr_margin_per_head"] == 2.25 and r["coupon_cost"] == 5.0
    assert r["total_incremental_margin"] == 4.0 and r["roi"] == 0.8
    assert r["n_treated"] == 4 and r["n_holdout"] == 2


def test_lift_without_holdout_is_null(spark):
    r = lift.incremental_lift(_outcomes(spark, [(1, "W", "treatment", 1, 0, 10.0)]), Params()).first()
    assert r["incr_purchase_rate"] is None and r["roi"] is None and r["n_holdout"] == 0


def test_routing_golden(spark):
    t = dt.datetime(2024, 1, 1)
    txns = spark.createDataFrame(
        [(1, t, 10.0, 1, "a")] * 3 + [(2, t, 10.0, 1, "a")] * 2 + [(9, t, 5.0, 1, "a")],
        "customer_id long, txn_date timestamp_ntz, amount double, n_items long, category string")
    cust = spark.createDataFrame([(1, "x", "T1", "app"), (2, "x", "T1", "app"), (3, "x", "T1", "app")],
                                 "customer_id long, age_group string, city_tier string, channel_pref string")
    p = Params(as_of="2024-12-31")
    f = features.customer_features(txns, cust, p)
    routed = {r["customer_id"]: r["data_tier"] for r in features.route_customers(f, cust, p).collect()}
    assert routed == {1: "known_full", 2: "known_sparse", 3: "unknown"}


def test_history_equals_features_as_of_each_date(spark):
    import random

    rnd = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    rows = [(rnd.randrange(30), base + dt.timedelta(hours=rnd.randrange(-100, 3000)), rnd.choice((None, 5.0, 7.5)), rnd.choice((None, 1, 2)),
             rnd.choice(("a", "b", "c", None))) for _ in range(600)] + [(40, None, 1.0, 1, "a")]
    txns = spark.createDataFrame(rows, "customer_id long, txn_date timestamp_ntz, amount double, n_items long, category string")
    dates = [(base + dt.timedelta(days=d)).strftime("%Y-%m-%d") for d in (0, 3, 4, 50, 51, 90, 400)]
    got = features.rfm_history(txns, dates[::-1])
    for d in dates:
        exp = features.rfm_features(txns, Params(as_of=d))
        mine = got.where(F.col("feature_ts") == F.lit(d).cast("timestamp_ntz")).select(*exp.columns)
        assert sorted(mine.collect(), key=str) == sorted(exp.collect(), key=str)
    approx = features.rfm_history(txns, dates, approx_distinct=True)
    assert sorted(approx.select("customer_id", "feature_ts", "category_diversity").collect()) == \
        sorted(got.select("customer_id", "feature_ts", "category_diversity").collect())
    assert features.rfm_history(txns.limit(0), dates).count() == 0


def test_history_scans_the_orders_once(spark):
    from liftlens.plans.testbed import SNAPSHOT_DATES, TestBed

    plan = TestBed(spark, "/root/testdata/sf0.001").history(SNAPSHOT_DATES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_orderdate#") and len([x for x in plan.splitlines() if "Relation" in x and "o_orderkey" in x]) == 1


def test_rates_golden(spark):
    as_of = dt.datetime(2024, 3, 1)
    rows = [(1, as_of - dt.timedelta(days=10), 25.0, 1, "a")] * 4 + [(2, as_of - dt.timedelta(days=60), 25.0, 1, "a")] * 4
    txns = spark.createDataFrame(rows, "customer_id long, txn_date timestamp_ntz, amount double, n_items long, category string")
    f = {r["customer_id"]: r for r in features.rfm_features(txns, Params(as_of="2024-03-01")).collect()}
    assert f[1]["tenure_days"] == 10 and f[1]["frequency_per_month"] == pytest.approx(4.0)
    assert f[1]["monetary_per_month"] == pytest.approx(100.0)
    assert f[2]["frequency_per_month"] == pytest.approx(2.0) and f[2]["monetary_per_month"] == pytest.approx(50.0)


def test_cap_golden(spark):
    d = lambda day: dt.datetime(2024, 1, 1) + dt.timedelta(days=day - 1)
    ledger = spark.createDataFrame([(1, d(1)), (1, d(30)), (2, d(0)), (2, d(30)), (3, d(30))],
                                   "customer_id long, decision_ts timestamp_ntz")
    offers = spark.createDataFrame([(1,), (2,), (3,), (4,)], "customer_id long")
    p = Params(as_of=d(31).strftime("%Y-%m-%d"), max_offers_30d=2, cap_days=30)
    kept = {r["customer_id"] for r in allocate.apply_frequency_cap(offers, ledger, p).collect()}
    assert kept == {2, 3, 4}


def test_asof_golden(spark):
    d = lambda x: dt.datetime(2024, 1, x)
    snaps = spark.createDataFrame([(1, d(5), "a"), (1, d(9), "b"), (1, d(11), "c")],
                                  "customer_id long, feature_ts timestamp_ntz, v string")
    ev = spark.createDataFrame([(10, 1, d(10)), (9, 1, d(9)), (4, 1, d(4))], "eid long, customer_id long, ts timestamp_ntz")
    got = {r["eid"]: r["v"] for r in snapshots.asof_features(ev, snaps, event_ts="ts").collect()}
    assert got == {10: "b", 9: "b", 4: None}


def test_champion_golden(spark):
    def champ(rows):
        df = spark.createDataFrame(rows, "version int, qini_coef double")
        return runs.champion(df).first()["champion_version"]

    assert champ([(1, 0.40)]) == 1
    assert champ([(1, 0.40), (2, 0.40)]) == 1
    assert champ([(1, 0.40), (2, 0.40), (3, 0.41)]) == 3
    assert champ([(1, 0.40), (2, None)]) == 1
    assert champ([(1, None), (2, 0.1)]) == 2


def test_unseen_category_is_zero_vector(spark):
    from liftlens.operators.uplift import feature_pipeline

    p = Params(gbt_iters=2)
    train = spark.createDataFrame([(float(i), "a" if i % 2 else "b", i % 2) for i in range(20)],
                                  "x double, c string, purchased int")
    model = feature_pipeline(p, num=("x",), cat=("c",)).fit(train)
    test = spark.createDataFrame([(1.0, "zzz")], "x double, c string")
    vec = model.transform(test).select("_m_c_ohe").first()[0]
    assert vec.numNonzeros() == 0


def test_asof_customer_missing_from_a_run(spark):
    d = lambda x: dt.datetime(2024, 1, x)
    snaps = spark.createDataFrame([(1, d(5), "a"), (1, d(9), "b"), (1, d(11), "c"), (2, d(5), "x"), (2, d(11), "z")],
                                  "customer_id long, feature_ts timestamp_ntz, v string")
    ev = spark.createDataFrame([(1, 2, d(10)), (2, 2, d(12)), (3, 2, d(4)), (4, 1, d(30)), (5, 3, d(10))],
                               "eid long, customer_id long, ts timestamp_ntz")
    got = {r["eid"]: r["v"] for r in snapshots.asof_features(ev, snaps, event_ts="ts").collect()}
    assert got == {1: "x", 2: "z", 3: None, 4: "c", 5: None}


def test_null_timestamps_match_nothing(spark):
    from liftlens.operators import outcomes

    d = lambda x: dt.datetime(2024, 1, x)
    snaps = spark.createDataFrame([(1, d(5), "a"), (1, None, "n")], "customer_id long, feature_ts timestamp_ntz, v string")
    ev = spark.createDataFrame([(1, 1, d(10)), (2, 1, None)], "eid long, customer_id long, ts timestamp_ntz")
    got = {r["eid"]: r["v"] for r in snapshots.asof_features(ev, snaps, event_ts="ts").collect()}
    assert got == {1: "a", 2: None}
    txns = spark.createDataFrame([(1, d(2), 5.0), (1, d(20), 7.0)], "customer_id long, txn_date timestamp_ntz, amount double")
    asg = spark.createDataFrame([(1, "W", "treatment", "T", 1.0, None), (2, "W", "treatment", "T", 1.0, d(15))],
                                "customer_id long, campaign_id string, group string, value_tier string, "
                                "coupon_value double, assigned_ts timestamp_ntz")
    out = {r["customer_id"]: (r["purchased"], r["spend"]) for r in
           outcomes.attribute_outcomes(asg, txns, None, Params(as_of="2024-01-01", outcome_days=10)).collect()}
    assert out == {1: (0, 0.0), 2: (0, 0.0)}
