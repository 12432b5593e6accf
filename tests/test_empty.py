"""Empty inputs give empty or neutral results, never errors."""

from __future__ import annotations

from liftlens.operators import allocate, evaluate, lift
from liftlens.operators.ordering import global_rank, prefix_sum
from liftlens.params import Params

SCORED = "customer_id long, value_tier string, uplift_score double, avg_basket_value double"
EVAL = "customer_id long, uplift_score double, group string, purchased int"


def test_w0_on_empty(spark):
    df = spark.createDataFrame([], "id long, k double, v long")
    assert prefix_sum(df, [("k", True), ("id", True)], {"cv": "v"}).count() == 0
    assert global_rank(df, [("k", True), ("id", True)], partition_by=["id"]).count() == 0


def test_allocation_on_empty(spark):
    p = Params()
    cand = allocate.profitable(allocate.offer_economics(spark.createDataFrame([], SCORED), p))
    s = allocate.allocation_summary(allocate.allocate_budget(cand, p)).first()
    assert s["customers_offered"] == 0 and s["expected_spend"] == 0.0
    sweep = allocate.budget_sweep(cand, [1.0, 2.0], p).collect()
    assert [r["customers_offered"] for r in sweep] == [0, 0]


def test_evaluation_on_empty(spark):
    df = spark.createDataFrame([], EVAL)
    curve = evaluate.qini_curve(df)
    assert curve.count() == 0
    q = evaluate.qini_coefficient(curve).first()
    assert q["n"] == 0 and q["qini_coef"] is None
    assert evaluate.decile_lift(evaluate.uplift_deciles(df)).count() == 0
    assert evaluate.score_summary(df).first()["n"] == 0
    assert evaluate.score_histogram(df).count() == 0


def test_lift_on_empty(spark):
    out = spark.createDataFrame([], "customer_id long, campaign_id string, group string, purchased int, "
                                    "redeemed int, spend double")
    assert lift.incremental_lift(out, Params()).count() == 0
