"""Planted-effect check: the T-learner ranks responders above a random score."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftlens.functions.hashing import md5_bucket
from liftlens.operators import evaluate, experiment, uplift
from liftlens.params import LEARNING_WAVE, VALUE_TIERS
from liftlens.plans.testbed import TestBed, stand_in_score

from conftest import SF_CHECK


def test_t_learner_beats_random_on_planted_effect(spark):
    tb = TestBed(spark, SF_CHECK)
    p = tb.p.with_(gbt_iters=20)
    asg = experiment.assign_groups(experiment.eligible_by_tier(tb.segments, VALUE_TIERS), LEARNING_WAVE, p)
    feats = tb.features.join(tb.segments, "customer_id", "left")
    # Treatment lifts the purchase probability only for frequent buyers (planted, deterministic).
    median = feats.approxQuantile("frequency_per_month", [0.5], 0.0)[0]
    u = md5_bucket("customer_id", "LABEL") / F.lit(100000.0)
    effect = F.when((F.col("group") == "treatment") & (F.col("frequency_per_month") > median), 0.5).otherwise(0.0)
    frame = (asg.select("customer_id", "group").join(feats, "customer_id")
             .withColumn("purchased", (u < F.lit(0.2) + effect).cast("int")))
    split = experiment.stratified_split(frame, p).persist()
    model = uplift.fit_t_learner(split.filter(F.col("split") == "train"), p)
    ev = model.score(split.filter(F.col("split") == "eval"))
    q_model = evaluate.qini_coefficient(evaluate.qini_curve(ev)).first()["qini_coef"]
    rand = ev.drop("uplift_score").withColumn("uplift_score", stand_in_score("RANDOM"))
    q_rand = evaluate.qini_coefficient(evaluate.qini_curve(rand)).first()["qini_coef"]
    top_bottom = evaluate.top_bottom_lift(evaluate.decile_lift(evaluate.uplift_deciles(ev))).first()
    split.unpersist()
    assert q_model > q_rand
    assert top_bottom["top_decile_uplift"] > top_bottom["bottom_decile_uplift"]
