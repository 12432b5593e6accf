"""Report frames and the smaller inventory helpers (J4, PF9, PF10, A11, dashboard pages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftlens.operators import features, runs
from liftlens.plans import reports
from liftlens.plans.catalog import eval_frame
from liftlens.plans.testbed import TestBed

from conftest import SF_SMALL


def test_pages(spark):
    tb = TestBed(spark, SF_SMALL)
    wave = reports.learning_wave(tb.learning_assignments, tb.learning_outcomes)
    assert {r["group"] for r in wave["summary"].collect()} == {"treatment", "holdout"}
    assert wave["ate"].count() == 1 and wave["balance"].count() == 4
    page = reports.uplift_model_page(tb.scored(), eval_frame(tb))
    assert page["histogram"].agg(F.sum("n")).first()[0] == tb.scored().count()
    assert page["curve"].count() == 2 * tb.learning_outcomes.count()
    assert page["qini"].first()["n"] == tb.learning_outcomes.count()
    assert page["summary"].first()["n"] == tb.scored().count()
    labels = {"value_tier": "Value tier", "avg_basket": "Mean basket"}
    prof = reports.display(reports.tier_profile(tb.segments, tb.features), labels)
    assert set(labels.values()) <= set(prof.columns) and "avg_recency" in prof.columns
    assert all(r["Mean basket"] == round(r["Mean basket"], 2) for r in prof.collect())
    over = reports.overview_counts(tb.features, tb.customers, tb.p).first()
    assert over["n_total"] == over["n_known"] + over["n_unknown"] == 150


def test_with_attributes_and_fill(spark):
    tb = TestBed(spark, SF_SMALL)
    extra = spark.createDataFrame([(10**9, 1.0)], "customer_id long, x double")
    got = features.with_attributes(tb.features.select("customer_id").unionByName(extra.select("customer_id")),
                                   tb.customers)
    assert got.count() == tb.features.count() + 1                  # left join keeps the unknown id
    assert got.filter(F.col("customer_id") == 10**9).first()["age_group"] is None
    filled = features.fill_features(spark.createDataFrame([(1, None)], "customer_id long, x double"), ["x"])
    assert filled.first()["x"] == 0.0


def test_next_version(spark):
    assert runs.next_version(None) == 1
    df = spark.createDataFrame([(1,), (3,)], "version int")
    assert runs.next_version(df) == 4


def test_optimisation_page(spark):
    from liftlens.operators import lift as lift_ops

    tb = TestBed(spark, SF_SMALL)
    lift_table = lift_ops.incremental_lift(tb.learning_outcomes, tb.p)
    page = reports.optimisation_page(tb.scored(), lift_table, tb.p, budget=1_000_000.0, margin_rate=0.4)
    a = page["allocation"].first()
    assert 0 < a["customers_offered"] and a["expected_spend"] <= 1_000_000.0
    assert page["latest_lift"].first()["campaign_id"] == "WAVE_01_LEARNING"
