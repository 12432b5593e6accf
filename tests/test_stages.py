"""The whole loop over tables on the smallest test tables: stage 1 -> wave -> learn -> allocate -> lift."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from liftlens.params import LEARNING_WAVE, OPTIMIZED_WAVE
from liftlens.plans import stages
from liftlens.sources.tables import TableStore
from liftlens.sources.testdata import TestTables

from conftest import SF_SMALL


@pytest.mark.parametrize("bucketed", [False, True])
def test_full_loop(spark, tmpdir_path, bucketed):
    import uuid

    from liftlens.params import testdata_params

    p = testdata_params(kmeans_restarts=2, final_restarts=2, k_range=(3, 4), gbt_iters=5)
    tt = TestTables(spark, SF_SMALL)
    if bucketed:
        store = TableStore(spark, f"{tmpdir_path}/wh", database="lt_" + uuid.uuid4().hex[:8], buckets=4)
    else:
        store = TableStore(spark, f"{tmpdir_path}/wh")
    txns, cust, red = tt.transactions(), tt.customers(), tt.redemptions()

    routing = {r["data_tier"]: r["n"] for r in stages.stage1(store, txns, cust, p).collect()}
    assert routing == {"known_full": 93, "known_sparse": 53, "unknown": 4}
    seg = store.read_table(stages.T_SEGMENTS)
    assert seg.count() == 146 and seg.filter(F.col("value_tier") == "High Value").count() > 0

    bal = stages.design_wave(store, p, LEARNING_WAVE).collect()
    assert sum(r["treatment"] or 0 for r in bal) + sum(r["holdout"] or 0 for r in bal) == 146
    stages.design_wave(store, p, LEARNING_WAVE)                      # rerun: same wave, no duplicates
    assert store.read_table(stages.T_ASSIGN).count() == 146

    summary = {r["group"]: r for r in stages.measure_wave(store, txns, red, p, LEARNING_WAVE).collect()}
    assert summary["treatment"]["n"] + summary["holdout"]["n"] == 146

    champ = stages.learn(store, p, [LEARNING_WAVE], 1, f"{tmpdir_path}/models").first()
    assert champ["champion_version"] == 1

    p2 = p.with_(as_of="1998-01-01")
    stages.stage1(store, txns, cust, p2, k=4)                        # second snapshot, merged by key
    snaps = store.read_snapshots(stages.T_SNAPSHOTS)
    assert snaps.select("feature_ts").distinct().count() == 2
    alloc = stages.score_and_allocate(store, p2, OPTIMIZED_WAVE, f"{tmpdir_path}/models").first()
    assert alloc["expected_spend"] <= p2.budget + 1e-6

    lift_row = stages.deliver_and_measure(store, txns, red, p2, OPTIMIZED_WAVE).first()
    assert lift_row["campaign_id"] == OPTIMIZED_WAVE
    stages.deliver_and_measure(store, txns, red, p2, OPTIMIZED_WAVE)  # rerun replaces its row
    assert store.read_table(stages.T_LIFT).count() == 1
    waves = {r["campaign_id"] for r in store.read_table(stages.T_OUTCOMES).select("campaign_id").distinct().collect()}
    assert waves == {LEARNING_WAVE, OPTIMIZED_WAVE}

    champ2 = stages.learn(store, p2, [LEARNING_WAVE, OPTIMIZED_WAVE], 2, f"{tmpdir_path}/models").first()
    assert champ2["champion_version"] in (1, 2)
    assert store.read_table(stages.T_RUNS, merge_schema=True).count() == 2
