"""Every registered query against its DuckDB oracle on the smallest test tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from liftlens.plans.catalog import QUERIES
from liftlens.plans.oracle_sql import ORACLE_SQL as SQL
from tools.oracle_check import duck, rows_of

from conftest import SF_SMALL

SLOW = {"choose_k", "kmeans_segments", "t_learner_scores"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, con, key):
    sdf = QUERIES[key](spark, SF_SMALL)
    cols = sdf.columns
    srows = sorted(rows_of(cols, [tuple(r) for r in sdf.collect()]))
    cur = con.execute(SQL[key])
    dcols = [d[0] for d in cur.description]
    drows = sorted(rows_of(dcols, cur.fetchall()))
    assert sorted(cols) == sorted(dcols)
    assert srows == drows


def test_only_model_fits_lack_an_oracle():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == SLOW


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["n_treated"] > 0


MULTI_BUCKET = sorted(k for k in SQL if k not in {"prefix_sum", "assign_nearest", "event_outcomes", "event_lift",
                                                  "rfm_features", "unknown_customers", "routing_counts",
                                                  "data_tier_by_attribute", "segment_profile", "value_tiers",
                                                  "overview_counts", "customers_enriched"})


@pytest.mark.parametrize("key", MULTI_BUCKET)
def test_query_matches_oracle_with_many_buckets(spark, con, key, monkeypatch):
    """The same queries with ~40 rows per range bucket: W0's multi-bucket path against the oracle."""
    from liftlens import params as params_mod
    from liftlens.plans import testbed

    def small_buckets(**kw):
        return params_mod.testdata_params(rows_per_bucket=40, **kw)

    monkeypatch.setattr(testbed, "testdata_params", small_buckets)
    sdf = QUERIES[key](spark, SF_SMALL)
    cols = sdf.columns
    srows = sorted(rows_of(cols, [tuple(r) for r in sdf.collect()]))
    cur = con.execute(SQL[key])
    drows = sorted(rows_of([d[0] for d in cur.description], cur.fetchall()))
    assert srows == drows


STAGED = ["allocate_budget", "asof_features", "assign_groups_exact", "budget_sweep_grid", "latest_snapshot",
          "publish_snapshot_merge", "qini_curve", "score_summary", "uplift_deciles"]


@pytest.mark.parametrize("key", STAGED)
def test_query_matches_oracle_through_parquet_stage(spark, con, key, monkeypatch):
    """Every materialisation forced through a staged Parquet table (the large-input path)."""
    from liftlens.functions import lineage

    monkeypatch.setattr(lineage, "STAGE_MIN_BYTES", 0)
    sdf = QUERIES[key](spark, SF_SMALL)
    cols = sdf.columns
    srows = sorted(rows_of(cols, [tuple(r) for r in sdf.collect()]))
    cur = con.execute(SQL[key])
    drows = sorted(rows_of([d[0] for d in cur.description], cur.fetchall()))
    assert srows == drows
