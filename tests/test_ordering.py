"""The bucketed running order equals a plain global window."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from liftlens.operators.ordering import exact_quantile, global_rank, prefix_sum


def _data(spark, n=3000, distinct=7, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(distinct) / 2.0, rnd.choice(["a", "b", "c"]), rnd.randrange(100) / 100.0)
            for i in range(n)]
    return spark.createDataFrame(rows, "id long, k double, g string, v double")


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 500, 97, 10])  # 10 -> 300 buckets: range-partitioner path
def test_prefix_sum_equals_plain_window(spark, rows_per_bucket):
    df = _data(spark)
    got = prefix_sum(df, [("k", False), ("id", True)], {"cv": F.col("v").cast("decimal(12,2)"), "cn": F.lit(1)},
                     rows_per_bucket=rows_per_bucket).select("id", "row_idx", "cv", "cn", "n_rows", "cv_total")
    w = Window.orderBy(F.col("k").desc(), F.col("id").asc())
    exp = df.select("id", F.row_number().over(w).alias("row_idx"),
                    F.sum(F.col("v").cast("decimal(12,2)")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cv"))
    g = {r["id"]: r for r in got.collect()}
    e = {r["id"]: r for r in exp.collect()}
    assert len(g) == len(e) == 3000
    total = sum(r["cv"] for r in e.values() if r["row_idx"] == 3000)
    for i, r in e.items():
        assert g[i]["row_idx"] == r["row_idx"]
        assert g[i]["cn"] == r["row_idx"]
        assert g[i]["cv"] == r["cv"]
        assert g[i]["n_rows"] == 3000
        assert g[i]["cv_total"] == total


@pytest.mark.parametrize("rows_per_bucket", [150, 7])
def test_prefix_sum_partitioned(spark, rows_per_bucket):
    df = _data(spark, n=2000)
    got = global_rank(df, [("k", True), ("id", True)], partition_by=["g"], rows_per_bucket=rows_per_bucket)
    w = Window.partitionBy("g").orderBy("k", "id")
    exp = df.select("id", F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("g")).alias("n"))
    g = {r["id"]: (r["row_idx"], r["n_rows"]) for r in got.collect()}
    e = {r["id"]: (r["r"], r["n"]) for r in exp.collect()}
    assert g == e


def test_bucketed_plan_has_no_single_partition_window(spark):
    df = _data(spark, n=2000)
    out = global_rank(df, [("k", True), ("id", True)], rows_per_bucket=200)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the row window is hash-partitioned by range bucket; only the per-bucket totals table
    # (<= k rows) is gathered into one partition, and it is broadcast back
    assert "hashpartitioning(_w0_bucket" in plan
    assert plan.count("SinglePartition") <= 1
    assert "BroadcastExchange" in plan


def test_exact_quantile_matches_pandas(spark):
    df = _data(spark, n=1001, distinct=1000)
    pdf = df.toPandas()
    for p in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = exact_quantile(df, "v", p, "id", rows_per_bucket=100).first()["q"]
        assert got == pytest.approx(float(pdf["v"].quantile(p)))


def test_timestamp_order_key_multi_bucket(spark):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, base + dt.timedelta(minutes=(i * 7919) % 5000)) for i in range(1500)],
                               "id long, t timestamp_ntz")
    got = {r["id"]: r["row_idx"] for r in global_rank(df, [("t", True), ("id", True)], rows_per_bucket=100).collect()}
    exp = {r["id"]: r["r"] for r in df.select("id", F.row_number().over(Window.orderBy("t", "id")).alias("r")).collect()}
    assert got == exp


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("nulls", [1, 400])
@pytest.mark.parametrize("buckets", [1, 10, 500])
def test_null_order_keys_rank_as_in_a_window(spark, ascending, nulls, buckets):
    n = 3000
    df = spark.range(n).select("id", F.when(F.col("id") >= nulls, F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("k"))
    got = global_rank(df, [("k", ascending), ("id", True)], rows_per_bucket=-(-n // buckets))
    key = F.col("k").asc() if ascending else F.col("k").desc()
    exp = df.select("id", F.row_number().over(Window.orderBy(key, "id")).alias("r"))
    assert {r["id"]: r["row_idx"] for r in got.collect()} == {r["id"]: r["r"] for r in exp.collect()}
