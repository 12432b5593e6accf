"""materialize: a staged Parquet table in the shared checkpoint folder, checkpoint() for other types."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftlens.functions.lineage import STAGE_FOLDER, materialize


def test_stages_parquet_under_checkpoint_dir(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 7).groupBy("g").agg(F.sum("id").alias("s"))
    m = materialize(df, stage_min_bytes=0)
    files = m.inputFiles()
    assert files and all(f"/{STAGE_FOLDER}/" in f for f in files)
    ckpt_leaf = spark.sparkContext.getCheckpointDir().rstrip("/").rsplit("/", 1)[-1]
    assert f"/{ckpt_leaf}/{STAGE_FOLDER}/" in files[0]
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FileScan parquet" in plan   # lineage cut at the files
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, df.collect()))


def test_small_plans_use_checkpoint(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 7)
    m = materialize(df)
    assert not m.inputFiles()
    assert m.count() == 1000


def test_void_columns_fall_back_to_checkpoint(spark):
    df = spark.range(10).withColumn("nothing", F.lit(None))
    m = materialize(df, stage_min_bytes=0)
    assert not m.inputFiles()
    assert m.count() == 10 and m.schema == df.schema


def test_without_shared_folder_persists(spark, monkeypatch):
    from pyspark import StorageLevel

    from liftlens.functions import lineage

    monkeypatch.setattr(lineage, "_checkpoint_dir", lambda df: None)
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    m = lineage.materialize(df, stage_min_bytes=0)
    try:
        assert m.storageLevel == StorageLevel.MEMORY_AND_DISK
        assert not m.inputFiles() and m.count() == 100
    finally:
        m.unpersist()
