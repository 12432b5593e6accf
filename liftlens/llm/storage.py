"""Tables staged in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "llm-staged"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; an error when the session names none."""
    d = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return d.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{FOLDER}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later passes survive lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no DataFrame reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let the driver notice what no DataFrame holds any more, between the steps of a long job.

    Spark deletes shuffles, broadcasts and checkpoints that nothing reads only
    after the driver has collected their handles, and the driver's heap keeps the
    plans of finished steps until then.
    """
    gc.collect()
    spark._jvm.System.gc()
