"""IO1-IO6: named tables under one warehouse root, stored as Parquet (or another file-based
format Spark can write with the same options, e.g. ``fmt="delta"`` when its jars are on the classpath).

* ``read_table``       - whole-table scan by name (filters and projections on
                         the returned frame push down to the Parquet scan and,
                         for wave tables, prune ``campaign_id`` partitions).
* ``write_overwrite``  - replace contents and schema.
* ``write_wave``       - partitioned by ``campaign_id`` with *dynamic* partition
                         overwrite: rewriting a wave replaces only that wave,
                         so reruns are idempotent.
* ``append_evolving``  - append; new columns are allowed and read back with
                         ``mergeSchema`` (missing values read as null).
* ``publish_snapshot`` - the (customer_id, feature_ts) keyed feature table,
                         partitioned by snapshot date; key-merge = new rows
                         plus existing rows whose key is absent from the new
                         ones, for the touched partitions only.
* ``ensure_schema``    - create a namespace if absent.

With ``database`` and ``buckets`` set, customer-keyed tables written with
``bucket_by`` become catalog tables bucketed and sorted by that key (files
under the same root). Two tables bucketed alike join without an exchange on
either side, so the stage runner's repeated customer_id joins do not
re-shuffle data that was already written in key order.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftlens.functions.lineage import has_checkpoint_dir

SNAPSHOT_PARTITION = "snapshot_date"


def ensure_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}`")


def conform(df: DataFrame, schema: T.StructType | None) -> DataFrame:
    """Select and cast to a declared schema (extra columns dropped, missing ones null)."""
    if schema is None:
        return df
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


@dataclass(frozen=True)
class TableStore:
    spark: SparkSession
    root: str
    database: str | None = None
    buckets: int = 0
    fmt: str = "parquet"

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def table_name(self, name: str) -> str | None:
        return f"{self.database}.{name}" if self.database else None

    def _catalog_table(self, name: str) -> str | None:
        t = self.table_name(name)
        return t if t and self.spark.catalog.tableExists(t) else None

    def exists(self, name: str) -> bool:
        if self._catalog_table(name):
            return True
        try:
            jvm = self.spark.sparkContext._jvm
            jsc = self.spark.sparkContext._jsc
        except Exception:  # noqa: BLE001  (no JVM handle, e.g. Spark Connect): probe by reading
            try:
                self.spark.read.format(self.fmt).load(self.path(name)).schema
                return True
            except Exception:  # noqa: BLE001
                return False
        p = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(jsc.hadoopConfiguration()).exists(p)

    # IO1
    def read_table(self, name: str, merge_schema: bool = False) -> DataFrame:
        t = self._catalog_table(name)
        if t:
            return self.spark.table(t)
        reader = self.spark.read.format(self.fmt)
        if merge_schema:
            reader = reader.option("mergeSchema", "true")
        return reader.load(self.path(name))

    # IO2
    def write_overwrite(self, df: DataFrame, name: str, schema: T.StructType | None = None,
                        bucket_by: str | None = None) -> None:
        out = conform(df, schema)
        if bucket_by and self.buckets > 0 and self.database:
            ensure_schema(self.spark, self.database)
            (out.write.mode("overwrite").format(self.fmt)
                .bucketBy(self.buckets, bucket_by).sortBy(bucket_by)
                .option("path", self.path(name))
                .saveAsTable(self.table_name(name)))
            return
        out.write.mode("overwrite").format(self.fmt).save(self.path(name))

    # IO3
    def write_wave(self, df: DataFrame, name: str, schema: T.StructType | None = None) -> None:
        out = conform(df, schema)
        (out.write.mode("overwrite").format(self.fmt)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("campaign_id")
            .save(self.path(name)))

    def replace_rows(self, df: DataFrame, name: str, by: tuple[str, ...]) -> None:
        """Put ``df`` in place of the rows with its values of ``by`` (dynamic partition overwrite): reruns add nothing."""
        (df.write.mode("overwrite").format(self.fmt).option("partitionOverwriteMode", "dynamic")
            .partitionBy(*by).save(self.path(name)))

    # IO4
    def append_evolving(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").format(self.fmt).option("mergeSchema", "true").save(self.path(name))

    # IO5
    def publish_snapshot(self, df: DataFrame, name: str = "customer_features_fs",
                         keys: tuple[str, ...] = ("customer_id", "feature_ts")) -> None:
        new = df.withColumn(SNAPSHOT_PARTITION, F.to_date("feature_ts"))
        if self.exists(name):
            existing = self.read_table(name)
            touched = new.select(SNAPSHOT_PARTITION).distinct()
            in_touched = existing.join(F.broadcast(touched), SNAPSHOT_PARTITION, "left_semi")
            # The merged rows are cut from the files they came from before those
            # partitions are replaced.
            new = self.detach(merge_by_key(new, in_touched, keys))
        (new.write.mode("overwrite").format(self.fmt)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(SNAPSHOT_PARTITION)
            .save(self.path(name)))

    def detach(self, df: DataFrame) -> DataFrame:
        """``df`` with no lineage into this store's files, so it may overwrite them.

        A reliable checkpoint in ``spark.checkpoint.dir`` when the cluster names
        one, else a staged copy written under ``<root>/_staging``.
        """
        if has_checkpoint_dir(df):
            return df.checkpoint(eager=True)
        path = self.path(f"_staging/{uuid.uuid4().hex}")
        df.write.mode("overwrite").parquet(path)       # private staging copy, always Parquet
        return self.spark.read.parquet(path)

    def read_snapshots(self, name: str = "customer_features_fs") -> DataFrame:
        return self.read_table(name).drop(SNAPSHOT_PARTITION)


def merge_by_key(new: DataFrame, existing: DataFrame, keys: tuple[str, ...] | list[str]) -> DataFrame:
    """Key-merge: every new row, plus existing rows whose key does not occur in ``new``."""
    keep = existing.join(new.select(*keys), list(keys), "left_anti")
    return new.unionByName(keep.select(*new.columns))
