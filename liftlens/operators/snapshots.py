"""Feature snapshots: IO5 input frames, PF11 latest snapshot, J10 point-in-time (as-of) join.

``latest_per_customer`` is a ``max_by`` aggregation (partial before the
shuffle), not a per-customer window, so a customer with many snapshots does
not make a hot task.

``asof_features`` carries snapshots forward: events and snapshots are stacked,
shuffled once by customer, sorted by time, and each event takes the last
snapshot before it. One exchange and one sort, whatever the number of snapshot
times: there is no list of them, no range condition and no fan-out. A customer
with a large share of all events is spread over salts and only that customer's
snapshots are repeated for each (``operators/skew.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftlens.functions.time import ts
from liftlens.operators import skew
from liftlens.params import SNAPSHOT_COLUMNS


def snapshot_rows(df: DataFrame) -> DataFrame:
    """PF1: the snapshot columns in their order; those that are missing are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in SNAPSHOT_COLUMNS])


def snapshot_frame(features: DataFrame, segments: DataFrame | None, feature_ts: str) -> DataFrame:
    """J3 features left-joined with segments, stamped with ``feature_ts`` and projected to the snapshot columns."""
    f = features.join(segments, "customer_id", "left") if segments is not None else features
    return snapshot_rows(f.withColumn("feature_ts", ts(feature_ts)))


def latest_per_customer(snapshots: DataFrame, key: str = "customer_id", ts_col: str = "feature_ts") -> DataFrame:
    """PF11: the newest snapshot row of each customer (deterministic; keys are unique per ts)."""
    others = [c for c in snapshots.columns if c != key]
    picked = (snapshots.groupBy(key)
              .agg(F.max_by(F.struct(*others), F.col(ts_col)).alias("_row")))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def asof_features(events: DataFrame, snapshots: DataFrame, *, event_ts: str, key: str = "customer_id",
                  columns: Sequence[str] | None = None, ts_col: str = "feature_ts",
                  rows_per_salt: int = skew.ROWS) -> DataFrame:
    """Each event with the newest snapshot of its customer taken at or before the event.

    Events without an earlier snapshot, a time or a key keep null features; snapshots without a
    time or a key are never the newest.
    """
    cols = list(columns) if columns is not None else [c for c in snapshots.columns if c not in (key, ts_col)]
    snaps = (snapshots.where(F.col(key).isNotNull() & F.col(ts_col).isNotNull())
             .select(F.col(key).alias("_key"), F.col(ts_col).alias("_ts"), F.struct(ts_col, *cols).alias("_snap")))
    rows = events.select(F.col(key).alias("_key"), F.col(event_ts).alias("_ts"),
                         F.struct(*[F.col(c) for c in events.columns]).alias("_event"))
    hot = skew.hot_keys(rows.select("_key"), "_key", rows_per_salt=rows_per_salt)
    snaps = skew.repeated(snaps, "_key", hot).withColumn("_event", F.lit(None).cast(rows.schema["_event"].dataType))
    rows = skew.salted(rows, "_key", hot).withColumn("_snap", F.lit(None).cast(snaps.schema["_snap"].dataType))
    order = Window.partitionBy("_key", skew.SALT).orderBy("_ts", F.col("_event").isNotNull(), "_snap")
    newest = F.last("_snap", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried = snaps.unionByName(rows).withColumn("_newest", newest).where("_event IS NOT NULL")
    return carried.select(*[F.col("_event")[c].alias(c) for c in events.columns],
                          *[F.col("_newest")[c].alias(c) for c in (ts_col, *cols)])
