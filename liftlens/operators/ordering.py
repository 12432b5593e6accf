"""Global running order at scale (row numbers and running sums; SL3 row index after a sort).

A plain ``Window.orderBy(...)`` without ``partitionBy`` moves every row into
one task. Here Spark's range partitioner cuts the total order into
contiguous *range buckets* (it orders nulls as a window does), and the
partition index is frozen into a materialised copy at once. Then:

1. per-bucket counts and sums: one small partial+final aggregation;
2. bucket offsets: a running sum over the tiny per-bucket table (at most
   ``n / rows_per_bucket`` rows per partition key, broadcast when there is no
   partition key);
3. ``Window.partitionBy(bucket).orderBy(keys)`` running values plus the offset.

Ties must be broken by the caller with a unique last key (e.g. customer_id);
the ranges then include it, so even a key with very few distinct values
splits evenly. ``partition_by`` restarts the order per group (e.g. per
stratum); buckets are (group, range bucket), so a group holding a third of all
rows is still split into bounded tasks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftlens.functions.lineage import materialize

BUCKET = "_w0_bucket"

OrderSpec = Sequence[tuple[str, bool]]  # (column, ascending)


def _norm_order(order: Sequence[str | tuple[str, bool]]) -> list[tuple[str, bool]]:
    return [(o, True) if isinstance(o, str) else (o[0], bool(o[1])) for o in order]


def sort_exprs(order: Sequence[str | tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc() if asc else F.col(c).desc() for c, asc in _norm_order(order)]


def n_buckets(n_rows: int, rows_per_bucket: int) -> int:
    return max(1, math.ceil(n_rows / max(1, rows_per_bucket)))


def prefix_sum(df: DataFrame, order: Sequence[str | tuple[str, bool]],
               sums: Mapping[str, Column | str] | None = None, *,
               partition_by: Sequence[str] = (), rows_per_bucket: int = 1_000_000,
               row_number: str = "row_idx", count_col: str | None = "n_rows",
               totals: bool = True, seed: int = 42, materialize_input: bool = True) -> DataFrame:
    """Global (or per ``partition_by`` group) row number and running sums in ``order``.

    Adds ``row_number`` (1-based), one running column per ``sums`` entry
    (inclusive of the row), and, when ``totals``, ``<name>_total`` per sum
    and ``count_col`` with the group size. The input is materialised once
    (count, range sample, totals and the window pass all read it).
    """
    order_n = _norm_order(order)
    sums = dict(sums or {})
    part = list(partition_by)
    exprs = {name: (F.col(e) if isinstance(e, str) else e) for name, e in sums.items()}
    base = df.withColumns({f"_v_{name}": e for name, e in exprs.items()}) if exprs else df
    if materialize_input:
        base = materialize(base)

    n = base.count()
    k = n_buckets(n, rows_per_bucket)
    if k == 1:
        return _single_bucket(base, order_n, exprs, part, row_number, count_col, totals)
    # Spark's range partitioner orders nulls as the window does; the partition index is frozen into
    # the materialised copy at once, so a recomputation can never move a row to another bucket.
    bucketed = materialize(base.repartitionByRange(k, *sort_exprs(order_n))
                           .withColumn(BUCKET, F.spark_partition_id()))

    per_bucket = bucketed.groupBy(*part, BUCKET).agg(
        F.count(F.lit(1)).alias("_c_cnt"),
        *[F.sum(f"_v_{name}").alias(f"_c_{name}") for name in exprs])
    w_prev = (Window.partitionBy(*part).orderBy(BUCKET)
              .rowsBetween(Window.unboundedPreceding, -1))
    w_all = Window.partitionBy(*part)
    off_cols = {"_o_cnt": F.coalesce(F.sum("_c_cnt").over(w_prev), F.lit(0))}
    for name in exprs:
        off_cols[f"_o_{name}"] = F.sum(f"_c_{name}").over(w_prev)
    if totals:
        off_cols["_t_cnt"] = F.sum("_c_cnt").over(w_all)
        for name in exprs:
            off_cols[f"_t_{name}"] = F.sum(f"_c_{name}").over(w_all)
    offsets = per_bucket.withColumns(off_cols).drop("_c_cnt", *[f"_c_{name}" for name in exprs])
    # Without a partition key the offsets table has at most k rows: broadcast.
    offsets = F.broadcast(offsets) if not part else offsets
    joined = bucketed.join(offsets, [*part, BUCKET], "inner")

    w_run = Window.partitionBy(*part, BUCKET).orderBy(*sort_exprs(order_n))
    w_cum = w_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {row_number: (F.row_number().over(w_run) + F.col("_o_cnt")).cast("bigint")}
    for name in exprs:
        local = F.sum(f"_v_{name}").over(w_cum)
        out[name] = F.when(F.col(f"_o_{name}").isNull(), local).otherwise(local + F.col(f"_o_{name}"))
    if totals:
        if count_col:
            out[count_col] = F.col("_t_cnt").cast("bigint")
        for name in exprs:
            out[f"{name}_total"] = F.col(f"_t_{name}")
    drop = [BUCKET, "_o_cnt", "_t_cnt", *[f"_v_{n_}" for n_ in exprs],
            *[f"_o_{n_}" for n_ in exprs], *[f"_t_{n_}" for n_ in exprs]]
    return joined.withColumns(out).drop(*drop)


def _single_bucket(base: DataFrame, order_n: list[tuple[str, bool]], exprs: Mapping[str, Column],
                   part: list[str], row_number: str, count_col: str | None, totals: bool) -> DataFrame:
    """One range bucket (at most ``rows_per_bucket`` rows per group): plain windows over the
    group, the totals from the same partitioning (no extra exchange, no join)."""
    w_run = Window.partitionBy(*part).orderBy(*sort_exprs(order_n))
    w_cum = w_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_all = Window.partitionBy(*part)
    out = {row_number: F.row_number().over(w_run).cast("bigint")}
    for name in exprs:
        out[name] = F.sum(f"_v_{name}").over(w_cum)
    if totals:
        if count_col:
            out[count_col] = F.count(F.lit(1)).over(w_all).cast("bigint")
        for name in exprs:
            out[f"{name}_total"] = F.sum(f"_v_{name}").over(w_all)
    return base.withColumns(out).drop(*[f"_v_{n_}" for n_ in exprs])


def global_rank(df: DataFrame, order: Sequence[str | tuple[str, bool]], *, partition_by: Sequence[str] = (),
                rows_per_bucket: int = 1_000_000, row_number: str = "row_idx",
                count_col: str | None = "n_rows") -> DataFrame:
    """Row number (and group size) in a total order, without a single-task window."""
    return prefix_sum(df, order, None, partition_by=partition_by, rows_per_bucket=rows_per_bucket,
                      row_number=row_number, count_col=count_col, totals=count_col is not None)


def quantile_agg(value: str, rank: str, n: str, p: float) -> Column:
    """Aggregate expression over a ranked frame: the linear-interpolated p-quantile
    (pandas / ``quantile_cont``): v[lo] + frac * (v[lo+1] - v[lo]), lo = floor((n-1)p)."""
    h = (F.col(n) - 1) * F.lit(float(p))
    lo = F.floor(h) + 1
    v_lo = F.max(F.when(F.col(rank) == lo, F.col(value)))
    v_hi = F.max(F.when(F.col(rank) == lo + 1, F.col(value)))
    frac = F.max(h) - F.floor(F.max(h))
    return v_lo + frac * (F.coalesce(v_hi, v_lo) - v_lo)


def exact_quantile(df: DataFrame, col: str, p: float, tiebreak: str, *,
                   rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Exact interpolated quantile without one big task: rank with W0, then one aggregate
    that only looks at the two rows around position (n-1)*p. One row, column ``q``."""
    ranked = global_rank(df.select(col, tiebreak), [(col, True), (tiebreak, True)],
                         rows_per_bucket=rows_per_bucket, row_number="_r", count_col="_n")
    return ranked.agg(quantile_agg(col, "_r", "_n", p).alias("q"))
