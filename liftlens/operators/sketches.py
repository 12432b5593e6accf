"""Mergeable sketches beside the exact aggregates: A8 quantiles (KLL), A10 distinct counts (HyperLogLog).

A sketch is a binary column of bounded size that can be stored with a
snapshot or a wave and merged later with those of others, without the rows.
Stated errors: a KLL quantile's rank is within ``RANK_ERROR`` of n (k = 200,
99 % of the time); a HyperLogLog estimate with 2**lg_k registers has a relative
standard error of about 1.04 / sqrt(2**lg_k).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftlens.functions.time import ts
from liftlens.operators.features import place_among

RANK_ERROR = 0.0165
LG_K = 12


def quantile_sketches(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One KLL sketch of ``value`` per ``by`` (nulls aside)."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double")).alias("sketch"))


def merged_quantiles(sketches: DataFrame, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The p-quantiles of the union of the sketches, per ``by``: columns n and quantiles (an array in the order of ``ps``)."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"),
                         F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for p in ps]).alias("quantiles"))


def distinct_error(lg_k: int = LG_K) -> float:
    return 1.04 / 2 ** (lg_k / 2)


def distinct_sketches(events: DataFrame, key: str, period: Column, lg_k: int = LG_K) -> DataFrame:
    """(period, sketch): the distinct keys of each period; periods are united with ``hll_union_agg``."""
    return events.groupBy(period.alias("period")).agg(F.hll_sketch_agg(key, F.lit(lg_k)).alias("sketch"))


def distinct_history(events: DataFrame, key: str, ts_col: str, dates: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """(feature_ts, n_exact, n_estimate): distinct keys with an event before each date.

    Estimates unite one sketch per interval between dates; exact counts add up the keys first seen in each
    interval. Both windows run over one row per interval.
    """
    points = [ts(d) for d in sorted(dates)]
    seen = events.where(F.col(ts_col) < points[-1]).select(key, place_among(F.col(ts_col), points).alias("period"))
    new = seen.groupBy(key).agg(F.min("period").alias("period")).where(F.col(key).isNotNull()).groupBy("period").agg(F.count(F.lit(1)).alias("new"))
    sketches = distinct_sketches(seen, key, F.col("period"), lg_k)
    grid = events.sparkSession.range(len(points)).select(F.col("id").cast("int").alias("period"))
    so_far = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = grid.join(F.broadcast(new), "period", "left").join(F.broadcast(sketches), "period", "left")
    return rows.select(
        F.element_at(F.array(*points), F.col("period") + 1).alias("feature_ts"),
        F.coalesce(F.sum("new").over(so_far), F.lit(0)).alias("n_exact"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch").over(so_far)), F.lit(0)).alias("n_estimate"))
