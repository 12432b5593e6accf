"""Uplift ranking checks: W1 Qini curve, W2 random diagonal, W3 Qini coefficient,
W4 deciles, W5 decile lift, U1 long curve, A8 score summary, A9 histogram.

All ordered quantities come from the bucketed running order (W0), so no step
moves the whole scored population into one task. The coefficient is the
closed form of the trapezoid area, a plain aggregate over the curve.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlens.functions.numeric import decile_of_rank
from liftlens.operators.ordering import global_rank, prefix_sum, quantile_agg
from liftlens.params import HOLDOUT, TREATMENT


def qini_curve(df: DataFrame, *, score: str = "uplift_score", outcome: str = "purchased",
               id_col: str = "customer_id", by: Sequence[str] = (),
               rows_per_bucket: int = 1_000_000) -> DataFrame:
    """W1 + W2: rows in score order (desc, ties by id) with cumulative buyers per group,
    the Qini value t_cum - c_cum * (nt/nc) (sizes floored at 1), x = i/n, and the
    random diagonal r_i = y_n * (i-1)/(n-1).
    """
    is_t = (F.col("group") == TREATMENT).cast("long")
    is_c = (F.col("group") == HOLDOUT).cast("long")
    base = df.select(*by, id_col, score, "group", outcome)
    ps = prefix_sum(base, [(score, False), (id_col, True)],
                    {"t_cum": is_t * F.col(outcome), "c_cum": is_c * F.col(outcome),
                     "nt_cum": is_t, "nc_cum": is_c},
                    partition_by=by, rows_per_bucket=rows_per_bucket, row_number="row_idx", count_col="n")
    nt = F.greatest(F.col("nt_cum"), F.lit(1))
    nc = F.greatest(F.col("nc_cum"), F.lit(1))
    y_n = (F.col("t_cum_total")
           - F.col("c_cum_total") * (F.greatest(F.col("nt_cum_total"), F.lit(1))
                                     / F.greatest(F.col("nc_cum_total"), F.lit(1))))
    rand = F.when(F.col("n") > 1, (F.col("row_idx") - 1) * (y_n / (F.col("n") - 1))).otherwise(F.lit(0.0))
    return ps.select(
        *by, id_col, score, "group", outcome, "row_idx", "n",
        (F.col("row_idx") / F.col("n")).alias("x"),
        F.col("t_cum").cast("bigint").alias("t_cum"), F.col("c_cum").cast("bigint").alias("c_cum"),
        nt.cast("bigint").alias("nt_cum"), nc.cast("bigint").alias("nc_cum"),
        (F.col("t_cum") - F.col("c_cum") * (nt / nc)).alias("qini"),
        F.when(F.col("row_idx") == F.col("n"), y_n).otherwise(rand).alias("random"),
    )


def qini_coefficient(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area between the curve and the diagonal over x = i/n:
    (sum(y) - y_1/2)/n - y_n/2, which is 0 for n = 1."""
    agg = curve.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("qini").alias("_sy"),
        F.max_by("qini", "row_idx").alias("_yn"),
        F.min_by("qini", "row_idx").alias("_y1"),
    )
    coef = (F.col("_sy") - F.col("_y1") / 2) / F.col("n") - F.col("_yn") / 2
    return agg.select(*by, F.col("n").cast("bigint").alias("n"),
                      F.when(F.col("n") > 0, coef).alias("qini_coef"),
                      F.col("_yn").alias("qini_end"))


def qini_curve_long(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The Model and Random series stacked, x in percent."""
    pct = (F.col("x") * 100).alias("pct")
    model = curve.select(*by, "row_idx", pct, F.col("qini").alias("y"), F.lit("Model").alias("series"))
    rand = curve.select(*by, "row_idx", pct, F.col("random").alias("y"), F.lit("Random").alias("series"))
    return model.unionByName(rand)


def uplift_deciles(df: DataFrame, *, score: str = "uplift_score", id_col: str = "customer_id",
                   by: Sequence[str] = (), rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Equal-frequency deciles of the score (0 lowest, 9 highest); ranks are 'first'
    with ties broken by id."""
    ranked = global_rank(df, [(score, True), (id_col, True)], partition_by=by, rows_per_bucket=rows_per_bucket,
                         row_number="score_rank", count_col="_n")
    return (ranked.withColumn("uplift_decile", decile_of_rank(F.col("score_rank"), F.col("_n")))
            .drop("_n"))


def decile_lift(deciled: DataFrame, outcome: str = "purchased", by: Sequence[str] = ()) -> DataFrame:
    """Observed uplift per decile = treated rate - holdout rate, an empty group counting 0."""
    t = F.avg(F.when(F.col("group") == TREATMENT, F.col(outcome)))
    h = F.avg(F.when(F.col("group") == HOLDOUT, F.col(outcome)))
    return (deciled.groupBy(*by, "uplift_decile")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count(F.when(F.col("group") == TREATMENT, 1)).alias("n_treated"),
                 F.count(F.when(F.col("group") == HOLDOUT, 1)).alias("n_holdout"),
                 F.coalesce(t, F.lit(0.0)).alias("treated_rate"),
                 F.coalesce(h, F.lit(0.0)).alias("holdout_rate"))
            .withColumn("observed_uplift", F.col("treated_rate") - F.col("holdout_rate")))


def top_bottom_lift(lift_by_decile: DataFrame, top: int = 9, bottom: int = 0,
                    by: Sequence[str] = ()) -> DataFrame:
    """Top- and bottom-decile observed uplift as one row (0 when a decile is empty)."""
    return lift_by_decile.groupBy(*by).agg(
        F.coalesce(F.max(F.when(F.col("uplift_decile") == top, F.col("observed_uplift"))),
                   F.lit(0.0)).alias("top_decile_uplift"),
        F.coalesce(F.max(F.when(F.col("uplift_decile") == bottom, F.col("observed_uplift"))),
                   F.lit(0.0)).alias("bottom_decile_uplift"))


def score_summary(scores: DataFrame, *, score: str = "uplift_score", id_col: str = "customer_id",
                  q: float = 0.9, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max (``describe``), share > 0 and the exact
    (interpolated) q-quantile.

    The quantile is found by rank (W0) and not by ``percentile``, whose
    global buffer would hold every value in one task.
    """
    ranked = global_rank(scores.select(id_col, score).filter(F.col(score).isNotNull()),
                         [(score, True), (id_col, True)], rows_per_bucket=rows_per_bucket,
                         row_number="_r", count_col="_n")
    return ranked.agg(
        F.count(F.col(score)).alias("n"),
        F.avg(score).alias("mean_uplift"),
        F.stddev_samp(score).alias("std_uplift"),
        F.min(score).alias("min_uplift"),
        F.max(score).alias("max_uplift"),
        F.avg((F.col(score) > 0).cast("double")).alias("share_positive"),
        quantile_agg(score, "_r", "_n", 0.25).alias("p25_uplift"),
        quantile_agg(score, "_r", "_n", 0.5).alias("p50_uplift"),
        quantile_agg(score, "_r", "_n", 0.75).alias("p75_uplift"),
        quantile_agg(score, "_r", "_n", q).alias("p90_uplift"),
    )


def score_histogram(scores: DataFrame, *, score: str = "uplift_score", bins: int = 40) -> DataFrame:
    """Counts in ``bins`` equal-width bins between the min and the max (max in the last bin).

    The two bounds are one scalar aggregate; the binning is a column
    expression and a partial+final aggregation over at most ``bins`` keys.
    """
    row = scores.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    if row is None or row["lo"] is None:
        return scores.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, n bigint")
    lo, hi = float(row["lo"]), float(row["hi"])
    if hi > lo:
        idx = F.least(F.floor((F.col(score) - F.lit(lo)) * F.lit(bins) / F.lit(hi - lo)) + 1, F.lit(bins))
    else:
        idx = F.lit(1)
    width = (hi - lo) / bins
    return (scores.filter(F.col(score).isNotNull())
            .groupBy(idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .select("bin",
                    (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("bin_lo"),
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_hi"),
                    "n"))
