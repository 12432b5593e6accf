"""Model runs and champion choice: M8 log_run, M9 promote.

A run is one row (version, wave, sizes, Qini, decile lifts) appended to a
``runs`` table; the champion is chosen from that table by the rule the
reference applies at each registration (a newer run replaces the champion
only with a strictly greater Qini; a run without a Qini counts as -1e9).
Applied over the whole history this is: the highest Qini, earliest version
among equals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlens.params import MISSING_QINI, RUNS


def run_rows(version: int, qini: DataFrame, deciles: DataFrame, sizes: DataFrame,
             by: str = "campaign_id") -> DataFrame:
    """Run rows per wave from per-wave metric frames (equi-joined on the wave; nothing collected).

    ``qini``: by, n, qini_coef; ``deciles``: by, top/bottom_decile_uplift;
    ``sizes``: by, n_train, n_eval.
    """
    m = (qini.select(by, "qini_coef", F.col("n").alias("_n_q"))
         .join(deciles.select(by, "top_decile_uplift", "bottom_decile_uplift"), by)
         .join(sizes.select(by, "n_train", "n_eval"), by))
    return m.select(
        F.lit(int(version)).alias("version"), F.col(by).alias("campaign_id"),
        F.col("n_train").cast("bigint"), F.col("n_eval").cast("bigint"), "qini_coef",
        (F.col("qini_coef") / F.greatest(F.col("_n_q"), F.lit(1))).alias("qini_per_row"),
        "top_decile_uplift", "bottom_decile_uplift")


def log_run(store, run: DataFrame, name: str = "runs") -> None:
    """M8: record the run; a rerun of the same version and wave replaces its row."""
    store.replace_rows(run.select(*[F.col(f.name).cast(f.dataType) for f in RUNS.fields]), name, ("version", "campaign_id"))


def champion(runs: DataFrame) -> DataFrame:
    """M9: the champion run (highest Qini, earliest version among equals; missing Qini = -1e9)."""
    q = F.coalesce(F.col("qini_coef"), F.lit(MISSING_QINI))
    return (runs.withColumn("_q", q)
            .orderBy(F.col("_q").desc(), F.col("version").asc())
            .limit(1)
            .select(F.col("version").alias("champion_version"), F.col("qini_coef")))


def next_version(runs: DataFrame | None) -> int:
    """One more than the newest recorded version (1 for an empty history); a scalar aggregate."""
    if runs is None:
        return 1
    v = runs.agg(F.max("version")).first()[0]
    return 1 if v is None else int(v) + 1
