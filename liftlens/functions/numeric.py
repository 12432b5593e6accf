"""Numeric helpers that keep ANSI mode happy and match pandas/numpy results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, null when den is 0 or null (ANSI division by zero would raise)."""
    return F.when(den != 0, num / den)


def half_even(c: Column, scale: int) -> Column:
    """Python's round(): exact halves go to the even neighbour."""
    return F.bround(c, scale)


def decile_of_rank(rank: Column, n: Column, bins: int = 10) -> Column:
    """Equal-frequency bin (0 = lowest) of a 1-based rank among n, as pandas ``qcut`` of ranks.

    ``greatest(ceil((r-1)*bins/(n-1)) - 1, 0)`` evaluated in integer arithmetic.
    """
    num = (rank - 1) * bins
    den = n - 1
    ceil_div = F.when(den > 0, F.floor((num + den - 1) / den)).otherwise(F.lit(0))
    return F.greatest(ceil_div - 1, F.lit(0)).cast("int")


def round_doubles(df: DataFrame, scale: int = 4) -> DataFrame:
    """Round every double column (for engine-independent comparisons of float sums)."""
    cols = [
        F.round(F.col(f.name), scale).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)
