"""Timestamp literals. Tables use TIMESTAMP_NTZ, so no session time zone is involved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts(value: str) -> Column:
    """A TIMESTAMP_NTZ literal from 'YYYY-MM-DD[ HH:MM:SS]'."""
    return F.lit(value).cast("timestamp_ntz")


def ts_plus_days(c: Column, days: int) -> Column:
    return c + F.make_dt_interval(F.lit(days))
