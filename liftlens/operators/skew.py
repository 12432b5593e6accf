"""Spreading the rows of hot keys over several tasks.

A hot key is one of the ``KEYS`` with the most rows that holds more than
``ROWS`` of them; any other key has at most ``ROWS`` rows or one in ``KEYS`` of
all, so leaving it whole is safe, and the list of hot keys is small enough to
broadcast whatever the table's size. A hot key gets a salt for every ``ROWS``
of its rows. The rows on the large side take one salt each, the matching rows
on the other side are repeated once per salt, and the two meet on (key, salt).
The list comes from one pre-aggregated count inside the same plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = 10_000
ROWS = 100_000
SALT = "_salt"


def hot_keys(rows: DataFrame, key: str, keys: int = KEYS, rows_per_salt: int = ROWS) -> DataFrame:
    """(key, _salts) of the hot keys; null keys aside."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") > rows_per_salt).orderBy(F.col("_n").desc()).limit(keys)
    return hot.select(key, F.ceil(F.col("_n") / F.lit(rows_per_salt)).alias("_salts"))


def salted(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Each row with one salt; rows without a key are spread too, as they meet nothing."""
    row = F.monotonically_increasing_id()
    salt = F.when(F.col(key).isNull(), row).when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(row, F.col("_salts")))
    return rows.join(F.broadcast(hot), key, "left").withColumn(SALT, salt.cast("bigint")).drop("_salts")


def repeated(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Each row once for every salt of its key."""
    salts = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    return rows.join(F.broadcast(hot), key, "left").withColumn(SALT, F.explode(salts)).drop("_salts")
