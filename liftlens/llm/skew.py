"""Left joins with a table of unique keys, of which a few may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 10_000  # no more keys than this can each hold over 1/10,000 of a total


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of ``table``, null where it has no such key.

    ``weight`` says how many of the rows a key holds at most. Keys above a
    1/10,000 share of the weights' sum, of which there are at most 10,000, are
    broadcast and their rows then pass the shuffled join on spread keys; any
    other key is a small part of the rows. Keys aren't null, and a key that holds
    many rows stands in ``table``.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_KEYS > total
    value = F.struct(*columns)
    seen = rows.join(F.broadcast(table.where(hot).select(*keys, value.alias("_hot"))), keys, "left")
    seen = seen.withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.monotonically_increasing_id() + 1))
    rest = table.where(~hot).select(*keys, F.lit(0).cast("bigint").alias("_salt"), value.alias("_rest"))
    found = F.coalesce("_hot", "_rest")
    return seen.join(rest, [*keys, "_salt"], "left").select(*rows.columns, *[found[c].alias(c) for c in columns])
