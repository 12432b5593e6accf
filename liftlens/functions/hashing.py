"""Deterministic per-row hash buckets.

A bucket is a pure function of (salt, id): stable across reruns, partition
counts and executor loss, and computed without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftlens.params import HASH_BUCKETS, HASH_SEPARATOR


def _salted(salt: str | Column | None, key: str | Column, raw: bool = False) -> Column:
    """``salt::key`` (``concat_ws`` casts the key to string); the bare key when unsalted."""
    key = F.col(key) if isinstance(key, str) else key
    if salt is None:
        return key if raw else key.cast("string")
    salt_col = F.lit(salt) if isinstance(salt, str) else salt
    return F.concat_ws(HASH_SEPARATOR, salt_col, key)


def md5_u32(key: str | Column, salt: str | Column | None = None) -> Column:
    """First 32 bits of md5(salt::key) as a non-negative bigint (portable to any SQL engine)."""
    return F.conv(F.substring(F.md5(_salted(salt, key)), 1, 8), 16, 10).cast("bigint")


def md5_bucket(key: str | Column, salt: str | Column | None = None, buckets: int = HASH_BUCKETS) -> Column:
    return md5_u32(key, salt) % F.lit(buckets)


def murmur_bucket(key: str | Column, salt: str | Column | None = None, buckets: int = HASH_BUCKETS) -> Column:
    """Spark's Murmur3 ``hash`` bucket, as the reference computes it.

    ``abs`` is taken on the bigint cast so that ``abs(Int.MinValue)`` cannot
    overflow under ANSI mode.
    """
    return F.abs(F.hash(_salted(salt, key, raw=True)).cast("bigint")) % F.lit(buckets)


def hash_bucket(kind: str, key: str | Column, salt: str | Column | None = None,
                buckets: int = HASH_BUCKETS) -> Column:
    if kind == "md5":
        return md5_bucket(key, salt, buckets)
    if kind == "murmur3":
        return murmur_bucket(key, salt, buckets)
    raise ValueError(f"unknown hash kind {kind!r}")


def hash_order_key(kind: str, key: str | Column, salt: str | Column | None = None) -> Column:
    """A 32-bit pseudo-random sort key per id (ties broken by the id itself by callers)."""
    if kind == "md5":
        return md5_u32(key, salt)
    if kind == "murmur3":
        return F.abs(F.hash(_salted(salt, key, raw=True)).cast("bigint"))
    raise ValueError(f"unknown hash kind {kind!r}")
