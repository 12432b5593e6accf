"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from liftlens.functions.hashing import hash_bucket, hash_order_key, md5_bucket, md5_u32, murmur_bucket
from liftlens.functions.numeric import (
    clip,
    decile_of_rank,
    half_even,
    round_doubles,
    safe_ratio,
)
from liftlens.functions.time import ts, ts_plus_days

__all__ = [
    "hash_bucket", "hash_order_key", "md5_bucket", "md5_u32", "murmur_bucket",
    "clip", "decile_of_rank", "half_even", "round_doubles", "safe_ratio",
    "ts", "ts_plus_days",
]
