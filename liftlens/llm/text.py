"""Vectorised word and shingle hashing over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BATCH_BYTES = 4 << 20  # bytes of an Arrow batch between Spark and a Python worker
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
SLICE_BYTES = 2 << 20  # text bytes hashed at a time (a longer single text goes alone)
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
# ASCII punctuation and control bytes part words too; every byte of a non-ASCII character belongs to one.
PUNCT = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])


def free(name: str, columns: list[str]) -> str:
    """``name``, with as many ``_`` before it as it takes to differ from every column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session end at BATCH_BYTES, unless it names a size itself.

    Spark's own bound (64 MB) lets a batch hold 10,000 texts; an executor holds
    several such batches on both sides of each Python step, and rows pass more
    than one.
    """
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, f"{BATCH_BYTES}b")


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(lower_ascii: bool) -> np.ndarray:
    b = np.arange(256, dtype=np.uint64)
    if lower_ascii:
        b[65:91] += np.uint64(32)
    return mix(b + np.uint64(1))


def _power_table(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


# A power of position p is that of its block of POWERS positions times that of its place therein: no table is as long as a text.
POWERS = 1 << 12
_UP, _DOWN = _power_table(_BASE, POWERS), _power_table(pow(_BASE, -1, 1 << 64), POWERS)


def _block_powers(base: int, n: int) -> np.ndarray:
    return _power_table(pow(base, POWERS, 1 << 64), n // POWERS + 1)


def _by_powers(values: np.ndarray) -> None:
    """Multiply each value by the base to the power of its position, in place."""
    n = len(values)
    blocks = _block_powers(_BASE, n)
    whole = values[:n - n % POWERS].reshape(-1, POWERS)
    whole *= _UP
    whole *= blocks[:len(whole), None]
    rest = values[n - n % POWERS:]
    rest *= _UP[:len(rest)]
    rest *= blocks[len(whole)]


def inverse_powers(at: np.ndarray, n: int) -> np.ndarray:
    """The base to the power of minus each position; positions are at most ``n``."""
    blocks = _block_powers(pow(_BASE, -1, 1 << 64), n)
    return _DOWN[at % POWERS] * blocks[at // POWERS]


@dataclass
class Words:
    """Words of a slice of texts: byte ranges in ``data``, hashes, and ``ptr[i]:ptr[i + 1]`` for text i."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    ptr: np.ndarray
    total: np.ndarray  # running sums behind the hashes

    def lead_hashes(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word (all of a shorter one)."""
        ends = np.minimum(self.ends, self.starts + size)
        h = (self.total[ends] - self.total[self.starts]) * inverse_powers(self.starts, len(self.data))
        return mix(h + (ends - self.starts).astype(np.uint64) + np.uint64(size << 32))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` text bytes (a longer text alone)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = total = 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            yield start, i
            start, total = i, 0
        total += s
    if len(sizes) > start:
        yield start, len(sizes)


def words(column: pa.Array, separators: np.ndarray = WHITE, lower_ascii: bool = True) -> Words:
    """All words of all texts of ``column``."""
    data, off = text_buffers(column)
    n = len(data)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    total[1:] = _byte_values(lower_ascii)[data]
    _by_powers(total[1:])
    np.cumsum(total, out=total)
    h = mix((total[ends] - total[starts]) * inverse_powers(starts, n) + (ends - starts).astype(np.uint64))
    return Words(data, off, starts, ends, h, np.searchsorted(starts, off), total)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words of one text; fewer words: one hash of the whole run; none: empty."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    out = np.full(n - size + 1, np.uint64(size))
    for k in range(size):
        out = out * np.uint64(_STEP) + hashes[k: n - size + 1 + k]
    return mix(out)
