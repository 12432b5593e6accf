"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer when the least hash of its s-mers lies
at its first or last place. Whether it is one depends on the k-mer alone, so an
edit changes only the anchors around it, and equal stretches keep theirs wherever
they stand. ``anchors`` gives positions and hashes; a fingerprint is the sorted
SKETCH least 32-bit anchor hashes of the whole text in hex, an unbiased sample of
its anchor set. Likeness of two fingerprints is the bottom-k estimate of the
Jaccard index (exact while the union has at most SKETCH anchors).

A text without a k-mer has one anchor, its whole; empty and null texts have none
and an empty fingerprint; two empty ones have likeness 1, an empty and another 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import mix

K, S = 16, 5
SKETCH = 64
SLICE_CHARS = 1 << 20
_STEP = 0xD1342543DE82EF95


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def _kmers(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k code points (``x`` holds mixed code points), by doubling windows."""
    h, width, out, at = x, 1, None, 0
    while True:
        if k & width:
            part = h[at: at + len(x) - k + 1]
            out = part if out is None else out * np.uint64(pow(_STEP, width, 1 << 64)) + part
            at += width
        if width * 2 > k:
            return mix(out)
        h = h[: len(h) - width] * np.uint64(pow(_STEP, width, 1 << 64)) + h[width:]
        width *= 2


def _window_least(x: np.ndarray, w: int) -> np.ndarray:
    least, width = x, 1
    while width * 2 <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = w - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the closed syncmers of a run of code points; shorter than k: the whole as one."""
    if len(points) < k:
        return _whole(points)
    x = mix(points.astype(np.uint64) + np.uint64(1))
    inner = _kmers(x, s)
    w = k - s + 1
    least = _window_least(inner, w)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[w - 1:] == least))
    return at, _kmers(x, k)[at]


def _whole(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.zeros(1, np.int64), np.frombuffer(hashlib.blake2b(points.tobytes(), digest_size=8).digest(), np.uint64)


def sketches(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The SKETCH least 32-bit anchor hashes of each text; the texts are hashed as one run, cut at their bounds."""
    n = np.array([len(t) for t in texts])
    ends = np.cumsum(n)
    at, h = anchors(np.concatenate(texts)) if n.sum() >= K else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    text = np.searchsorted(ends, at, side="right")
    inside = at + K <= ends[np.minimum(text, len(ends) - 1)]
    text, h = text[inside], h[inside]
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    out = []
    for i, t in enumerate(texts):
        own = h[bounds[i]:bounds[i + 1]] if len(t) >= K else _whole(t)[1]
        out.append(np.unique((own >> np.uint64(32)).astype(np.uint32))[:SKETCH])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index estimated from two sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SKETCH]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, union, assume_unique=True).sum() / len(union))


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` (such a column is replaced); no shuffle."""
    docs = docs.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = [as_text(s) for s in sketches([code_points(t) for t in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], [*part.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.StringType())]))


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judged(rows: list[tuple]) -> pa.RecordBatch:
    """Results for all rows but the last of ``rows`` (doc_id, code points), each with its follower."""
    points = [r[1] for r in rows]
    edited = []
    for i in range(len(rows) - 1):
        half = len(points[i]) // 2
        edited.append(np.concatenate([points[i][: len(points[i]) - half], points[i + 1][:half]]))
    made = sketches([*points, *edited])
    own, changed = made[: len(points)], made[len(points):]
    sha = [hashlib.sha256(e.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest() for e in edited]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows[:-1]], pa.int64()), pa.array([len(p) for p in points[:-1]], pa.int64()), pa.array(sha, pa.string()),
         pa.array([as_text(s) for s in own[:-1]]), pa.array([as_text(s) for s in changed]),
         pa.array([likeness(a, b) for a, b in zip(own[:-1], changed, strict=True)], pa.float64()),
         pa.array([likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)], pa.float64())],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, guard, doc_id, text) sorted so that each row's follower comes next; a guard only follows."""
    held: list[tuple] = []
    bucket, closed, size = None, False, 0
    for batch in batches:
        for b, guard, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guard", "doc_id", "text")), strict=True):
            if b != bucket:
                if len(held) > 1:
                    yield _judged(held)
                held, size, bucket, closed = [], 0, b, False
            if closed:  # further rows equal to the guard
                continue
            closed = guard
            held.append((doc, code_points(text)))
            size += len(held[-1][1])
            if size > SLICE_CHARS or guard:
                if len(held) > 1:
                    yield _judged(held)
                held = held[-1:]
                size = len(held[0][1])
    if len(held) > 1:
        yield _judged(held)


def beside_next(docs: DataFrame, buckets_per_partition: int = 3) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and their likeness to it and to the next document's.

    The next document is that of the next larger doc_id, after the last the
    first; rows without an id come last, equal ids by a hash of their text.
    The edited text has its last floor(n / 2) code points replaced by the first
    as many (or all) of the next. Documents go to ranges of doc_id in one
    shuffle; each range also gets the first row of the next as a guard.
    """
    spark = docs.sparkSession
    last = F.lit(2**63 - 1)
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), last).alias("at"), F.xxhash64("text").alias("tie"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * buckets_per_partition)
    cuts = keyed.withColumn("d", F.col("at").cast("double")).approxQuantile("d", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    splits = [-float("inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="d", outputCol="b", handleInvalid="keep").transform(
        keyed.withColumn("d", F.col("at").cast("double"))).withColumn("bucket", F.col("b").cast("int")).drop("d", "b")
    # one row per range: at most n of them
    heads = [r.asDict(True) for r in placed.groupBy("bucket").agg(F.min(F.struct("at", "tie")).alias("head")).orderBy("bucket").collect()]
    follows = [(heads[i]["bucket"], h["head"]["at"], h["head"]["tie"]) for i, h in enumerate(heads[1:] + heads[:1])]
    guards = F.broadcast(spark.createDataFrame(follows, "bucket int, at bigint, tie bigint"))
    rows = placed.select("bucket", F.lit(False).alias("guard"), "at", "tie", "doc_id", "text")
    extra = placed.drop("bucket").join(guards, ["at", "tie"]).select("bucket", F.lit(True).alias("guard"), "at", "tie", "doc_id", "text")
    dealt = rows.unionByName(extra).repartition("bucket").sortWithinPartitions("bucket", "guard", "at", "tie")
    return dealt.select("bucket", "guard", F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_streamed, OUT)


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and likeness to the edited text and the next document."""
    return beside_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
