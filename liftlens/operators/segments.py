"""Segmentation and value tiers: M1-M4, A3, W6, J8.

k-means is batched Lloyd: all (k, restart) sets of centres advance together, in
one pass and one aggregation per iteration over the cached vectors, so the
number of jobs depends on the iterations of the slowest fit, not on the number
of fits. A task adds up, for each centre, the count, the sum of the vectors and
their squared norms; the driver holds the centres alone (fits x k x dim). The
silhouette of every k is one more pass, from those sums. Segment profiles and
tier maps have one row per segment (at most k), so the window that ranks them
and the broadcast that applies them are bounded by k.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftlens.functions.lineage import materialize
from liftlens.params import CLUSTER_FEATURES, LOG_FEATURES, TIER_LABELS, Params

VECTOR = "features"
ROWS_PER_PARTITION = 50_000
START_ROWS = 2_000  # rows that the starting centres are drawn from; fits and scores use all rows
SHIFT = 1e-4  # a fit has converged when no centre moves further
PARTIAL_ROWS = 50_000  # partial sums of a pass that the driver takes as they are
CENTRE_BYTES = 32 << 20  # centres that one pass sends to the tasks
CELLS = 1 << 20  # differences computed at a time
PACK_BYTES = 16 << 10  # bytes of vectors in a row of the table that passes read
PASS_CELLS = 1 << 16  # distances of a pass computed at a time (512 KB, which a core's cache holds)


# M1
def cluster_vectors(features: DataFrame, cols: Sequence[str] = CLUSTER_FEATURES,
                    log_cols: Sequence[str] = LOG_FEATURES, id_col: str = "customer_id",
                    rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Nulls to 0, log1p on the skewed money columns, standardised by the population std
    (as scikit-learn's scaler; a zero std leaves the centred value): an array column ``features``.

    At most ``ceil(rows / rows_per_partition)`` partitions: every k-means pass runs a task for each."""
    x = features.select(id_col, *[
        (F.log1p(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) if c in log_cols
         else F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c)
        for c in cols])
    stats = x.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return x.select(id_col, F.array(*[
        (F.col(c) - F.lit(stats[f"m_{c}"] or 0.0)) / F.lit(stats[f"s_{c}"] or 1.0) for c in cols]).alias(VECTOR)).coalesce(max(1, -(-stats["_n"] // rows_per_partition)))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1)


def packed(vectors: DataFrame) -> DataFrame:
    """The vectors, some of a task's to a row, as the bytes of their doubles: passes over them convert no arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                step = max(1, PACK_BYTES // max(1, 8 * x.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array([x[at: at + step].tobytes() for at in range(0, len(x), step)], pa.binary())], [VECTOR])

    return vectors.select(VECTOR).mapInArrow(run, f"{VECTOR} binary")


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a column, packed or not."""
    if not len(column):
        return np.zeros((0, dim))
    if not pa.types.is_binary(column.type):
        return _matrix(column)
    return np.concatenate([np.frombuffer(b.as_buffer()) for b in column]).reshape(-1, dim)


@dataclass
class Fit:
    """One k-means fit: its centres, and what a pass over all rows added up for them."""

    centres: np.ndarray
    cost: float = math.inf
    n: np.ndarray | None = None
    sums: np.ndarray | None = None
    squares: np.ndarray | None = None
    iterations: int = 0


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre (the first of equals) and the squared distance."""
    d2 = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    at = d2.argmin(1)
    return at, np.maximum(d2[np.arange(len(x)), at], 0)


def measure(vectors: DataFrame, fits: Mapping[object, Fit], partitions: int) -> None:
    """One pass over vectors, packed or not: every fit's cost, and per centre the count, the vector sum and the sum of squared norms.

    Each task gives one row per centre. Up to ``PARTIAL_ROWS`` of them are added up on the driver, more
    by a shuffle."""
    keys = list(fits)
    centres = [fits[k].centres for k in keys]
    dim = centres[0].shape[1]

    sizes = [len(c) for c in centres]
    alike = [np.flatnonzero(np.array(sizes) == k) for k in dict.fromkeys(sizes)]  # fits of equally many centres meet a row together
    stacks = [np.concatenate([centres[i] for i in own]) for own in alike]
    first = np.concatenate([[0], np.cumsum(sizes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((len(own), len(c) // len(own), dim + 3)) for own, c in zip(alike, stacks, strict=True)]  # n, cost, squares, sums
        tables = [np.column_stack([-2 * c, (c * c).sum(1)]) for c in stacks]
        step = max(1, PASS_CELLS // max(map(len, stacks)))
        for batch in batches:
            x = _unpacked(batch.column(0), dim)
            for at in range(0, len(x), step):
                part = x[at: at + step]
                squares = (part * part).sum(1)
                ones = np.ones(len(part))
                row, lifted = np.column_stack([ones, squares, part]), np.column_stack([part, ones])
                for total, table in zip(held, tables, strict=True):
                    fits_, k = total.shape[:2]
                    d2 = (table @ lifted.T).reshape(fits_, k, len(part))  # less the row's own square
                    low = d2.min(1)
                    near = d2 == low[:, None]
                    for j in range(1, k):  # of equally near centres the first
                        near[:, j] &= ~near[:, :j].any(1)
                    sums = (near.reshape(fits_ * k, -1).astype(float) @ row).reshape(fits_, k, -1)
                    total[..., 0] += sums[..., 0]
                    total[..., 2:] += sums[..., 1:]
                    total[:, 0, 1] += np.maximum(low + squares, 0).sum(1)
        out = np.zeros((first[-1], dim + 3))
        for own, total in zip(alike, held, strict=True):
            for i, sums in zip(own, total, strict=True):
                out[first[i]: first[i + 1]] = sums
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(list(out))], ["centre", "added"])

    added = vectors.select(VECTOR).mapInArrow(run, "centre bigint, added array<double>")
    found = np.zeros((sum(map(len, centres)), dim + 3))
    if partitions * len(found) > PARTIAL_ROWS:
        added = added.groupBy("centre").agg(F.array(*[F.sum(F.col("added")[i]) for i in range(dim + 3)]).alias("added"))
    for centre, row in added.collect():
        found[centre] += row
    at = 0
    for key, c in zip(keys, centres, strict=True):
        mine, at = found[at: at + len(c)], at + len(c)
        fit = fits[key]
        fit.n, fit.cost, fit.squares, fit.sums = mine[:, 0], mine[:, 1].sum(), mine[:, 2], mine[:, 3:]


def _starts(vectors: DataFrame, runs: Sequence[tuple[int, int]], seed: int) -> dict[tuple[int, int], Fit]:
    """k-means++ centres of each (k, restart), drawn from the ``START_ROWS`` rows with the smallest hashes."""
    drawn = vectors.select(VECTOR, F.xxhash64(F.lit(seed), *vectors.columns).alias("h")).orderBy("h").limit(START_ROWS).collect()
    x = np.array([r[VECTOR] for r in drawn], float)
    out = {}
    for k, restart in runs:
        rnd = np.random.default_rng([seed, restart, k])
        chosen = [x[rnd.integers(len(x))]]
        gap = ((x - chosen[0]) ** 2).sum(1)
        while len(chosen) < k:
            chosen.append(x[rnd.choice(len(x), p=gap / gap.sum())] if gap.sum() > 0 else x[rnd.integers(len(x))])
            gap = np.minimum(gap, ((x - chosen[-1]) ** 2).sum(1))
        out[k, restart] = Fit(np.array(chosen))
    return out


def fit_all(vectors: DataFrame, ks: Sequence[int], restarts: int, seed: int, max_iter: int = 300) -> dict[tuple[int, int], Fit]:
    """Every (k, restart) fit, advanced together; one job an iteration for all that still move."""
    fits = _starts(vectors, [(k, r) for k in ks for r in range(max(1, restarts))], seed)
    moving, partitions = dict(fits), vectors.rdd.getNumPartitions()
    rows = packed(vectors).persist()
    try:
        while moving:
            measure(rows, moving, partitions)
            for key, fit in list(moving.items()):
                new = np.where(fit.n[:, None] > 0, fit.sums / np.maximum(fit.n, 1)[:, None], fit.centres)  # an empty one stays
                moved = np.sqrt(((new - fit.centres) ** 2).sum(1).max())
                if moved <= SHIFT or fit.iterations == max_iter:
                    del moving[key]  # cost and sums are those of these centres
                else:
                    fit.centres, fit.iterations = new, fit.iterations + 1
    finally:
        rows.unpersist()
    return fits


def fit_best(vectors: DataFrame, ks: Sequence[int], restarts: int, seed: int, max_iter: int = 300) -> dict[int, Fit]:
    """For each k the fit of the lowest cost (then the first)."""
    best: dict[int, Fit] = {}
    for (k, _), fit in fit_all(vectors, ks, restarts, seed, max_iter).items():
        if k not in best or fit.cost < best[k].cost:
            best[k] = fit
    return best


def silhouettes(vectors: DataFrame, fits: Mapping[int, Fit]) -> dict[int, float]:
    """Mean silhouette (squared Euclidean, as Spark ML's evaluator) of each fit over all rows, in one pass."""
    given = [(k, f.centres, f.n, f.sums, f.squares) for k, f in fits.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(given))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            for i, (_, centres, n, sums, squares) in enumerate(given):
                at, _ = _nearest(x, centres)
                held = np.maximum(n, 1)
                far = (x * x).sum(1)[:, None] + squares / held - 2 * x @ (sums / held[:, None]).T  # mean distance to a cluster
                rows = np.arange(len(x))
                own = far[rows, at] * held[at] / np.maximum(held[at] - 1, 1)
                far[rows, at] = np.inf
                other = np.where(n > 0, far, np.inf).min(1)
                top = np.maximum(own, other)
                safe = (n[at] > 1) & np.isfinite(other) & (top > 0)
                total[i] += np.where(safe, (other - own) / np.where(safe, top, 1), 0).sum()
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in given], pa.int64()), pa.array(total)], ["k", "s"])

    rows = vectors.select(VECTOR).mapInArrow(run, "k bigint, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    return {r["k"]: r["s"] / max(1.0, fits[r["k"]].n.sum()) for r in rows}


# M2
def choose_k(vectors: DataFrame, params: Params) -> tuple[int, DataFrame]:
    """Silhouette for each k of ``params.k_range``, fitted and scored on all rows; the best k
    (fallback ``n_segments``) and a small frame (k, silhouette, training_cost, chosen).

    The vectors are cached for the passes unless the caller has done so."""
    spark, schema = vectors.sparkSession, "k int, silhouette double, training_cost double, chosen boolean"
    own = not vectors.is_cached
    if own:
        vectors.persist()
    try:
        if not params.k_range or vectors.isEmpty():
            return params.n_segments, spark.createDataFrame([], schema)
        fits = fit_best(vectors, params.k_range, params.kmeans_restarts, params.seed, params.kmeans_max_iter)
        score = silhouettes(vectors, fits)
    finally:
        if own:
            vectors.unpersist()
    best = max(sorted(fits), key=lambda k: score[k])
    return best, spark.createDataFrame([(int(k), float(score[k]), float(fits[k].cost), k == best) for k in sorted(fits)], schema)


# M3
def fit_segments(vectors: DataFrame, k: int, params: Params) -> DataFrame:
    """Final k-means (``final_restarts`` restarts, all rows): customer_id, segment_id."""
    if vectors.isEmpty():
        return vectors.select("customer_id", F.lit(0).alias("segment_id"))
    fit = fit_best(vectors, [k], params.final_restarts, params.seed, params.kmeans_max_iter)[k]
    return assign_nearest(vectors, VECTOR, dict(enumerate(fit.centres.tolist())), "segment_id").select("customer_id", "segment_id")


def _closest(ids: np.ndarray, centres: np.ndarray) -> Callable[[pa.Array], pa.Array]:
    """Per vector the nearest of the centres and its squared distance, by exact differences.

    Centres are sorted by norm into blocks; as |x - c| >= ||x| - |c||, a block whose norms are all too far
    from a vector's norm is left out for it."""
    norms = np.sqrt((centres * centres).sum(1))
    order = np.lexsort((ids, norms))
    ids, centres, norms = ids[order], centres[order], norms[order]
    size = max(1, min(256, len(ids)))

    def run(column: pa.Array) -> pa.Array:
        x = _matrix(column) if len(column) else np.zeros((0, centres.shape[1]))
        norm = np.sqrt((x * x).sum(1))
        best, who = np.full(len(x), np.inf), np.zeros(len(x), ids.dtype)
        starts = np.arange(0, len(ids), size)
        middle = np.median(norm) if len(x) else 0.0
        for a in starts[np.argsort(np.abs(norms[starts] - middle), kind="stable")]:
            block, low, high = centres[a: a + size], norms[a], norms[min(a + size, len(ids)) - 1]
            gap = np.maximum(np.maximum(low - norm, norm - high), 0) * (1 - 1e-9)
            rows = np.flatnonzero(gap * gap <= best)
            step = max(1, CELLS // block.size)
            for at in range(0, len(rows), step):
                some = rows[at: at + step]
                d2 = ((x[some][:, None, :] - block) ** 2).sum(2)
                least = d2.min(1)
                name = np.where(d2 == least[:, None], ids[a: a + size], np.iinfo(ids.dtype).max).min(1)
                better = (least < best[some]) | ((least == best[some]) & (name < who[some]))
                best[some[better]], who[some[better]] = least[better], name[better]
        return pa.StructArray.from_arrays([pa.array(best), pa.array(who)], ["d2", "id"])

    return run


# M4
def assign_nearest(df: DataFrame, vec_col: str, centres: Mapping[int, Sequence[float]] | DataFrame,
                   out_col: str = "centre_id") -> DataFrame:
    """Nearest centre by squared Euclidean distance (ties to the smaller id); null for a null vector.

    ``centres`` is a mapping or a DataFrame (id, vector). Each pass sends at most ``CENTRE_BYTES`` of
    them to the tasks, without a join or a shuffle; a larger table is cut into ranges of ids, one such
    pass each, all in the same stage, and the nearest of all ranges wins."""
    if isinstance(centres, DataFrame):
        key, vec = centres.columns[:2]
        size = centres.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("dim")).first()
        parts = max(1, -(-(size["n"] or 0) * (size["dim"] or 0) * 8 // CENTRE_BYTES))
        table = centres.select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))
        blocks = ([(r["id"], r["v"]) for r in table.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).collect()] for i in range(parts))
    else:
        blocks = iter([list(centres.items())])
    found = None
    for block in blocks:
        if block:
            near = F.arrow_udf(_closest(np.array([i for i, _ in block], np.int64), np.array([v for _, v in block], float)),
                               "struct<d2: double, id: bigint>")
            one = F.when(F.col(vec_col).isNotNull(), near(F.coalesce(vec_col, F.array(*[F.lit(0.0)] * len(block[0][1])))))
            found = one if found is None else F.least(found, one)
    if found is None:
        raise ValueError("assign_nearest needs a centre")
    return df.withColumn(out_col, found["id"].cast("int"))


# A3
def segment_profile(df: DataFrame, segment_col: str = "segment_id") -> DataFrame:
    """Per segment: size and mean recency, frequency, monthly spend and basket."""
    return df.groupBy(segment_col).agg(
        F.count(F.lit(1)).alias("size"),
        F.avg("recency_days").alias("recency"),
        F.avg("frequency_per_month").alias("freq"),
        F.avg("monetary_per_month").alias("monetary"),
        F.avg("avg_basket_value").alias("basket"),
    )


def tier_label(rank: Column) -> Column:
    labels = F.array(*[F.lit(t) for t in TIER_LABELS])
    return F.element_at(labels, F.least(rank, F.lit(len(TIER_LABELS))).cast("int"))


# W6
def value_tiers(profile: DataFrame, segment_col: str = "segment_id") -> DataFrame:
    """Rank segments by mean monthly spend (desc, ties by segment) and label them
    High, Medium-High, Medium, then Low. The profile has one row per segment."""
    w = Window.orderBy(F.col("monetary").desc(), F.col(segment_col).asc())
    ranked = profile.withColumn("tier_rank", F.row_number().over(w))
    return ranked.withColumn("value_tier", tier_label(F.col("tier_rank")))


def apply_tiers(df: DataFrame, tiers: DataFrame, segment_col: str = "segment_id") -> DataFrame:
    """Attach value_tier by segment (broadcast: one row per segment)."""
    return df.join(F.broadcast(tiers.select(segment_col, "value_tier")), segment_col, "left")


# J8
def tier_lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Map ``key`` to ``value`` through a table of one row per key; absent keys get ``default``."""
    found = df.join(table.select(key, F.col(value).alias("_found")), key, "left")
    return found.withColumn(value, F.coalesce(F.col("_found"), F.lit(default))).drop("_found")


def segment_customers(features: DataFrame, params: Params, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """M1-M3 + A3 + W6: (segments customer_id/segment_id/value_tier, the k-selection frame)."""
    # Checkpointed (lineage cut at the shared folder) and cached on top: every iteration passes over
    # them, and a lost executor's partitions are re-read from the checkpoint, not recomputed from
    # the feature joins and shuffles.
    vectors = materialize(cluster_vectors(features)).persist()
    try:
        if k is None:
            k, frame = choose_k(vectors, params)
        else:
            frame = vectors.sparkSession.createDataFrame(
                [(int(k), None, None, True)], "k int, silhouette double, training_cost double, chosen boolean")
        # Reliable checkpoint in the shared checkpoint folder: cuts the fit's lineage, so a lost
        # executor re-reads the segment ids instead of re-running the restarts.
        seg = materialize(fit_segments(vectors, k, params))
    finally:
        vectors.unpersist()
    prof = segment_profile(features.join(seg, "customer_id"), "segment_id")
    tiers = value_tiers(prof, "segment_id")
    return apply_tiers(seg, tiers, "segment_id").select("customer_id", "segment_id", "value_tier"), frame
