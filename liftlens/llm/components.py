"""Connected components: spanning forests over bounded blocks of edges, then star steps for what is still too large.

A task takes at most ``BLOCK`` edges and gives back a spanning forest of them in
which each node hangs on the smallest of its tree. While that leaves clearly
fewer edges, the rest is dealt into fewer blocks; once one block holds all, its
forest is the answer: two or three small jobs in all. An edge table with more
nodes than fit a block goes on by alternating large-star and small-star steps
(Kiveris et al., 2014), which end when nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u):]
    head = np.arange(len(nodes))
    while True:
        x, y = head[a], head[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[head]
        np.minimum.at(head, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (head != head[head]).any():
            head = head[head]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's edges as (node, smallest node of its tree), the smallest itself left out."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        nodes, roots = _roots(*(np.concatenate(side) for side in zip(*parts, strict=True)))
        hangs = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[hangs]), pa.array(roots[hangs])], ["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    least = least.withColumn("least", F.least("u", "least"))
    out = both.join(least, "u")
    if large:
        return out.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
    centre = least.select("u", F.col("least").alias("v"))
    return out.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(centre).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): component is the smallest node reachable."""
    e = edges.where("u <> v").select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).checkpoint()
    n = e.count()
    while n > BLOCK:
        e = e.repartition(-(-n // BLOCK)).mapInArrow(_forest, "u bigint, v bigint").distinct().checkpoint()
        left = e.count()
        if 10 * left > 7 * n:
            e = _by_stars(e)
            break
        n = left
    else:
        e = e.coalesce(1).mapInArrow(_forest, "u bigint, v bigint").checkpoint()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _by_stars(e: DataFrame) -> DataFrame:
    """Each node with the smallest of its component, by checkpointed pairs of star steps."""
    seen = None
    while True:
        e = _star(_star(e, True), False).checkpoint()
        sign = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sign == seen:
            return e
        seen = sign
