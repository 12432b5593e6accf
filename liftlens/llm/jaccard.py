"""Exact Jaccard join of word n-gram sets by signature trees, and its connected classes.

Every document becomes its set of distinct ``size``-word shingles (fewer
words: the whole run as one). Two sets link when
``100 * |A & B| >= percent * |A | B|``. Steps, each a Spark stage over all rows:

1. *Order.* One fixed-size table counts shingles by hash cell over the whole
   corpus. It only fixes a global order (crowded cells last, then by hash), so
   collisions cost time, never links.
2. *Classes.* Equal sets collapse to one class (pre-aggregated per task). A
   class keeps its size, its prefix (the first ``n - ceil(0.8 n) + 1`` shingles
   in that order: linked sets share one), minimum hashes and a token bitmap.
3. *Merging.* Classes that share a minimum hash are compared with one centre
   per hash; verified links merge classes into first components.
4. *Signature trees.* Prefix tokens shared by several components form groups,
   cut into blocks sorted by size. A block is a tree: its root, inner nodes
   and leaves hold OR-combined bitmaps and size ranges. Pairs of blocks, then of
   nodes, then of members are traversed together; a pair of nodes is dropped
   when its largest possible overlap is too small for any link, or when all of
   both sides are in one component already.
   A tree gives a spanning forest of the surviving pairs, not the pairs.
5. *Verification.* Classes joined by these forests form families. Blocks of a
   family meet as trees again, now over the full sets made anew from the texts,
   and each pair that the bitmaps leave is compared on the spot. Then components.

Links inside one component need not all be enumerated; no link between two
components is lost, because step 4 starts from every prefix token. A hot
shingle, source or group of copies never has to fit one task: groups are
windows that spill, blocks have a fixed size, and joins are ones that Spark
splits. Shingles are 64-bit hashes.

Null or wordless text: no shingles, linked with nothing. Repeated rows stay and
share a class. Null ids stay and are never a component's id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected_components
from .skew import lookup
from .storage import new_path, release, remove, staged
from .text import free, mix, shingles, slices, words

CELLS = 1 << 20  # cells of the order table (1 byte each when sent to tasks)
CELL_RANGES = 64  # ranges of cells, each added up by one task
BLOCK = 4096  # members of a signature tree
LEAF = 16  # members under one inner node
STRIP = 1 << 22  # bytes of bitmaps compared at a time
BLOCK_SHINGLES = 1 << 21  # shingles of a block of full sets (16 MB)
MIN_HASHES = 4
TEXT_KEY = 16  # bytes of a text's SHA-256 that tell rows of one doc_id apart


def _order_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Shingle counts by hash cell over all documents: CELLS numbers, added up in CELL_RANGES ranges by the executors."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                w = words(batch.column(0).slice(a, b - a))
                if not len(w.hashes):
                    continue
                found = [np.unique(shingles(w.hashes[w.ptr[i]:w.ptr[i + 1]], size)) for i in range(b - a)]
                total += np.bincount((np.concatenate(found) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).astype(np.uint32)
        held = [(i, part.tobytes()) for i, part in enumerate(np.split(total, CELL_RANGES)) if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.array([c for _, c in held], pa.binary())], ["part", "cells"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // CELL_RANGES, np.uint32)
        for c in table["cells"]:
            total += np.frombuffer(c.as_buffer(), np.uint32)
        return pa.table({"part": table["part"][:1], "cells": pa.array([total.tobytes()], pa.binary())})

    counts = np.zeros((CELL_RANGES, CELLS // CELL_RANGES), np.uint32)
    added = docs.select("text").mapInArrow(cells, "part bigint, cells binary").groupBy("part").applyInArrow(add, "part bigint, cells binary")
    for part, held in added.collect():
        counts[part] = np.frombuffer(held, np.uint32)
    return counts.reshape(-1)


def order_levels(docs: DataFrame, size: int) -> np.ndarray:
    """For each hash cell, how crowded it is: 0 while its count may be chance, then one more per doubling of the excess."""
    counts = _order_counts(docs, size).astype(np.float64)
    mean = counts.mean()
    chance = 8 * max(mean, 1.0) ** 0.5
    return np.floor(1 + np.log2(np.maximum((counts - mean) / chance, 0.5))).astype(np.uint8)


def shingle_sets(docs: DataFrame, levels: np.ndarray, size: int, percent: int) -> DataFrame:
    """Per row: a row number, doc_id, key of the text, n, digest of the set and, once per task for equal sets, prefix, min hashes and bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    odd = mix(np.arange(1, MIN_HASHES + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lev, seen, row = sent.value, set(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in slices(batch.column(1)):
                w = words(batch.column(1).slice(a, b - a))
                rows = np.arange(row, row + b - a)
                row += b - a
                keys, ns, digests, prefixes, mins, bits = [], [], [], [], [], []
                for i in range(b - a):
                    keys.append(hashlib.sha256(w.data[w.offsets[i]:w.offsets[i + 1]]).digest()[:TEXT_KEY])
                    s = np.unique(shingles(w.hashes[w.ptr[i]:w.ptr[i + 1]], size))
                    n = len(s)
                    ns.append(n)
                    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None
                    digests.append(d)
                    if d is None or d in seen:
                        prefixes.append(None), mins.append(None), bits.append(None)
                        continue
                    seen.add(d)
                    keep = n - -(-percent * n // 100) + 1
                    level = lev[(s % np.uint64(CELLS)).astype(np.int64)]
                    low = s[level == 0]
                    if len(low) < keep:
                        low = s[np.argsort(level, kind="stable")]
                    prefixes.append(low[:keep].astype(np.int64))
                    mins.append(np.array([mix(s * o).min() for o in odd]).astype(np.int64))
                    bits.append(bitmap(s).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), batch.column(0).slice(a, b - a), pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(prefixes, pa.list_(pa.int64())), pa.array(mins, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    ["row", "doc_id", "tkey", "n", "digest", "prefix", "mins", "bits"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "row bigint, doc_id bigint, tkey binary, n bigint, digest binary, prefix array<bigint>, mins array<bigint>, bits binary")


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bits set by a set's hashes; the length is the power of two from twice the set's size up (64 at least)."""
    m = max(64, 1 << (2 * len(s) - 1).bit_length())
    out = np.zeros(m, bool)
    out[(mix(s) & np.uint64(m - 1)).astype(np.int64)] = True
    return np.packbits(out)


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (in the last axis) at a smaller power-of-two length: the OR of their parts."""
    while (half := bits.shape[-1] // 2) >= size:
        bits = bits[..., :half] | bits[..., half:]
    return bits


def _least_overlap(na, nb, percent: int):
    """Smallest intersection with which sets of these sizes link."""
    return -(-percent * (na + nb) // (100 + percent))


class SignatureTree:
    """Members sorted by size; leaves under inner nodes of LEAF members at most, with OR-combined bitmaps and size ranges.

    A node holds bitmaps of one length only. One that was cut to a smaller
    member's length would be nearly full and rule nothing out.
    """

    def __init__(self, n: np.ndarray, bits: list[bytes], comp: np.ndarray):
        self.n, self.comp = n, comp
        lengths = np.array([len(x) for x in bits])
        runs = [*np.flatnonzero(np.diff(lengths, prepend=-1)).tolist(), len(n)]
        self.spans = [(s, min(s + LEAF, end)) for start, end in zip(runs, runs[1:]) for s in range(start, end, LEAF)]
        self.bits = [np.stack([np.frombuffer(x, np.uint8) for x in bits[a:b]]).view(np.uint64) for a, b in self.spans]
        self.ors = [np.bitwise_or.reduce(x)[None] for x in self.bits]
        self.widths = np.array([x.shape[1] for x in self.bits])
        self.low = np.array([n[a:b].min() for a, b in self.spans])
        self.high = np.array([n[a:b].max() for a, b in self.spans])
        self.one = [comp[a] if (comp[a:b] == comp[a]).all() else None for a, b in self.spans]


def _max_overlap(n, bits, other):
    """Most elements of a set of size n that can lie in ``other``: each bit absent there is an element missing."""
    return n - np.bitwise_count(bits & ~other).sum(axis=-1).astype(np.int64)


def _common_bits(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Matrix of the bits that each of ``xs`` shares with each of ``ys``."""
    return np.bitwise_count(xs[:, None, :] & ys[None, :, :]).sum(axis=-1, dtype=np.int64)


def _strips(nodes: np.ndarray, widths: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of nodes whose bitmaps are equally long, at most STRIP bytes of a comparison with one node each."""
    for width in np.unique(widths[nodes]):
        own = nodes[widths[nodes] == width]
        step = max(1, STRIP // (8 * int(width) * LEAF * LEAF))
        for k in range(0, len(own), step):
            yield own[k:k + step]


def traverse(x: SignatureTree, y: SignatureTree, same: bool, percent: int, accept=None) -> Iterator[tuple[int, np.ndarray]]:
    """Dual traversal: (member of x, members of y), edges of a spanning forest over the pairs that may link.

    Without ``accept`` every pair of different components that sizes and bitmaps
    allow counts, and members joined by such pairs end up joined by the edges.
    With ``accept(r, ys)``, the exact test, only pairs that it confirms count and
    members of one component are joined from the start. Nodes and members that
    are joined already are not compared again.
    """
    comps = x.comp if same else np.concatenate([x.comp, y.comp])
    joined = np.arange(len(comps)) if accept is None else np.unique(comps, return_inverse=True)[1].astype(np.int64)
    jx = joined[:len(x.n)]
    jy = jx if same else joined[len(x.n):]
    firsts = np.array([c for c, _ in y.spans])
    for i, (a, b) in enumerate(x.spans):
        # sizes: J >= t needs the smaller to be at least t of the larger
        near = (100 * x.high[i] >= percent * y.low) & (100 * y.high >= percent * x.low[i])
        if same:
            near[:i] = False
        if (jx[a:b] == jx[a]).all():
            near &= (np.minimum.reduceat(jy, firsts) != jx[a]) | (np.maximum.reduceat(jy, firsts) != jx[a])
        if x.one[i] is not None:
            near &= np.array([c != x.one[i] for c in y.one])
        nx, cx = x.n[a:b, None], x.comp[a:b, None]
        for js in _strips(np.flatnonzero(near), y.widths):
            width = min(x.widths[i], y.widths[js[0]])
            xb = fold(x.bits[i], width)
            absent = nx - np.bitwise_count(xb).sum(axis=-1, dtype=np.int64)[:, None]
            # members of the one node against the ORs of the others, at the others' smallest sizes
            able = absent + _common_bits(xb, np.concatenate([fold(y.ors[j], width) for j in js])) >= _least_overlap(nx, y.low[js], percent)
            js = js[able.any(axis=0)]
            if not len(js):
                continue
            ys = np.concatenate([np.arange(*y.spans[j]) for j in js])
            yb = np.concatenate([fold(y.bits[j], width) for j in js])
            ok = (jy[ys] != jx[a:b, None]) & (y.comp[ys] != cx)
            if same:
                ok &= ys > np.arange(a, b)[:, None]
            use = ok.any(axis=0)
            if not use.any():
                continue
            ys, yb, ok = ys[use], yb[use], ok[:, use]
            common = _common_bits(xb, yb)
            most = np.minimum(absent + common, y.n[ys] - np.bitwise_count(yb).sum(axis=-1, dtype=np.int64) + common)
            ok &= most >= _least_overlap(nx, y.n[ys], percent)
            for k in np.flatnonzero(ok.any(axis=1)):
                r, left = a + k, ys[ok[k]]
                left = left[jy[left] != jx[r]]
                if accept is not None and len(left):
                    left = left[accept(r, left)]
                if not len(left):
                    continue
                others, at = np.unique(jy[left], return_index=True)
                own = jx[r]
                for other in others:
                    joined[joined == other] = own
                yield r, left[at]


def _block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of blocks of one token that may hold a link: roots' size ranges and components are compared."""
    root = members.groupBy("token", F.col("at").alias("block")).agg(F.min("n").alias("low"), F.max("n").alias("high"),
                                                 F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    other = root.select("token", *[F.col(c).alias(f"{c}_2") for c in ("block", "low", "high", "c0", "c1")])
    return root.join(other, "token").where(
        (F.col("block") <= F.col("block_2")) & (100 * F.col("high") >= percent * F.col("low_2"))
        & ~((F.col("c0") == F.col("c1")) & (F.col("c0_2") == F.col("c1_2")) & (F.col("c0") == F.col("c0_2")))
    ).select("token", "block", "block_2")


def _sides(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The members of both blocks (side 0 and 1) of each pair; a block with itself comes once."""
    sides = pairs.select("token", "block", "block_2", F.lit(0).alias("side"), F.col("block").alias("at")).unionByName(
        pairs.where("block <> block_2").select("token", "block", "block_2", F.lit(1).alias("side"), F.col("block_2").alias("at")))
    return sides.join(members, ["token", "at"])


def candidate_edges(sets: DataFrame, classes: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that join every two classes of different components which the signature trees can't rule out.

    A tree gives a spanning forest of its surviving pairs, so its rows are fewer
    than its members however many pairs survive.
    """
    by_token = Window.partitionBy("token")
    own = sets.where("prefix IS NOT NULL")
    tokens = own.select(F.explode("prefix").alias("token"), "row")
    shared = tokens.withColumn("holders", F.count("*").over(by_token)).where("holders > 1").select("token", "row")
    known = own.select("row", "digest").join(classes.join(comps, "cls").select("digest", "cls", "n", "comp"), "digest").drop("digest")
    placed = shared.join(known, "row").select("token", "comp", "cls", "n")
    # the windows and the grouping below share one exchange by token
    open_groups = placed.withColumn("c0", F.min("comp").over(by_token)).withColumn("c1", F.max("comp").over(by_token)) \
        .where("c0 < c1").groupBy("token", "comp", "cls", "n").agg(F.lit(1)).select("token", "comp", "cls", "n").checkpoint()
    open_groups = open_groups.withColumn("group_n", F.count("*").over(by_token))
    leaf = open_groups.where(F.col("group_n") <= LEAF).drop("group_n")
    other = leaf.select("token", *[F.col(c).alias(f"{c}_2") for c in ("comp", "cls", "n")])
    leaf_pairs = leaf.join(other, "token").where(
        (F.col("cls") < F.col("cls_2")) & (F.col("comp") != F.col("comp_2"))
        & (100 * F.col("n") >= percent * F.col("n_2")) & (100 * F.col("n_2") >= percent * F.col("n"))
    ).select(F.col("cls").alias("a"), F.col("cls_2").alias("b")).distinct()

    place = F.row_number().over(by_token.orderBy("n", "cls"))
    members = open_groups.where(F.col("group_n") > LEAF).drop("group_n").withColumn("at", F.floor((place - 1) / BLOCK))
    pairs = _block_pairs(members, percent).checkpoint()  # three numbers per pair of blocks; the plan below stays short
    both = _sides(pairs, members).join(classes.select("cls", "bits"), "cls")

    def join_blocks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        trees = []
        for side in (0, 1):
            t = table.filter(pc.equal(table["side"], side)).sort_by([("n", "ascending"), ("cls", "ascending")])
            trees.append((t["cls"].to_numpy(), SignatureTree(t["n"].to_numpy(), t["bits"].to_pylist(), t["comp"].to_numpy()))
                         if len(t) else None)
        (ids, x), other = trees[0], trees[1]
        ids2, y = other or (ids, x)
        found_a, found_b = [], []
        for r, ys in traverse(x, y, other is None, percent):
            found_a.append(np.full(len(ys), ids[r]))
            found_b.append(ids2[ys])
        a = np.concatenate(found_a) if found_a else np.zeros(0, np.int64)
        b = np.concatenate(found_b) if found_b else np.zeros(0, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    tree_edges = both.groupBy("token", "block", "block_2").applyInArrow(join_blocks, "a bigint, b bigint")
    # a group of at most LEAF members has no inner node to prune; its pairs meet the bitmaps once for all their tokens
    return _may_link(leaf_pairs, classes, percent).unionByName(tree_edges.distinct())


def centre_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): every class with the smallest class that shares one of its minimum hashes."""
    keys = classes.select(F.posexplode("mins").alias("k", "h"), "cls")
    centre = keys.groupBy("k", "h").agg(F.min("cls").alias("a"), F.count("*").alias("c")).where("c > 1")
    return keys.join(centre, ["k", "h"]).where("a < cls").select("a", F.col("cls").alias("b")).distinct()


def _may_link(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and bitmaps allow a link."""
    c = classes.select("cls", "n", "bits")
    sized = pairs.join(c.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x")), "a") \
        .join(c.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y")), "b") \
        .where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "x", "y")), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                x, y = fold(x, len(y)), fold(y, len(x))
                most = min(_max_overlap(na, x, y), _max_overlap(nb, y, x))
                keep.append(bool(most >= _least_overlap(na, nb, percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sized.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes those whose full sets link, or enough of them to connect the same classes.

    Pairs meet in families (components of the pairs), cut into blocks of about
    BLOCK_SHINGLES shingles in the order of their minimum hashes (which keeps
    likely partners together), so that a text moves once for each pair of blocks,
    not of classes. Classes that other links of the same pair of blocks connect
    already aren't compared.
    """
    pairs = pairs.checkpoint()
    family = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    before = F.sum("n").over(Window.partitionBy("component").orderBy("mins", "node")) - F.col("n")
    members = family.join(classes.select(F.col("cls").alias("node"), "n", "mins"), "node") \
        .withColumn("block", F.floor(before / BLOCK_SHINGLES)).checkpoint()
    left = members.select(F.col("node").alias("a"), "component", F.col("block").alias("p"))
    right = members.select(F.col("node").alias("b"), F.col("block").alias("q"))
    groups = max(1, members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BLOCK_SHINGLES)
    key = F.pmod(F.xxhash64("component", F.least("p", "q"), F.greatest("p", "q")), F.lit(groups))
    meet = pairs.join(left, "a").join(right, "b").select(key.alias("key"), "a", "b").checkpoint()
    need = meet.select("key", F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "owner", "digest"), "cls")
    texts = _texts_of(docs, need.select("owner"))
    rows = need.join(texts, "owner").select("key", F.col("cls").alias("a"), F.lit(None).cast("bigint").alias("b"), "digest", "text") \
        .unionByName(meet.select("key", "a", "b"), allowMissingColumns=True)

    def check(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        loaded = table.filter(pc.is_valid(table["text"])).combine_chunks()
        sets = {}
        for cls, digest, text in zip(loaded["a"].to_pylist(), loaded["digest"].to_pylist(), loaded["text"], strict=True):
            if cls not in sets:
                s = np.unique(shingles(words(pa.array([text.as_py()])).hashes, size))
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digest:
                    sets[cls] = s
        asked = table.filter(pc.is_valid(table["b"]))
        found, head = [], {}

        def top(c: int) -> int:
            while head.get(c, c) != c:
                head[c] = c = head.get(head[c], head[c])
            return c

        for a, b in zip(asked["a"].to_pylist(), asked["b"].to_pylist(), strict=True):
            p, q = top(a), top(b)
            if p == q:
                continue
            x, y = sets[a], sets[b]
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                found.append((a, b))
                head[p] = q
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return rows.groupBy("key").applyInArrow(check, "a bigint, b bigint")


def family_links(edges: DataFrame, classes: DataFrame, comps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links between classes of different components, enough of them to connect all that links connect.

    Classes joined by candidate ``edges`` form families, cut into blocks of about
    BLOCK_SHINGLES shingles by size. Every two blocks of a family
    that their roots allow meet as signature trees over the full sets, made anew
    from the texts; the pairs that the trees leave are compared exactly on the
    spot, so that pairs never become rows.
    """
    family = connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = classes.select("cls", "n").join(comps, "cls")
    before = F.sum("n").over(Window.partitionBy("component").orderBy("n", "comp", "node")) - F.col("n")
    members = family.join(known.withColumnRenamed("cls", "node"), "node") \
        .select(F.col("component").alias("token"), F.col("node").alias("cls"), "n", "comp", F.floor(before / BLOCK_SHINGLES).alias("at")).checkpoint()
    need = _sides(_block_pairs(members, percent), members).checkpoint()
    groups = max(1, need.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BLOCK_SHINGLES)
    need = need.withColumn("key", F.pmod(F.xxhash64("token", "block", "block_2"), F.lit(groups))) \
        .join(classes.select("cls", "owner", "digest", "bits"), "cls")
    rows = need.join(_texts_of(docs, need.select("owner")), "owner") \
        .select("key", "token", "block", "block_2", "side", "cls", "n", "comp", "digest", "bits", "text")

    def check(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        meets: dict[tuple, tuple[dict, dict]] = {}
        for batch in table.to_batches():
            texts = batch.column("text")
            for i, (token, p, q, side, cls, digest) in enumerate(zip(
                    *(batch.column(c).to_pylist() for c in ("token", "block", "block_2", "side", "cls", "digest")), strict=True)):
                own = meets.setdefault((token, p, q), ({}, {}))[side]
                if cls in own:
                    continue
                s = np.unique(shingles(words(texts.slice(i, 1)).hashes, size))
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digest:
                    own[cls] = s, batch.column("bits")[i].as_py(), batch.column("comp")[i].as_py()
        found = [pair for sides in meets.values() for pair in _links_of(sides, percent)]
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return rows.groupBy("key").applyInArrow(check, "a bigint, b bigint")


def _links_of(sides: tuple[dict, dict], percent: int) -> Iterator[tuple[int, int]]:
    """Links between two blocks (an empty second side: within the first), each {class: (set, bitmap, component)}."""
    ordered = [sorted(side, key=lambda c: (len(side[c][0]), c)) for side in sides if side]
    trees = [SignatureTree(np.array([len(side[c][0]) for c in ids]), [side[c][1] for c in ids], np.array([side[c][2] for c in ids]))
             for ids, side in zip(ordered, sides)]
    every = [side[c][0] for ids, side in zip(ordered, sides) for c in ids]
    place = np.unique(np.concatenate(every), return_inverse=True)[1]
    local = np.split(place, np.cumsum([len(s) for s in every])[:-1])
    same = len(trees) == 1
    x, y = trees[0], trees[-1]
    ys_from = 0 if same else len(x.n)
    held = np.zeros(place.max() + 1, bool)

    def accept(r: int, ys: np.ndarray) -> np.ndarray:
        held[local[r]] = True
        parts = [local[ys_from + k] for k in ys]
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        common = np.add.reduceat(held[np.concatenate(parts)].astype(np.int64), starts)
        held[local[r]] = False
        return 100 * common >= percent * (x.n[r] + y.n[ys] - common)

    for r, ys in traverse(x, y, same, percent, accept):
        for k in ys:
            yield ordered[0][r], ordered[-1][k]


FILTER_BITS = 1 << 23
MAP_BITS = 1 << 15  # bits of one of Spark's bitmaps


def _texts_of(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """(owner, text): texts of the owners, and perhaps of a few other documents.

    A bit filter of fixed size over the owners keeps other texts from being
    shuffled; the join that follows is exact whatever the filter lets through.
    Equal rows come once per task.
    """
    bit = F.pmod("owner", F.lit(FILTER_BITS))
    marks = np.zeros((FILTER_BITS // MAP_BITS, MAP_BITS // 8), np.uint8)
    maps = owners.groupBy(F.floor(bit / MAP_BITS).alias("map")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(MAP_BITS))).alias("bits"))
    for at, bits in maps.collect():
        marks[at] = np.frombuffer(bits, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.unpackbits(sent.value, bitorder="little").astype(bool), set()
        for batch in batches:
            hit = [i is not None and bool(bits[i % FILTER_BITS]) for i in batch.column(0).to_pylist()]
            part = batch.filter(pa.array(hit, pa.bool_()))
            new = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                same = (doc, hash(text))
                new.append(text is not None and same not in seen)
                seen.add(same)
            yield part.filter(pa.array(new, pa.bool_()))

    return docs.mapInArrow(run, docs.schema).select(F.col("doc_id").alias("owner"), "text")


def _members(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, tkey, n, comp, component_id) per row of ``docs``: key of its text, group of its component, the group's smallest id."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    path = new_path(spark, "sets")
    shingle_sets(docs, order_levels(docs, size), size, percent).write.parquet(path)
    sets = spark.read.parquet(path)
    named = sets.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("owner"), F.max("n").alias("n"),
        F.max(F.struct(F.col("mins").isNotNull().alias("own"), "mins", "bits")).alias("s"))
    classes = staged(named.select(F.monotonically_increasing_id().alias("cls"), "digest", "owner", "n", "s.mins", "s.bits"), "classes")
    linkable = classes.where("owner IS NOT NULL")

    first = verified(_may_link(centre_pairs(linkable), linkable, percent).checkpoint(), linkable, docs, size, percent) \
        .select(F.col("a").alias("u"), F.col("b").alias("v")).checkpoint()
    release(spark)
    comps = linkable.select("cls").join(connected_components(first), F.col("cls") == F.col("node"), "left") \
        .select("cls", F.coalesce("component", "cls").alias("comp")).checkpoint()

    rest = candidate_edges(sets, linkable, comps, percent).checkpoint()
    sets = sets.select("doc_id", "tkey", "n", "digest").checkpoint()
    remove(spark, path)
    release(spark)
    more = family_links(rest, linkable, comps, docs, size, percent)
    across = more.join(comps.select(F.col("cls").alias("a"), F.col("comp").alias("u")), "a") \
        .join(comps.select(F.col("cls").alias("b"), F.col("comp").alias("v")), "b").select("u", "v")
    merged = connected_components(across)
    final = comps.join(merged, F.col("comp") == F.col("node"), "left") \
        .select("cls", F.coalesce("component", "comp").alias("comp"))

    ids = classes.join(final, "cls", "left").select("digest", "owner", F.coalesce("comp", "cls").alias("comp"))
    least = ids.groupBy("comp").agg(F.min("owner").alias("component_id"))
    by_digest = ids.join(least, "comp").select("digest", "comp", "component_id")
    linked = sets.where("n > 0").join(by_digest, "digest").select("doc_id", "tkey", "n", "comp", "component_id")
    alone = sets.where("n = 0").select("doc_id", "tkey", "n", F.lit(None).cast("bigint").alias("comp"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Null text or no words: ``n_shingles`` 0 and a component of its own. Rows
    that repeat a doc_id are judged each by its own text. A row without an id
    links only with equal sets. Other columns are ignored.
    """
    return _members(docs, size, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` that stay: of each component one row, the one with the least doc_id, of equal ids the least text key.

    Rows that repeat an id are told apart by their texts, and a row that stands
    in the table more than once stays once. A null id comes last: such a row
    stays if no row with an id links with it. Rows without words are no copies
    of anything and stay. All columns are kept.
    """
    rows = _members(docs, size, percent).where("n > 0").select("comp", F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey").checkpoint()
    release(docs.sparkSession)
    heads = rows.groupBy("comp").agg(F.min(F.struct("no_id", "doc_id", "tkey")).alias("head"), F.count("*").alias("c"))
    placed = lookup(rows, heads.where("c > 1"), ["comp"], "c", ["head"]).where("head IS NOT NULL")
    of_head = F.struct("no_id", "doc_id", "tkey") == F.col("head")
    later = placed.where(~of_head).select("doc_id", "tkey").distinct()
    twice = placed.where(of_head).groupBy("doc_id", "tkey").count().where("count > 1")

    doc, tkey, mark = (free(n, docs.columns) for n in ("row_doc", "row_text", "row_mark"))
    fields = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*fields, F.expr(f"substring(unhex(sha2(coalesce(text, ''), 256)), 1, {TEXT_KEY})").alias(tkey))

    def is_in(table: DataFrame, how: str) -> DataFrame:
        t = table.select(F.col("doc_id").alias(doc), F.col("tkey").alias(mark))
        return keyed.join(t, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(tkey) == F.col(mark)), how)

    if twice.isEmpty():
        return is_in(later, "left_anti").select(*fields)
    once = is_in(later.unionByName(twice.select("doc_id", "tkey")), "left_anti").select(*fields)
    return once.unionByName(is_in(twice, "left_semi").dropDuplicates(["doc_id", tkey]).select(*fields))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set's size and its component over links of 0.8 and more on 5-word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
