"""Benchmark decontamination: word-pair seeds, then Smith-Waterman alignment.

Texts are lower-cased words of letters and digits. Test items are taken in
blocks of at most ITEMS_PER_BLOCK items and BLOCK_BYTES bytes of text, each block
against all documents (a stated query set):

1. the seeds of an item are its ordered pairs of words next to each other or one
   word apart (an item under SEED words: its whole run); one pass counts how often
   each occurs, as such a pair, in the whole corpus;
2. an alignment of ``least`` and more holds a known number of seeds (see
   :func:`_bounds`), each at its own place of the item and of the document. Half
   that number of an item's places, those with the commonest seeds, are passed
   over; the rest of the number must still be met, so that no alignment is lost;
3. in a second pass the documents' seeds are counted along each text; where an
   item meets its number within the longest reach of an alignment, a window takes
   all that such an alignment could cover; overlapping windows merge, and a
   Smith-Waterman alignment (match 2, else -1, gap -1) scores item against window.

``score`` is the alignment's score over that of an exact copy. Pairs of at least
``least`` are returned. Texts never move between tasks.

Null or empty items match nothing, as do null or empty documents. Repeated rows
give repeated pairs; items with equal ids are one item each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import PUNCT, mix, shingles, slices, words

SEED = 4  # words from which an item is sought by pairs
LEAST = 0.5
ITEMS_PER_BLOCK, BLOCK_BYTES = 2_000, 4 << 20
MATCH, MISS, GAP = 2, -1, -1
CELLS = 1 << 21  # cells of one alignment matrix batch row


def _words(column: pa.Array):
    return words(pc.utf8_lower(pc.fill_null(column, "")), PUNCT)


def _kind(n: int) -> int:
    """0: an item of ``n`` words is sought by pairs; else by its whole run of so many words."""
    return 0 if n >= SEED else n


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + np.uint64(0x9E3779B97F4A7C15)) + b)


def _bounds(n: int, least: float) -> tuple[int, int]:
    """(pairs, document words) that an alignment of an item of ``n`` words with a score of ``least`` has at least, at most.

    M matches with X errors score 2 M - X >= s. Of the M - 1 steps from match to match those with two errors and more
    are at most X / 2 <= M - s / 2, so s / 2 - 1 steps have one error or none: they go one or two words on in both
    texts. In the document the alignment takes at most M + X <= 3 M - s words.
    """
    if _kind(n):
        return 1, n
    s = math.ceil(MATCH * n * least - 1e-9)
    return max(1, math.ceil(s / 2) - 1), max(n, 3 * n - s)


@dataclass
class Items:
    """A block of test items: ids, word hashes, and seeds sorted by hash with their item and position.

    ``need``: places of each item that a document must meet within ``reach`` words.
    """

    ids: np.ndarray
    words: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    need: np.ndarray
    reach: np.ndarray

    def thinned(self, counts: dict[int, int], least: float) -> Items:
        """Without the commonest places of each item, half as many as an alignment of ``least`` is sure to meet."""
        keep = np.ones(len(self.seeds), bool)
        n = np.array([counts.get(int(i), 0) for i in range(len(self.seeds))], np.int64)
        bounds = [_bounds(len(w), least) for w in self.words]
        need = np.array([b[0] for b in bounds], np.int64)
        for i in range(len(self.ids)):
            own = np.flatnonzero(self.item == i)
            cost = np.bincount(self.place[own], n[own])
            passed = need[i] // 2
            keep[own] = ~np.isin(self.place[own], np.argsort(-cost, kind="stable")[:passed])
            need[i] -= passed
        return Items(self.ids, self.words, self.seeds[keep], self.item[keep], self.place[keep], need,
                     np.array([b[1] for b in bounds], np.int64))


def _seeds(ids: list, texts: list) -> Items:
    w = _words(pa.array(texts, pa.string()))
    runs = [w.hashes[w.ptr[i]:w.ptr[i + 1]] for i in range(len(texts))]
    made, places = [], []
    for r in runs:
        if _kind(len(r)) or not len(r):
            made.append(shingles(r, len(r)))
            places.append(np.zeros(len(made[-1]), np.int64))
        else:
            made.append(np.concatenate([_pair(r[:-1], r[1:]), _pair(r[:-2], r[2:])]))
            places.append(np.concatenate([np.arange(len(r) - 1), np.arange(len(r) - 2)]))
    h = np.concatenate(made) if made else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(made)), [len(m) for m in made])
    place = np.concatenate(places) if made else np.zeros(0, np.int64)
    order = np.lexsort((place, item, h))
    none = np.zeros(len(ids), np.int64)
    return Items(np.array(ids, np.int64), runs, h[order], item[order], place[order], none, none)


def _blocks(items: DataFrame) -> Iterator[Items]:
    """The items in bounded blocks, one block on the driver at a time."""
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint"), "text")
    ids, texts, size = [], [], 0
    for r in rows.toLocalIterator(prefetchPartitions=False):
        if ids and (len(ids) >= ITEMS_PER_BLOCK or size + len(r["text"]) > BLOCK_BYTES):
            yield _seeds(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"]), texts.append(r["text"])
        size += len(r["text"])
    if ids:
        yield _seeds(ids, texts)


def _runs(w, kinds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions in the slice) of the pairs (kind 0) and of the runs of so many words, none across texts."""
    text = np.repeat(np.arange(len(w.ptr) - 1), np.diff(w.ptr))
    for kind in kinds.tolist():
        for far in (1, 2) if kind == 0 else (kind - 1,):
            n = len(w.hashes) - far
            if n < 1:
                continue
            h = _pair(w.hashes[:n], w.hashes[far:]) if kind == 0 else shingles(w.hashes, kind)
            at = np.flatnonzero(text[:n] == text[far:])
            yield h[at], at


def _hits(w, seeds: np.ndarray, sizes: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in the slice, index of the first equal seed) of every seed met."""
    at_all, seed_all = [], []
    for h, at in _runs(w, sizes):
        maybe = np.flatnonzero(near[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        i = np.searchsorted(seeds, h[maybe])
        ok = (i < len(seeds)) & (seeds[np.minimum(i, len(seeds) - 1)] == h[maybe])
        at_all.append(at[maybe[ok]])
        seed_all.append(i[ok])
    return np.concatenate(at_all or [np.zeros(0, np.int64)]), np.concatenate(seed_all or [np.zeros(0, np.int64)])


def _near(seeds: np.ndarray) -> np.ndarray:
    near = np.zeros(1 << 20, bool)
    near[(seeds & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return near


def _sizes(items: Items) -> np.ndarray:
    return np.unique([_kind(len(r)) for r in items.words if len(r)])


def seed_counts(docs: DataFrame, items: Items) -> dict[int, int]:
    """How often each seed of the block occurs in the whole corpus (by the index of its first equal seed)."""
    sent = docs.sparkSession.sparkContext.broadcast((items.seeds, _sizes(items)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, sizes = sent.value
        near, total = _near(seeds), np.zeros(len(seeds), np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                _, seed = _hits(_words(batch.column(0).slice(a, b - a)), seeds, sizes, near)
                total += np.bincount(seed, minlength=len(seeds))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["seed", "n"])

    rows = docs.select("text").mapInArrow(count, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).collect()
    known = {r["seed"]: r["n"] for r in rows}  # at most one row per seed of the block
    first = np.searchsorted(items.seeds, items.seeds)
    return {i: known.get(int(f), 0) for i, f in enumerate(first)}


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of the pairs a[i], b[i] and where in b the best alignments end (exclusive)."""
    m, n = max(map(len, a)), max(map(len, b))
    x, y = np.zeros((len(a), m), np.uint64), np.ones((len(b), n), np.uint64)
    on_x, on_y = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        x[i, :len(p)], on_x[i, :len(p)] = p, True
        y[i, :len(q)], on_y[i, :len(q)] = q, True
    above = np.zeros((len(a), n + 1), np.int32)
    best, end = np.zeros(len(a), np.int32), np.zeros(len(a), np.int64)
    slope = -GAP * np.arange(n + 1, dtype=np.int32)
    for i in range(m):
        same = (x[:, i:i + 1] == y) & on_x[:, i:i + 1] & on_y
        row = np.zeros_like(above)
        row[:, 1:] = np.maximum(above[:, :-1] + np.where(same, MATCH, MISS), above[:, 1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope, axis=1) - slope  # gaps in the item
        at = row.argmax(axis=1)
        top = row[np.arange(len(a)), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
        above = row
    return best, end


def _batches_of(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """Pair indices in order of length, so many at once that a matrix row stays under CELLS cells."""
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    at = 0
    while at < len(order):
        stop = at + 1
        wide = len(pairs[order[at]][1])
        while stop < len(order):
            wide = max(wide, len(pairs[order[stop]][1]))
            if (stop + 1 - at) * wide > CELLS // 8 or len(pairs[order[stop]][0]) > 2 * len(pairs[order[at]][0]) + 8:
                break
            stop += 1
        yield np.array(order[at:stop])
        at = stop


def _windows(w, items: Items, hits: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(text, item, first word, end) of merged windows around the seeds, word positions in the slice."""
    at, first = hits
    if not len(at):
        return []
    last = np.searchsorted(items.seeds, items.seeds[first], side="right")
    n = last - first
    at = np.repeat(at, n)
    item = items.item[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    # the distinct places met, by item and then along the texts
    met = np.unique(item * np.int64(len(w.hashes)) + at)
    item, at = np.divmod(met, len(w.hashes))
    text = np.searchsorted(w.ptr, at, side="right") - 1
    # those among as many as the item needs, within its reach
    begin = np.arange(len(met))
    stop = begin + items.need[item] - 1
    end = np.minimum(stop, len(met) - 1)
    full = (stop == end) & (item[end] == item) & (text[end] == text) & (at[end] - at < items.reach[item])
    marks = np.bincount(begin[full], minlength=len(met) + 1) - np.bincount(end[full] + 1, minlength=len(met) + 1)
    among = np.cumsum(marks[:-1]) > 0
    item, at, text = item[among], at[among], text[among]
    low = np.maximum(at - items.reach[item], w.ptr[text])
    high = np.minimum(at + items.reach[item], w.ptr[text + 1])
    out: list[tuple[int, int, int, int]] = []
    for t, i, a, b in sorted(zip(text.tolist(), item.tolist(), low.tolist(), high.tolist(), strict=True)):
        if out and out[-1][:2] == (t, i) and a <= out[-1][3]:
            out[-1] = (t, i, out[-1][2], max(b, out[-1][3]))
        else:
            out.append((t, i, a, b))
    return out


def _found(column: pa.Array, items: Items, near: np.ndarray, sizes: np.ndarray, least: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, end) of the best alignment of every pair that reaches ``least``."""
    w = _words(column)
    windows = _windows(w, items, _hits(w, items.seeds, sizes, near))
    pairs = [(items.words[i], w.hashes[a:b]) for _, i, a, b in windows]
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for group in _batches_of(pairs):
        scores, ends = align([pairs[g][0] for g in group], [pairs[g][1] for g in group])
        full = np.array([MATCH * len(pairs[g][0]) for g in group])
        good = np.flatnonzero(scores / full >= least)
        if not len(good):
            continue
        # the start: the same alignment read backwards from its end
        _, back = align([pairs[group[g]][0][::-1] for g in good], [pairs[group[g]][1][:ends[g]][::-1] for g in good])
        for g, r in zip(good, back, strict=True):
            t, i, a, _ = windows[group[g]]
            start, end = a + int(ends[g]) - int(r), a + int(ends[g])
            new = (float(scores[g] / full[g]), start - int(w.ptr[t]), end - int(w.ptr[t]))
            if (t, i) not in best or new[0] > best[t, i][0]:
                best[t, i] = new
    return sorted((t, i, *v) for (t, i), v in best.items())


def leaks(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): documents that hold a copy of a test item, exact or edited.

    ``docs`` (doc_id, text), ``items`` (item_id, text); other columns are ignored. Word positions count from 0, the last is inclusive.
    """
    docs = docs.select("doc_id", "text")
    schema = "doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items):
        thin = block.thinned(seed_counts(docs, block), least)
        sent = docs.sparkSession.sparkContext.broadcast(vars(thin))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Items(**sent.value)
            near, sizes = _near(own.seeds), _sizes(own)
            for batch in batches:
                for a, b in slices(batch.column(1)):
                    found = _found(batch.column(1).slice(a, b - a), own, near, sizes, least)
                    ids = batch.column(0).slice(a, b - a).to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[f[0]] for f in found], pa.int64()), pa.array([int(own.ids[f[1]]) for f in found], pa.int64()),
                         pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64()),
                         pa.array([f[4] - 1 for f in found], pa.int64())], ["doc_id", "item_id", "score", "first_word", "last_word"])

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def clean_of(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """Rows of ``docs`` that hold no test item; all columns are kept."""
    for block in _blocks(items):
        thin = block.thinned(seed_counts(docs, block), least)
        sent = docs.sparkSession.sparkContext.broadcast(vars(thin))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Items(**sent.value)
            near, sizes = _near(own.seeds), _sizes(own)
            for batch in batches:
                for a, b in slices(batch.column("text")):
                    part = batch.slice(a, b - a)
                    keep = np.ones(b - a, bool)
                    keep[np.array([f[0] for f in _found(part.column("text"), own, near, sizes, least)], np.int64)] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds, exactly or edited."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
