"""Toxicity by a classifier chain of linear models.

Categories are label columns, judged in the given order: the model of a
category reads the words of the text and the probabilities of the categories
before it. In training those probabilities are out-of-fold (FOLDS folds by
hash of doc_id), so a later model sees earlier ones as wrong as they will be.

Features are presences of words and of word beginnings (4 and 5 bytes, so that
inflections share a feature), by 64-bit hash. Per category the FEATURES with the
largest chi-square over the sample are kept. Training uses at most SAMPLE
labelled documents, the least by hash of doc_id (a bound of the classifier's
training only; all documents are scored, whole). Each threshold maximises F1 of
the out-of-fold probabilities.

Labels: null label or unlabelled document: not trained on; several labels of a
document: the largest. A category without both classes has a constant
probability and never rejects. Null or empty text: probabilities of a text
without words. Rows stay as they are, repeated ones alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import PUNCT, bound_batches, free, mix, slices, words

CATEGORIES = ("quality", "toxic")
SAMPLE = 20_000
FEATURES = 384
FOLDS = 3
LEADS = (4, 5)
STEPS = 150
TEXT_BYTES = 1 << 18  # text bytes whose features are held at a time (a longer single text goes alone)
RIDGE = 1e-4


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ptr): all words and word beginnings of each text, text by text."""
    w = words(pc.utf8_lower(pc.fill_null(column, "")), PUNCT)
    kinds = [w.hashes, *(w.lead_hashes(n) for n in LEADS)]
    h = np.stack(kinds, axis=1).reshape(-1)
    return h, w.ptr * len(kinds)


def _sample(labels: DataFrame, categories: tuple[str, ...], sample: int) -> DataFrame:
    known = labels.groupBy("doc_id").agg(*[F.max(c).cast("double").alias(c) for c in categories])
    known = known.where(" AND ".join(f"{c} IS NOT NULL" for c in (*categories, "doc_id")))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


@dataclass
class Chain:
    """Fitted chain: sorted feature hashes; per category weights (features, earlier categories, bias) and threshold."""

    categories: tuple[str, ...]
    hashes: np.ndarray
    weights: list[np.ndarray]
    thresholds: list[float]

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """One row of category probabilities per text."""
        h, ptr = _features(column)
        n, k = len(column), len(self.hashes)
        near = np.zeros(1 << 16, bool)
        near[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        at = np.flatnonzero(near[(h & np.uint64(0xFFFF)).astype(np.int64)])
        pos = np.minimum(np.searchsorted(self.hashes, h[at]), max(k - 1, 0))
        hit = self.hashes[pos] == h[at] if k else np.zeros(0, bool)
        doc = np.searchsorted(ptr, at[hit], side="right") - 1
        pair = np.unique(doc * k + pos[hit]) if k else np.zeros(0, np.int64)
        doc, feature = (pair // k, pair % k) if k else (pair, pair)
        out = np.zeros((n, len(self.categories)))
        for c, w in enumerate(self.weights):
            z = np.bincount(doc, w[feature], minlength=n) + w[-1] + out[:, :c] @ w[k:k + c]
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def _fit(doc: np.ndarray, feature: np.ndarray, k: int, extra: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logistic regression over the given rows by accelerated gradient; weights of k features, extra columns, bias."""
    n = len(y)
    on = np.zeros(n)
    on[rows] = 1
    m = max(on.sum(), 1)
    df = np.bincount(feature, on[doc], minlength=k)
    # columns scaled to equal weight in the gradient; a frequent one isn't favoured
    scale = np.concatenate([1 / np.sqrt(np.maximum(df, 1) / m), np.ones(extra.shape[1] + 1)])
    w, v = np.zeros(len(scale)), np.zeros(len(scale))
    share = np.clip((y * on).sum() / m, 1 / (m + 2), 1 - 1 / (m + 2))
    v[-1] = w[-1] = np.log(share / (1 - share))
    per_row = np.bincount(doc, (scale[feature] ** 2), minlength=n)[rows]
    step = 4 / (np.percentile(per_row, 99) + extra.shape[1] + 1) if len(rows) else 0.0
    for t in range(STEPS):
        u = scale * v
        z = np.bincount(doc, u[feature], minlength=n) + u[-1] + extra @ u[k:-1]
        g = on * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / m
        grad = scale * np.concatenate([np.bincount(feature, g[doc], minlength=k), extra.T @ g, [g.sum()]])
        grad[:-1] += RIDGE * v[:-1]
        new = v - step * grad
        v = new + (t / (t + 3)) * (new - w)
        w = new
    return scale * w


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the largest F1, halfway to the next lower probability; above 1 without both classes."""
    if not (0 < y.sum() < len(y)):
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(p[order][1:] < p[order][:-1], True)
    best = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + below) / 2)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, sample: int = SAMPLE) -> Chain:
    """Fit the chain on at most ``sample`` labelled documents."""
    bound_batches(docs.sparkSession)
    # at most `sample` rows of a key and some numbers: small enough to send to every task
    known = F.broadcast(_sample(labels, categories, sample))
    c = len(categories)
    rows = docs.select("doc_id", "text").join(known, "doc_id").select("doc_id", "text", F.array(*categories).alias("y"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), TEXT_BYTES):
                h, ptr = _features(batch.column("text").slice(a, b - a))
                ys = np.array(batch.column("y").slice(a, b - a).to_pylist()).reshape(-1, c)
                found = [np.unique(h[ptr[i]:ptr[i + 1]]) for i in range(b - a)]
                h, index = np.unique(np.concatenate(found), return_inverse=True)
                y = np.repeat(ys, [len(u) for u in found], axis=0)
                columns = [pa.array(h.astype(np.int64)), pa.array(np.bincount(index).astype(np.float64))]
                columns += [pa.array(np.bincount(index, y[:, j])) for j in range(c)]
                yield pa.RecordBatch.from_arrays(columns, ["h", "n", *(f"n{j}" for j in range(c))])

    counts = rows.mapInArrow(count, "h bigint, n double, " + ", ".join(f"n{j} double" for j in range(c)))
    counts = counts.groupBy("h").agg(F.sum("n").alias("n"), *[F.sum(f"n{j}").alias(f"n{j}") for j in range(c)]).where("n >= 2").checkpoint()
    size = rows.agg(F.count("*"), *[F.coalesce(F.sum(F.col("y")[j]), F.lit(0.0)) for j in range(c)]).first()
    total, chosen = size[0], set()
    for j in range(c):
        base = size[1 + j] / total if total else 0.0
        if not 0 < base < 1:
            continue
        gap = F.abs(F.col(f"n{j}") - base * F.col("n")) - 0.5
        chi = gap * gap / (F.col("n") * base * (1 - base) * (1 - F.col("n") / (total + 1)))
        chosen |= {r[0] for r in counts.orderBy(chi.desc(), "h").limit(FEATURES).select("h").collect()}
    hashes = np.sort(np.array(sorted(chosen), np.int64).astype(np.uint64))

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), TEXT_BYTES):
                h, ptr = _features(batch.column("text").slice(a, b - a))
                own = [np.flatnonzero(np.isin(hashes, h[ptr[i]:ptr[i + 1]])).astype(np.int32) for i in range(b - a)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(own, pa.list_(pa.int32()))],
                                                 ["doc_id", "y", "own"])

    # at most `sample` documents, each with its chosen features only; repeated rows of a document train once
    got = rows.dropDuplicates(["doc_id"]).mapInArrow(design, "doc_id bigint, y array<double>, own array<int>").toArrow().sort_by("doc_id")
    n, k = got.num_rows, len(hashes)
    own = [x.values.to_numpy() for x in got["own"]]
    doc = np.repeat(np.arange(n), [len(x) for x in own])
    feature = np.concatenate(own).astype(np.int64) if n else np.zeros(0, np.int64)
    y = np.array(got["y"].to_pylist()).reshape(-1, c)
    fold = (mix(got["doc_id"].to_numpy().astype(np.uint64)) % np.uint64(FOLDS)).astype(np.int64) if n else np.zeros(0, np.int64)
    held, weights, thresholds = np.zeros((n, c)), [], []
    for j in range(c):
        for f in range(FOLDS):
            w = _fit(doc, feature, k, held[:, :j], y[:, j], np.flatnonzero(fold != f))
            z = np.bincount(doc, w[feature], minlength=n) + w[-1] + held[:, :j] @ w[k:-1]
            out = fold == f
            held[out, j] = 1 / (1 + np.exp(-np.clip(z[out], -30, 30)))
        weights.append(_fit(doc, feature, k, held[:, :j], y[:, j], np.arange(n)))
        thresholds.append(_best_threshold(held[:, j], y[:, j]))
    return Chain(tuple(categories), hashes, weights, thresholds)


def score(docs: DataFrame, chain: Chain, prefix: str = "p_", tags: str = "rejected") -> DataFrame:
    """``docs`` with a probability column per category and ``tags`` (array of categories over their thresholds); such columns are replaced."""
    names = [prefix + c for c in chain.categories] + [tags]
    docs = docs.drop(*names)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), TEXT_BYTES):
                part = batch.slice(a, b - a)
                p = chain.probabilities(part.column("text"))
                over = p >= np.array(chain.thresholds)
                judged = [[c for c, o in zip(chain.categories, row, strict=True) if o] for row in over]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(p[:, j]) for j in range(p.shape[1])), pa.array(judged, pa.list_(pa.string()))],
                    [*part.schema.names, *names])

    fields = [*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names[:-1]), T.StructField(tags, T.ArrayType(T.StringType()))]
    return docs.mapInArrow(run, T.StructType(fields))


def not_toxic(docs: DataFrame, labels: DataFrame, category: str = "toxic") -> DataFrame:
    """Rows of ``docs`` that the chain doesn't reject for ``category``; all columns are kept."""
    names = docs.columns
    chain = fit_chain(docs, labels)
    prefix, tags = "toxicity_p_", free("toxicity_tags", names)
    while any(f"{prefix}{c}".lower() in map(str.lower, names) for c in chain.categories):
        prefix = f"_{prefix}"
    scored = score(docs, chain, prefix, tags)
    return scored.where(~F.array_contains(tags, category)).select(*[F.col(f"`{n}`") for n in names])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chained probabilities and whether it is judged toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chain = fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, chain).select("doc_id", "p_quality", "p_toxic", F.array_contains("rejected", "toxic").alias("toxic"))
