"""Batched k-means, its silhouettes, and nearest centres, against Spark ML and brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftlens import Params
from liftlens.operators import segments
from liftlens.plans.testbed import TestBed

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def vectors(spark):
    v = segments.cluster_vectors(TestBed(spark, SF_SMALL).features).persist()
    yield v
    v.unpersist()


def test_all_fits_converge_to_the_means_of_their_own_rows(vectors):
    fits = segments.fit_all(vectors, (3, 5), 4, 42)
    x = np.array([r[0] for r in vectors.select(segments.VECTOR).collect()])
    assert len(fits) == 8 and len({f.cost for f in fits.values()}) > 2
    for (k, _), fit in fits.items():
        d2 = ((x[:, None, :] - fit.centres) ** 2).sum(2)
        at = d2.argmin(1)
        assert fit.iterations < 300 and fit.centres.shape == (k, x.shape[1])
        assert fit.cost == pytest.approx(d2.min(1).sum()) and fit.n.tolist() == np.bincount(at, minlength=k).tolist()
        for i in range(k):
            assert np.allclose(x[at == i].mean(0), fit.centres[i], atol=1e-3)
    best = segments.fit_best(vectors, (3, 5), 4, 42)
    assert {k: f.cost for k, f in best.items()} == pytest.approx({k: min(f.cost for (j, _), f in fits.items() if j == k) for k in (3, 5)})


def test_fits_are_as_good_as_spark_ml(vectors):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    ml = vectors.select("customer_id", array_to_vector(segments.VECTOR).alias("features")).persist()
    costs = [KMeans(k=4, seed=s, maxIter=300).fit(ml).summary.trainingCost for s in (42, 43, 44)]
    fits = segments.fit_best(vectors, (4,), 10, 42)
    assert fits[4].cost <= 1.02 * min(costs)
    assigned = segments.assign_nearest(vectors, segments.VECTOR, dict(enumerate(fits[4].centres.tolist())), "prediction")
    mine = segments.silhouettes(vectors, fits)[4]
    theirs = ClusteringEvaluator().evaluate(assigned.select(array_to_vector(segments.VECTOR).alias("features"), F.col("prediction").cast("double")))
    ml.unpersist()
    assert mine == pytest.approx(theirs)


def test_a_pass_is_one_job_whatever_the_restarts(spark, vectors, monkeypatch):
    passes = []
    plain = segments.measure

    def counted(vecs, fits, partitions):
        passes.append(len(fits))
        plain(vecs, fits, partitions)

    monkeypatch.setattr(segments, "measure", counted)
    fits = segments.fit_all(vectors, (3, 4), 6, 7)
    assert passes[0] == 12 and len(passes) == 1 + max(f.iterations for f in fits.values())
    monkeypatch.setattr(segments, "PARTIAL_ROWS", 0)  # the shuffled sums
    again = segments.fit_all(vectors.repartition(5), (3, 4), 6, 7)
    assert {k: f.cost for k, f in again.items()} == pytest.approx({k: f.cost for k, f in fits.items()})


def test_a_pass_measures_fits_together(monkeypatch):
    import pyarrow as pa

    class Rows:  # one task's batches
        def __init__(self, x):
            self.batches = [pa.RecordBatch.from_arrays([pa.array(list(p), pa.list_(pa.float64()))], ["features"]) for p in (x[:700], x[:0], x[700:])]

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def collect(self):
            return [row for b in self.run(iter(self.batches)) for row in zip(b["centre"].to_pylist(), map(np.array, b["added"].to_pylist()))]

    def refused(x, centres):
        raise AssertionError("a fit by itself")

    monkeypatch.setattr(segments, "_nearest", refused)
    monkeypatch.setattr(segments, "PASS_CELLS", 1000)
    rnd = np.random.default_rng(1)
    x = np.round(rnd.normal(size=(2000, 3)) * 2)  # with equal rows and equally near centres
    fits = {(k, r): segments.Fit(x[rnd.integers(len(x), size=k)]) for r in range(3) for k in (4, 1, 5)}
    fits[4, 0].centres[3] = fits[4, 0].centres[1]
    segments.measure(Rows(x), fits, 1)
    for (k, _), fit in fits.items():
        d2 = ((x[:, None, :] - fit.centres) ** 2).sum(2)
        at = d2.argmin(1)
        assert fit.n.tolist() == np.bincount(at, minlength=k).tolist() and fit.cost == pytest.approx(d2.min(1).sum())
        for i in range(k):
            assert np.allclose(fit.sums[i], x[at == i].sum(0)) and fit.squares[i] == pytest.approx((x[at == i] ** 2).sum())
    assert fits[4, 0].n[3] == 0


def test_k_is_chosen_on_all_rows(spark):
    n = 12_000  # three groups, every row at distance 1 from its group's centre
    rows = [(i, [100.0 * (i % 3), 1.0 if i % 2 else -1.0]) for i in range(n)]
    vectors = spark.createDataFrame(rows, f"customer_id long, {segments.VECTOR} array<double>")
    k, frame = segments.choose_k(vectors, Params(as_of="2024-12-31", k_range=(2, 3), kmeans_restarts=3))
    cost = {r["k"]: r["training_cost"] for r in frame.collect()}
    assert k == 3 and abs(cost[3] - n) < 1e-3
    assert not vectors.is_cached


def test_few_or_equal_rows_or_none(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], f"customer_id long, {segments.VECTOR} array<double>")
    p = Params(k_range=(2, 5), kmeans_restarts=2, final_restarts=2)
    k, frame = segments.choose_k(same, p)
    assert k == 2 and all(r["training_cost"] == 0 and r["silhouette"] == 0 for r in frame.collect())
    assert segments.fit_segments(same, 5, p).count() == 3
    assert segments.choose_k(same.limit(0), p)[0] == p.n_segments and segments.fit_segments(same.limit(0), 4, p).count() == 0


@pytest.mark.parametrize("limit", [32 << 20, 100_000])
def test_nearest_of_10_000_centres(spark, monkeypatch, limit):
    monkeypatch.setattr(segments, "CENTRE_BYTES", limit)
    rnd = np.random.default_rng(5)
    centres = np.round(rnd.normal(size=(10_000, 3)) * rnd.choice([1, 5, 30], size=(10_000, 1)), 1)
    x = np.concatenate([np.round(rnd.normal(size=(300, 3)) * 9, 1), centres[:100]])
    table = spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "id long, v array<double>")
    rows = spark.createDataFrame([*enumerate(x.tolist()), (9999, None)], "vec_id long, v array<double>").repartition(3)
    got = {r["vec_id"]: r["c"] for r in segments.assign_nearest(rows, "v", table, "c").collect()}
    assert got.pop(9999) is None
    assert got == {i: int(((centres - p) ** 2).sum(1).argmin()) for i, p in enumerate(x)}
