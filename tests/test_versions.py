"""Versioned tables: killed publications, two writers, reruns, removal of what no version names; sketches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from liftlens.operators import sketches
from liftlens.sources.versions import VersionedTables

SNAP = "customer_id long, feature_ts timestamp_ntz, v int"


def _snaps(spark, rows):
    return spark.createDataFrame([(c, dt.datetime(2024, 1, d), v) for c, d, v in rows], SNAP)


def _rows(df):
    return sorted((r["customer_id"], r["feature_ts"].day, r["v"]) for r in df.collect())


def test_killed_publication_leaves_the_old_version(spark, tmpdir_path, monkeypatch):
    t = VersionedTables(spark, tmpdir_path)
    assert t.versions("s") == [] and t.parts("s") == {}
    assert t.publish_snapshot(_snaps(spark, [(1, 1, 10), (2, 1, 20), (1, 2, 30)]), "s") == 1
    with monkeypatch.context() as m:
        m.setattr(VersionedTables, "_put", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            t.publish_snapshot(_snaps(spark, [(1, 1, 99)]), "s")
    assert _rows(t.read("s")) == [(1, 1, 10), (1, 2, 30), (2, 1, 20)]
    assert t.vacuum("s") == 1                                     # what the killed one wrote aside
    assert t.publish_snapshot(_snaps(spark, [(1, 1, 11), (3, 3, 40)]), "s") == 2
    assert _rows(t.read("s")) == [(1, 1, 11), (1, 2, 30), (2, 1, 20), (3, 3, 40)]
    assert _rows(t.read("s", version=1)) == [(1, 1, 10), (1, 2, 30), (2, 1, 20)]
    assert _rows(t.read("s", part="2024-01-01")) == [(1, 1, 11), (2, 1, 20)]
    assert t.vacuum("s") == 1 and len(_rows(t.read("s"))) == 4


def test_two_writers_get_two_versions(spark, tmpdir_path):
    a, b = VersionedTables(spark, tmpdir_path), VersionedTables(spark, tmpdir_path)
    df = _snaps(spark, [(1, 1, 1)])
    calls = []

    def slow(old):
        calls.append(dict(old))
        if len(calls) == 1:                                        # the other writer commits in between
            b.replace("w", {"B": df})
        return {**old, "A": a.write_aside(df, "w")}

    assert a.commit("w", slow) == 2 and calls[0] == {} and list(calls[1]) == ["B"]
    assert set(a.parts("w")) == {"A", "B"} and a.read("w").count() == 2
    assert a.replace("w", {"A": df.withColumn("v", F.lit(5))}) == 3  # a rerun replaces its part
    assert sorted(r["v"] for r in b.read("w").collect()) == [1, 5]
    assert [a.claim("n"), b.claim("n"), a.claim("n")] == [1, 2, 3]


def test_sketches_merge_to_those_of_all_rows(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(i, f"g{i % 5}", rnd.gauss(0, 1) if i % 50 else None) for i in range(20_000)], "id long, g string, x double")
    values = sorted(r["x"] for r in df.where("x IS NOT NULL").collect())
    row = sketches.merged_quantiles(sketches.quantile_sketches(df, "x", ["g"]), [0.1, 0.5, 0.99]).first()
    assert row["n"] == len(values)
    for p, v in zip([0.1, 0.5, 0.99], row["quantiles"]):
        assert abs(sum(x <= v for x in values) / len(values) - p) <= sketches.RANK_ERROR
    base = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(rnd.randrange(3000) or None, base + dt.timedelta(hours=rnd.randrange(2000))) for _ in range(9000)],
                               "k long, t timestamp_ntz")
    dates = ["2024-01-01", "2024-01-11", "2024-02-01", "2024-06-01"]
    for r in sketches.distinct_history(ev, "k", "t", dates).collect():
        exact = len({e["k"] for e in ev.collect() if e["t"] < r["feature_ts"] and e["k"] is not None})
        assert r["n_exact"] == exact and abs(r["n_estimate"] - exact) <= 3 * sketches.distinct_error() * exact + 1
