"""Hot keys: one customer with a third of all sales, an order key with three values."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from liftlens.operators import features, outcomes
from liftlens.operators.ordering import BUCKET, global_rank, sort_exprs
from liftlens.params import Params


def test_w0_buckets_stay_bounded_under_ties(spark):
    rnd = random.Random(7)
    n = 30_000
    df = spark.createDataFrame([(i, float(rnd.randrange(3))) for i in range(n)], "id long, k double")
    ranges = df.repartitionByRange(30, *sort_exprs([("k", False), ("id", True)]))
    sizes = [r["n"] for r in ranges.withColumn(BUCKET, F.spark_partition_id())
             .groupBy(BUCKET).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 25 and max(sizes) <= 3 * n / 30
    ranked = global_rank(df, [("k", False), ("id", True)], rows_per_bucket=1000)
    got = [r["id"] for r in ranked.orderBy("row_idx").collect()]
    exp = [r["id"] for r in df.orderBy(F.col("k").desc(), "id").collect()]
    assert got == exp


def test_hot_customer_features_and_attribution(spark):
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(30_000):
        cid = 0 if i % 3 == 0 else rnd.randrange(1, 500)          # customer 0 holds a third of all sales
        rows.append((cid, base + dt.timedelta(days=rnd.randrange(200)), 10.0, 1, "c%d" % (i % 4)))
    txns = spark.createDataFrame(rows, "customer_id long, txn_date timestamp_ntz, amount double, n_items long, category string")
    p = Params(as_of="2024-05-01", outcome_days=30)
    f = {r["customer_id"]: r for r in features.rfm_features(txns, p).collect()}
    hot = [r for r in rows if r[0] == 0 and r[1] < dt.datetime(2024, 5, 1)]
    assert f[0]["txn_count"] == len(hot) and f[0]["category_diversity"] == 4
    asg = spark.createDataFrame([(c, "W", "treatment", "T", 5.0, dt.datetime(2024, 5, 1)) for c in range(500)],
                                "customer_id long, campaign_id string, group string, value_tier string, "
                                "coupon_value double, assigned_ts timestamp_ntz")
    out = {r["customer_id"]: r for r in outcomes.attribute_outcomes(asg, txns, None, p).collect()}
    win = [r for r in rows if r[0] == 0 and dt.datetime(2024, 5, 1) <= r[1] < dt.datetime(2024, 5, 31)]
    assert len(out) == 500
    assert out[0]["spend"] == sum(r[2] for r in win) and out[0]["purchased"] == 1


def _brute(rows, asg, days):
    out = {}
    for cid, camp, start in asg:
        end = start + dt.timedelta(days=days)
        hits = [r for r in rows if r[0] == cid and start <= r[1] < end]
        out[(camp, cid)] = (int(bool(hits)), sum(r[2] for r in hits))
    return out


def test_attribution_overlapping_windows_at_any_as_of(spark):
    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    rows = [(rnd.randrange(40), base + dt.timedelta(hours=rnd.randrange(24 * 90)), float(rnd.randrange(1, 50)), 1, "a")
            for _ in range(4000)]
    txns = spark.createDataFrame(rows, "customer_id long, txn_date timestamp_ntz, amount double, n_items long, category string")
    asg_rows = [(c, w, base + dt.timedelta(days=off, hours=h))
                for w, off, h in (("W1", 10, 0), ("W2", 25, 6), ("W3", 26, 0)) for c in range(40)]
    asg = spark.createDataFrame([(c, w, "treatment", "T", 1.0, t) for c, w, t in asg_rows],
                                "customer_id long, campaign_id string, group string, value_tier string, "
                                "coupon_value double, assigned_ts timestamp_ntz")
    p = Params(as_of="2024-01-01", outcome_days=30)
    exp = _brute(rows, asg_rows, 30)
    got = {(r["campaign_id"], r["customer_id"]): (r["purchased"], r["spend"])
           for r in outcomes.attribute_outcomes(asg, txns, None, p).collect()}
    assert got == exp
    for as_of in ("2023-06-01", "2024-09-01"):               # measured long before or after: the same windows
        other = Params(as_of=as_of, outcome_days=30)
        got2 = {(r["campaign_id"], r["customer_id"]): (r["purchased"], r["spend"])
                for r in outcomes.attribute_outcomes(asg, txns, None, other).collect()}
        assert got2 == exp


def test_attribution_with_100_000_assignment_times(spark):
    rnd = random.Random(12)
    base = dt.datetime(2024, 1, 1)
    asg_rows = [(c, f"W{c % 3}", base + dt.timedelta(minutes=rnd.randrange(300_000), microseconds=c)) for c in range(100_000)]
    rows = [(0 if i % 3 == 0 else rnd.randrange(100_000), base + dt.timedelta(minutes=rnd.randrange(400_000)), float(i % 7), 1, "a")
            for i in range(60_000)]                               # customer 0 holds a third of all sales
    asg_rows += [(0, f"X{i}", base + dt.timedelta(minutes=1000 * i)) for i in range(200)]
    txns = spark.createDataFrame(rows, "customer_id long, txn_date timestamp_ntz, amount double, n_items long, category string")
    asg = spark.createDataFrame([(c, w, "treatment", "T", 1.0, t) for c, w, t in asg_rows],
                                "customer_id long, campaign_id string, group string, value_tier string, "
                                "coupon_value double, assigned_ts timestamp_ntz")
    assert asg.select("assigned_ts").distinct().count() > 99_000
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    exp = {}
    for c, w, t in asg_rows:
        hits = [r for r in by.get(c, ()) if t <= r[1] < t + dt.timedelta(days=30)]
        exp[w, c] = (int(bool(hits)), sum(r[2] for r in hits))
    p = Params(as_of="2024-01-01", outcome_days=30)
    for kw in ({}, {"rows_per_salt": 500}):                # as it is, and with customer 0 over salts
        got = {(r["campaign_id"], r["customer_id"]): (r["purchased"], r["spend"])
               for r in outcomes.attribute_outcomes(asg, txns, None, p, **kw).collect()}
        assert got == exp


def _brute_asof(ev_rows, snap_rows):
    by = {}
    for c, t, v in sorted(snap_rows):
        by.setdefault(c, []).append((t, v))
    return {eid: next((v for s, v in reversed(by.get(c, ())) if s <= t), None) for eid, c, t in ev_rows}


def test_asof_hot_key_and_1_000_runs(spark):
    from liftlens.operators import skew, snapshots

    rnd = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    snap_rows = [(c, base + dt.timedelta(hours=h), f"{c}-{h}") for c in range(20) for h in range(1000) if c == 0 or (c * 7 + h) % 5]
    ev_rows = [(i, 0 if i % 3 == 0 else rnd.randrange(22), base + dt.timedelta(minutes=rnd.randrange(-500, 70_000)))
               for i in range(6000)]                                        # customer 0: a third of all events
    snaps = spark.createDataFrame(snap_rows, "customer_id long, feature_ts timestamp_ntz, v string")
    ev = spark.createDataFrame(ev_rows, "eid long, customer_id long, ts timestamp_ntz")
    exp = _brute_asof(ev_rows, snap_rows)
    for kw in ({}, {"rows_per_salt": 200}):
        got = {r["eid"]: r["v"] for r in snapshots.asof_features(ev, snaps, event_ts="ts", **kw).collect()}
        assert got == exp and len(got) == 6000
    hot = {r["customer_id"]: r["_salts"] for r in skew.hot_keys(ev, "customer_id", 5, 200).collect()}
    assert hot[0] >= 10 and len(hot) <= 5
    sizes = skew.salted(ev, "customer_id", skew.hot_keys(ev, "customer_id", 5, 200)).groupBy("customer_id", "_salt").count()
    assert sizes.where("customer_id = 0").agg(F.max("count")).first()[0] <= 250


def test_hot_null_keys_are_spread(spark):
    from liftlens.operators import snapshots

    ev = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("customer_id"),
                                  F.lit(dt.datetime(2024, 1, 2)).cast("timestamp_ntz").alias("ts"))
    snaps = spark.createDataFrame([(None, dt.datetime(2024, 1, 1), "n"), (4, dt.datetime(2024, 1, 1), "f")],
                                  "customer_id long, feature_ts timestamp_ntz, v string")
    got = snapshots.asof_features(ev, snaps, event_ts="ts").where("v IS NOT NULL").collect()
    assert [(r["id"], r["v"]) for r in got] == [(4, "f")]


def test_zone_aware_timestamps_under_a_non_utc_session(spark):
    from liftlens.operators import snapshots

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        base = dt.datetime(2024, 3, 9, 22, 30)        # around a DST change in that zone
        base = base.astimezone()
        snap_rows = [(c, base + dt.timedelta(hours=h), f"{c}-{h}") for c in range(5) for h in (0, 5, 30)]
        ev_rows = [(i, i % 5, base + dt.timedelta(minutes=37 * i)) for i in range(200)]
        snaps = spark.createDataFrame(snap_rows, "customer_id long, feature_ts timestamp, v string")
        ev = spark.createDataFrame(ev_rows, "eid long, customer_id long, ts timestamp")
        got = {r["eid"]: r["v"] for r in snapshots.asof_features(ev, snaps, event_ts="ts").collect()}
        assert got == _brute_asof(ev_rows, snap_rows)
        txns = ev.select("customer_id", F.col("ts").alias("txn_date"), F.lit(1.0).alias("amount"))
        asg = spark.createDataFrame([(c, "W", "treatment", "T", 1.0, base + dt.timedelta(hours=3)) for c in range(5)],
                                    "customer_id long, campaign_id string, group string, value_tier string, "
                                    "coupon_value double, assigned_ts timestamp")
        p = Params(as_of="2024-03-01", outcome_days=2)
        a1 = sorted(tuple(r) for r in outcomes.attribute_outcomes(asg, txns, None, p).collect())
        assert sum(r[5] for r in a1) == 5
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
