"""The oracle's SQL spelling of Spark's Murmur3 ``hash`` equals Spark's own on edge-case strings."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from liftlens.plans.oracle_sql import spark_hash


def test_sql_murmur3_equals_spark_hash(spark):
    rng = random.Random(7)
    strs = ["", "a", "ab", "abc", "abcd", "abcde", "WAVE_01_LEARNING::12345", "é", "x€z", "日本語"]
    strs += ["".join(rng.choice("azAZ09:_é€") for _ in range(rng.randint(0, 33))) for _ in range(200)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(s,) for s in strs])
    got = dict(con.execute(f"SELECT s, {spark_hash('s')} FROM t").fetchall())
    want = {r[0]: r[1] for r in spark.createDataFrame([(s,) for s in strs], "s string")
            .select("s", F.hash("s")).collect()}
    assert got == want
