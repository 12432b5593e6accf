"""W0 (bucketed running order) against a plain global window, at growing row counts.

Rows are lineitem of the given scale, unioned with itself ``copies`` times (a copy index joins the
order key so the total order stays unique). Both sides compute a row number and a running sum of
l_extendedprice in (l_extendedprice desc, l_orderkey, l_linenumber, copy) order and write through
the ``noop`` sink; the results are compared on the sum of row_idx * running sum. Prints JSON lines.

usage: python tools/w0_scaling.py [sf_dir] [copies ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

ORDER = [("l_extendedprice", False), ("l_orderkey", True), ("l_linenumber", True), ("copy", True)]


def rows(spark, sf_dir: str, copies: int):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return li.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def timed(build):
    """Seconds to build the frame (W0 materialises, counts and samples here) and compute every row."""
    t = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main(argv: list[str]) -> None:
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.1"
    copies_list = [int(a) for a in argv[1:] if not a.startswith("/")] or [1, 4, 8]
    from liftlens.operators.ordering import prefix_sum, sort_exprs
    from liftlens.session import local_session

    spark = local_session(cores=8, shuffle_partitions=16, app_name="w0-scaling")
    for copies in copies_list:
        df = rows(spark, sf_dir, copies)
        n = df.count()
        def w0():
            return prefix_sum(df, ORDER, {"run": "l_extendedprice"}, totals=False, count_col=None)

        def plain():
            w = Window.orderBy(*sort_exprs(ORDER))
            return df.select("*", F.row_number().over(w).alias("row_idx"),
                             F.sum("l_extendedprice").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))

        t_w0 = min(timed(w0) for _ in range(2))
        t_plain = min(timed(plain) for _ in range(2))
        check = [b().agg(F.sum(F.col("row_idx") * F.col("run")).alias("c")).first()["c"] for b in (w0, plain)]
        print(json.dumps({"rows": n, "w0_sec": round(t_w0, 2), "plain_window_sec": round(t_plain, 2),
                          "equal": abs(check[0] - check[1]) <= 1e-9 * abs(check[1])}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
