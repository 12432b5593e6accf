"""IO7: the star-schema test tables seen as POS transactions and a CRM master.

| ours                       | test tables                                               |
| transactions.customer_id   | orders.o_custkey                                          |
| transactions.txn_date      | orders.o_orderdate                                        |
| transactions.amount        | orders.o_totalprice                                       |
| transactions.n_items       | lineitem rows of the order (0 when none)                  |
| transactions.category      | orders.o_orderpriority                                    |
| customers.age_group        | customer.c_mktsegment                                     |
| customers.city_tier        | 'Tier' || (1 + c_nationkey % 3)                           |
| customers.channel_pref     | app / web / store by c_custkey % 3                        |
| redemptions                | orders with a line discounted by at least 5 %             |

The per-order line aggregate is one partial+final hash aggregation on
``l_orderkey``; orders then join it on the order key (sort-merge at scale,
both sides hash-partitioned on the key once).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the adapter (see FIXTURES.md).
CHANNEL_BY_MOD3 = ("app", "web", "store")
REDEMPTION_MIN_DISCOUNT = 0.05


@dataclass(frozen=True)
class TestTables:
    __test__ = False  # not a pytest class
    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def order_lines(self) -> DataFrame:
        """One row per order: number of lines and whether any line carries a >= 5 % discount."""
        return (self.raw("lineitem")
                .groupBy("l_orderkey")
                .agg(F.count(F.lit(1)).alias("n_lines"),
                     F.max(F.col("l_discount")).alias("max_discount")))

    def transactions(self, with_items: bool = True) -> DataFrame:
        o = self.raw("orders").select(
            F.col("o_orderkey").alias("txn_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("txn_date"),
            F.col("o_totalprice").alias("amount"),
            F.col("o_orderpriority").alias("category"),
        )
        if not with_items:
            return o
        lines = self.order_lines()
        return (o.join(lines, o.txn_id == lines.l_orderkey, "left")
                .select("customer_id", "txn_date", "amount",
                        F.coalesce(F.col("n_lines"), F.lit(0)).cast("bigint").alias("n_items"),
                        "category", "txn_id"))

    def redemptions(self) -> DataFrame:
        """Orders that redeemed an incentive: some line discounted by >= 5 %."""
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        disc = (self.raw("lineitem")
                .filter(F.col("l_discount") >= REDEMPTION_MIN_DISCOUNT)
                .select("l_orderkey").distinct())
        return (o.join(disc, o.o_orderkey == disc.l_orderkey, "left_semi")
                .select(F.col("o_custkey").alias("customer_id"),
                        F.col("o_orderdate").alias("redeemed_ts")))

    def customers(self) -> DataFrame:
        c = self.raw("customer")
        ch = F.col("c_custkey") % 3
        return c.select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_mktsegment").alias("age_group"),
            F.concat(F.lit("Tier"), (F.lit(1) + F.col("c_nationkey") % 3).cast("string")).alias("city_tier"),
            F.when(ch == 0, F.lit(CHANNEL_BY_MOD3[0]))
             .when(ch == 1, F.lit(CHANNEL_BY_MOD3[1]))
             .otherwise(F.lit(CHANNEL_BY_MOD3[2])).alias("channel_pref"),
        )
