"""Inputs derived from the supplied test tables, shared by the registered queries.

* history features at an as-of date (A1 + J1 + E2);
* value tiers for oracle-checked queries: quartiles of monthly spend by rank
  (High Value = top quarter), so a SQL engine can reproduce them; the k-means
  tiers of the real pipeline are checked rows-only;
* the stand-in uplift score ``(md5 bucket of 'SCORE::'||id - 30000) / 100000``
  (some scores negative), used wherever a fitted model would score, so the
  downstream operators can be checked exactly;
* the learning wave: md5 split of all known customers at the as-of date and
  its outcomes attributed from the orders of the next 90 days.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlens.functions.hashing import md5_bucket
from liftlens.functions.lineage import materialize
from liftlens.functions.time import ts
from liftlens.operators import experiment, features, outcomes
from liftlens.operators.ordering import global_rank
from liftlens.params import LEARNING_WAVE, SNAPSHOT_COLUMNS, TIER_LABELS, VALUE_TIERS, Params, testdata_params
from liftlens.sources.testdata import TestTables

# Fixed values of the stand-in score.
SCORE_SALT = "SCORE"
SCORE_OFFSET = 30000
SCORE_SCALE = 100000.0
SNAPSHOT_DATES = ("1997-01-01", "1998-01-01", "1999-01-01")
WAVE2_AS_OF = "1998-01-01"


def stand_in_score(salt: str = SCORE_SALT):
    return ((md5_bucket("customer_id", salt) - F.lit(SCORE_OFFSET)) / F.lit(SCORE_SCALE)).alias("uplift_score")


def quartile_tiers(feats: DataFrame, params: Params, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, customer_id, segment_id (0 = top quarter of monthly spend), value_tier."""
    ranked = global_rank(feats.select(*by, "customer_id", "monetary_per_month"),
                         [("monetary_per_month", False), ("customer_id", True)], partition_by=by,
                         rows_per_bucket=params.rows_per_bucket, row_number="_r", count_col="_n")
    q = F.floor(((F.col("_r") - 1) * 4) / F.col("_n")).cast("int")
    labels = F.array(*[F.lit(t) for t in TIER_LABELS[:4]])
    return ranked.select(*by, "customer_id", q.alias("segment_id"), F.element_at(labels, q + 1).alias("value_tier"))


class TestBed:
    __test__ = False  # not a pytest class

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.tables = TestTables(spark, sf_dir)
        self.p = params or testdata_params()

    def at(self, as_of: str) -> "TestBed":
        return TestBed(self.spark, self.sf_dir, self.p.with_(as_of=as_of))

    @cached_property
    def txns(self) -> DataFrame:
        return self.tables.transactions()

    @cached_property
    def customers(self) -> DataFrame:
        return self.tables.customers()

    @cached_property
    def redemptions(self) -> DataFrame:
        return self.tables.redemptions()

    @cached_property
    def features(self) -> DataFrame:
        return features.customer_features(self.txns, self.customers, self.p)

    def history(self, dates) -> DataFrame:
        """The customer_features table as of each date, with feature_ts."""
        return features.customer_history(self.txns, self.customers, self.p, dates)

    @cached_property
    def segments(self) -> DataFrame:
        return quartile_tiers(self.features, self.p)

    def snapshot(self) -> DataFrame:
        """Features joined with tiers, stamped with feature_ts = as_of (IO5 input)."""
        f = self.features.join(self.segments, "customer_id", "left")
        return f.withColumn("feature_ts", ts(self.p.as_of)).select(*SNAPSHOT_COLUMNS)

    def scored(self, salt: str = SCORE_SALT) -> DataFrame:
        """Known customers with value tier, basket value and the stand-in score."""
        f = self.features.join(self.segments, "customer_id", "left")
        return f.select("customer_id", "value_tier", "avg_basket_value", stand_in_score(salt))

    @cached_property
    def learning_assignments(self) -> DataFrame:
        eligible = experiment.eligible_by_tier(self.segments, VALUE_TIERS)
        return experiment.assign_groups(eligible, LEARNING_WAVE, self.p)

    @cached_property
    def learning_outcomes(self) -> DataFrame:
        return outcomes.attribute_outcomes(materialize(self.learning_assignments), self.tables.transactions(with_items=False),
                                           self.redemptions, self.p)
