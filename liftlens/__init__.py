"""liftlens: incentive uplift analytics as Spark DataFrame and Spark ML jobs.

Customer RFM features and value tiers, reproducible treatment/holdout
splits, attribution of later purchases, two-model (T-learner) uplift
scores, Qini and decile checks, budget allocation under frequency caps,
and holdout-measured lift. Every operator takes and returns DataFrames and
never collects rows to the driver.
"""

from liftlens.params import Params, testdata_params

__all__ = ["Params", "testdata_params"]
