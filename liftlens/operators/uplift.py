"""Two-model (T-learner) uplift with Spark ML: M5 feature pipeline, M6 fit, M7 score.

Both models are fitted by Spark ML on the cluster (no driver-side fit):
gradient-boosted trees over standardised numeric features and one-hot
categorical features. ``StringIndexer(handleInvalid="keep")`` followed by
``OneHotEncoder(dropLast=True)`` maps a category never seen in training to
the all-zero vector, as a one-hot encoder that ignores unknown values does.
Scoring is two ``transform`` calls with distinct output columns and one
array lookup per model: no join, no UDF.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlens.params import CAT_FEATURES, HOLDOUT, NUM_FEATURES, TREATMENT, Params

LABEL = "purchased"


# M5
def feature_pipeline(params: Params, num: Sequence[str] = NUM_FEATURES, cat: Sequence[str] = CAT_FEATURES,
                     label: str = LABEL, prefix: str = "m") -> Pipeline:
    """Scaled numeric + one-hot categorical features feeding a GBT classifier.

    ``prefix`` keeps intermediate column names of the two models apart.
    """
    idx = [StringIndexer(inputCol=c, outputCol=f"_{prefix}_{c}_idx", handleInvalid="keep") for c in cat]
    ohe = OneHotEncoder(inputCols=[f"_{prefix}_{c}_idx" for c in cat],
                        outputCols=[f"_{prefix}_{c}_ohe" for c in cat], dropLast=True)
    num_vec = VectorAssembler(inputCols=list(num), outputCol=f"_{prefix}_num", handleInvalid="keep")
    scaler = StandardScaler(inputCol=f"_{prefix}_num", outputCol=f"_{prefix}_num_s", withMean=True, withStd=True)
    assemble = VectorAssembler(inputCols=[f"_{prefix}_num_s", *[f"_{prefix}_{c}_ohe" for c in cat]],
                               outputCol=f"_{prefix}_x")
    gbt = GBTClassifier(featuresCol=f"_{prefix}_x", labelCol=label, maxIter=params.gbt_iters,
                        maxDepth=params.gbt_depth, stepSize=params.gbt_step, seed=params.seed)
    gbt.setPredictionCol(f"_{prefix}_pred").setRawPredictionCol(f"_{prefix}_raw").setProbabilityCol(f"_{prefix}_prob")
    return Pipeline(stages=[*idx, ohe, num_vec, scaler, assemble, gbt])


def _model_input(df: DataFrame, num: Sequence[str], cat: Sequence[str]) -> DataFrame:
    """Numeric nulls to 0 and categorical nulls to a label of their own."""
    return df.withColumns({
        **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in num},
        **{c: F.coalesce(F.col(c).cast("string"), F.lit("(missing)")) for c in cat},
    })


@dataclass
class TLearner:
    treated: PipelineModel
    control: PipelineModel
    num: tuple[str, ...] = NUM_FEATURES
    cat: tuple[str, ...] = CAT_FEATURES

    # M7
    def score(self, df: DataFrame, out_col: str = "uplift_score") -> DataFrame:
        """p(purchase | treated) - p(purchase | control) per row."""
        cols = df.columns
        x = _model_input(df, self.num, self.cat)
        t = self.treated.transform(x).select(
            *x.columns, vector_to_array(F.col("_t_prob")).getItem(1).alias("p_treated"))
        c = self.control.transform(t).select(
            *t.columns, vector_to_array(F.col("_c_prob")).getItem(1).alias("p_control"))
        return c.select(*cols, "p_treated", "p_control",
                        (F.col("p_treated") - F.col("p_control")).alias(out_col))

    def save(self, path: str) -> None:
        self.treated.write().overwrite().save(f"{path}/treated")
        self.control.write().overwrite().save(f"{path}/control")

    @classmethod
    def load(cls, path: str) -> "TLearner":
        return cls(PipelineModel.load(f"{path}/treated"), PipelineModel.load(f"{path}/control"))


# M6
def fit_t_learner(train: DataFrame, params: Params, num: Sequence[str] = NUM_FEATURES,
                  cat: Sequence[str] = CAT_FEATURES, label: str = LABEL) -> TLearner:
    """Two identical pipelines, one on treated rows and one on holdout rows."""
    x = _model_input(train, num, cat).persist()
    try:
        # The two fits are independent Spark jobs: submit them from two driver threads.
        with ThreadPoolExecutor(max_workers=2) as pool:
            f_t = pool.submit(lambda: feature_pipeline(params, num, cat, label, "t")
                              .fit(x.filter(F.col("group") == TREATMENT)))
            f_c = pool.submit(lambda: feature_pipeline(params, num, cat, label, "c")
                              .fit(x.filter(F.col("group") == HOLDOUT)))
            m_t, m_c = f_t.result(), f_c.result()
    finally:
        x.unpersist()
    return TLearner(m_t, m_c, tuple(num), tuple(cat))
