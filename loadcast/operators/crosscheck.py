"""Built-in learners on the networks' matrix, as a yardstick for them.

Linear regression and boosted trees from MLlib, one model each for all
locations, which enter as indicators with interactions for the linear part, so
that its predictions are those of one regression per location.  The validation
part, not a random split, picks the trees' depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.params import FEATURES

LINEAR, TREES = "linear", "trees"
TREE_DEPTHS = (3, 5)
TREE_ROUNDS = 20
SEED = 500


def by_location(matrix: DataFrame, locations: Sequence[str], features: Sequence[str] = FEATURES) -> tuple[DataFrame, list[str]]:
    """An indicator per location and each feature times it, and their names; as many as locations times features and one."""
    columns, names = {}, []
    for i, place in enumerate(locations):
        here = F.col("location") == place
        columns[f"_is{i}"] = here.cast("double")
        names.append(f"_is{i}")
        for f in features:
            columns[f"_{i}_{f}"] = F.when(here, F.col(f)).otherwise(0.0)
            names.append(f"_{i}_{f}")
    return matrix.withColumns(columns), names


def fit_linear(matrix: DataFrame, locations: Sequence[str], features: Sequence[str] = FEATURES) -> PipelineModel:
    """Least squares per location on the training rows (parts fit and val)."""
    wide, names = by_location(matrix.filter(F.col("part") != "test"), locations, features)
    learner = LinearRegression(featuresCol="_x", labelCol="label", predictionCol=LINEAR, fitIntercept=False, solver="normal", standardization=False)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_x"), learner]).fit(wide)


def fit_trees(matrix: DataFrame, locations: Sequence[str], features: Sequence[str] = FEATURES) -> PipelineModel:
    """Boosted trees on the rows of part fit; of ``TREE_DEPTHS`` the depth with the least error on part val."""
    wide, _ = by_location(matrix, locations, features)
    names = [*[f"_is{i}" for i in range(len(locations))], *features]
    judge = RegressionEvaluator(labelCol="label", predictionCol=TREES, metricName="rmse")
    best = None
    for depth in TREE_DEPTHS:
        learner = GBTRegressor(labelCol="label", predictionCol=TREES, featuresCol="_x", maxDepth=depth, maxIter=TREE_ROUNDS, seed=SEED)
        model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_x"), learner]).fit(wide.filter("part = 'fit'"))
        error = judge.evaluate(model.transform(wide.filter("part = 'val'")))
        if best is None or error < best[0]:
            best = error, model
    return best[1]


def predict(matrix: DataFrame, model: PipelineModel, name: str, locations: Sequence[str], features: Sequence[str] = FEATURES) -> DataFrame:
    """``matrix`` with a column of predictions in scaled units."""
    wide, _ = by_location(matrix, locations, features)
    return model.transform(wide).select(*matrix.columns, name)
