"""Training data to models, models to projected loads and their roll-ups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.operators.metrics import regression_metrics
from loadcast.operators.ordered import attach
from loadcast.operators.reshape import melt, scenario_wide
from loadcast.operators.rollup import annual_baseline, annual_series, annual_weighted, monthly_mean
from loadcast.operators.scaling import bounds, ordered_split, scale, unscale
from loadcast.operators.training import score, training_matrix
from loadcast.params import FEATURES, LABEL, SCENARIOS, Scenario
from loadcast.sources.scratch import materialize

MODELS = ("ann", "dnn")


@dataclass
class TrainingData:
    loads: DataFrame  # all labelled rows of the training table, also those without all features
    split: DataFrame  # rows in original units, with row and part
    limits: DataFrame  # one row per location
    matrix: DataFrame  # scaled rows as fit() reads them


def split_scale(training: DataFrame, site_rows: int | None = None) -> TrainingData:
    """Split and scale.  Table and split are written once; bounds and matrix derive from them."""
    training = materialize(training, "training")
    split = materialize(ordered_split(training), "split")
    loads = training.filter(F.col(LABEL).isNotNull()).select("location", "time", LABEL)
    limits = bounds(split)
    scaled = scale(split, limits, [*FEATURES, LABEL], site_rows)
    return TrainingData(loads, split, limits, training_matrix(scaled))


def test_predictions(
    data: TrainingData, networks: DataFrame, site_rows: int | None = None, models: Sequence[str] = MODELS
) -> DataFrame:
    """Test rows with predicted and actual load in kW; ``hour`` counts them per location."""
    tests = data.matrix.filter(F.col("part") == "test")
    scored = score(tests, networks, models=models).withColumnRenamed("label", LABEL)
    loads = [c for c in scored.columns if c.endswith("_cooling_load")]
    back = unscale(scored, data.limits, loads, LABEL, site_rows)
    first = data.split.filter(F.col("part") == "test").groupBy("location").agg(F.min("row").alias("_first"))
    return attach(back, first, ["location"], site_rows).select(
        "location", "time", (F.col("row") - F.col("_first") + 1).alias("hour"), *loads
    )


test_predictions.__test__ = False  # not a test case


def evaluate(predictions: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """MSE, RMSE, CV-RMSE, MAPE and R2 per location and kind of network."""
    long = melt(predictions, ["location", LABEL], [f"{m}_cooling_load" for m in models])
    named = long.withColumn("model", F.replace("category", F.lit("_cooling_load"), F.lit("")))
    return regression_metrics(named, ["location", "model"], LABEL, "values")


def project_load(
    features: DataFrame,
    limits: DataFrame,
    networks: DataFrame,
    site_rows: int | None = None,
    models: Sequence[str] = MODELS,
) -> DataFrame:
    """Predicted loads in kW per location, scenario and time, of the kinds of network wanted."""
    scaled = scale(features, limits, FEATURES, site_rows).na.fill(0.0, FEATURES)
    scored = score(scaled, networks, models=models)
    loads = [c for c in scored.columns if c.endswith("_cooling_load")]
    return unscale(scored.drop(*FEATURES), limits, loads, LABEL, site_rows)


def loads_by_scenario(
    projected: DataFrame, scenarios: Iterable[Scenario] = SCENARIOS, models: Sequence[str] = MODELS
) -> DataFrame:
    return scenario_wide(projected, [f"{m}_cooling_load" for m in models], [s.code for s in scenarios])


def monthly_loads(wide: DataFrame) -> DataFrame:
    return monthly_mean(wide, [c for c in wide.columns if "cooling_load" in c])


def annual_loads(monthly: DataFrame, training: DataFrame, model: str = "dnn") -> DataFrame:
    """Projected annual loads and the baseline year of the training table."""
    columns = [c for c in monthly.columns if c.startswith(f"{model}_")]
    return annual_series(
        annual_weighted(monthly, columns), annual_baseline(training, LABEL, columns)
    )
