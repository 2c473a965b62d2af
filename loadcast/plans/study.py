"""The three stages of the study over stored inputs.

Each stage hands over Parquet tables, partitioned by location and scenario, so
stages can be run one by one and repeated on their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from loadcast.operators import training as networks
from loadcast.operators.features import cooling_profile, projection_features, training_table
from loadcast.operators.reshape import strip_text
from loadcast.params import (
    DAILY_VARIABLES,
    SCENARIOS,
    SITES,
    Scenario,
    Site,
    history_spans,
    projection_spans,
    training_years,
)
from loadcast.plans import forecast
from loadcast.plans.projection import load_projection, synthesize
from loadcast.plans.weather import load_history, load_weather
from loadcast.sources.series import scan_table
from loadcast.sources.sinks import write_table

SHEET = "location string, Year int, Month string, Hour int, Weekday string, `Cooling Load (kW)` double"


def load_cooling(spark: SparkSession, path: str) -> DataFrame:
    """Load profile from a CSV export of the building-load sheets."""
    return cooling_profile(scan_table(spark, path, SHEET))


def synthetic_weather(
    spark: SparkSession,
    history_cells: DataFrame,
    projections: str | Sequence[str],
    out: str,
    sites: Sequence[Site] = SITES,
    scenarios: Sequence[Scenario] = SCENARIOS,
    file_key: str | None = None,
) -> DataFrame:
    """Gridded history and daily projection files to synthetic hourly weather at ``out``."""
    history = load_history(history_cells, history_spans(sites), file_key)
    daily = load_projection(spark, projections).select("location", "scenario", "time", *DAILY_VARIABLES)
    hourly = synthesize(history, daily, projection_spans(sites), scenarios)
    write_table(hourly, out, order_by=["time"])
    return spark.read.schema(hourly.schema).parquet(out)


def train(
    weather_cells: DataFrame,
    loads: DataFrame,
    weights: str,
    sites: Sequence[Site] = SITES,
    trials: int = 10,
    executions: int = 3,
    epochs: int = 250,
    seed: int = 500,
) -> tuple[forecast.TrainingData, DataFrame]:
    """Search, refit and store the networks of all sites at ``weights``; returns data and scores."""
    training = training_table(load_weather(weather_cells), loads, training_years(sites))
    data = forecast.split_scale(training, len(sites))
    tried = networks.search(data.matrix, trials=trials, executions=executions, epochs=epochs, seed=seed)
    fitted = networks.fit(data.matrix, networks.best_networks(tried), epochs=epochs, seed=seed)
    fitted.write.parquet(weights)
    return data, forecast.evaluate(forecast.test_predictions(data, fitted, len(sites)))


def project(
    synthetic: DataFrame, data: forecast.TrainingData, weights: DataFrame, site_rows: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hourly, monthly and annual projected loads."""
    features = projection_features(strip_text(synthetic))
    loads = forecast.project_load(features, data.limits, weights, site_rows)
    hourly = forecast.loads_by_scenario(loads)
    monthly = forecast.monthly_loads(hourly)
    return hourly, monthly, forecast.annual_loads(monthly, data.loads)
