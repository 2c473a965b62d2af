"""Observed weather: cubes to hourly series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.functions.strict import clamp_negative
from loadcast.functions.units import joules_to_watts, kelvin_to_celsius, metres_to_mm, ms_to_kmh, wind_magnitude
from loadcast.operators.disagg import filter_years
from loadcast.operators.grid import deaccumulate, spatial_mean
from loadcast.operators.timefix import repair_hours
from loadcast.params import WEATHER
from loadcast.sources.scratch import materialize

GRID = ["u10_wind", "v10_wind", "dewpoint_temp", "temp", "ssrd", "precip"]


def convert_units(df: DataFrame) -> DataFrame:
    """Celsius, W/m2 and mm for whichever of the four quantities are there."""
    rules = {
        "dewpoint_temp": kelvin_to_celsius,
        "temp": kelvin_to_celsius,
        "ssrd": joules_to_watts,
        "precip": metres_to_mm,
    }
    return df.withColumns({c: f(F.col(c)) for c, f in rules.items() if c in df.columns})


def load_weather(cells: DataFrame, accumulated: bool = True) -> DataFrame:
    """Hourly weather of the training period from grid cells (tidy rows).

    Wind is the mean of the cells' speeds; running totals of radiation and rain
    become hourly amounts.
    """
    speed = ms_to_kmh(wind_magnitude(F.col("u10_wind"), F.col("v10_wind")))
    converted = convert_units(cells.dropna("any", subset=GRID)).withColumn("wind_speed", speed)
    hourly = spatial_mean(converted, WEATHER)
    # The rows and their borders read the means, not the grid.
    return deaccumulate(materialize(hourly, "hourly")) if accumulated else hourly


def load_history(
    cells: DataFrame,
    spans: dict[str, tuple[int, int]] | None = None,
    file_key: str | None = None,
    compat_day_gap: bool = False,
) -> DataFrame:
    """Hourly history from grid cells of several files.

    Time steps are averaged per file, put in file and time order and repaired;
    wind is the speed of the mean components.
    """
    keys = ["location", *([file_key] if file_key else []), "time"]
    means = spatial_mean(cells.dropna("any", subset=GRID), GRID, keys)
    order = [F.col(k).alias(f"_o_{k}") for k in keys[1:]]
    ordered = means.select("*", *order)
    names = [f"_o_{k}" for k in keys[1:]]
    repaired = repair_hours(ordered, ["location"], names, compat_day_gap=compat_day_gap)
    kept = filter_years(repaired, spans) if spans else repaired
    fluxes = kept.withColumns({c: clamp_negative(F.col(c)) for c in ("ssrd", "precip")})
    speed = ms_to_kmh(wind_magnitude(F.col("u10_wind"), F.col("v10_wind")))
    return convert_units(fluxes.withColumn("wind_speed", speed)).select("location", "time", *WEATHER)
