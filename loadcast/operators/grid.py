"""Gridded readings to one hourly series per location."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast.functions.strict import strict_avg
from loadcast.functions.units import wind_magnitude
from loadcast.operators.ordered import month_chunk, previous_row
from loadcast.functions.calendar import add_hours
from loadcast.params import RESET_HOUR


def spatial_mean(cells: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("location", "time")) -> DataFrame:
    """Mean over all grid cells of a time step, combined before the shuffle."""
    return cells.groupBy(*keys).agg(*[strict_avg(c).alias(c) for c in columns])


def wind_speeds(cells: DataFrame, keys: Sequence[str] = ("location", "time")) -> DataFrame:
    """Mean wind speed (m/s) per time step from components, by both rules in one pass.

    ``per_cell`` averages the speeds of the cells, ``mean_vector`` takes the
    speed of the averaged components.
    """
    u, v = F.col("u10_wind"), F.col("v10_wind")
    speed = cells.withColumn("per_cell", wind_magnitude(u, v))
    means = spatial_mean(speed, ["per_cell", "u10_wind", "v10_wind"], keys)
    return means.withColumn("mean_vector", wind_magnitude(u, v)).drop("u10_wind", "v10_wind")


def wind_speed(cells: DataFrame, how: str, keys: Sequence[str] = ("location", "time")) -> DataFrame:
    """Mean wind speed by one rule; the aggregates of the other are pruned."""
    if how not in ("per_cell", "mean_vector"):
        raise ValueError(f"unknown wind rule: {how}")
    return wind_speeds(cells, keys).select(*keys, F.col(how).alias("wind_speed"))


def accumulation_chunk(time: Column) -> Column:
    return month_chunk(add_hours(time, F.lit(-RESET_HOUR)))


def deaccumulate(
    hourly: DataFrame, columns: Sequence[str] = ("ssrd", "precip"), keys: Sequence[str] = ("location",)
) -> DataFrame:
    """Hourly amounts from running totals that start again at the reset hour."""
    before = {f"_before_{c}": c for c in columns}
    lagged = previous_row(hourly, keys, ["time"], before, accumulation_chunk(F.col("time")))
    starts = F.hour("time") == RESET_HOUR
    amounts = {
        c: F.when(starts, F.col(c)).otherwise(F.col(c) - F.col(f"_before_{c}")) for c in columns
    }
    return lagged.withColumns(amounts).drop(*before)
