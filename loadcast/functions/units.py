"""Unit conversions and derived weather quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magnus coefficients of the dew-point formula (Lawrence 2005).
MAGNUS_A = 17.625
MAGNUS_B = 243.04


def kelvin_to_celsius(x: Column) -> Column:
    return x - 273.15


def joules_to_watts(x: Column) -> Column:
    """J/m2 gathered over one hour to W/m2."""
    return x / 3600


def metres_to_mm(x: Column) -> Column:
    return x * 1000


def flux_to_mm_per_hour(x: Column) -> Column:
    """kg/m2/s of water to mm/h."""
    return x * 3600


def ms_to_kmh(x: Column) -> Column:
    return x * 3.6


def wind_magnitude(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def dew_point(humidity: Column, celsius: Column) -> Column:
    """Dew point in Celsius from relative humidity (%) and air temperature.

    Humidity of 0 or less gives NULL, as Spark's logarithm does.
    """
    saturation = MAGNUS_A * celsius / (MAGNUS_B + celsius)
    gamma = F.ln(humidity / 100) + saturation
    return MAGNUS_B * gamma / (MAGNUS_A - gamma)
