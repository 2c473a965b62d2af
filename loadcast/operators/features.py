"""Supervised tables: lags, season, cyclic hour, loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadcast.functions.calendar import (
    days_in_month,
    dry_season,
    hour_angle,
    month_number,
    month_start,
    next_month_start,
    representative_time,
    weekday_count,
)
from loadcast.functions.strict import only_value, strict_avg
from loadcast.operators.disagg import filter_years
from loadcast.operators.ordered import month_chunk, previous_row
from loadcast.operators.reshape import clean_header, rename_all
from loadcast.params import FEATURES, LABEL, LAGGED


def previous_hour(hourly: DataFrame, columns: Sequence[str] = LAGGED, keys: Sequence[str] = ("location",)) -> DataFrame:
    """Add ``ph_*`` columns with the values of the row before."""
    return previous_row(hourly, keys, ["time"], {f"ph_{c}": c for c in columns}, month_chunk("time"))


def cyclic_season(df: DataFrame) -> DataFrame:
    angle = hour_angle(F.col("time"))
    return df.withColumns({"dry": dry_season(F.col("time")), "xhour": F.sin(angle), "yhour": F.cos(angle)})


def cooling_profile(sheet: DataFrame) -> DataFrame:
    """Representative-day load per month and hour, weighted by kinds of day.

    Rows with missing cells are dropped, as for a sheet export with the columns
    location, Year, Month, Hour, Weekday and 'Cooling Load (kW)'.  The weekday
    count takes in the first day of the next month; the weekend count is what
    is left of the month.  Months may be numbers or names.
    """
    table = rename_all(sheet, clean_header).dropna("any")
    if dict(table.dtypes)["Month"] == "string":
        table = table.withColumn("Month", month_number(F.col("Month")))
    stamped = table.withColumn("time", representative_time(F.col("Year"), F.col("Month"), F.col("Hour")))
    kinds = {
        k: only_value(F.col("Weekday") == k, F.col("Cooling_Load_kW"), f"a {k} line of one hour").alias(k)
        for k in ("Weekend", "Weekday")
    }
    wide = stamped.groupBy("location", "time").agg(*kinds.values())
    t = F.col("time")
    weekdays = weekday_count(month_start(t), next_month_start(t))
    weekends = days_in_month(t) - weekdays
    load = (F.col("Weekday") * weekdays + F.col("Weekend") * weekends) / days_in_month(t)
    return wide.withColumn(LABEL, load)


def training_table(
    weather: DataFrame, load: DataFrame, training_years: dict[str, int] | None = None
) -> DataFrame:
    """Weather, lags, season and label of each location's training year.

    Lags are taken before the year filter, so the first hour of the year sees
    the last of the year before.  Without ``training_years`` all years are kept.
    """
    lagged = previous_hour(weather)
    if training_years:
        lagged = filter_years(lagged, {place: (year, year) for place, year in training_years.items()})
    return cyclic_season(lagged).join(load.select("location", "time", LABEL), ["location", "time"], "left").select(
        "location", "time", *FEATURES, LABEL
    )


def month_hour_mean(hourly: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("location", "scenario")) -> DataFrame:
    """Mean per year, month and hour of day."""
    parts = {"year": F.year("time"), "month": F.month("time"), "hour": F.hour("time")}
    return (
        hourly.withColumns(parts)
        .groupBy(*keys, *parts)
        .agg(*[strict_avg(c).alias(c) for c in columns])
    )


def previous_hour_wrapped(
    profile: DataFrame, columns: Sequence[str] = LAGGED, keys: Sequence[str] = ("location", "scenario")
) -> DataFrame:
    """``ph_*`` columns of a representative-day series; its first row takes row 24.

    Such a series has 288 rows per year, so a window over the whole series is
    bounded by the calendar.
    """
    series = W.partitionBy(*keys).orderBy("time")
    whole = series.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = F.row_number().over(series) == 1
    lags = {
        f"ph_{c}": F.when(first, F.nth_value(c, 24).over(whole)).otherwise(F.lag(c).over(series)) for c in columns
    }
    return profile.withColumns(lags)


def projection_features(synthetic: DataFrame, keys: Sequence[str] = ("location", "scenario")) -> DataFrame:
    """Model inputs from synthetic hourly weather (columns without ``proj_``)."""
    profile = month_hour_mean(synthetic, LAGGED, keys)
    stamped = profile.withColumn("time", representative_time(F.col("year"), F.col("month"), F.col("hour")))
    wrapped = previous_hour_wrapped(stamped, LAGGED, keys)
    return cyclic_season(wrapped).select(*keys, "time", *FEATURES).dropna("any")
