"""Monthly and annual roll-ups of predicted loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadcast.functions.calendar import days_in_month, days_in_year
from loadcast.functions.strict import strict_avg, strict_sum

REPRESENTATIVE_HOURS = 12 * 24


def monthly_mean(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("location",)) -> DataFrame:
    """Mean per calendar month, with ``time`` (first of month) and ``month_index``.

    The index counts the months present in a series, from 1; its window runs
    over months, twelve per year.
    """
    by_month = (
        df.withColumns({"year": F.year("time"), "month": F.month("time")})
        .groupBy(*keys, "year", "month")
        .agg(*[strict_avg(c).alias(c) for c in columns])
    )
    order = W.partitionBy(*keys).orderBy("year", "month")
    return by_month.withColumns(
        {"time": F.make_date("year", "month", F.lit(1)), "month_index": F.row_number().over(order)}
    )


def annual_weighted(monthly: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("location",)) -> DataFrame:
    """Annual mean of monthly means, each weighted by its share of the year's hours."""
    month_hours = 24 * days_in_month(F.make_date("year", "month", F.lit(1)))
    year_hours = 24 * days_in_year(F.col("year"))
    weighted = monthly.withColumns({c: F.col(c) * month_hours / year_hours for c in columns})
    return weighted.groupBy(*keys, "year").agg(*[strict_sum(c).alias(c) for c in columns])


def annual_baseline(
    profile: DataFrame, load: str, columns: Sequence[str], keys: Sequence[str] = ("location",)
) -> DataFrame:
    """Hourly mean of a year given by representative days, repeated per column.

    The mean is over the whole year, so a year without a load for each of its
    ``REPRESENTATIVE_HOURS`` gives NULL, whether hours are missing as rows or as values.
    """
    daily_share = F.col(load) * days_in_month(F.col("time"))
    complete = F.count_distinct(F.when(F.col("_share").isNotNull(), F.col("time"))) == REPRESENTATIVE_HOURS
    totals = (
        profile.select(*keys, "time", F.year("time").alias("year"), daily_share.alias("_share"))
        .groupBy(*keys, "year")
        .agg(F.when(complete, strict_sum("_share")).alias("_total"))
    )
    mean = F.col("_total") / (24 * days_in_year(F.col("year")))
    return totals.select(*keys, "year", *[mean.alias(c) for c in columns])


def annual_series(projected: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline year and projected years in one series."""
    return projected.unionByName(baseline)
