"""Hour-of-day pattern of the history and its use on daily projections."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadcast.functions.calendar import add_days
from loadcast.functions.strict import only_value, ratio_or_zero, strict_avg
from loadcast.functions.units import dew_point, flux_to_mm_per_hour, kelvin_to_celsius, ms_to_kmh
from loadcast.operators.ordered import attach
from loadcast.params import RATIOS, SCENARIOS, SHIFT_DAYS, SHIFT_YEARS, Scenario, scenario_table


def year_index(series: DataFrame, shift_years: int = SHIFT_YEARS) -> DataFrame:
    """Position of each year in a location's history and its projection year.

    The distinct comes first, so the ranking window sees years, not hours.
    """
    years = series.select("location", F.year("time").alias("year")).distinct()
    rank = F.dense_rank().over(W.partitionBy("location").orderBy("year"))
    return years.select(
        "location", "year", (F.col("year") + shift_years).alias("year_proj"), rank.alias("year_index")
    )


def hourly_ratio(history: DataFrame, day: str | None = None) -> DataFrame:
    """Each hour's share of its daily mean; missing or undefined ratios are 0.

    The window partition is one local day of one location: 24 rows.  ``day``
    names a column to keep the date in; the result is partitioned by it, which a
    join on (location, day) can use as it is.
    """
    name = day or "_day"
    dated = history.withColumn(name, F.to_date("time"))
    window = W.partitionBy("location", name)
    ratios = {r: ratio_or_zero(F.col(c), strict_avg(c, window)) for c, r in RATIOS.items()}
    kept = [name] if day else []
    return dated.select("location", "time", *kept, *[c.alias(n) for n, c in ratios.items()])


def with_day_index(ratio: DataFrame, years: DataFrame, on: str = "year", rows: int | None = None) -> DataFrame:
    """Add year_index, month and day, looking the year up as ``on`` (year or year_proj)."""
    index = years.select("location", F.col(on).alias("_year"), "year_index")
    dated = ratio.withColumns({"_year": F.year("time"), "month": F.month("time"), "day": F.day("time")})
    return attach(dated, index, ["location", "_year"], rows).drop("_year")


def shift_pattern(ratio: DataFrame, days: int = SHIFT_DAYS) -> DataFrame:
    """Move the pattern onto the projection calendar by a whole number of days."""
    return ratio.withColumn("time", add_days(F.col("time"), days))


def daily_weather(daily: DataFrame, scenarios: Iterable[Scenario] = SCENARIOS) -> DataFrame:
    """Projection variables in the units of the history.

    The scenario's warming goes onto the temperature before the dew point is
    taken from it.
    """
    scenarios = list(scenarios)
    dim = scenario_table(daily.sparkSession, scenarios).select("scenario", "warming")
    warming = F.when(F.col("warming").isNull(), _unknown("scenario").cast("double")).otherwise(F.col("warming"))
    warmed = attach(daily, dim, ["scenario"], len(scenarios)).withColumn(
        "temp", kelvin_to_celsius(F.col("tas")) + warming
    )
    return warmed.select(
        "location",
        "scenario",
        "time",
        dew_point(F.col("hurs"), F.col("temp")).alias("dewpoint_temp"),
        "temp",
        F.col("rsds").alias("ssrd"),
        flux_to_mm_per_hour(F.col("pr")).alias("precip"),
        ms_to_kmh(F.col("sfcWind")).alias("wind_speed"),
    )


def _unknown(column: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(column, F.lit("NULL")))).cast("string")


def filter_years(df: DataFrame, spans: dict[str, tuple[int, int]], time: str = "time") -> DataFrame:
    """Keep each location's closed span of years.

    Written as time ranges, one per distinct span, so that they reach the scan
    and prune row groups.  A location without a span stops the query.
    """
    known = F.col("location").isin(*spans)
    place = F.when(known, F.col("location")).otherwise(_unknown("location"))
    grouped: dict[tuple[int, int], list[str]] = {}
    for location, span in spans.items():
        grouped.setdefault(span, []).append(location)

    def inside(span: tuple[int, int], locations: Sequence[str]) -> Column:
        first = F.make_timestamp_ntz(F.lit(span[0]), *[F.lit(n) for n in (1, 1, 0, 0, 0)])
        after = F.make_timestamp_ntz(F.lit(span[1] + 1), *[F.lit(n) for n in (1, 1, 0, 0, 0)])
        return F.col("location").isin(*locations) & (F.col(time) >= first) & (F.col(time) < after)

    keep = F.lit(False)
    for span, locations in grouped.items():
        keep = keep | inside(span, locations)
    # Unknown locations pass the filter, which stays one that a scan can use, to be reported behind it.
    return df.filter(keep | ~known | F.col("location").isNull()).withColumn("location", place)


def disaggregate(
    pattern: DataFrame, daily: DataFrame, scenarios: Iterable[Scenario] = SCENARIOS, day: str = "day"
) -> DataFrame:
    """Synthetic hourly weather: shifted hourly ratios times daily projections.

    ``pattern`` carries its date in column ``day``.  A pattern hour and a
    projection day belong together when year index, month and day agree; both
    take the index from the same projection year, so that is equality of the
    date, and no index has to be joined.

    The scenarios of a day travel as one row (columns per scenario) and fan out
    behind the join, so the hours are not shuffled once per scenario.  Every
    pattern hour is kept for each scenario, with NULL values where the day is
    missing.  An unknown scenario or a repeated day stops the query.
    """
    codes = [s.code for s in scenarios]
    scenario = F.when(F.col("scenario").isin(codes), F.col("scenario")).otherwise(_unknown("scenario"))
    known = daily.withColumns({"scenario": scenario, day: F.to_date("time")})
    cells = [
        only_value(F.col("scenario") == code, F.col(c), f"a day of scenario {code}").alias(f"{c}_{code}")
        for code in codes
        for c in RATIOS
    ]
    days = known.groupBy("location", day).agg(*cells)
    joined = pattern.join(days, ["location", day], "left")
    each = [
        F.struct(
            F.lit(code).alias("scenario"),
            *[(F.col(f"{c}_{code}") * F.col(r)).alias(f"proj_{c}") for c, r in RATIOS.items()],
        )
        for code in codes
    ]
    return joined.select("location", "time", F.inline(F.array(*each))).select(
        "location", "scenario", "time", *[f"proj_{c}" for c in RATIOS]
    )


def rank_pattern(history: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank of each hour within its day, highest first, ties averaged (24 rows a window)."""
    day = ["location", F.to_date("time")]
    ranks = {}
    for c in columns:
        ordered = W.partitionBy(*day).orderBy(F.desc(c))
        ties = F.count(F.lit(1)).over(W.partitionBy(*day, c))
        ranks[f"rank_{c}"] = F.rank().over(ordered) + (ties - 1) / 2
    return history.select("location", "time", *[c.alias(n) for n, c in ranks.items()])
