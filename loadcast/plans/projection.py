"""Climate projections: CSV series to synthetic hourly weather."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.functions.calendar import truncate_hour
from loadcast.operators.disagg import daily_weather, disaggregate, filter_years, hourly_ratio, shift_pattern
from loadcast.operators.reshape import join_variables
from loadcast.operators.timefix import repair_hours, shift_origin
from loadcast.params import DAILY_VARIABLES, SCENARIOS, SHIFT_DAYS, Scenario
from loadcast.sources.scratch import materialize
from loadcast.sources.series import require_sound, scan_series

SERIES = ["location", "scenario", "interval", "variable"]


def align_series(
    long: DataFrame, hourly: bool, compat_day_gap: bool = False, series_count: int | None = None
) -> DataFrame:
    """Whole hours, series origin at hour 0 and, for hourly data, repaired hours."""
    whole = long.withColumn("time", truncate_hour(F.col("time")))
    moved = shift_origin(whole, SERIES, ["line"], series_count=series_count)
    return repair_hours(moved, SERIES, ["line"], compat_day_gap=compat_day_gap) if hourly else moved


def load_projection(
    spark: SparkSession,
    paths: str | Sequence[str],
    hourly: bool = False,
    variables: Sequence[str] = DAILY_VARIABLES,
    compat_day_gap: bool = False,
    repeated: str | None = None,
    on_bad: str = "stop",
) -> DataFrame:
    """Projection table (location, scenario, interval, time, variables) from CSV files.

    Repaired hourly series may still hold a time twice, so they are joined with
    row repetition; daily series expect one row per day.  ``repeated`` (fanout or
    unique) chooses the rule.  Lines with a time or a value that cannot be read stop
    the query, unless ``on_bad`` is ``null``: then what cannot be read is missing.
    """
    if on_bad not in ("stop", "null"):
        raise ValueError(f"unknown rule for bad lines: {on_bad}")
    rule = repeated or ("fanout" if hourly else "unique")
    text = scan_series(spark, paths, "disagg" if hourly else "daily")
    # The text is parsed once; finding the origins and moving the series read the table.
    long = materialize(text, "series")
    if on_bad == "stop":
        require_sound(long)
    long = long.drop("bad")
    aligned = align_series(long, hourly, compat_day_gap)
    if rule == "fanout":
        aligned = materialize(aligned.drop("line"), "aligned")  # read once per variable
    keys = ["location", "scenario", "interval", "time"]
    return join_variables(aligned, keys, variables, rule)


def synthesize(
    history: DataFrame,
    daily: DataFrame,
    spans: dict[str, tuple[int, int]] | None = None,
    scenarios: Iterable[Scenario] = SCENARIOS,
    shift_days: int = SHIFT_DAYS,
) -> DataFrame:
    """Synthetic hourly weather for all locations and scenarios in one plan."""
    scenarios = list(scenarios)
    # Whole days: shifting first leaves the daily ratios as they are, and the
    # shifted date serves the ratio's window and the join alike.
    pattern = hourly_ratio(shift_pattern(history, shift_days), "day")
    days = filter_years(daily, spans) if spans else daily
    return disaggregate(pattern, daily_weather(days, scenarios), scenarios)
