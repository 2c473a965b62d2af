"""Tables behind the charts: long form, ready to plot."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.operators.metrics import trend_line
from loadcast.operators.reshape import melt, scenario_wide, select_matching
from loadcast.operators.rollup import monthly_mean
from loadcast.params import LABEL, LAGGED, SCENARIOS, Scenario


def scenario_months(daily: DataFrame, quantity: str, scenarios: Iterable[Scenario] = SCENARIOS) -> DataFrame:
    """Monthly means of one daily quantity (prefix), scenarios as categories."""
    wide = scenario_wide(daily, LAGGED, [s.code for s in scenarios])
    months = monthly_mean(wide, [c for c in wide.columns if c not in ("location", "time")])
    return melt(select_matching(months, keep=["location", "time"], starts_with=[quantity]), ["location", "time"])


def hour_by_month(table: DataFrame, category: str) -> DataFrame:
    """One column of an hourly table by hour and month label."""
    labelled = table.withColumns(
        {"hour": F.hour("time"), "month": F.month("time"), "month_label": F.date_format("time", "MMM")}
    )
    ids = ["location", "time", "hour", "month", "month_label"]
    return melt(labelled, ids).filter(F.col("category") == category)


def prediction_lines(predictions: DataFrame) -> DataFrame:
    """Actual and predicted test loads by row number."""
    return melt(predictions.drop("time"), ["location", "hour"])


def prediction_trend(predictions: DataFrame, model: str) -> DataFrame:
    return trend_line(predictions, ["location"], LABEL, f"{model}_cooling_load")


def projected_lines(table: DataFrame, ids: Sequence[str], model: str = "dnn") -> DataFrame:
    """Monthly (ids with month_index) or annual (ids with year) loads by scenario."""
    return melt(select_matching(table, keep=ids, contains=[model]), ids)
