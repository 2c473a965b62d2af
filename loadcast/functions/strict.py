"""Aggregates and ratios with the missing-value rules of the study."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def _complete(c: str | Column, window: WindowSpec | None) -> Column:
    seen, rows = F.count(c), F.count(F.lit(1))
    if window is not None:
        seen, rows = seen.over(window), rows.over(window)
    return seen == rows


def strict_avg(c: str | Column, window: WindowSpec | None = None) -> Column:
    """Mean that is NULL as soon as one value of the group is missing."""
    value = F.avg(c) if window is None else F.avg(c).over(window)
    return F.when(_complete(c, window), value)


def strict_sum(c: str | Column, window: WindowSpec | None = None) -> Column:
    """Sum that is NULL as soon as one value of the group is missing."""
    value = F.sum(c) if window is None else F.sum(c).over(window)
    return F.when(_complete(c, window), value)


def ratio_or_zero(x: Column, whole: Column) -> Column:
    """x / whole, and 0 where the ratio is undefined."""
    return F.coalesce(F.nanvl(F.try_divide(x, whole), F.lit(0.0)), F.lit(0.0))


def clamp_negative(x: Column) -> Column:
    """Negative values become 0; missing values stay missing."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def only_value(hit: Column, value: Column, what: str) -> Column:
    """Aggregate: the value of the one row of a group that is hit; a second one stops the query."""
    message = F.raise_error(F.lit(f"{what} is there more than once"))
    return F.when(F.count_if(hit) > 1, message.cast("double")).otherwise(F.max(F.when(hit, value)))
