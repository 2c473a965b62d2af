"""Ordered split and min-max scaling with the bounds of the training part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.operators.ordered import attach, month_chunk, number_rows
from loadcast.params import FEATURES, LABEL


def ordered_split(training: DataFrame, validation: float = 0.2) -> DataFrame:
    """Add ``row`` (1-based, by time) and ``part`` (fit, val or test) per location.

    The first two thirds train, the rest tests; the last fifth of the training
    rows validates.
    """
    numbered = number_rows(training.dropna("any"), ["location"], ["time"], month_chunk("time"), "row", "_n")
    cut = F.floor(F.col("_n") * 2 / 3)
    fit = F.floor(cut * F.lit(1 - validation) + F.lit(1e-9))
    part = F.when(F.col("row") <= fit, "fit").when(F.col("row") <= cut, "val").otherwise("test")
    return numbered.withColumns({"part": part, "row": F.col("row").cast("int")}).drop("_n")


def bounds(split: DataFrame, columns: Sequence[str] = (*FEATURES, LABEL)) -> DataFrame:
    """Minimum and maximum of each column over the training rows, one row per location."""
    train = split.filter(F.col("part") != "test")
    aggs = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return train.groupBy("location").agg(*aggs)


def scale(
    df: DataFrame, limits: DataFrame, columns: Sequence[str], site_rows: int | None = None
) -> DataFrame:
    """(x - min) / (max - min); NULL for a column that is constant in training."""
    scaled = {
        c: F.try_divide(F.col(c) - F.col(f"min_{c}"), F.col(f"max_{c}") - F.col(f"min_{c}")) for c in columns
    }
    kept = limits.select("location", *[f"{n}_{c}" for c in columns for n in ("min", "max")])
    return attach(df, kept, ["location"], site_rows).withColumns(scaled).select(*df.columns)


def unscale(
    df: DataFrame, limits: DataFrame, columns: Sequence[str], label: str = LABEL, site_rows: int | None = None
) -> DataFrame:
    """Scaled predictions back to the units of ``label``."""
    low, high = F.col(f"min_{label}"), F.col(f"max_{label}")
    kept = limits.select("location", low, high)
    back = {c: F.col(c) * (high - low) + low for c in columns}
    return attach(df, kept, ["location"], site_rows).withColumns(back).select(*df.columns)
