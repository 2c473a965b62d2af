"""Registry of queries and oracles, and the rounding both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 9, **special: int) -> DataFrame:
    """Double columns at single precision, so that summation order does not show.

    The decimal rounding first clears noise around zero; ``special`` columns
    have their own number of digits for it.
    """
    names = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns(
        {n: F.round(n, special.get(n, digits)).cast("float").cast("double") for n in names}
    )


def sql_round(columns: dict[str, str] | list[str], digits: int = 9, **special: int) -> str:
    """Select items that match ``rounded``; adding 0.0 turns -0.0 into 0.0."""
    items = columns if isinstance(columns, dict) else {c: c for c in columns}
    return ", ".join(
        f'cast(cast(round({e}, {special.get(n, digits)}) + 0.0 as float) as double) as "{n}"' for n, e in items.items()
    )
