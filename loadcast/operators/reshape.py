"""Column naming, long and wide forms, variable joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.functions.strict import only_value

# Replacements that turn a sheet header into a column name, in order.
HEADER_REPLACEMENTS = [(" (", "_"), (" ", "_"), (")", "")]


def select_matching(
    df: DataFrame,
    keep: Sequence[str] = (),
    contains: Sequence[str] = (),
    starts_with: Sequence[str] = (),
    without: Sequence[str] = (),
) -> DataFrame:
    """Columns kept by name, substring or prefix, less those with a substring."""

    def wanted(c: str) -> bool:
        positive = c in keep or any(p in c for p in contains) or any(c.startswith(p) for p in starts_with)
        chosen = positive or not (keep or contains or starts_with)
        return chosen and not any(p in c for p in without)

    return df.select(*[c for c in df.columns if wanted(c)])


def rename_all(df: DataFrame, rule: Callable[[str], str]) -> DataFrame:
    return df.toDF(*[rule(c) for c in df.columns])


def strip_text(df: DataFrame, text: str = "proj_") -> DataFrame:
    """Remove the first occurrence of ``text`` from every column name."""
    return rename_all(df, lambda c: c.replace(text, "", 1))


def clean_header(name: str) -> str:
    return reduce(lambda n, pair: n.replace(*pair), HEADER_REPLACEMENTS, name)


def join_variables(
    long: DataFrame, keys: Sequence[str], variables: Sequence[str], how: str = "unique"
) -> DataFrame:
    """One column per variable, on the keys that the first variable has.

    ``unique`` expects at most one row per key and variable and folds everything
    in one aggregation; a repeated key stops the query with a message.  ``fanout``
    chains left joins, which repeats rows for repeated keys.
    """
    base = variables[0]
    if how == "fanout":
        parts = [
            long.filter(F.col("variable") == v).select(*keys, F.col("value").alias(v)) for v in variables
        ]
        return reduce(lambda a, b: a.join(b, list(keys), "left"), parts)
    if how != "unique":
        raise ValueError(f"unknown join rule: {how}")

    def only(v: str):
        hit = F.col("variable") == v
        value = F.max(F.when(hit, F.col("value")))
        message = F.concat(F.lit(f"{v} has repeated keys, use how='fanout'"))
        return F.when(F.count_if(hit) > 1, F.raise_error(message).cast("double")).otherwise(value)

    return (
        long.filter(F.col("variable").isin(*variables))
        .groupBy(*keys)
        .agg(F.count_if(F.col("variable") == base).alias("_base"), *[only(v).alias(v) for v in variables])
        .filter(F.col("_base") > 0)
        .drop("_base")
    )


def scenario_wide(
    df: DataFrame, values: Sequence[str], scenarios: Sequence[str], keys: Sequence[str] = ("location", "time")
) -> DataFrame:
    """Scenario series side by side by key, columns ``<value>_<scenario>``.

    A scenario with two rows of one key stops the query.
    """
    cols = [
        only_value(F.col("scenario") == s, F.col(v), f"a key of scenario {s}").alias(f"{v}_{s}")
        for v in values
        for s in scenarios
    ]
    return df.groupBy(*keys).agg(*cols)


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Long form with ``category`` and ``values``; NULL values are kept."""
    chosen = list(columns or [c for c in df.columns if c not in ids])
    return df.unpivot(list(ids), chosen, "category", "values")
