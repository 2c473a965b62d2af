"""Error metrics, correlations and trend lines: one aggregation each."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-7  # floor of the percentage error's denominator


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation; NULL where a column is constant."""
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def regression_metrics(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    y, p = F.col(actual), F.col(predicted)
    mse = F.avg((y - p) * (y - p))
    rmse = F.sqrt(mse)
    return df.groupBy(*keys).agg(
        mse.alias("mse"),
        rmse.alias("rmse"),
        F.try_divide(100 * rmse, F.avg(y)).alias("cv_rmse"),
        (100 * F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPSILON)))).alias("mape"),
        F.pow(safe_corr(actual, predicted), 2).alias("r2"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("location",), digits: int = 2) -> DataFrame:
    """Full Pearson matrix in long form (a, b, r), from one pass over the rows.

    One covariance per pair and one spread per column are aggregated; entries of
    a constant column are NULL.
    """
    at = {c: i for i, c in enumerate(columns)}
    pairs = list(combinations(columns, 2))
    wide = df.groupBy(*keys).agg(
        *[F.covar_pop(a, b).alias(f"_c{at[a]}_{at[b]}") for a, b in pairs],
        *[F.when(F.min(c) < F.max(c), F.stddev_pop(c)).alias(f"_s{i}") for c, i in at.items()],
    )
    cells = [f"struct('{c}' as a, '{c}' as b, if(_s{i} is null, null, 1.0D) as r)" for c, i in at.items()]
    for a, b in pairs:
        r = f"try_divide(_c{at[a]}_{at[b]}, _s{at[a]} * _s{at[b]})"
        cells += [f"struct('{x}' as a, '{y}' as b, {r} as r)" for x, y in ((a, b), (b, a))]
    matrix = wide.select(*keys, F.expr(f"inline(array({', '.join(cells)}))"))
    return matrix.withColumn("r", F.round("r", digits))


def trend_line(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line y = intercept + slope * x."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )
