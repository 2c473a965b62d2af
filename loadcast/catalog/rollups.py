"""Queries on monthly and annual roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.catalog import views as V
from loadcast.catalog.patterns import CODES
from loadcast.catalog.registry import query, rounded, sql_round
from loadcast.catalog.training import FORECAST_SQL, full_training, projected
from loadcast.catalog.views import with_views
from loadcast.functions.calendar import representative_time
from loadcast.operators.reshape import scenario_wide
from loadcast.operators.rollup import annual_baseline, annual_series, annual_weighted, monthly_mean
from loadcast.params import DAILY_VARIABLES, LABEL
from loadcast.plans import charts, forecast
from loadcast.sources.scratch import materialize

DIGITS = {"pr": 15}
LOADS = [f"dnn_cooling_load_{s}" for s in CODES]
_MONTHS = "select location, scenario, year(time) as year, month(time) as month, " + ", ".join(
    f'avg("{c}") as "{c}"' for c in DAILY_VARIABLES
) + " from P group by 1, 2, 3, 4"
_SHARE = "day(last_day(make_date(year, month, 1))) / dayofyear(make_date(year, 12, 31))"
# A profile with every representative hour of the months that B has (the month's mean where an hour is absent), but for one hour of one year.
_ABSENT = "location = 'smg' and year(time) = 1997 and month(time) = 3 and hour(time) = 5"
_BASE = {
    "BM": "select location, year(time) as y, month(time) as m, avg(avg_cooling_load) as mean from B group by 1, 2, 3",
    "BH": f"select location, {V._STAMP.format(y='y', m='m', h='h')} as time, mean from BM cross join (select unnest(range(24)) as h)",
    "BF": f"select location, time, coalesce(avg_cooling_load, mean) as load from BH left join B using (location, time) where not ({_ABSENT})",
    "BA": """select location, year(time) as year, case when count(*) = 288 then sum(load * day(last_day(cast(time as date))))
 / (24 * dayofyear(make_date(year(time), 12, 31))) end as load from BF group by 1, 2""",
}


def full_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = materialize(V.mean_load(spark, sf_dir), "loads")  # for the hours and the months' means
    months = loads.groupBy("location", F.year("time").alias("y"), F.month("time").alias("m")).agg(F.avg(LABEL).alias("mean"))
    hours = months.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
    stamped = hours.select("location", representative_time(F.col("y"), F.col("m"), F.col("h")).alias("time"), "mean")
    filled = stamped.join(loads, ["location", "time"], "left").filter(f"not ({_ABSENT})")
    return filled.select("location", "time", F.coalesce(LABEL, "mean").alias(LABEL))


@query(
    "monthly_mean",
    with_views(
        "P",
        "select location, scenario, cast(year as int) as year, cast(month as int) as month, make_date(year, month, 1) as time,"
        " cast(row_number() over (partition by location, scenario order by year, month) as int) as month_index, "
        + sql_round({c: f'"{c}"' for c in DAILY_VARIABLES}, **DIGITS)
        + " from M",
        {"M": _MONTHS},
    ),
)
def monthly_mean_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = monthly_mean(V.daily(spark, sf_dir), DAILY_VARIABLES, ["location", "scenario"])
    return rounded(monthly, **DIGITS)


@query(
    "annual_weighted",
    with_views(
        "P",
        "select location, scenario, cast(year as int) as year, "
        + sql_round({c: f'sum("{c}" * {_SHARE})' for c in DAILY_VARIABLES}, **DIGITS)
        + " from M group by 1, 2, 3",
        {"M": _MONTHS},
    ),
)
def annual_weighted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["location", "scenario"]
    monthly = monthly_mean(V.daily(spark, sf_dir), DAILY_VARIABLES, keys)
    return rounded(annual_weighted(monthly, DAILY_VARIABLES, keys), **DIGITS)


@query(
    "annual_baseline",
    with_views(
        "B", f"select location, cast(year as int) as year, {sql_round({c: 'load' for c in LOADS})} from BA", _BASE
    ),
)
def annual_baseline_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(annual_baseline(full_profile(spark, sf_dir), LABEL, LOADS))


@query(
    "annual_series",
    with_views(
        "PB",
        f"""select location, cast(year as int) as year, {sql_round(LOADS)} from (
select location, year, {", ".join(f"sum(case when scenario = '{s}' then tas * {_SHARE} end) as dnn_cooling_load_{s}" for s in CODES)}
from M group by 1, 2
union all select location, year, load, load, load from BA)""",
        {"M": _MONTHS, **_BASE},
    ),
)
def annual_series_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["location", "scenario"]
    monthly = monthly_mean(V.daily(spark, sf_dir), ["tas"], keys)
    annual = annual_weighted(monthly, ["tas"], keys).withColumnRenamed("tas", "dnn_cooling_load")
    wide = scenario_wide(annual, ["dnn_cooling_load"], CODES, ["location", "year"])
    return rounded(annual_series(wide, annual_baseline(full_profile(spark, sf_dir), LABEL, LOADS)))


_ALL_LOADS = [f"{m}_cooling_load_{s}" for m in ("ann", "dnn") for s in CODES]
_WIDE = {
    **FORECAST_SQL,
    "PW": "select location, time, "
    + ", ".join(
        f"max(case when scenario = '{s}' then {m}_cooling_load end) as {m}_cooling_load_{s}"
        for m in ("ann", "dnn")
        for s in CODES
    )
    + " from PL group by 1, 2",
    "PM": "select location, year(time) as year, month(time) as month, "
    + ", ".join(f"case when count({c}) = count(*) then avg({c}) end as {c}" for c in _ALL_LOADS)
    + " from PW group by 1, 2, 3",
}


@query(
    "monthly_loads",
    with_views(
        "TBS",
        "select location, cast(year as int) as year, cast(month as int) as month, make_date(year, month, 1) as time,"
        " cast(row_number() over (partition by location order by year, month) as int) as month_index, "
        + sql_round(_ALL_LOADS)
        + " from PM",
        _WIDE,
    ),
)
def monthly_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forecast.monthly_loads(forecast.loads_by_scenario(projected(spark, sf_dir))))


_ANNUAL = f"""select location, cast(year as int) as year, {sql_round(LOADS)} from (
select location, year, {", ".join(f"case when count({c}) = count(*) then sum({c} * {_SHARE}) end as {c}" for c in LOADS)}
from PM group by 1, 2
union all select location, year, load, load, load from (
 select location, year(time) as year, case when count(distinct if(avg_cooling_load is null, null, time)) = 288 and count(avg_cooling_load) = count(*) then
  sum(avg_cooling_load * day(last_day(cast(time as date)))) / (24 * dayofyear(make_date(year(time), 12, 31))) end as load
 from TR group by 1, 2))"""


@query(
    "annual_loads",
    with_views(
        "TBS",
        _ANNUAL,
        _WIDE,
    ),
)
def annual_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = materialize(full_training(spark, sf_dir), "training")  # for the scaling and the baseline
    loads = forecast.loads_by_scenario(projected(spark, sf_dir, training, ["dnn"]), models=["dnn"])
    return rounded(forecast.annual_loads(forecast.monthly_loads(loads), training))


@query(
    "chart_annual_loads",
    with_views(
        "TBS",
        f'select location, year, category, "values" from ({_ANNUAL}) unpivot include nulls ("values" for category in ({", ".join(LOADS)}))',
        _WIDE,
    ),
)
def chart_annual_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.projected_lines(annual_loads(spark, sf_dir), ["location", "year"])


@query(
    "chart_projected_months",
    with_views(
        "TBS",
        "\nunion all ".join(
            f"select location, cast(row_number() over (partition by location order by year, month) as int) as month_index,"
            f" '{c}' as category, {sql_round({'values': c})} from PM"
            for c in LOADS
        ),
        _WIDE,
    ),
)
def chart_projected_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = forecast.loads_by_scenario(projected(spark, sf_dir, models=["dnn"]), models=["dnn"])
    monthly = forecast.monthly_loads(loads)
    return rounded(charts.projected_lines(monthly, ["location", "month_index"]))
