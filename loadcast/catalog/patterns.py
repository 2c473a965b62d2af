"""Queries on the hour-of-day pattern and the synthetic weather."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.catalog import views as V
from loadcast.catalog.registry import query, rounded, sql_round
from loadcast.catalog.views import with_views
from loadcast.operators.disagg import (
    daily_weather,
    hourly_ratio,
    rank_pattern,
    shift_pattern,
    with_day_index,
    year_index,
)
from loadcast.operators.reshape import join_variables, melt, scenario_wide
from loadcast.params import DAILY_VARIABLES, RATIOS, SCENARIOS, WEATHER
from loadcast.plans.charts import scenario_months
from loadcast.plans.projection import synthesize
from loadcast.sources.scratch import materialize

# From the first day of the history view (2024) to the first year of the daily view (1995).
FIXTURE_DAYS = -10592
CODES = [s.code for s in SCENARIOS]

_RATIO = "select *, " + ", ".join(
    f"coalesce({c} / nullif(avg({c}) over (partition by location, cast(time as date)), 0), 0) as {r}"
    for c, r in RATIOS.items()
) + " from H"
_YEARS = """select location, year, year + 30 as year_proj, dense_rank() over (partition by location order by year) as year_index
from (select distinct location, year(time) as year from H)"""
_PARTS = "cast(year_index as int) as year_index, cast(month(time) as int) as month, cast(day(time) as int) as day"

_WARMING = "case scenario when '26' then 1.0 when '45' then 1.4 else 2.0 end"
_GAMMA = "ln(hurs / 100) + 17.625 * temp / (243.04 + temp)"
_DAILY = {
    "W": f"select *, tas - 273.15 + cast({_WARMING} as double) as temp from P",
    "D": f"""select location, scenario, time, 243.04 * ({_GAMMA}) / (17.625 - ({_GAMMA})) as dewpoint_temp, temp,
 rsds as ssrd, pr * 3600 as precip, "sfcWind" * 3600 / 1000 as wind_speed from W""",
}


@query(
    "year_index",
    with_views(
        "P",
        """select location, cast(year as int) as year, cast(year + 30 as int) as year_proj,
 cast(dense_rank() over (partition by location order by year) as int) as year_index
from (select distinct location, year(time) as year from P)""",
    ),
)
def year_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return year_index(V.daily(spark, sf_dir))


@query(
    "hourly_ratio",
    with_views(
        "H",
        f"select location, time, {_PARTS}, {sql_round(list(RATIOS.values()))} "
        "from Q join Yr using (location) where Yr.year = year(time)",
        {"Q": _RATIO, "Yr": _YEARS},
    ),
)
def hourly_ratio_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = materialize(V.history(spark, sf_dir), "history")  # read twice
    return rounded(with_day_index(hourly_ratio(hist), year_index(hist)))


@query(
    "shift_pattern",
    with_views(
        "H",
        f"select location, time, {_PARTS}, {sql_round(list(RATIOS.values()))} "
        "from Z left join Yr on Yr.location = Z.place and Yr.year_proj = year(Z.time)",
        {
            "Q": _RATIO,
            "Yr": _YEARS,
            "Z": "select location as place, time + interval 10958 day as time, "
            + ", ".join(RATIOS.values())
            + " from Q",
        },
    ).replace("select location, time, cast(year_index", "select place as location, time, cast(year_index"),
)
def shift_pattern_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = materialize(V.history(spark, sf_dir), "history")  # read twice
    shifted = shift_pattern(hourly_ratio(hist))
    return rounded(with_day_index(shifted, year_index(hist), "year_proj"))


@query(
    "disaggregate",
    with_views(
        "HP",
        "select z.location, c.scenario, z.time, "
        + sql_round({f"proj_{c}": f"d.{c} * z.{r}" for c, r in RATIOS.items()})
        + """ from Z z cross join (select unnest(['26', '45', '85']) as scenario) c
 left join E d on d.location = z.location and d.scenario = c.scenario and d.year_index = z.year_index
  and d.month = z.month and d.day = z.day""",
        {
            "Q": _RATIO,
            "Z": "select *, 1 as year_index, month(time) as month, day(time) as day from (select location, "
            "time - interval 10592 day as time, " + ", ".join(RATIOS.values()) + " from Q)",
            **_DAILY,
            "E": "select *, dense_rank() over (partition by location order by year(time)) as year_index, month(time) as month, day(time) as day from D",
        },
    ),
)
def disaggregate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(synthesize(V.history(spark, sf_dir), V.daily(spark, sf_dir), shift_days=FIXTURE_DAYS))


@query(
    "scenario_bias",
    with_views("P", f"select location, scenario, time, {sql_round(['temp'])} from W", {"W": _DAILY["W"]}),
)
def scenario_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(daily_weather(V.daily(spark, sf_dir)).select("location", "scenario", "time", "temp"))


@query(
    "dew_point",
    with_views("P", f"select location, scenario, time, {sql_round(WEATHER)} from D", _DAILY),
)
def dew_point_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(daily_weather(V.daily(spark, sf_dir)))


@query(
    "join_variables",
    with_views(
        "P",
        "select location, scenario, time, "
        + sql_round({c: "case when rsds >= 450 then rsds end" if c == "rsds" else f'"{c}"' for c in DAILY_VARIABLES}, 15)
        + " from P where hurs >= 70",
    ),
)
def join_variables_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes in the base variable drop keys, holes in another leave NULL."""
    long = melt(V.daily(spark, sf_dir), ["location", "scenario", "time"]).withColumnsRenamed(
        {"category": "variable", "values": "value"}
    )
    hole = ((F.col("variable") == "hurs") & (F.col("value") < 70)) | (
        (F.col("variable") == "rsds") & (F.col("value") < 450)
    )
    return rounded(join_variables(long.filter(~hole), ["location", "scenario", "time"], DAILY_VARIABLES), 15)


@query(
    "scenario_wide",
    with_views(
        "P",
        "select location, time, "
        + sql_round(
            {f"{v}_{s}": f"max(case when scenario = '{s}' then {v} end)" for v in ("temp", "dewpoint_temp") for s in CODES}
        )
        + " from D group by 1, 2",
        _DAILY,
    ),
)
def scenario_wide_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scenario_wide(daily_weather(V.daily(spark, sf_dir)), ["temp", "dewpoint_temp"], CODES))


@query(
    "chart_scenario_months",
    with_views(
        "P",
        "select location, cast(date_trunc('month', time) as date) as time, 'ssrd_' || scenario as category, "
        + sql_round({"values": "case when count(ssrd) = count(*) then avg(ssrd) end"})
        + """ from (select d.location, d.time, c.scenario, e.ssrd
 from (select distinct location, time from D) d cross join (select unnest(['26', '45', '85']) as scenario) c
 left join D e on e.location = d.location and e.time = d.time and e.scenario = c.scenario)
group by 1, 2, 3""",
        _DAILY,
    ),
)
def chart_scenario_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scenario_months(daily_weather(V.daily(spark, sf_dir)), "ssrd"))


@query(
    "rank_pattern",
    with_views(
        "H",
        "select location, time, "
        + ", ".join(
            f"rank() over (partition by location, cast(time as date) order by {c} desc)"
            f" + (count(*) over (partition by location, cast(time as date), {c}) - 1) / 2.0 as rank_{c}"
            for c in ("dewpoint_temp", "precip")
        )
        + " from (select location, time, round(dewpoint_temp, 9) as dewpoint_temp, round(precip, 9) as precip from H)",
    ),
)
def rank_pattern_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = V.history(spark, sf_dir).select("location", "time", *[F.round(c, 9).alias(c) for c in ("dewpoint_temp", "precip")])
    return rank_pattern(hist, ["dewpoint_temp", "precip"])
