"""Climate-shaped views of the test tables, for Spark and as DuckDB SQL.

Each view maps whole tables onto an input the operators expect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.functions.calendar import add_hours, representative_time, truncate_hour
from loadcast.functions.strict import clamp_negative
from loadcast.functions.units import joules_to_watts, kelvin_to_celsius, metres_to_mm, ms_to_kmh, wind_magnitude


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G: gridded hourly readings."""
    user, value = F.col("user_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.when(user % 2 == 0, "jkt").otherwise("smg").alias("location"),
        (user % 10).cast("int").alias("lon"),
        F.floor(user / 10).cast("int").alias("lat"),
        truncate_hour(F.col("ts")).alias("time"),
        (value / 20 - 1).alias("u10_wind"),
        ((user % 7).cast("double") - 3).alias("v10_wind"),
        (290 + value / 100).alias("dewpoint_temp"),
        (295 + value / 100).alias("temp"),
        ((value - 10) * 3600).alias("ssrd"),
        F.when(F.col("event_type") == "error", value / 1000).otherwise(0.0).alias("precip"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H: hourly history per location."""
    return (
        grid(spark, sf_dir)
        .groupBy("location", "time")
        .agg(
            kelvin_to_celsius(F.avg("dewpoint_temp")).alias("dewpoint_temp"),
            kelvin_to_celsius(F.avg("temp")).alias("temp"),
            joules_to_watts(clamp_negative(F.avg("ssrd"))).alias("ssrd"),
            metres_to_mm(F.avg("precip")).alias("precip"),
            ms_to_kmh(wind_magnitude(F.avg("u10_wind"), F.avg("v10_wind"))).alias("wind_speed"),
        )
    )


def _line_location() -> Column:
    return F.when(F.col("l_linestatus") == "F", "jkt").otherwise("smg").alias("location")


def _line_scenario() -> Column:
    flag = F.col("l_returnflag")
    return F.when(flag == "A", "26").when(flag == "N", "45").otherwise("85").alias("scenario")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: daily projections per location and scenario."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(_line_location(), _line_scenario(), F.col("l_shipdate").alias("time"))
        .agg(
            F.avg(50 + F.col("l_quantity")).alias("hurs"),
            (F.avg("l_discount") / 3600).alias("pr"),
            (F.avg("l_extendedprice") / 100).alias("rsds"),
            (F.avg("l_tax") * 100).alias("sfcWind"),
            (295 + F.avg("l_quantity") / 10).alias("tas"),
        )
    )


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S: synthetic hourly weather per location and scenario."""
    hour = (F.col("l_orderkey") % 24).cast("int")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(_line_location(), _line_scenario(), add_hours(F.col("l_shipdate"), hour).alias("time"))
        .agg(
            (18 + F.avg("l_quantity") / 10).alias("proj_dewpoint_temp"),
            (20 + F.avg("l_quantity") / 10).alias("proj_temp"),
            (F.avg("l_extendedprice") / 100).alias("proj_ssrd"),
            F.avg("l_discount").alias("proj_precip"),
            (F.avg("l_tax") * 100).alias("proj_wind_speed"),
        )
    )


def raw_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X: raw hour sequences, ordered by (ts, event_id) within a series."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series"), "ts", "event_id", truncate_hour(F.col("ts")).alias("time")
    )


def load_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: building load by kind of day, with the headers of a sheet export."""
    day = F.dayofweek("o_orderdate")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.when(F.col("o_orderstatus") == "F", "jkt").otherwise("smg").alias("location"),
            F.year("o_orderdate").alias("Year"),
            F.month("o_orderdate").alias("Month"),
            (F.col("o_orderkey") % 24).cast("int").alias("Hour"),
            F.when(day.isin(1, 7), "Weekend").otherwise("Weekday").alias("Weekday"),
        )
        .agg((F.avg("o_totalprice") / 1000).alias("Cooling Load (kW)"))
    )


def mean_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B: load per representative hour, whatever kinds of day are there."""
    sheet = load_sheet(spark, sf_dir)
    time = representative_time(F.col("Year"), F.col("Month"), F.col("Hour"))
    return sheet.groupBy("location", time.alias("time")).agg(F.avg("Cooling Load (kW)").alias("avg_cooling_load"))


def month_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T: weather per representative hour."""
    day, hour = F.col("l_shipdate"), (F.col("l_orderkey") % 24).cast("int")
    time = representative_time(F.year(day), F.month(day), hour)
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(_line_location(), time.alias("time"))
        .agg(
            F.avg(20 + F.col("l_quantity") / 10).alias("temp"),
            F.avg(18 + F.col("l_quantity") / 10).alias("dewpoint_temp"),
            (F.avg("l_extendedprice") / 100).alias("ssrd"),
            F.avg("l_discount").alias("precip"),
        )
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y: actual and predicted values."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"),
        F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * 1500).alias("p"),
    )


_PLACE = "case when l_linestatus = 'F' then 'jkt' else 'smg' end"
_SCENARIO = "case l_returnflag when 'A' then '26' when 'N' then '45' else '85' end"
_STAMP = "make_timestamp({y}, {m}, case when {h} >= 8 then 1 else 2 end, {h}, 0, 0)"

SQL_VIEWS = {
    "G": """select case when user_id % 2 = 0 then 'jkt' else 'smg' end as location,
 cast(user_id % 10 as int) as lon, cast(floor(user_id / 10.0) as int) as lat,
 cast(date_trunc('hour', ts) as timestamp) as time,
 value / 20 - 1 as u10_wind, cast(user_id % 7 as double) - 3 as v10_wind,
 290 + value / 100 as dewpoint_temp, 295 + value / 100 as temp,
 (value - 10) * 3600 as ssrd,
 case when event_type = 'error' then value / 1000 else 0 end as precip
from events""",
    "H": """select location, time, avg(dewpoint_temp) - 273.15 as dewpoint_temp, avg(temp) - 273.15 as temp,
 case when avg(ssrd) < 0 then 0 else avg(ssrd) end / 3600 as ssrd, avg(precip) * 1000 as precip,
 sqrt(avg(u10_wind) * avg(u10_wind) + avg(v10_wind) * avg(v10_wind)) * 3.6 as wind_speed
from G group by location, time""",
    "P": f"""select {_PLACE} as location, {_SCENARIO} as scenario, l_shipdate as time,
 avg(50 + l_quantity) as hurs, avg(l_discount) / 3600 as pr, avg(l_extendedprice) / 100 as rsds,
 avg(l_tax) * 100 as "sfcWind", 295 + avg(l_quantity) / 10 as tas
from lineitem group by 1, 2, 3""",
    "S": f"""select {_PLACE} as location, {_SCENARIO} as scenario,
 l_shipdate + to_hours(cast(l_orderkey % 24 as int)) as time,
 18 + avg(l_quantity) / 10 as dewpoint_temp, 20 + avg(l_quantity) / 10 as temp,
 avg(l_extendedprice) / 100 as ssrd, avg(l_discount) as precip, avg(l_tax) * 100 as wind_speed
from lineitem group by 1, 2, 3""",
    "X": """select event_type as series, event_id,
 row_number() over (partition by event_type order by ts, event_id) as pos,
 cast(date_trunc('hour', ts) as timestamp) as time
from events""",
    "L": """select case when o_orderstatus = 'F' then 'jkt' else 'smg' end as location,
 cast(year(o_orderdate) as int) as year, cast(month(o_orderdate) as int) as month,
 cast(o_orderkey % 24 as int) as hour,
 case when dayofweek(o_orderdate) in (0, 6) then 'Weekend' else 'Weekday' end as kind,
 avg(o_totalprice) / 1000 as load_kw
from orders group by 1, 2, 3, 4, 5""",
    "B": f"""select location, {_STAMP.format(y="year", m="month", h="hour")} as time, avg(load_kw) as avg_cooling_load
from L group by 1, 2""",
    "T": f"""select {_PLACE} as location,
 {_STAMP.format(y="year(l_shipdate)", m="month(l_shipdate)", h="(l_orderkey % 24)")} as time,
 avg(20 + l_quantity / 10) as temp, avg(18 + l_quantity / 10) as dewpoint_temp,
 avg(l_extendedprice) / 100 as ssrd, avg(l_discount) as precip
from lineitem group by 1, 2""",
    "Y": "select l_returnflag as model, l_extendedprice as y, l_quantity * 1500 as p from lineitem",
}

_NEEDS = {"H": ["G"], "B": ["L"]}


def with_views(names: str, body: str, more: dict[str, str] | None = None, recursive: bool = False) -> str:
    """SQL with the named views (letters) and further CTEs in front."""
    wanted: list[str] = []
    for n in names:
        for v in [*_NEEDS.get(n, []), n]:
            if v not in wanted:
                wanted.append(v)
    ctes = {**{v: SQL_VIEWS[v] for v in wanted}, **(more or {})}
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(f"{n} as ({q})" for n, q in ctes.items()) + "\n" + body
