"""Queries on reading, writing and repairing series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.catalog import views as V
from loadcast.catalog.registry import query, rounded, sql_round
from loadcast.catalog.views import with_views
from loadcast.functions.calendar import add_hours, decode_hours, seconds_between, truncate_hour
from loadcast.functions.strict import clamp_negative
from loadcast.operators.disagg import filter_years
from loadcast.operators.grid import deaccumulate, spatial_mean, wind_speeds
from loadcast.operators.reshape import melt, select_matching, strip_text
from loadcast.operators.timefix import repair_hours, shift_origin
from loadcast.params import DAILY_VARIABLES, SCENARIOS, WEATHER
from loadcast.plans.projection import load_projection
from loadcast.plans.weather import GRID, convert_units, load_history, load_weather
from loadcast.sources.cubes import cube_to_rows
from loadcast.sources.scratch import materialize, scratch_path
from loadcast.sources.series import bad_lines, path_keys, scan_series, scan_table
from loadcast.sources.sinks import read_positions, write_table

SPANS = {"jkt": (1996, 1999), "smg": (1995, 1998)}


def _write_series(spark: SparkSession, sf_dir: str) -> str:
    """P as CSV series in the layout of the projections; returns the folder.

    Scenario 45 is stamped one hour late, and the clock is left out at midnight.
    """
    labels = F.create_map(*[F.lit(x) for s in SCENARIOS for x in (s.code, s.label)])
    long = melt(V.daily(spark, sf_dir), ["location", "scenario", "time"])
    late = F.when(F.col("scenario") == "45", add_hours(F.col("time"), F.lit(1))).otherwise(F.col("time"))
    text = F.when(F.hour(late) == 0, late.cast("date").cast("string")).otherwise(late.cast("string"))
    files = long.select(
        labels[F.col("scenario")].alias("rcp"),
        F.year("time").alias("interval"),
        F.concat_ws("_", "category", "location", F.lit("daily")).alias("series"),
        text.alias("date"),
        F.col("values").alias("v"),
        F.lit("x").alias("note"),
    )
    path = scratch_path(spark, "series")
    # Range partitioning keeps a file in time order and splits a large one.
    ordered = files.repartitionByRange("rcp", "interval", "series", "date").sortWithinPartitions(
        "rcp", "interval", "series", "date"
    )
    ordered.write.option("header", True).partitionBy("rcp", "interval", "series").csv(path)
    return path


@query(
    "scan_csv_series",
    with_views(
        "P",
        """select location, scenario, cast(year(time) as varchar) as "interval", variable,
 case when scenario = '45' then time + interval 1 hour else time end as time, """
        + sql_round(["value"], 15)
        + """ from (unpivot P on hurs, pr, rsds, "sfcWind", tas into name variable value value)""",
    ),
)
def scan_csv_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_series(spark, _write_series(spark, sf_dir), "daily")
    return rounded(rows.select("location", "scenario", "interval", "variable", "time", "value"), 15)


@query(
    "path_to_keys",
    with_views(
        "P",
        """select location, scenario, cast(year(time) as varchar) as "interval", variable, 'daily' as kind, count(*) as n
from (unpivot P on hurs, pr, rsds, "sfcWind", tas into name variable value value)
group by 1, 2, 3, 4, 5""",
    ),
)
def path_to_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).option("header", True).schema("date string").csv(
        _write_series(spark, sf_dir)
    )
    keys = {n: c for n, c in path_keys(F.col("_metadata.file_path")).items()}
    return files.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.count(F.lit(1)).alias("n"))


@query(
    "sink_roundtrip",
    with_views("P", f"select location, scenario, time, {sql_round(DAILY_VARIABLES, 15)} from P"),
)
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through CSV, then through Parquet."""
    text, table = scratch_path(spark, "text"), scratch_path(spark, "table")
    write_table(V.daily(spark, sf_dir), text, fmt="csv")
    schema = "time timestamp_ntz, hurs double, pr double, rsds double, sfcWind double, tas double, location string, scenario string"
    write_table(scan_table(spark, text, schema), table)
    back = spark.read.schema(schema).parquet(table)
    return rounded(back.select("location", "scenario", "time", *DAILY_VARIABLES), 15)


@query(
    "load_projection",
    with_views(
        "P",
        f"""select location, scenario, cast(year(time) as varchar) as "interval", time, {sql_round(DAILY_VARIABLES, 15)} from P""",
    ),
)
def load_projection_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(load_projection(spark, _write_series(spark, sf_dir)), 15)


def _repair_sql(source: str, series: str) -> str:
    """Literal recursion over row positions: the corrected time before decides."""
    step = "date_diff('second', r.fixed, x.time)"
    return f"""select x.*, x.time as fixed from {source} x where x.pos = 1
 union all
 select x.*, case when {step} = 7200 then x.time - interval 1 hour
  when {step} = 0 then r.fixed + interval 1 hour else x.time end
 from R r join {source} x on x.{series} = r.{series} and x.pos = r.pos + 1"""


_KEYS = ["location", "scenario", "interval", "variable"]
_CODES = [s.code for s in SCENARIOS]

# Hours as faulty files give them: a doubled hour, a skipped one, and one that jumps back to a time that is there already.
_FAULTY = """case when day(time) % 5 = 2 and hour(time) = 3 then time - interval 1 hour
 when day(time) % 7 = 3 and hour(time) = 10 then time + interval 1 hour
 when day(time) % 6 = 5 and hour(time) = 15 then time - interval 6 hour else time end"""


def _write_hourly(spark: SparkSession, sf_dir: str) -> str:
    """H as hourly CSV series of three scenarios and two intervals, in the order of time, with faulty hours.

    Scenario 45 is stamped one hour late, so its series begin at hour 1; minutes are those of the value.
    """
    labels = F.create_map(*[F.lit(x) for c in SCENARIOS for x in (c.code, c.label)])
    names = dict(zip(WEATHER, DAILY_VARIABLES))
    hist = V.history(spark, sf_dir).withColumnsRenamed(names).withColumn("scenario", F.explode(F.array(*[F.lit(c) for c in _CODES])))
    long = melt(hist, ["location", "scenario", "time"])
    stamped = F.expr(_FAULTY) + F.when(F.col("scenario") == "45", F.expr("interval 1 hour")).otherwise(F.expr("interval 0 hour"))
    minutes = F.make_dt_interval(mins=F.day("time") + F.hour("time"))
    files = long.select(
        labels[F.col("scenario")].alias("rcp"),
        F.when(F.day("time") <= 15, "first").otherwise("second").alias("interval"),
        F.concat_ws("_", "category", "location", F.lit("disagg")).alias("series"),
        F.date_format(stamped + minutes, "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.col("values").alias("v"),
        F.col("time").cast("string").alias("at"),
    )
    path = scratch_path(spark, "hourly")
    place = ["rcp", "interval", "series", "at"]
    files.repartitionByRange(*place).sortWithinPartitions(*place).write.option("header", True).partitionBy("rcp", "interval", "series").csv(path)
    return path


_HOURLY_SQL = {
    "U": "select location, time, "
    + ", ".join(f'{w} as "{v}"' for w, v in zip(WEATHER, DAILY_VARIABLES))
    + " from H",
    "V": f"""select location, scenario, if(day(time) <= 15, 'first', 'second') as "interval", variable, value, time,
 date_trunc('hour', {_FAULTY} + if(scenario = '45', interval 1 hour, interval 0 hour)) as stamped
from (unpivot U on {", ".join(f'"{v}"' for v in DAILY_VARIABLES)} into name variable value value)
 cross join (select unnest({_CODES}) as scenario)""",
    "O": """select *, dense_rank() over (order by location, scenario, "interval", variable) as series,
 row_number() over (partition by location, scenario, "interval", variable order by time) as pos,
 first_value(hour(stamped)) over (partition by location, scenario, "interval", variable order by time) as first_hour from V""",
    "X": """select location, scenario, "interval", variable, value, series, pos,
 cast(if(first_hour > 0, stamped - interval 1 hour, stamped) as timestamp) as time from O""",
}


@query(
    "load_projection_hourly",
    with_views(
        "H",
        """select location, scenario, "interval", fixed as time, """
        + sql_round({v: f"{v}.value" for v in DAILY_VARIABLES}, 12)
        + f' from (select * from R where variable = \'{DAILY_VARIABLES[0]}\') as "{DAILY_VARIABLES[0]}"'
        + "".join(
            f""" left join (select location, scenario, "interval", fixed, value from R where variable = '{v}') as "{v}"
 using (location, scenario, "interval", fixed)"""
            for v in DAILY_VARIABLES[1:]
        ),
        {**_HOURLY_SQL, "R": _repair_sql("X", "series")},
        recursive=True,
    ),
)
def load_projection_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins moved, hours repaired, and variables joined with rows repeated where a time is there twice."""
    return rounded(load_projection(spark, _write_hourly(spark, sf_dir), hourly=True), 12)


_BAD = {"value": "l_quantity % 7 = 0", "time": "l_linenumber % 5 = 4", "missing": "l_quantity % 11 = 0"}


@query(
    "bad_lines",
    f"""select if(l_linestatus = 'F', 'jkt', 'smg') as location, case l_returnflag when 'A' then '26' when 'N' then '45' else '85' end as scenario,
 cast(year(l_shipdate) as varchar) as "interval", 'tas' as variable, count(*) as lines, count(*) filter ({_BAD['time']}) as bad_times,
 count(*) filter ({_BAD['value']} and not {_BAD['missing']}) as bad_values, sum(case when {_BAD['value']} or {_BAD['missing']} then 0 else l_orderkey end)::double as total
from lineitem group by 1, 2, 3, 4""",
)
def bad_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with numbers and times that cannot be read, beside missing ones: counts per file, and the sum of what is sound."""
    labels = F.create_map(*[F.lit(x) for c in SCENARIOS for x in (c.code, c.label)])
    lines = V.table(spark, sf_dir, "lineitem").select(
        labels[V._line_scenario()].alias("rcp"),
        F.year("l_shipdate").alias("interval"),
        F.concat(F.lit("tas_"), V._line_location(), F.lit("_daily")).alias("series"),
        F.expr(f"if({_BAD['time']}, 'day ' || l_linenumber, cast(l_shipdate as string))").alias("date"),
        F.expr(f"case when {_BAD['missing']} then null when {_BAD['value']} then l_orderkey || ' kg' else cast(l_orderkey as string) end").alias("v"),
    )
    path = scratch_path(spark, "lines")
    lines.write.option("header", True).option("nullValue", "NA").partitionBy("rcp", "interval", "series").csv(path)
    series = materialize(scan_series(spark, path, "daily"), "series")
    totals = series.groupBy(*_KEYS).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))
    return bad_lines(series).join(totals, _KEYS)


@query(
    "sink_order",
    with_views("S", "select location, scenario, time, row_number() over (partition by location, scenario order by time) as position from S"),
)
def sink_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row in the files that were written in the order of time."""
    path = scratch_path(spark, "sorted")
    shuffled = V.synthetic(spark, sf_dir).orderBy(F.xxhash64("time", "scenario"))
    write_table(shuffled, path, order_by=["time"])
    return read_positions(spark, path).select("location", "scenario", "time", "position")


@query(
    "decode_time_axis",
    """select event_id, cast(date_trunc('hour', ts) + interval 7 hour as timestamp) as time from events""",
)
def decode_time_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two unit origins, and hours with the noise of a stored double."""
    ev = V.table(spark, sf_dir, "events")
    origin = F.when(F.col("event_type").isin("click", "error"), "1900-01-01").otherwise("1970-01-01")
    hours = seconds_between(origin.cast("timestamp_ntz"), truncate_hour(F.col("ts"))) / 3600
    axis = ev.select(
        "event_id",
        F.concat(F.lit("hours since "), origin, F.lit(" 00:00:00.0")).alias("units"),
        (hours + 1e-6).alias("hours"),
    )
    return axis.select("event_id", decode_hours(F.col("units"), F.col("hours")).alias("time"))


def _cubes(spark: SparkSession, sf_dir: str, lats: int = 2) -> DataFrame:
    """G folded to cubes of 5 longitudes by 2 latitudes (or 1, the two-dimensional form) by 2 hours.

    Cells are averaged first, so a fold gathers at most 20 of them.
    """
    cell = ["location", "lat", "lon", "time"]
    cells = V.grid(spark, sf_dir).groupBy(*cell).agg(*[F.avg(c).alias(c) for c in GRID])
    lon, lat, hour = F.col("lon"), F.col("lat"), F.hour("time")
    corner = {
        "_lon0": lon - F.pmod(lon, F.lit(5)),
        "_lat0": lat - F.pmod(lat, F.lit(lats)),
        "_hour0": hour - F.pmod(hour, F.lit(2)),
        "_day": F.to_date("time"),
    }
    index = F.pmod(lon, F.lit(5)) + 5 * (F.pmod(lat, F.lit(lats)) + lats * F.pmod(hour, F.lit(2)))
    folded = (
        cells.withColumns({**corner, "_i": index})
        .groupBy("location", *corner)
        .agg(F.map_from_entries(F.collect_list(F.struct("_i", F.struct(*GRID)))).alias("_m"))
    )

    def spread(v: str):
        return F.transform(places, lambda i: F.try_element_at("_m", i)[v]).alias(v)

    places = F.sequence(F.lit(0), F.lit(10 * lats - 1))
    first_hour = F.date_diff("_day", F.lit("1900-01-01").cast("date")) * 24 - 7 + F.col("_hour0")
    return folded.select(
        "location",
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: i + F.col("_lon0")).alias("lon"),
        F.transform(F.sequence(F.lit(0), F.lit(lats - 1)), lambda i: i + F.col("_lat0")).alias("lat"),
        F.transform(F.array(F.lit(0), F.lit(1)), lambda h: (h + first_hour).cast("double")).alias("hours"),
        F.lit("hours since 1900-01-01 00:00:00.0").alias("units"),
        *[spread(v) for v in GRID],
    )


_CELLS = "select location, lon, lat, time, " + sql_round({c: f"avg({c})" for c in GRID})


@query("cube_to_rows", with_views("G", _CELLS + " from G group by location, lon, lat, time"))
def cube_to_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cube_to_rows(_cubes(spark, sf_dir), GRID))


@query("flat_cube_to_rows", with_views("G", _CELLS + " from G group by location, lon, lat, time"))
def flat_cube_to_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cube_to_rows(_cubes(spark, sf_dir, lats=1), GRID))


@query(
    "spatial_mean",
    with_views(
        "G", "select location, time, " + sql_round({c: f"avg({c})" for c in GRID}) + " from G group by 1, 2"
    ),
)
def spatial_mean_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial_mean(V.grid(spark, sf_dir), GRID))


@query(
    "wind_speed",
    with_views(
        "G",
        "select location, time, "
        + sql_round(
            {
                "per_cell": "avg(sqrt(u10_wind * u10_wind + v10_wind * v10_wind))",
                "mean_vector": "sqrt(avg(u10_wind) * avg(u10_wind) + avg(v10_wind) * avg(v10_wind))",
            }
        )
        + " from G group by 1, 2",
    ),
)
def wind_speed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wind_speeds(V.grid(spark, sf_dir)))


@query(
    "unit_convert",
    with_views(
        "G",
        "select location, lon, lat, time, "
        + sql_round(
            {
                "dewpoint_temp": "dewpoint_temp - 273.15",
                "air_temp": "temp - 273.15",
                "ssrd": "case when ssrd < 0 then 0 else ssrd end / 3600",
                "precip": "precip * 1000",
            }
        )
        + " from G",
    ),
)
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    clamped = V.grid(spark, sf_dir).withColumn("ssrd", clamp_negative(F.col("ssrd")))
    out = convert_units(clamped).withColumnRenamed("temp", "air_temp")
    return rounded(out.drop("u10_wind", "v10_wind"))


@query(
    "drop_missing",
    with_views(
        "G",
        f"""select location, lon, lat, time, {sql_round(GRID)} from G where precip <> 0 and lon <> 3""",
    ),
)
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL and NaN both count as missing."""
    cells = V.grid(spark, sf_dir).withColumns(
        {
            "precip": F.nullif("precip", F.lit(0.0)),
            "temp": F.when(F.col("lon") == 3, F.lit(float("nan"))).otherwise(F.col("temp")),
        }
    )
    return rounded(cells.dropna("any"))


@query(
    "deaccumulate",
    with_views(
        "H",
        "select location, time, "
        + sql_round(
            {c: f"case when hour(time) = 8 then {c} else {c} - lag({c}) over w end" for c in ("ssrd", "precip")}
        )
        + " from H window w as (partition by location order by time)",
    ),
)
def deaccumulate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(deaccumulate(V.history(spark, sf_dir).select("location", "time", "ssrd", "precip")))


@query(
    "load_weather",
    with_views(
        "G",
        "select location, time, "
        + sql_round(
            {
                "dewpoint_temp": "dewpoint_temp",
                "temp": "temp",
                "ssrd": "case when hour(time) = 8 then ssrd else ssrd - lag(ssrd) over w end",
                "precip": "case when hour(time) = 8 then precip else precip - lag(precip) over w end",
                "wind_speed": "wind_speed",
            }
        )
        + " from M window w as (partition by location order by time)",
        {
            "M": """select location, time, avg(dewpoint_temp - 273.15) as dewpoint_temp, avg(temp - 273.15) as temp,
 avg(ssrd / 3600) as ssrd, avg(precip * 1000) as precip,
 avg(sqrt(u10_wind * u10_wind + v10_wind * v10_wind) * 3600 / 1000) as wind_speed from G group by 1, 2"""
        },
    ),
)
def load_weather_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(load_weather(V.grid(spark, sf_dir)))


@query(
    "load_history",
    with_views(
        "G",
        "select location, fixed as time, "
        + sql_round(
            {
                "dewpoint_temp": "dewpoint_temp - 273.15",
                "temp": "temp - 273.15",
                "ssrd": "case when ssrd < 0 then 0 else ssrd end / 3600",
                "precip": "case when precip < 0 then 0 else precip end * 1000",
                "wind_speed": "sqrt(u * u + v * v) * 3600 / 1000",
            }
        )
        + " from R where year(fixed) between 2024 and 2024",
        {
            "M": """select location, time, avg(dewpoint_temp) as dewpoint_temp, avg(temp) as temp, avg(ssrd) as ssrd,
 avg(precip) as precip, avg(u10_wind) as u, avg(v10_wind) as v,
 row_number() over (partition by location order by time) as pos from G group by 1, 2""",
            "R": _repair_sql("M", "location"),
        },
        recursive=True,
    ),
)
def load_history_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = {"jkt": (2024, 2024), "smg": (2024, 2024)}
    return rounded(load_history(V.grid(spark, sf_dir), spans))


@query(
    "repair_hours",
    with_views(
        "X",
        "select series, event_id, pos, time, fixed from R",
        {"R": _repair_sql("X", "series")},
        recursive=True,
    ),
)
def repair_hours_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = V.raw_hours(spark, sf_dir).withColumn("fixed", F.col("time"))
    out = repair_hours(raw, ["series"], ["ts", "event_id"], time="fixed", position="pos")
    return out.select("series", "event_id", "pos", "time", "fixed")


@query(
    "repair_origin",
    with_views(
        "X",
        """select series, event_id, case when f.h > 0 then time - interval 1 hour else time end as time
from X join (select series, hour(time) as h from X where pos = 1) f using (series)""",
    ),
)
def repair_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = shift_origin(V.raw_hours(spark, sf_dir), ["series"], ["ts", "event_id"])
    return moved.select("series", "event_id", "time")


@query(
    "filter_year_range",
    with_views(
        "P",
        f"""select location, scenario, time, {sql_round(DAILY_VARIABLES)} from P
where (location = 'jkt' and year(time) between 1996 and 1999) or (location = 'smg' and year(time) between 1995 and 1998)""",
    ),
)
def filter_year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filter_years(V.daily(spark, sf_dir), SPANS))


@query(
    "rename_by_pattern",
    with_views("S", f"select location, scenario, time, {sql_round(WEATHER)} from S"),
)
def rename_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(strip_text(V.synthetic(spark, sf_dir)).select("location", "scenario", "time", *WEATHER))


@query(
    "select_by_name",
    with_views("S", f"select location, time, {sql_round({'proj_temp': 'temp', 'proj_ssrd': 'ssrd'})} from S"),
)
def select_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = select_matching(
        V.synthetic(spark, sf_dir), keep=["location", "time"], contains=["temp"], starts_with=["proj_ssrd"], without=["dew"]
    )
    return rounded(chosen)
