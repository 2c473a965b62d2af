import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loadcast.operators.disagg import (
    daily_weather,
    filter_years,
    hourly_ratio,
    rank_pattern,
    shift_pattern,
    with_day_index,
    year_index,
)
from loadcast.params import RATIOS, SCENARIOS, projection_spans, scenario_table
from loadcast.plans.projection import synthesize

HISTORY = "location string, time timestamp_ntz, dewpoint_temp double, temp double, ssrd double, precip double, wind_speed double"
DAILY = "location string, scenario string, time timestamp_ntz, hurs double, pr double, rsds double, sfcWind double, tas double"


def history(spark, days=3, start=datetime(2021, 12, 29)):
    rows = []
    for place in ("jkt", "smg"):
        for h in range(24 * days):
            t = start + timedelta(hours=h)
            sun = max(0.0, math.sin((t.hour - 6) / 12 * math.pi)) * 800
            # The first day is dry: a ratio of 0 to 0.
            rain = 0.0 if h < 24 else float(h % 5)
            rows.append((place, t, 20 + h % 7, 25 + h % 24 / 3, sun, rain, 5 + h % 3))
    return spark.createDataFrame([tuple(r[:2]) + tuple(map(float, r[2:])) for r in rows], HISTORY)


def daily(spark, days=4, start=datetime(2051, 12, 29)):
    rows = [
        (place, s.code, start + timedelta(days=d), 70.0 + d, 1e-5 * d, 200.0 + d, 2.0 + d, 300.0 + d)
        for place in ("jkt", "smg")
        for s in SCENARIOS
        for d in range(days)
    ]
    return spark.createDataFrame(rows, DAILY)


def test_ratio_averages_to_one(spark):
    ratio = hourly_ratio(history(spark)).groupBy("location", F.to_date("time").alias("d"))
    for r in ratio.agg(*[F.avg(c).alias(c) for c in RATIOS.values()]).collect():
        for c in RATIOS.values():
            dry = c == "ratio_precip" and r["d"].day == 29
            assert r[c] == pytest.approx(0.0 if dry else 1.0)


def test_one_missing_hour_zeroes_the_day(spark):
    broken = history(spark).withColumn("temp", F.when(F.hour("time") != 5, F.col("temp")))
    assert [r[0] for r in hourly_ratio(broken).select("ratio_temp").distinct().collect()] == [0.0]


def test_synthetic_daily_mean_is_the_projection(spark):
    out = synthesize(history(spark), daily(spark), {"jkt": (2022, 2051), "smg": (2022, 2051)})
    # The pattern day 2021-12-31 lands on 2052-01-01, outside the projection.
    assert out.count() == 2 * 3 * 72
    lost = out.filter(F.year("time") == 2052)
    assert lost.count() == 2 * 3 * 24 and lost.filter(F.col("proj_temp").isNotNull()).count() == 0
    means = out.filter(F.year("time") == 2051).groupBy("location", "scenario", F.to_date("time").alias("d"))
    got = {
        (r["location"], r["scenario"], r["d"]): r
        for r in means.agg(*[F.avg(f"proj_{c}").alias(c) for c in RATIOS]).collect()
    }
    wanted = daily_weather(daily(spark)).filter(F.year("time") == 2051).collect()
    hit = 0
    for w in wanted:
        r = got.get((w["location"], w["scenario"], w["time"].date()))
        if r:
            hit += 1
            for c in ("dewpoint_temp", "temp", "ssrd", "wind_speed"):
                assert r[c] == pytest.approx(w[c])
    assert hit == 2 * 3 * 2


def test_join_needs_no_second_shuffle_of_hours(spark):
    out = synthesize(history(spark), daily(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # One exchange for the hours (window and join share it), one for the days.
    assert plan.count("Exchange hashpartitioning") == 2


def test_shift_and_index(spark):
    hist = history(spark)
    years = year_index(hist)
    shifted = with_day_index(shift_pattern(hourly_ratio(hist)), years, "year_proj")
    by_day = {r["time"].date().isoformat(): r["year_index"] for r in shifted.collect()}
    assert by_day == {"2051-12-30": 1, "2051-12-31": 1, "2052-01-01": None}


def test_warming_per_scenario(spark):
    temps = {r["scenario"]: r["temp"] for r in daily_weather(daily(spark, 1)).filter("location = 'jkt'").collect()}
    assert temps == {s.code: pytest.approx(300 - 273.15 + s.warming) for s in SCENARIOS}
    assert scenario_table(spark).count() == 3


def test_filter_years_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "d")
    daily(spark).write.parquet(path)
    out = filter_years(spark.read.parquet(path), projection_spans())
    assert {r["location"] for r in out.collect()} == {"jkt"}  # 2051 is outside the second site's span
    assert "GreaterThanOrEqual(time" in out._jdf.queryExecution().executedPlan().toString()


def test_rank_averages_ties(spark):
    t = datetime(2024, 1, 1)
    rows = [("jkt", t + timedelta(hours=i), x) for i, x in enumerate([5.0, 7.0, 5.0, 1.0])]
    df = spark.createDataFrame(rows, "location string, time timestamp_ntz, temp double")
    assert [r["rank_temp"] for r in rank_pattern(df, ["temp"]).orderBy("time").collect()] == [2.5, 1.0, 2.5, 4.0]
