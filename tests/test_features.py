from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from timestamps import hours

from loadcast.operators.features import (
    cooling_profile,
    month_hour_mean,
    previous_hour_wrapped,
    projection_features,
    training_table,
)
from loadcast.operators.grid import spatial_mean, wind_speed
from loadcast.operators.reshape import melt
from loadcast.operators.rollup import annual_baseline, annual_weighted, monthly_mean
from loadcast.params import FEATURES, LABEL, LAGGED
from loadcast.plans.charts import hour_by_month, prediction_lines, prediction_trend, projected_lines
from loadcast.plans.weather import load_history

WEATHER = "location string, time timestamp_ntz, " + ", ".join(f"{c} double" for c in LAGGED)


def weather(spark, start, n, step=1):
    rows = [("jkt", start + timedelta(hours=i * step), *[float(i + k) for k in range(4)]) for i in range(n)]
    return spark.createDataFrame(rows, WEATHER)


def test_first_hour_of_year_sees_the_year_before(spark):
    df = weather(spark, datetime(2020, 12, 31, 20), 10)
    load = df.select("location", "time", F.lit(1.0).alias(LABEL)).filter(F.hour("time") == 2)
    out = training_table(df, load, {"jkt": 2021}).orderBy("time").collect()
    assert len(out) == 6 and list(out[0].asDict()) == ["location", "time", *FEATURES, LABEL]
    assert out[0]["ph_dewpoint_temp"] == 3.0 and out[0]["dewpoint_temp"] == 4.0
    assert [r[LABEL] for r in out] == [None, None, 1.0, None, None, None]
    assert out[0]["dry"] == 0.0 and out[0]["xhour"] == 0.0 and out[0]["yhour"] == 1.0


def test_cooling_profile_weights(spark):
    rows = [
        ("jkt", 2021, 2, 9, "Weekday", 100.0),
        ("jkt", 2021, 2, 9, "Weekend", 40.0),
        ("jkt", 2021, 2, 3, "Weekday", 70.0),
        ("jkt", 2021, 2, 4, "Weekend", None),
    ]
    sheet = spark.createDataFrame(rows, "location string, Year int, Month int, Hour int, Weekday string, `Cooling Load (kW)` double")
    out = {r["time"]: r for r in cooling_profile(sheet).collect()}
    assert set(out) == {datetime(2021, 2, 1, 9), datetime(2021, 2, 2, 3)}
    # 21 weekdays (1 March counted in) and 7 remaining days of 28.
    assert out[datetime(2021, 2, 1, 9)][LABEL] == pytest.approx((100 * 21 + 40 * 7) / 28)
    assert out[datetime(2021, 2, 2, 3)][LABEL] is None


def test_wrapped_lag_takes_row_24(spark):
    df = weather(spark, datetime(2022, 1, 1, 8), 30).withColumn("scenario", F.lit("26"))
    out = previous_hour_wrapped(df).orderBy("time").collect()
    assert [r["ph_temp"] for r in out[:3]] == [24.0, 1.0, 2.0]
    short = previous_hour_wrapped(df.limit(5)).orderBy("time").first()
    assert short["ph_temp"] is None


def test_projection_features_drop_the_overflow_day(spark):
    df = weather(spark, datetime(2022, 1, 1), 24 * 31).withColumn("scenario", F.lit("26"))
    over = df.limit(3).withColumns({"time": F.col("time") + F.expr("interval 400 days"), **{c: F.lit(None).cast("double") for c in LAGGED}})
    out = projection_features(df.unionByName(over))
    assert out.count() == 24 and out.columns == ["location", "scenario", "time", *FEATURES]
    means = month_hour_mean(df.unionByName(over), LAGGED).filter("temp is null")
    assert means.count() == 3


def test_spatial_mean_is_strict_and_wind_rules_differ(spark):
    t = hours(0)[0]
    rows = [("jkt", t, 3.0, 4.0, 1.0), ("jkt", t, -3.0, 4.0, None)]
    df = spark.createDataFrame(rows, "location string, time timestamp_ntz, u10_wind double, v10_wind double, temp double")
    assert spatial_mean(df, ["temp"]).first()["temp"] is None
    assert wind_speed(df, "per_cell").first()["wind_speed"] == 5.0
    assert wind_speed(df, "mean_vector").first()["wind_speed"] == 4.0
    with pytest.raises(ValueError):
        wind_speed(df, "other")


def test_history_files_are_joined_in_order(spark):
    """The second file repeats the last hour of the first."""
    rows = []
    for file, offsets in (("f1", [0, 1, 2]), ("f2", [2, 3])):
        for h in offsets:
            for lon in (0, 1):
                rows.append(("jkt", file, lon, 0, hours(h)[0], 3.0, 4.0, 280.0, 300.0 + lon, 3600.0, -0.001))
    df = spark.createDataFrame(
        rows,
        "location string, file string, lon int, lat int, time timestamp_ntz, u10_wind double, v10_wind double, "
        "dewpoint_temp double, temp double, ssrd double, precip double",
    )
    out = load_history(df, {"jkt": (2024, 2024)}, file_key="file").orderBy("time").collect()
    # The doubled hour moves on; the next raw hour then looks doubled and moves on too.
    assert [r["time"] for r in out] == hours(0, 1, 2, 3, 4)
    assert out[0]["temp"] == pytest.approx(27.35) and out[0]["precip"] == 0.0 and out[0]["ssrd"] == 1.0
    assert out[0]["wind_speed"] == pytest.approx(18.0)


def test_rollups(spark):
    t = datetime(2023, 12, 31)
    rows = [("jkt", t + timedelta(days=i), float(i % 5)) for i in range(367)] + [("smg", t, None)]
    df = spark.createDataFrame(rows, "location string, time timestamp_ntz, x double")
    monthly = monthly_mean(df, ["x"])
    jkt = monthly.filter("location = 'jkt'").orderBy("year", "month").collect()
    assert [r["month_index"] for r in jkt] == list(range(1, 14)) and jkt[0]["time"].isoformat() == "2023-12-01"
    assert monthly.filter("location = 'smg'").first()["x"] is None
    annual = {(r["location"], r["year"]): r["x"] for r in annual_weighted(monthly, ["x"]).collect()}
    days = [float(i % 5) for i in range(1, 367)]
    assert annual["jkt", 2024] == pytest.approx(sum(days) / 366) and annual["smg", 2023] is None


def test_baseline_is_the_hourly_mean_of_the_year(spark):
    rows = [("jkt", datetime(2021, m, 1 if h >= 8 else 2, h), float(m)) for m in range(1, 13) for h in range(24)]
    df = spark.createDataFrame(rows, f"location string, time timestamp_ntz, {LABEL} double")
    out = annual_baseline(df, LABEL, ["a", "b"]).first()
    lengths = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    assert out["a"] == out["b"] == pytest.approx(sum((i + 1) * n for i, n in enumerate(lengths)) / 365)
    assert annual_baseline(df.limit(287), LABEL, ["a"]).first()["a"] is None  # an hour that is no row
    assert annual_baseline(df.union(df.limit(1).withColumn(LABEL, F.lit(None).cast("double"))), LABEL, ["a"]).first()["a"] is None


def test_chart_tables(spark):
    df = weather(spark, datetime(2022, 5, 1), 3)
    rows = hour_by_month(df, "precip").orderBy("time").collect()
    assert [(r["hour"], r["month"], r["month_label"], r["values"]) for r in rows] == [(0, 5, "May", 3.0), (1, 5, "May", 4.0), (2, 5, "May", 5.0)]
    loads = spark.createDataFrame(
        [("jkt", datetime(2022, 1, 1), 1, 10.0, 12.0, 11.0), ("jkt", datetime(2022, 1, 2), 2, 20.0, 22.0, 21.0)],
        f"location string, time timestamp_ntz, hour int, ann_cooling_load double, dnn_cooling_load double, {LABEL} double",
    )
    assert prediction_lines(loads).count() == 6
    line = prediction_trend(loads, "dnn").first()
    assert (line["slope"], line["intercept"]) == (pytest.approx(1.0), pytest.approx(1.0))
    assert melt(loads, ["location", "time", "hour"], ["ann_cooling_load"]).count() == 2
    assert projected_lines(loads, ["location", "hour"]).count() == 2
