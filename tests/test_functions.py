from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loadcast.functions import calendar as C
from loadcast.functions.strict import clamp_negative, ratio_or_zero, strict_avg, strict_sum
from loadcast.functions.units import dew_point


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("r")).first()["r"]


def test_strict_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, x double")
    out = {r["k"]: r for r in df.groupBy("k").agg(strict_avg("x").alias("m"), strict_sum("x").alias("s")).collect()}
    assert out["a"]["m"] is None and out["a"]["s"] is None
    assert out["b"]["m"] == 3.0 and out["b"]["s"] == 6.0


def test_ratio_of_nothing_is_zero(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0), (1.0, 2.0), (None, 2.0), (1.0, None), (float("nan"), 1.0)], "x double, m double"
    )
    out = [r[0] for r in df.select(ratio_or_zero(F.col("x"), F.col("m"))).collect()]
    assert out == [0.0, 0.5, 0.0, 0.0, 0.0]


def test_clamp_keeps_missing(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(clamp_negative(F.col("x"))).collect()] == [0.0, 2.0, None]


def test_dew_point(spark):
    full = one(spark, dew_point(F.col("h"), F.col("t")), h=100.0, t=27.5)
    assert full == pytest.approx(27.5)
    assert one(spark, dew_point(F.col("h"), F.col("t")), h=60.0, t=30.0) == pytest.approx(21.39, abs=0.01)
    assert one(spark, dew_point(F.col("h"), F.col("t")), h=0.0, t=30.0) is None


def test_february_counts_take_in_next_first(spark):
    def counts(text):
        t = F.lit(text).cast("timestamp_ntz")
        days = C.weekday_count(C.month_start(t), C.next_month_start(t))
        return tuple(spark.range(1).select(days, C.days_in_month(t), C.days_in_year(F.year(t))).first())

    assert counts("2021-02-01 09:00:00") == (21, 28, 365)
    assert counts("2024-02-02 03:00:00") == (22, 29, 366)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.dates(date(1950, 1, 1), date(2100, 1, 1)), st.integers(0, 80)), min_size=20, max_size=40))
def test_weekday_count_matches_counting(spark, spans):
    rows = [(a, a + timedelta(days=n)) for a, n in spans]
    df = spark.createDataFrame(rows, "a date, b date")
    got = df.select("a", "b", C.weekday_count(F.col("a"), F.col("b")).alias("n")).collect()
    for r in got:
        days = (r["b"] - r["a"]).days + 1
        assert r["n"] == sum((r["a"] + timedelta(days=d)).weekday() < 5 for d in range(days))


def test_parse_both_forms(spark):
    df = spark.createDataFrame([("2022-01-01 05:00:00",), ("2022-01-02",), ("x",), (None,)], "s string")
    out = [r[0] for r in df.select(C.parse_time(F.col("s"))).collect()]
    assert out == [datetime(2022, 1, 1, 5), datetime(2022, 1, 2), None, None]


def test_decode_hours(spark):
    t = C.decode_hours(F.col("u"), F.col("h"))
    assert one(spark, t, u="hours since 1900-01-01 00:00:00.0", h=1051896.0) == datetime(2020, 1, 1, 7)
    assert one(spark, t, u="hours since 1970-01-01", h=0.4999999999) == datetime(1970, 1, 1, 7, 30)
    assert one(spark, t, u="no unit", h=1.0) is None


def test_representative_time(spark):
    at = C.representative_time(F.col("y"), F.col("m"), F.col("h"))
    assert one(spark, at, y=2021, m=3, h=8) == datetime(2021, 3, 1, 8)
    assert one(spark, at, y=2021, m=3, h=7) == datetime(2021, 3, 2, 7)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Jakarta"])
def test_time_arithmetic_ignores_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        a, b = (F.lit(s).cast("timestamp_ntz") for s in ("2024-03-10 01:30:00", "2024-03-10 03:30:00"))
        row = spark.range(1).select(C.seconds_between(a, b), C.truncate_hour(a), C.add_hours(a, F.lit(1))).first()
        assert tuple(row) == (7200, datetime(2024, 3, 10, 1), datetime(2024, 3, 10, 2, 30))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_month_number(spark):
    df = spark.createDataFrame([("3",), ("March",), ("sep",), ("xyz",)], "m string")
    assert [r[0] for r in df.select(C.month_number(F.col("m"))).collect()] == [3, 3, 9, None]
