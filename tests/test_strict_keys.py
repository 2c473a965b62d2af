"""Rows that must not vanish, and keys that must stop a query."""

from datetime import datetime, timedelta

import pytest

from loadcast.functions import calendar as C
from loadcast.operators import mlp, training
from loadcast.operators.disagg import daily_weather, disaggregate, filter_years
from loadcast.operators.features import cooling_profile
from loadcast.operators.metrics import regression_metrics
from loadcast.operators.ordered import previous_row
from loadcast.operators.reshape import scenario_wide
from loadcast.operators.timefix import repair_hours
from loadcast.params import FEATURES, RATIOS
from loadcast.sources.series import scan_series
from pyspark.sql import functions as F

T0 = datetime(2024, 3, 1)


def _networks(spark, places):
    kinds = (("ann", mlp.shallow(3)), ("dnn", mlp.shallow(5)))
    rows = [
        training.plan_row(p, m, layers, weights=mlp.initial_weights(layers, len(FEATURES), [7, i, j]))
        for i, p in enumerate(places)
        for j, (m, layers) in enumerate(kinds)
    ]
    return training.plans(spark, rows)


def test_scoring_in_any_number_of_parts_keeps_all_rows(spark, monkeypatch):
    rows = [(p, *[float(i + j) for j in range(len(FEATURES))]) for i, p in enumerate(["a", "b", None, "zz", "c", "a"])]
    df = spark.createDataFrame(rows + rows[:1], "location string, " + ", ".join(f"{c} double" for c in FEATURES))
    nets = _networks(spark, "abc")
    loads = [F.round(f"{m}_cooling_load", 9).alias(f"{m}_cooling_load") for m in ("ann", "dnn")]  # sums by block differ in the last bit

    def scored():
        return sorted(map(str, training.score(df, nets).select("location", *FEATURES, *loads).collect()))

    many = scored()
    monkeypatch.setattr(training, "SCORE_PARTS", 1)
    assert scored() == many
    assert len(many) == 7 and sum("ann_cooling_load=None" in r for r in many) == 2
    assert training.score(df, nets, models=["dnn"]).columns[-1] == "dnn_cooling_load"


def test_any_site_code_is_read(spark, tmp_path):
    for site in ("jkt", "site01", "new-york"):
        folder = tmp_path / "RCP 2.6" / "day"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"tas_{site}_daily.csv").write_text("time,tas\n2022-01-01,1.5\n")
    found = scan_series(spark, str(tmp_path), "daily")
    assert {r.location for r in found.collect()} == {"jkt", "site01", "new-york"}
    (folder / "notes.csv").write_text("time,x\n2022-01-01,1\n")
    with pytest.raises(Exception, match="not the path of a series"):
        scan_series(spark, str(tmp_path), "daily").collect()


DAILY = "location string, scenario string, time timestamp_ntz, hurs double, pr double, rsds double, sfcWind double, tas double"


def test_unknown_keys_stop_the_query(spark):
    bad_site = spark.createDataFrame([("x", T0)], "location string, time timestamp_ntz")
    with pytest.raises(Exception, match="unknown location: x"):
        filter_years(bad_site, {"jkt": (2020, 2030)}).collect()
    bad_scenario = spark.createDataFrame([("jkt", "99", T0, 50.0, 0.0, 1.0, 1.0, 300.0)], DAILY)
    with pytest.raises(Exception, match="unknown scenario: 99"):
        daily_weather(bad_scenario).collect()
    units = spark.createDataFrame([("days since 1900-01-01", 1.0)], "u string, h double")
    with pytest.raises(Exception, match="not hours since"):
        units.select(C.decode_hours(F.col("u"), F.col("h"))).collect()
    clock = spark.createDataFrame([("hours since 2020-01-01 05:30:00", 1.0)], "u string, h double")
    assert clock.select(C.decode_hours(F.col("u"), F.col("h"), "UTC").alias("t")).first().t == datetime(2020, 1, 1, 6, 30)


def test_repeated_days_stop_the_query(spark):
    columns = ", ".join(f"{c} double" for c in RATIOS)
    days = spark.createDataFrame([("jkt", "26", T0, *[1.0] * len(RATIOS))] * 2, f"location string, scenario string, time timestamp_ntz, {columns}")
    pattern = spark.createDataFrame([("jkt", T0, T0.date(), *[1.0] * len(RATIOS))], "location string, time timestamp_ntz, day date, " + ", ".join(f"{r} double" for r in RATIOS.values()))
    with pytest.raises(Exception, match="more than once"):
        disaggregate(pattern, days).collect()
    with pytest.raises(Exception, match="more than once"):
        scenario_wide(days, list(RATIOS)[:1], ["26"]).collect()
    sheet = spark.createDataFrame([("jkt", 2021, 1, 5, "Weekday", 1.0)] * 2, "location string, Year int, Month int, Hour int, Weekday string, `Cooling Load (kW)` double")
    with pytest.raises(Exception, match="more than once"):
        cooling_profile(sheet).collect()


def test_null_series_are_repaired_and_lagged(spark):
    rows = [(k, i, T0 + timedelta(hours=h)) for k in ("a", None) for i, h in enumerate((0, 1, 3, 4))]
    df = spark.createDataFrame(rows, "series string, pos int, time timestamp_ntz")
    out = repair_hours(df, ["series"], ["pos"], chunks=3).collect()
    assert len(out) == 8
    for key in ("a", None):
        assert [r.time.hour for r in sorted(out, key=lambda r: r.pos) if r.series == key] == [0, 1, 2, 3]
    lagged = previous_row(df, ["series"], ["pos"], {"before": "pos"}, F.floor(F.col("pos") / 2)).collect()
    assert sorted((str(r.series), r.pos, r.before) for r in lagged) == sorted((str(k), i, i - 1 if i else None) for k in ("a", None) for i in range(4))


def test_many_unsettled_chunks_chain(spark, monkeypatch):
    from loadcast.operators import ordered, timefix

    monkeypatch.setattr(ordered, "CHUNK_BITS", 1)
    monkeypatch.setattr(timefix, "CHAIN_BLOCK", 7)
    gaps = [0, 2] * 60
    hours, at = [], 0
    for g in gaps:
        at += g
        hours.append(at)
    df = spark.createDataFrame([("s", i, T0 + timedelta(hours=h)) for i, h in enumerate(hours)], "series string, pos int, time timestamp_ntz")
    got = {r.pos: r.time for r in repair_hours(df, ["series"], ["pos"], chunks=2).collect()}
    want, before = {}, None
    for i, h in enumerate(hours):
        t = T0 + timedelta(hours=h)
        if before is not None and t - before == timedelta(hours=2):
            t -= timedelta(hours=1)
        elif before is not None and t == before:
            t += timedelta(hours=1)
        want[i] = before = t
    assert got == want


def test_mean_zero_is_no_error(spark):
    df = spark.createDataFrame([("m", 1.0, 1.0), ("m", -1.0, 0.0)], "model string, y double, p double")
    assert regression_metrics(df, ["model"], "y", "p").first().cv_rmse is None
