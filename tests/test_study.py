"""All three stages from files, on two short years of two sites."""

import math
from datetime import datetime, timedelta

from loadcast.params import SCENARIOS, Site
from loadcast.plans import study

SITES = (
    Site("jkt", "Jakarta", (2021, 2021), (2051, 2051), 2021),
    Site("smg", "Semarang", (2021, 2021), (2051, 2051), 2021),
)
CELLS = (
    "location string, lon int, lat int, time timestamp_ntz, u10_wind double, v10_wind double, "
    "dewpoint_temp double, temp double, ssrd double, precip double"
)


def cells(spark, accumulated):
    rows = []
    for place in ("jkt", "smg"):
        for day in range(60):
            total = 0.0
            for step in range(24):
                t = datetime(2021, 1, 1, 8) + timedelta(days=day, hours=step)
                sun = max(0.0, math.sin((t.hour - 6) / 12 * math.pi)) * 2e6
                total += sun
                temp = 300 + 3 * math.sin((t.hour - 9) / 12 * math.pi) + day / 60
                for lon in (0, 1):
                    rows.append((place, lon, 0, t, 3.0, 4.0, 295.0, temp + lon, total if accumulated else sun, 1e-4))
    return spark.createDataFrame(rows, CELLS)


def test_study(spark, tmp_path):
    for s in SCENARIOS:
        folder = tmp_path / f"RCP {s.code[0]}.{s.code[1]}" / "2051-2051"
        folder.mkdir(parents=True)
        for place in ("jkt", "smg"):
            for var, base in (("hurs", 75.0), ("pr", 1e-5), ("rsds", 200.0), ("sfcWind", 2.0), ("tas", 300.0)):
                days = [datetime(2051, 1, 1) + timedelta(days=d) for d in range(70)]
                body = "".join(f"{d:%Y-%m-%d} 12:00:00,{base * (1 + i / 1000)}\n" for i, d in enumerate(days))
                (folder / f"{var}_{place}_daily.csv").write_text("time,x\n" + body)
    sheet = ["location,Year,Month,Hour,Weekday,Cooling Load (kW)"]
    for place in ("jkt", "smg"):
        for month in ("January", "Feb"):
            for hour in range(24):
                for kind, load in (("Weekday", 900), ("Weekend", 600)):
                    sheet.append(f"{place},2021,{month},{hour},{kind},{load + 20 * hour}")
    (tmp_path / "sheet.csv").write_text("\n".join(sheet) + "\n")

    out = study.synthetic_weather(
        spark, cells(spark, False), str(tmp_path / "RCP *"), str(tmp_path / "synthetic"), SITES
    )
    assert out.filter("proj_temp is not null").count() > 2 * 3 * 24 * 55
    loads = study.load_cooling(spark, str(tmp_path / "sheet.csv"))
    assert loads.filter("avg_cooling_load is not null").count() == 2 * 2 * 24
    data, scores = study.train(
        cells(spark, True), loads, str(tmp_path / "weights"), SITES, trials=2, executions=1, epochs=3
    )
    assert scores.count() == 4 and spark.read.parquet(str(tmp_path / "weights")).count() == 4
    hourly, monthly, annual = study.project(out, data, spark.read.parquet(str(tmp_path / "weights")), 2)
    assert hourly.count() > 0 and monthly.count() > 0
    years = {(r["location"], r["year"]) for r in annual.collect()}
    assert {("jkt", 2021), ("jkt", 2051), ("smg", 2021), ("smg", 2051)} <= years
