from datetime import datetime

import pytest
from pyspark.sql import functions as F
from timestamps import hours

from loadcast.operators.reshape import clean_header, join_variables, select_matching
from loadcast.plans.projection import load_projection
from loadcast.sources.cubes import cube_to_rows
from loadcast.sources.series import bad_lines, scan_series
from loadcast.sources.sinks import read_positions, write_table


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_scan_reads_two_columns_and_path_keys(spark, tmp_path):
    write(tmp_path / "RCP 2.6" / "2021-2030", "tas_jkt_daily.csv", "when,val,extra\n2021-01-01,300.5,9\n2021-01-02 00:00:00,NA,9\n")
    write(tmp_path / "RCP 8.5" / "2031-2040", "pr_smg_disagg.csv", "time,pr\n2031-01-01 01:00:00,0.25\n")
    rows = scan_series(spark, str(tmp_path)).drop("line", "bad").orderBy("time").collect()
    assert [tuple(r) for r in rows] == [
        ("26", "2021-2030", "tas", "jkt", "daily", datetime(2021, 1, 1), 300.5),
        ("26", "2021-2030", "tas", "jkt", "daily", datetime(2021, 1, 2), None),
        ("85", "2031-2040", "pr", "smg", "disagg", datetime(2031, 1, 1, 1), 0.25),
    ]
    assert scan_series(spark, str(tmp_path), "disagg").count() == 1


def test_line_keeps_file_order_across_splits(spark, tmp_path):
    lines = [f"2021-01-01 00:00:00,{i}" for i in range(20000)]
    write(tmp_path / "RCP 2.6" / "a", "tas_jkt_daily.csv", "time,v\n" + "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = scan_series(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 3
        assert [r[0] for r in df.orderBy("line").select("value").collect()] == [float(i) for i in range(20000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_load_hourly_projection(spark, tmp_path):
    """A series that starts at hour 1, skips an hour and doubles one."""
    stamps = [1, 2, 3, 5, 6, 7, 8, 8, 9]
    for var in ("hurs", "tas"):
        body = "".join(f"2021-01-01 {h:02d}:10:00,{i}\n" for i, h in enumerate(stamps))
        write(tmp_path / "RCP 4.5" / "2021", f"{var}_jkt_disagg.csv", "time,x\n" + body)
    out = load_projection(spark, str(tmp_path), hourly=True, variables=["hurs", "tas"]).orderBy("time").collect()
    assert [r["time"].hour for r in out] == list(range(9))
    assert [r["hurs"] for r in out] == [float(i) for i in range(9)] == [r["tas"] for r in out]
    assert {(r["location"], r["scenario"], r["interval"]) for r in out} == {("jkt", "45", "2021")}


def test_join_variables(spark):
    t = hours(0, 1, 2)
    rows = [("jkt", t[0], "a", 1.0), ("jkt", t[1], "a", 2.0), ("jkt", t[1], "b", 5.0), ("jkt", t[2], "b", 6.0)]
    long = spark.createDataFrame(rows, "location string, time timestamp_ntz, variable string, value double")
    for how in ("unique", "fanout"):
        out = join_variables(long, ["location", "time"], ["a", "b"], how).orderBy("time").collect()
        assert [(r["a"], r["b"]) for r in out] == [(1.0, None), (2.0, 5.0)]
    twice = long.union(long.filter(F.col("variable") == "b"))
    assert join_variables(twice, ["location", "time"], ["a", "b"], "fanout").count() == 3
    with pytest.raises(Exception, match="repeated keys"):
        join_variables(twice, ["location", "time"], ["a", "b"]).collect()


def cube(spark, lon, lat, hrs, **values):
    row = ("jkt", lon, lat, hrs, "hours since 1970-01-01 00:00:00.0", *values.values())
    kinds = ", ".join(f"{v} array<double>" for v in values)
    return spark.createDataFrame(
        [row], f"location string, lon array<double>, lat array<double>, hours array<double>, units string, {kinds}"
    )


def test_cube_runs_longitude_fastest(spark):
    values = [float(i) for i in range(12)]
    df = cube(spark, [1.0, 2.0], [10.0, 20.0, 30.0], [0.0, 1.0], temp=values, precip=values[::-1])
    out = cube_to_rows(df, ["temp", "precip"]).orderBy("temp").collect()
    assert [(r["lon"], r["lat"], r["time"].hour) for r in out[:7]] == [
        (1.0, 10.0, 7), (2.0, 10.0, 7), (1.0, 20.0, 7), (2.0, 20.0, 7), (1.0, 30.0, 7), (2.0, 30.0, 7), (1.0, 10.0, 8),
    ]
    assert [r["precip"] for r in out] == values[::-1]


def test_two_dimensional_cube_and_missing_cells(spark):
    df = cube(spark, [1.0, 2.0], [10.0], [0.0, 1.0], temp=[1.0, None, 3.0, 4.0], precip=[1.0, 2.0, float("nan"), 4.0])
    assert [r["temp"] for r in cube_to_rows(df, ["temp", "precip"]).orderBy("temp").collect()] == [1.0, 4.0]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_sink(spark, tmp_path, fmt):
    rows = [("jkt", "26", t, x) for t, x in zip(hours(0, 1), [0.1, None])] + [("smg", "85", hours(2)[0], 1 / 3)]
    df = spark.createDataFrame(rows, "location string, scenario string, time timestamp_ntz, x double")
    path = str(tmp_path / "t")
    write_table(df, path, fmt=fmt)
    schema = "time timestamp_ntz, x double, location string, scenario string"
    back = spark.read.schema(schema).option("header", True).option("nullValue", "NA").format(fmt).load(path)
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))
    assert (tmp_path / "t" / "location=jkt" / "scenario=26").is_dir()


def test_names(spark):
    assert clean_header("Cooling Load (kW)") == "Cooling_Load_kW"
    df = spark.range(1).selectExpr("1 as time", "2 as dnn_a", "3 as ann_a", "4 as ssrd_45", "5 as my_ssrd")
    assert select_matching(df, keep=["time"], contains=["dnn"]).columns == ["time", "dnn_a"]
    assert select_matching(df, starts_with=["ssrd"]).columns == ["ssrd_45"]
    assert select_matching(df, without=["nn_"]).columns == ["time", "ssrd_45", "my_ssrd"]


def test_scratch_folder_follows_the_session():
    from types import SimpleNamespace

    from loadcast.sources.scratch import scratch_dir

    def session(setting, master, checkpoint=None):
        context = SimpleNamespace(applicationId="app-1", master=master, getCheckpointDir=lambda: checkpoint)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting or default), sparkContext=context)

    assert scratch_dir(session("hdfs:///shared/", "yarn")) == "hdfs:///shared/loadcast-app-1"
    assert scratch_dir(session("", "yarn", "s3://b/c")) == "s3://b/c/loadcast-app-1"
    with pytest.raises(ValueError):
        scratch_dir(session("", "spark://host:7077"))


def test_bad_lines_are_counted_and_stop(spark, tmp_path):
    folder = tmp_path / "RCP 2.6" / "2051-2051"
    folder.mkdir(parents=True)
    lines = ["2051-01-01,1.5,x", "2051-01-02,NA,x", "2051-01-03,,x", "2051-01-04, 2.5 ,x", "51/1/5,3,x", "2051-01-06,3 mm,x", "noon,high,x"]
    (folder / "tas_jkt_daily.csv").write_text("time,tas,note\n" + "\n".join(lines) + "\n")
    (folder / "tas_smg_daily.csv").write_text("time,tas\n2051-01-01,1\n")
    series = scan_series(spark, str(tmp_path / "RCP *"), "daily")
    rows = series.filter("location = 'jkt'").orderBy("line").collect()
    assert [(r.time is None, r.value, r.bad) for r in rows] == [
        (False, 1.5, None),
        (False, None, None),
        (False, None, None),
        (False, 2.5, None),
        (True, 3.0, "time"),
        (False, None, "value"),
        (True, None, "time value"),
    ]
    counts = {r.location: (r.lines, r.bad_times, r.bad_values) for r in bad_lines(series).collect()}
    assert counts == {"jkt": (7, 2, 2), "smg": (1, 0, 0)}
    with pytest.raises(ValueError, match="26/2051-2051/tas_jkt: 2 times, 2 values"):
        load_projection(spark, str(tmp_path / "RCP *"), variables=["tas"])
    (folder / "tas_jkt_daily.csv").write_text("time,tas,note\n" + "\n".join([*lines[:4], lines[5]]) + "\n")
    assert load_projection(spark, str(tmp_path / "RCP *"), variables=["tas"], on_bad="null").count() == 6


def test_order_over_many_files(spark, tmp_path):
    """A folder of many files is in order from file to file."""
    hot = spark.range(20_000).selectExpr("'jkt' as location", "'26' as scenario", "timestamp_ntz'2020-01-01' + make_dt_interval(0, int(id)) as time", "id")
    small = spark.range(7).selectExpr("'smg' as location", "'85' as scenario", "timestamp_ntz'2020-01-01' + make_dt_interval(0, int(id)) as time", "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_table(hot.unionByName(small).orderBy(F.xxhash64("id")), str(tmp_path / "t"), order_by=["time"])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    files = list((tmp_path / "t" / "location=jkt" / "scenario=26").glob("*.parquet"))
    assert len(files) > 1
    assert read_positions(spark, str(tmp_path / "t")).filter("position <> id + 1").count() == 0
