import random

from pyspark.sql import functions as F
from timestamps import hours

from loadcast.operators.grid import deaccumulate
from loadcast.operators.ordered import attach, month_chunk, number_rows, previous_row


def sparse(spark):
    """Irregular series with empty months and months of one row."""
    offsets = [0, 1, 2, 700, 5000, 5001, 9000, 9001, 9002, 20000]
    rows = [(place, t, float(i)) for place in ("a", "b") for i, t in enumerate(hours(*offsets))]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "location string, time timestamp_ntz, x double"), len(offsets)


def test_previous_row_crosses_chunks(spark):
    df, n = sparse(spark)
    out = previous_row(df, ["location"], ["time"], {"before": "x"}, month_chunk("time")).orderBy("location", "time")
    assert [r["before"] for r in out.collect()] == ([None] + [float(i) for i in range(n - 1)]) * 2


def test_previous_row_hands_on_missing_values(spark):
    rows = [("a", t, x) for t, x in zip(hours(0, 1, 2), [1.0, None, 3.0])]
    df = spark.createDataFrame(rows, "location string, time timestamp_ntz, x double")
    out = previous_row(df, ["location"], ["time"], {"before": "x"}, F.hour("time")).orderBy("time")
    assert [r["before"] for r in out.collect()] == [None, 1.0, None]


def test_number_rows(spark):
    df, n = sparse(spark)
    out = number_rows(df, ["location"], ["time"], month_chunk("time")).orderBy("location", "time").collect()
    assert [r["row"] for r in out] == list(range(1, n + 1)) * 2
    assert {r["total"] for r in out} == {n}


def test_attach_broadcasts_only_within_its_bound(spark):
    # Reading the plan only: no automatic broadcast for relations of unknown size.
    left = spark.range(10).withColumnRenamed("id", "k")
    dim = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))

    def plan(rows):
        return attach(left, dim, ["k"], rows)._jdf.queryExecution().optimizedPlan().toString()

    assert "strategy=broadcast" in plan(10)
    assert "strategy=broadcast" not in plan(None)
    assert "strategy=broadcast" not in plan(10**9)


def test_deaccumulate(spark):
    offsets = list(range(6, 36))
    total, rows = 0.0, []
    for t in hours(*offsets):
        total = 1.0 if t.hour == 8 else total + 1.0
        rows.append(("a", t, total, 2 * total))
    df = spark.createDataFrame(rows, "location string, time timestamp_ntz, ssrd double, precip double")
    out = deaccumulate(df).orderBy("time").collect()
    assert out[0]["ssrd"] is None  # nothing before the first row
    assert {r["ssrd"] for r in out[1:]} == {1.0} and {r["precip"] for r in out[1:]} == {2.0}


def test_deaccumulate_without_reset_row(spark):
    times = [t for t in hours(*range(6, 12)) if t.hour != 8]
    rows = [("a", t, x, 0.0) for t, x in zip(times, [10.0, 12.0, 3.0, 4.0, 6.0])]
    df = spark.createDataFrame(rows, "location string, time timestamp_ntz, ssrd double, precip double")
    assert [r["ssrd"] for r in deaccumulate(df).orderBy("time").collect()] == [None, 2.0, -9.0, 1.0, 2.0]
