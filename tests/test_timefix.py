from datetime import timedelta

import numpy as np
import pytest
from timestamps import hours

from loadcast.operators.timefix import repair_hours, shift_origin


def loop_repair(times, compat=False):
    """Row by row, as defined: compare with the corrected time before."""
    out = list(times)
    for k in range(1, len(out)):
        gap = (out[k] - out[k - 1]) / timedelta(hours=1)
        if gap == 2 or (compat and gap == 48):
            out[k] -= timedelta(hours=1)
        elif gap == 0:
            out[k] = out[k - 1] + timedelta(hours=1)
    return out


def repaired(spark, series, chunks=3, compat=False):
    rows = [(name, i, t) for name, times in series.items() for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "series string, line int, time timestamp_ntz")
    out = repair_hours(df, ["series"], ["line"], compat_day_gap=compat, chunks=chunks, position="pos")
    found = {}
    for r in out.orderBy("series", "pos").collect():
        assert r["pos"] == r["line"] + 1
        found.setdefault(r["series"], []).append(r["time"])
    return found


HAND_MADE = {
    "spring gap": hours(0, 1, 3, 4),
    "autumn double": hours(0, 1, 1, 2),
    "gap, double later": hours(0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 10, 11, 12),
    "two days": hours(0, 1, 49, 50),
    "starts late": hours(1, 2, 3),
    "single": hours(5),
    "backward": hours(0, 2, 1, 2, 3),
}


@pytest.mark.parametrize("compat", [False, True])
def test_hand_made(spark, compat):
    assert repaired(spark, HAND_MADE, compat=compat) == {k: loop_repair(v, compat) for k, v in HAND_MADE.items()}


def test_gap_and_double_are_closed(spark):
    out = repaired(spark, HAND_MADE)
    assert out["spring gap"] == hours(0, 1, 2, 3)
    assert out["autumn double"] == hours(0, 1, 2, 3)


@pytest.mark.parametrize("chunks, bits, compat", [(1, 18, False), (4, 3, False), (17, 18, True)])
def test_random_series_match_the_loop(spark, monkeypatch, chunks, bits, compat):
    monkeypatch.setattr("loadcast.operators.ordered.CHUNK_BITS", bits)
    rng = np.random.default_rng(chunks)
    gaps = [1, 1, 1, 0, 2, 3, -1, 5, 47, 48, 49]
    series = {}
    for i in range(60):
        steps = rng.choice(gaps, size=int(rng.integers(1, 60)))
        series[f"s{i:02d}"] = hours(*np.cumsum(steps).tolist())
    series["hot"] = hours(*np.cumsum(rng.choice(gaps, size=2000)).tolist())
    assert repaired(spark, series, chunks, compat) == {k: loop_repair(v, compat) for k, v in series.items()}


def test_second_pass_changes_nothing(spark):
    rng = np.random.default_rng(7)
    series = {f"s{i}": hours(*np.cumsum(rng.choice([1, 1, 1, 1, 1, 2], size=200)).tolist()) for i in range(4)}
    once = repaired(spark, series)
    assert once == {k: loop_repair(v) for k, v in series.items()}


def test_origin_moves_whole_series(spark):
    rows = [("a", i, t) for i, t in enumerate(hours(1, 2, 0))] + [("b", i, t) for i, t in enumerate(hours(0, 5))]
    df = spark.createDataFrame(rows, "series string, line int, time timestamp_ntz")
    out = shift_origin(df, ["series"], ["line"]).orderBy("series", "line")
    assert [r["time"] for r in out.collect()] == hours(0, 1, -1, 0, 5)
