"""Embedding near-duplicates against all pairs in double precision."""

import numpy as np
import pytest

from loadcast.llm import embeddup

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, threshold=0.93):
    """Links and least ids by all pairs; rows are numbered by their place."""
    good = []
    for i, (_, vector, label) in enumerate(rows):
        if label is not None and vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector):
            good.append((i, np.array(vector, float), label))
    links = {i: set() for i in range(len(rows))}
    for x, (i, a, la) in enumerate(good):
        for j, b, lb in good[x + 1 :]:
            if la == lb and len(a) == len(b):
                a1, b1 = a / abs(a).max(), b / abs(b).max()
                if a1 @ b1 / np.sqrt((a1 @ a1) * (b1 @ b1)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((row[0], len(links[i]), least, row[0] == least))
    return sorted(out, key=str)


def check(spark, rows, threshold=0.93):
    got = embeddup.near_duplicates(spark.createDataFrame(rows, SCHEMA), threshold).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, threshold)


def vectors(rng, n, dims):
    return rng.normal(size=(n, dims)).astype(np.float32)


@pytest.mark.parametrize("tile", [16, 1024])
def test_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddup, "TILE_ROWS", tile)
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1, None):
        centres = vectors(rng, 12, 16)
        for i in range(90):
            spread = (0.05, 0.25, 0.4, 2.0)[i % 4]
            v = centres[i % 12] + spread * vectors(rng, 1, 16)[0]
            rows.append((len(rows), v.tolist(), label))
    rows += [(1000 + i, rows[3][1], 0) for i in range(40)]  # copies
    check(spark, rows)
    check(spark, rows, 0.8)


def test_cosines_around_the_threshold(spark):
    """A chain of angles whose cosines lie within rounding of int8 of the threshold, on both sides."""
    rows, step = [], np.arccos(0.93)
    for i in range(60):
        angle = i * step * (1 + (-1) ** i * 2e-4 * i)
        v = np.zeros(8)
        v[2], v[5] = np.cos(angle), np.sin(angle)
        rows.append((100 - i, v.tolist(), 7))
    check(spark, rows)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for dims in (1, 3, 64, 2100):
        x = embeddup.unit(rng.normal(size=(50, dims)) ** 5)
        q, scales, errors = embeddup.quantise(x)
        side = embeddup._Side({c: v.tobytes() for c, v in (("nodes", np.arange(50)), ("copies", np.ones(50, int)), ("quantised", q), ("scales", scales), ("errors", errors))}, dims)
        near, off = embeddup.bounds(side, side, slice(0, 50))
        assert (abs(near - x @ x.T) <= off).all()
        assert off.max() < 0.1 or dims > 64


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [0.0, 0.0], [1.0, None], [1.0, inf], [nan, 1.0]]
    rows = [(i, v, 1) for i, v in enumerate(odd)] + [(i + 10, v, 1) for i, v in enumerate(odd)]
    rows += [(30, [1.0, 0.0], 1), (30, [1.0, 0.0], 1), (30, [0.0, 1.0], 1), (31, [1.0, -0.0], 1), (32, [1.0, 0.0], None)]
    rows += [(None, [1.0, 0.01], 1), (None, [-1.0, 0.0], 1), (None, [-1.0, 0.0], 1), (40, [1.0], 1), (41, [2.0], 1), (42, [1.0, 0.0, 0.0], 1)]
    rows += [(50, [1e38, 1e38], 2), (51, [1e-38, 1e-38], 2), (52, [1e38, -1e38], 2)]
    check(spark, rows)
    assert embeddup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as node", "1 as tile", "2 as root", "3 as salt", "4 as first", "5 as linked")
    assert embeddup.near_duplicates(more).count() == len(rows)
