"""The mix against a plain schedule, and its edge cases."""

import re
from collections import defaultdict

import pytest

from loadcast.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def source_docs(docs):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40 + 7 * (i % 13))), "en", f"s{i % 3}" if i % 10 else None) for i in range(120)]
    return docs(*rows)


def test_targets_share_by_weight_up_to_the_cap(spark):
    sized = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 600), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sized).collect()}
    assert got["b"] == 20 and got[None] == 0
    assert sum(got.values()) == pytest.approx(1.5 * 1610)
    assert got["a"] == pytest.approx(5 * got["c"], rel=0.3) or got["a"] == 2000


def test_points_fill_every_prefix_evenly(spark):
    from pyspark.sql import functions as F

    u = [r.u for r in spark.range(64).select(mixing.point(F.col("id")).alias("u")).collect()]
    assert sorted(u) == [i / 64 for i in range(64)]
    for n in (8, 16, 32):
        assert sorted(int(x * n) for x in u[:n]) == list(range(n))


def test_report_and_mix_agree(docs):
    frame = source_docs(docs)
    report = {r.doc_id: r for r in mixing.mix_report(frame).collect()}
    by_source = defaultdict(int)
    for r in report.values():
        assert 0 <= r.taken <= 2 * r.size
        by_source[r.source] += r.taken
    targets = {r.source: r.target for r in report.values()}
    for s, t in targets.items():
        assert by_source[s] == int(t + 0.5)
    assert {r.doc_id: r.taken for r in mixing.mix_report(frame.repartition(5)).collect()} == {d: r.taken for d, r in report.items()}
    used = defaultdict(int)
    texts = {r.doc_id: r.text for r in frame.collect()}
    for r in mixing.mix(frame).collect():
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
        used[r.doc_id] += len(words(r.text))
    assert dict(used) == {d: r.taken for d, r in report.items() if r.taken}


def test_tiny_sources_reach_their_targets(docs):
    rows = [(i, " ".join(["w"] * 100), "en", "big") for i in range(100)] + [(1000 + i, "a b c d e f g h i j", "en", f"tiny{i}") for i in range(6)]
    rows += [(None, " ".join(["x"] * n), "en", "no ids") for n in range(1, 30)]
    frame = docs(*rows)
    by_source, targets = defaultdict(int), {}
    for r in mixing.mix_report(frame).collect():
        assert r.taken <= 2 * r.size
        by_source[r.source] += r.taken
        targets[r.source] = r.target
    assert targets["tiny0"] == 20
    assert dict(by_source) == {s: int(t + 0.5) for s, t in targets.items()}
    assert sum(len(words(r.text)) for r in mixing.mix(frame).collect()) == sum(by_source.values())


def test_very_long_text(docs):
    report = {r.doc_id: r for r in mixing.mix_report(docs((1, "w " * 300_000, "en", "a"), (2, "one two", "en", "b"))).collect()}
    assert report[1].size == 300_000 and report[1].taken == int(report[1].target + 0.5)
    assert report[2].size == 2 and report[2].taken == 4


def test_slots_follow_the_targets_in_every_prefix(spark):
    sources = spark.createDataFrame([(0, 64_000, 96_000.0), (1, 64_000, 32_000.0), (2, 5, 10.0)], "sid long, source_size long, target double")
    slots = sorted(mixing.schedule(sources).collect(), key=lambda r: r.slot)
    for n in (64, 256, 1000):
        assert abs(sum(r.sid == 0 for r in slots[:n]) - 0.75 * n) <= 8
    used = defaultdict(int)
    for r in slots:
        used[r.sid] += min(r.used, {2: 5}.get(r.sid, 64))
    assert used == {0: 96_000, 1: 32_000, 2: 10}
    assert len({(r.sid, r.block, r.lap) for r in slots}) == len(slots)


def test_edges(docs):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "one", "en", None), (3, "one", "en", None), (None, " two \n words ", "en", "b")]
    frame = docs(*rows).selectExpr("*", "'x' as size", "1 as sid", "2 as start")
    report = mixing.mix_report(frame).collect()
    assert len(report) == 5
    assert all(r.taken <= 2 * r.size for r in report)
    out = mixing.mix(frame)
    assert out.columns == frame.columns
    assert all(r["size"] == "x" for r in out.collect())
    assert mixing.mix_report(docs().limit(0)).count() == 0
    assert mixing.mix(docs().limit(0)).count() == 0
