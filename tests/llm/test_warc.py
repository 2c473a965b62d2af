"""Archives written and read back."""

import gzip
import hashlib
import tracemalloc

import pytest

from loadcast.llm import warc
from loadcast.sources.scratch import scratch_path

SCHEMA = "page_id long, url string, html string"
LONG = "<html>" + "x" * 200 + "</html>"
NASTY = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3 + "é𝄞\x00\n"


def test_round_trip(spark):
    rows = [
        (5, "http://a.example/x?y#z", LONG),
        (3, "http://b.example", LONG),
        (9, None, LONG),
        (1, "http://c.example/\r\nX: y", NASTY),
        (2, "http://d.example/", None),
        (4, "http://d.example/", ""),
        (6, "u", "short"),
        (7, "u", "short"),
        (None, "u", LONG),
        (3, "http://b.example", LONG),
    ]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as digest", "1 as payload", "2 as capture")
    got = sorted(warc.archive_report(pages).collect(), key=str)
    assert len(got) == len(rows)
    for r in got:
        html = next(h for p, _, h in rows if p == r.page_id) or ""
        assert r.payload_bytes == len(html.encode())
        assert r.payload_digest == hashlib.sha256(html.encode()).hexdigest()
        again = html == LONG and r.page_id != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if again else ("response", None))
    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages, path)
    found = warc.captures(warc.read_archives(spark, path)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert len(r.requests) == 1 and len(r.metadata) == 1
        page = r.metadata[0].fields.get("pageid")
        html = next(h for p, _, h in rows if str(p) == str(page)) or ""
        assert r.response.payload == (None if r.response.warc_type == "revisit" else bytearray(html.encode()))
    assert warc.archive_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_records_without_their_response_are_kept(spark):
    text = lambda kind, name, other: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{other}Content-Length: 2\r\n\r\nhi\r\n\r\n"
    data = text("warcinfo", "i", "") + text("request", "q", "WARC-Concurrent-To: <gone>\r\n") + text("metadata", "m", "WARC-Concurrent-To: <r>\r\n") + text("response", "r", "")
    packed = gzip.compress(data[:60].encode()) + gzip.compress(data[60:].encode())
    assert [r[0] for r in warc.parse_archive(packed)] == ["warcinfo", "request", "metadata", "response"]
    schema = warc.RECORD_DDL
    records = spark.createDataFrame([(*r[:8], dict(r[8]), r[9]) for r in warc.parse_archive(data.encode())], schema)
    got = {r.transaction: r for r in warc.captures(records).collect()}
    assert got["<gone>"].response is None and len(got["<gone>"].requests) == 1
    assert got["<r>"].response.record_id == "<r>" and len(got["<r>"].metadata) == 1


def _record(name, body):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{name}>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_archives_are_read_in_steps():
    body = bytes(range(256)) * 16_384  # 4 MiB, longer than a step
    records = [_record(k, body + str(k).encode()) for k in range(30)]
    packed = b"".join(gzip.compress(r, 1) for r in records)
    tracemalloc.start()
    got = [(r[1], r[6], r[7]) for r in warc.parse_archive(packed)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(f"<{k}>", len(body) + len(str(k)), hashlib.sha256(body + str(k).encode()).hexdigest()) for k in range(30)]
    assert peak < 10 * len(body)  # of 120 MiB unpacked
    assert [r[7] for r in warc.parse_archive(b"".join(records))] == [d for *_, d in got]
    assert [r[7] for r in warc.parse_archive(gzip.compress(b"".join(records), 1))] == [d for *_, d in got]


def test_broken_archives_stop():
    whole = _record("a", b"x" * 5_000) + _record("b", b"y" * 5_000)
    for cut in (len(whole) - 3_000, len(whole) // 2 + 20):
        with pytest.raises(ValueError, match="ends inside"):
            list(warc.parse_archive(whole[:cut]))
    with pytest.raises(ValueError, match="ends inside a gzip member"):
        list(warc.parse_archive(gzip.compress(whole)[:-20]))
    assert list(warc.parse_archive(b"")) == []
    step = warc.STEP_BYTES
    apart = b"\n" * (step - 2) + whole  # the mark of a record lies across two steps
    assert [r[1] for r in warc.parse_archive(apart)] == ["<a>", "<b>"]


def test_long_pages(spark):
    rows = [(k, "http://l.example/", "é" * 3_000_000 + str(k)) for k in range(3)]
    pages = spark.createDataFrame(rows, SCHEMA)
    assert warc.records_per_file(pages) == 3 * int(warc.ARCHIVE_BYTES / (6_000_001 + 1_000))
    got = {r.page_id: r for r in warc.archive_report(pages).collect()}
    for k, _, html in rows:
        assert got[k].payload_bytes == len(html.encode()) and got[k].payload_digest == hashlib.sha256(html.encode()).hexdigest()
