"""WARC: archives written from pages, and captures assembled from archives.

A page gives three records: the request, the response (or, for a payload seen
before, a revisit) and metadata; request and metadata name the response's id in
WARC-Concurrent-To.  Records are written as text with exact lengths, gzipped.
Reading parses records by their lengths, one archive at a time; transactions
are assembled by joining on the concurrent-to id, one nested row per capture.

Archives roll over after some ``ARCHIVE_BYTES`` of records of average length, and
``RECORDS_PER_FILE`` records at most.  A read task holds one file as it is stored;
what it unpacks are steps of ``STEP_BYTES`` and one record, also of an archive with
a gzip member per record.

Defined results: a null html is an empty payload; a null url is an empty one; a
null page_id stays null; among equal payloads of at least ``MIN_BYTES`` bytes
the rows with the smallest page_id are responses (rows with no id refer to it;
without any id all are responses); repeated rows are captures of their own; an
empty table gives empty archives and no captures; other columns are not read.
"""

from __future__ import annotations

import hashlib
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.sources.scratch import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_BYTES = 100
RECORDS_PER_FILE = 9_000
ARCHIVE_BYTES = 128 << 20
STEP_BYTES = 1 << 20
ROW_BYTES = 8 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_DDL = (
    "warc_type string, record_id string, concurrent_to string, target_uri string, warc_date string, refers_to_uri string, "
    "payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
)
RECORD = pa.schema(
    [
        ("warc_type", pa.string()),
        ("record_id", pa.string()),
        ("concurrent_to", pa.string()),
        ("target_uri", pa.string()),
        ("warc_date", pa.string()),
        ("refers_to_uri", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()),
    ]
)


def _id(kind: str) -> Column:
    """A record id: the digest of what names the capture, in the shape of a UUID."""
    digest = F.md5(F.concat_ws("|", F.lit(kind), "page_id", "url", "capture"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column, name: str, content: str, block: Column, *more: Column) -> Column:
    """One record but for its last line end, which the text writer adds."""
    line = lambda key, value: F.concat(F.lit(key + ": "), value, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _id(name)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.col("warc_date")),
        *more,
        line("Content-Type", F.lit(content)),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n"),
    )


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, bytes, first_id, first_url (of the response that holds an equal payload)."""
    payload = F.coalesce("html", F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    known = pages.select("page_id", url.alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    first = (
        known.filter(F.col("bytes") >= MIN_BYTES)
        .groupBy("digest")
        .agg(F.count("*").alias("copies"), F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"))
        .filter("copies > 1 and first_id is not null")
        .drop("copies")
    )
    return known.join(first, "digest", "left")


def write_archives(pages: DataFrame, path: str, warc_date: str = "2024-01-01T00:00:00Z") -> None:
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = with_revisits(pages).withColumns({"again": again, "capture": F.monotonically_increasing_id(), "warc_date": F.lit(warc_date)})
    line = lambda key, value: F.concat(F.lit(key + ": "), value, F.lit("\r\n"))
    concurrent = line("WARC-Concurrent-To", _id("response"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    host, target = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    seen = F.when(F.col("again"), F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To-Target-URI", F.col("first_url")))).otherwise("")
    about = F.concat(
        F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")),
        F.when(F.col("again"), F.concat(F.lit("refersToPage: "), F.col("first_id").cast("string"), F.lit("\r\n"))).otherwise(""),
    )
    records = F.array(
        _record(F.lit("request"), "request", "application/http; msgtype=request", asked, concurrent),
        _record(
            F.when(F.col("again"), "revisit").otherwise("response"),
            "response",
            "application/http; msgtype=response",
            F.when(F.col("again"), head).otherwise(F.concat(head, F.col("payload"))),
            seen,
            line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ),
        _record(F.lit("metadata"), "metadata", "application/warc-fields", about, concurrent),
    )
    writer = rows.select(F.explode(records).alias("value")).write
    writer.options(lineSep="\r\n", compression="gzip", maxRecordsPerFile=records_per_file(pages)).text(path)


def records_per_file(pages: DataFrame) -> int:
    """Whole captures of average length that fill an archive."""
    mean = pages.agg(F.avg(F.octet_length(F.coalesce("html", F.lit(""))))).first()[0] or 0
    return 3 * max(1, min(RECORDS_PER_FILE // 3, int(ARCHIVE_BYTES / (mean + 1_000))))


def _headers(block: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in block.decode("utf-8", "replace").split("\r\n") if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def unpacked(data: bytes) -> Iterator[bytes]:
    """An archive, plain or of gzip members, in steps."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[at : at + STEP_BYTES] for at in range(0, len(data), STEP_BYTES))
        return
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof:
            step = member.unconsumed_tail
            if not step:
                step = data[at : at + STEP_BYTES]
                at += len(step)
            out = member.decompress(step, STEP_BYTES)
            if out:
                yield out
            elif not step:
                raise ValueError("an archive ends inside a gzip member")
        at -= len(member.unused_data)


class _Reader:
    """What is read from the steps and not yet taken."""

    def __init__(self, steps: Iterator[bytes]):
        self.steps, self.held, self.at = steps, bytearray(), 0

    def more(self) -> bool:
        step = next(self.steps, None)
        if step is None:
            return False
        del self.held[: self.at]
        self.at = 0
        self.held += step
        return True

    def skip_to(self, mark: bytes) -> bool:
        while (found := self.held.find(mark, self.at)) < 0:
            self.at = max(self.at, len(self.held) - len(mark) + 1)
            if not self.more():
                return False
        self.at = found
        return True

    def until(self, mark: bytes) -> bytes | None:
        """All up to the mark, which is passed."""
        seen = 0
        while (found := self.held.find(mark, self.at + seen)) < 0:
            seen = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self.more():
                return None
        out = bytes(self.held[self.at : found])
        self.at = found + len(mark)
        return out

    def take(self, size: int) -> bytes:
        """The next bytes, fewer at the end."""
        while len(self.held) - self.at < size and self.more():
            pass
        out = bytes(self.held[self.at : self.at + size])
        self.at += len(out)
        return out


def parse_archive(data: bytes) -> Iterator[tuple]:
    """Records of one archive, plain or gzipped, found by their lengths."""
    reader = _Reader(unpacked(data))
    while reader.skip_to(b"WARC/"):
        top = reader.until(b"\r\n\r\n")
        if top is None:
            raise ValueError("an archive ends inside the header of a record")
        head = _headers(top)
        size = int(head["content-length"])
        block = reader.take(size)
        if len(block) < size:
            raise ValueError(f"an archive ends inside record {head.get('warc-record-id')}")
        yield _record_row(head, block)


def _record_row(head: dict[str, str], block: bytes) -> tuple:
    kind, fields, payload = head.get("warc-type"), {}, None
    digest, length = head.get("warc-payload-digest", "").rpartition(":")[2] or None, None
    if head.get("content-type", "").startswith("application/http"):
        top, _, body = block.partition(b"\r\n\r\n")
        fields = _headers(top)
        if kind == "revisit":
            length = int(fields["content-length"]) if "content-length" in fields else None
        elif kind == "response":
            payload, length = body, len(body)
            found = hashlib.sha256(body).hexdigest()
            if digest not in (None, found):
                raise ValueError(f"payload of {head.get('warc-record-id')} has digest {found}, not {digest}")
            digest = found
    elif head.get("content-type", "").startswith("application/warc-fields"):
        fields = _headers(block)
    uri, other = head.get("warc-target-uri"), head.get("warc-refers-to-target-uri")
    return kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), uri, head.get("warc-date"), other, length, digest, list(fields.items()), payload


def _parse(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in parse_archive(content.as_py()):
                    rows.append(row if with_payload else (*row[:-1], None))
                    size += 500 + len(rows[-1][-1] or b"")
                    if size > ROW_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORD)], schema=RECORD)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of all archives under the path."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse(with_payload), RECORD_DDL)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per transaction: response (or revisit), and its other records.

    A record without a response in the archives gives a row with a null response.
    """
    main = records.filter("warc_type in ('response', 'revisit')")
    side = records.filter("warc_type in ('request', 'metadata')").drop("payload")
    parts = side.groupBy(F.coalesce("concurrent_to", "record_id").alias("transaction"))
    kind = lambda k: F.collect_list(F.when(F.col("warc_type") == k, F.struct("record_id", "target_uri", "warc_date", "fields")))
    sides = parts.agg(kind("request").alias("requests"), kind("metadata").alias("metadata"))
    whole = main.select(F.coalesce("concurrent_to", "record_id").alias("transaction"), F.struct(*main.columns).alias("response"))
    return whole.join(sides, "transaction", "full")


def archive_report(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives, reads them back and reports every capture."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    field = lambda k: F.get("metadata", F.lit(0))["fields"][k].cast("long")
    return captures(read_archives(spark, path, with_payload=False)).select(
        field("pageid").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        field("referstopage").alias("refers_to"),
    )
