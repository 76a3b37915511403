"""Archives that end early, and records that carry their date."""

import gzip
import io
import random
import zlib

import pytest

from tallyweave.llm import warc
from tallyweave.llm.common import scratch


def record(n, body):
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def read(packed):
    return [block for _, _, block in warc.records_of(io.BufferedReader(warc.Inflated(io.BytesIO(packed)), 1 << 12))]


BODIES = [b"", b"abc" * 40_000, random.Random(1).randbytes(90_000), b"z"]


def test_one_stream_and_many_members_are_read_whole():
    records = [record(k, b) for k, b in enumerate(BODIES)]
    assert read(gzip.compress(b"".join(records))) == BODIES
    assert read(b"".join(map(gzip.compress, records))) == BODIES
    assert read(b"") == [] and read(gzip.compress(b"")) == []


@pytest.mark.parametrize("lost", [1, 4, 8, 30, 5000])
def test_a_stream_without_its_end_is_an_error(lost):
    whole = gzip.compress(b"".join(record(k, b) for k, b in enumerate(BODIES)))
    with pytest.raises((EOFError, ValueError)):
        read(whole[:-lost])


def test_a_stream_cut_behind_a_record_is_an_error():
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    packed = b"".join(packer.compress(record(k, b)) for k, b in enumerate(BODIES[:2])) + packer.flush(zlib.Z_FULL_FLUSH)
    with pytest.raises(EOFError):
        read(packed)


def test_records_are_dated(spark):
    rows = spark.createDataFrame([(1, "u", "text")], "page_id bigint, url string, html string")
    folder = scratch(spark, "warc")
    warc.write_archives(warc.with_roles(rows, "page_id", "html"), folder, "page_id", "url", "html", "2026-01-02T03:04:05Z")
    (line,) = spark.read.option("lineSep", "\r\n\r\n\r\n\r\n").text(folder).limit(1).collect()
    assert "WARC-Date: 2026-01-02T03:04:05Z" in line["value"]
