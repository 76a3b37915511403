"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader by offset.

``write_archives`` lets Spark write records as gzip files, each file one single
gzip stream, as many tools do.  Such a file can only be read from its start.
``normalise`` inflates each once, as a stream, rewrites every record as a gzip
member of its own and writes a sidecar index with the place of each member, so
that ``read_records`` can open any record by itself.

Files are read and written with bounded memory (one record at a time) through
Arrow's file systems, which know local, HDFS, S3 and GCS addresses.  A
normalised file is written under a name of its task attempt and renamed when it is
complete, so a task that is repeated, or runs twice, leaves whole files only.

Defined results: a NULL payload is empty; of equal payloads the record with the
smallest id is the response, the others revisit it, and rows that share the
smallest id are all responses; records without an id come last and
are responses only if no record of that payload has an id; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.lookup import lookup

CRLF = b"\r\n"
#: One record follows another after this.
RECORD_END = "\r\n\r\n"
VERSION = "WARC/1.1"


def base32(sha1_hex: Column) -> Column:
    """A SHA-1 in hexadecimal digits as bare base32: 40 digits of 4 bits are 32 of 5."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    # Five hexadecimal digits, 20 bits, are four characters.
    parts = []
    for k in range(8):
        value = F.conv(F.substring(sha1_hex, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            digit = F.shiftright(value, shift).bitwiseAND(F.lit(31))
            parts.append(F.substring(F.lit(alphabet), digit + 1, F.lit(1)))
    return F.concat(*parts)


def with_roles(records: DataFrame, key: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """``records`` with ``_bytes``, ``_digest``, ``_type`` and ``_refers_to`` by equal payloads.

    Only digests are grouped, and only those that several records share are
    looked up; that moves each payload once.  A digest that very many records
    share is split among tasks.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    known = records.withColumns(
        {"_bytes": F.octet_length(body).cast("long"), "_digest": F.sha1(body.cast("binary"))}
    )
    groups = (
        known.where(F.col("_bytes") >= least_bytes)
        .groupBy("_digest", "_bytes")
        .agg(F.min(key).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    joined = lookup(known, groups, ["_digest", "_bytes"])
    other = F.col("_first").isNotNull() & ~F.col(key).eqNullSafe(F.col("_first"))
    return joined.select(
        *[F.col(f"`{c}`") for c in records.columns],
        "_bytes",
        base32(F.col("_digest")).alias("_digest"),
        F.when(other, "revisit").otherwise("response").alias("_type"),
        F.when(other, F.col("_first")).alias("_refers_to"),
    )


def _header(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field whose value is NULL is left out, and a value keeps to one line."""
    lines = [
        F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n"))
        for name, value in fields
    ]
    return F.concat(F.lit(f"{VERSION}\r\n"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit("\r\n"))


def write_archives(
    records: DataFrame, folder: str, key: str, uri: str, payload: str, date: str | None = None
) -> None:
    """Writes records with their roles as gzip files of one stream each, dated ``date`` (UTC; by default now).

    Spark's own text writer does it, with the end of a record as the line
    separator, so its committer takes care of lost and repeated tasks.
    """
    body = F.when(F.col("_type") == "response", F.coalesce(F.col(payload), F.lit(""))).otherwise("")
    header = _header(
        ("WARC-Type", F.col("_type")),
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col(key).cast("string"), F.lit("none")), F.lit(">"))),
        ("WARC-Date", F.lit(date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))),
        ("WARC-Target-URI", F.col(uri)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("_refers_to").cast("string"), F.lit(">"))),
        ("WARC-Profile", F.when(F.col("_type") == "revisit", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("X-Payload-Length", F.col("_bytes")),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.octet_length(body)),
    )
    records.select(F.concat(header, body).alias("value")).write.option("compression", "gzip").option(
        "lineSep", RECORD_END
    ).text(folder)


# --- streams of records ----------------------------------------------------------


class Inflated(io.RawIOBase):
    """The contents of a gzip file of any number of members, inflated as they are read.

    A file that ends inside a member, be it in its trailer, is an error: it has been cut short.
    """

    def __init__(self, source, chunk: int = 1 << 20):
        self.source, self.chunk = source, chunk
        self.inflater = zlib.decompressobj(31)
        self.waiting, self.inside = b"", False

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if self.inflater.eof:
                self.waiting = self.inflater.unused_data
                self.inflater, self.inside = zlib.decompressobj(31), False
            data = self.waiting or self.source.read(self.chunk)
            if not data and not self.inside:
                return 0
            self.inside = True
            out = self.inflater.decompress(data, len(into))
            self.waiting = self.inflater.unconsumed_tail
            if out:
                into[: len(out)] = out
                return len(out)
            if not data and not self.inflater.eof:
                raise EOFError("the file ends inside a gzip member")


def records_of(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields, header bytes, block) of each record of an inflated WARC stream."""
    while True:
        line = stream.readline()
        while line == CRLF:
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head, fields = [line], {}
        while (line := stream.readline()) not in (CRLF, b""):
            head.append(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip()] = value.strip()
        block = stream.read(int(fields["Content-Length"]))
        if len(block) != int(fields["Content-Length"]):
            raise ValueError("the file ends inside a record")
        yield fields, b"".join(head) + CRLF, block


def opened(address: str):
    """The file system and path of an address as Spark gives it."""
    return fs.FileSystem.from_uri(address if "://" in address else address.replace("file:/", "file:///", 1))


def normalise_file(source: str, target: str, level: int = 6) -> int:
    """Rewrites one archive; returns the number of its records."""
    system, path = opened(source)
    to_system, to_path = opened(target)
    attempt = f"{to_path}.{uuid.uuid4().hex}"
    entries, at = [], 0
    with system.open_input_stream(path, compression=None) as raw, to_system.open_output_stream(
        attempt, compression=None
    ) as out:
        for fields, head, block in records_of(io.BufferedReader(Inflated(raw), 1 << 20)):
            deflater = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = deflater.compress(head) + deflater.compress(block)
            member += deflater.compress(RECORD_END.encode()) + deflater.flush()
            out.write(member)
            entries.append((fields.get("WARC-Record-ID", ""), fields.get("WARC-Type", ""), at, len(member)))
            at += len(member)
    names = ("record_id", "record_type", "offset", "length")
    index = "".join(json.dumps(dict(zip(names, e, strict=True))) + "\n" for e in entries)
    with to_system.open_output_stream(f"{attempt}.index", compression=None) as out:
        out.write(index.encode())
    to_system.move(attempt, to_path)
    to_system.move(f"{attempt}.index", f"{to_path}.index")
    return len(entries)


def normalise(spark: SparkSession, folder: str, target: str) -> list[str]:
    """Normalises all archives of a folder into another; one task for each file.

    An archive of one gzip stream cannot be split, so a file is the unit of
    work; its size is up to who wrote it.  Names of files, not contents, pass
    through the driver.
    """
    names = sorted({r[0] for r in spark.read.format("binaryFile").load(folder).select("path").collect()})
    if not names:
        return []
    base = target if "://" in target else f"file://{target}"
    system, path = opened(base)
    system.create_dir(path, recursive=True)
    pairs = [(n, f"{base}/{k:06d}.warc.gz") for k, n in enumerate(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = normalise_file(row["source"], row["target"])
                yield pa.RecordBatch.from_pydict({"target": [row["target"]], "records": [n]})

    work = spark.createDataFrame(pairs, "source string, target string").repartition(len(pairs))
    done = work.mapInArrow(run, "target string, records bigint").collect()
    return sorted(r["target"] for r in done)


RECORD = (
    "archive string, offset bigint, record_id string, record_type string, refers_to string, uri string, "
    "stated_bytes bigint, stated_digest string, payload_bytes bigint, payload_digest string, payload binary"
)


def read_index(spark: SparkSession, archives: list[str]) -> DataFrame:
    """(archive, record_id, record_type, offset, length) from the sidecar files."""
    kind = "record_id string, record_type string, offset bigint, length bigint"
    if not archives:
        return spark.createDataFrame([], f"archive string, {kind}")
    rows = spark.read.schema(kind).json([f"{a}.index" for a in archives])
    return rows.select(F.regexp_replace(F.input_file_name(), r"\.index$", "").alias("archive"), "*")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Opens each indexed record at its offset and checks it against its own header.

    ``payload_bytes`` and ``payload_digest`` are computed from what was read; a
    revisit has no payload of its own, so there they are NULL.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = source = None
        try:
            for batch in batches:
                rows = []
                for entry in batch.to_pylist():
                    if entry["archive"] != name:
                        if source is not None:
                            source.close()
                        name = entry["archive"]
                        system, path = opened(name)
                        source = system.open_input_file(path)
                    source.seek(entry["offset"])
                    member = zlib.decompress(source.read(entry["length"]), 31)
                    fields, _, block = next(records_of(io.BufferedReader(io.BytesIO(member))))
                    own = fields["WARC-Type"] == "response"
                    rows.append(
                        {
                            "archive": name,
                            "offset": entry["offset"],
                            "record_id": fields["WARC-Record-ID"],
                            "record_type": fields["WARC-Type"],
                            "refers_to": fields.get("WARC-Refers-To"),
                            "uri": fields.get("WARC-Target-URI"),
                            "stated_bytes": int(fields["X-Payload-Length"]) if "X-Payload-Length" in fields else None,
                            "stated_digest": fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
                            "payload_bytes": len(block) if own else None,
                            "payload_digest": base64.b32encode(hashlib.sha1(block).digest()).decode() if own else None,
                            "payload": block if own and payloads else None,
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)
        finally:
            if source is not None:
                source.close()

    return index.select("archive", "offset", "length").mapInArrow(run, RECORD)


SCHEMA = pa.schema(
    [
        (n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[t])
        for n, t in (c.split() for c in RECORD.split(", "))
    ]
)
