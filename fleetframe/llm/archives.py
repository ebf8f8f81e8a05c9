"""Converter from legacy ARC archives to WARC, and the WARC round trip.

An ARC file begins with a version block that names the fields of every header line: version
1 has five (URL, IP address, date, content type, length), version 2 ten. Records follow one
another, each a header line, as many bytes as the line declares, and a newline. The
converter reads headers by the version of their own file and bodies by declared length, and
synthesises what WARC has and ARC lacks: record identifiers (UUIDs made from file, offset and
content), ISO timestamps, record types, and block and payload digests. Equal payloads above a
size are stored once: the record of the smallest page holds it, others revisit it.

Archives are written by Spark, gzip-compressed, into the shared folder. A task writes segments
of about ``SEGMENT_BYTES``, each with its own version block, and a file holds a few segments, so
files can be read whole without a shuffle to make them equal.

The converter reads the archives twice: once for an index of records, without payloads, from which
revisits are found; once to convert each file with its own revisits. Between the two passes whole
compressed files move, never single payloads.

Cases: a null payload is empty; a null URL is written as ``-``; spaces and controls in URLs
are percent-encoded; repeated rows make repeated records, all of one type; an empty table
makes empty archives; a record that ends early or a header of the wrong form raises an error.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sizing import shared_dir, shared_table
from .textarrays import NULL_ID

SEGMENT_BYTES = 4 << 20
FILE_SEGMENTS = 4
TASK_FILES = 8
#: Up to so many files a conversion gets a partition for each, so that few meet in one task.
FILE_TASKS = 2000
#: zlib's level 4; the default of 6 takes more than twice its time for archives 4 % smaller.
GZIP_LEVEL = "FOUR"
MIN_SHARED_BYTES = 100
ARC_DATE = "20240101000000"
#: Names of the header fields of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PAGE_HEADER = b"X-Page-Id: "
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    mime: str
    body: bytes
    offset: int


def arc_file_header(version: int, name: str = "pages.arc") -> bytes:
    """The version block every ARC file begins with."""
    block = f"{version} 0 archive\n{ARC_FIELDS[version]}\n\n".encode()
    return f"filedesc://{name} 0.0.0.0 {ARC_DATE} text/plain ".encode() + (
        b"200 - - 0 " + name.encode() + b" " if version == 2 else b""
    ) + str(len(block)).encode() + b"\n" + block


def arc_record(version: int, url: str | None, mime: str, body: bytes, ip: str = "0.0.0.0", date: str = ARC_DATE) -> bytes:
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "-"
    middle = f" 200 {hashlib.md5(body).hexdigest()} - 0 -" if version == 2 else ""
    return f"{safe} {ip} {date} {mime}{middle} {len(body)}\n".encode() + body


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of one ARC file after its version block; a later block begins a joined archive."""
    place, fields = 0, None
    while place < len(data):
        if data[place:place + 1] == b"\n":
            place += 1
            continue
        end = data.find(b"\n", place)
        if end < 0:
            raise ValueError(f"no header line at {place}")
        header = data[place:end].decode("utf-8", "replace").split(" ")
        opens = header[0].startswith("filedesc://")
        if not opens and len(header) != fields or len(header) < 5 or not header[-1].isdecimal():
            raise ValueError(f"malformed header at {place}")
        length = int(header[-1])
        body = data[end + 1:end + 1 + length]
        if len(body) != length:
            raise ValueError(f"record at {place} declares {length} bytes, {len(body)} are there")
        if opens:
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown version {version}")
            fields = len(ARC_FIELDS[version].split())
        else:
            yield ArcRecord(header[0], header[1], header[2], header[3], body, place)
        place = end + 1 + length


def split_response(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head and payload of an archived response; all is payload if there is no head."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = body.find(b"\r\n\r\n")
    return (body, b"") if end < 0 else (body[:end + 4], body[end + 4:])


def iso_date(date: str) -> str:
    """14-digit ARC date as a WARC date; shorter dates are filled with the earliest moment."""
    full = date + "00000101000000"[len(date):]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def warc_record(record_id: str, kind: str, url: str, date: str, mime: str, head: bytes, payload: bytes,
                refers_to: str | None = None, extra: dict[str, str] | None = None, payload_digest: str | None = None) -> bytes:
    block = head if kind == "revisit" else head + payload
    payload_digest = payload_digest or hashlib.sha256(payload).hexdigest()
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{record_id}>", "WARC-Date": date,
        "WARC-Target-URI": url, "WARC-Payload-Digest": "sha256:" + payload_digest,
        "WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(),
        "Content-Type": "application/http; msgtype=response" if head else mime,
    }
    if kind == "revisit":
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = refers_to or ""
    fields |= extra or {}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of one WARC file."""
    place = 0
    while place < len(data):
        if data[place] in b"\r\n":
            place += 1
            continue
        end = data.find(b"\r\n\r\n", place)
        if end < 0 or not data.startswith(b"WARC/", place):
            raise ValueError(f"no record at {place}")
        lines = data[place:end].decode().split("\r\n")[1:]
        fields = dict(line.split(": ", 1) for line in lines)
        length = int(fields["Content-Length"])
        block = data[end + 4:end + 4 + length]
        if len(block) != length:
            raise ValueError(f"record at {place} declares {length} bytes, {len(block)} are there")
        yield fields, block
        place = end + 4 + length


def _new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def _segments(records: Iterator[bytes], head: bytes, end: bytes) -> Iterator[pa.RecordBatch]:
    """Records joined to segments, each after ``head``; the writer puts ``end`` after each."""
    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record)
        if size >= SEGMENT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([head + end.join(held)], pa.binary())], ["value"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([head + end.join(held)], pa.binary())], ["value"])


def _write(segments: DataFrame, path: str, end: str) -> None:
    segments.select(F.col("value").cast("string")).write.option("lineSep", end).option("compression", "gzip").option(
        "zlib.compress.level", GZIP_LEVEL
    ).option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, version: int = 1) -> None:
    """Pages as ARC files: a version block, then an HTTP response for each page."""
    rows = pages.select(
        F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"),
    )

    def records(batches):
        for batch in batches:
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                head += (PAGE_HEADER + page.encode() + b"\r\n" if page is not None else b"") + b"\r\n"
                yield arc_record(version, url, "text/html", head + html)

    def segments(batches):
        return _segments(records(batches), arc_file_header(version) + b"\n", b"\n")

    _write(rows.mapInArrow(segments, "value binary"), path, "\n")


ARC_SCHEMA = "page_id long, url string, date string, mime string, record_id string, head binary, payload binary, payload_digest string, payload_bytes long"
INDEX_SCHEMA = "path string, offset long, page_id long, record_id string, payload_digest string, payload_bytes long"
KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in schema.split(", ")])


def arc_rows(path: str, content: bytes) -> Iterator[dict]:
    """A row for each record of one compressed ARC file, with synthesised identifier and digest."""
    for r in parse_arc(gzip.decompress(content)):
        head, payload = split_response(r.body)
        page = re.search(rb"\r\n" + PAGE_HEADER + rb"(-?[0-9]+)\r\n", head)
        digest = hashlib.sha256(payload).hexdigest()
        identity = f"{path.rsplit('/', 1)[-1]} {r.offset} {r.url} {digest}"
        yield {
            "path": path, "offset": r.offset, "page_id": int(page[1]) if page else None, "url": r.url,
            "date": iso_date(r.date), "mime": r.mime, "record_id": str(uuid.uuid5(NAMESPACE, identity)),
            "head": head, "payload": payload, "payload_digest": digest, "payload_bytes": len(payload),
        }


def read_arc(spark: SparkSession, path: str, schema: str = ARC_SCHEMA) -> DataFrame:
    """One row for each ARC record; columns that ``schema`` leaves out never leave the task that parses."""

    def parse(batches):
        arrow = _arrow(schema)
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows, size = {n: [] for n in arrow.names}, 0
                for r in arc_rows(name, data):
                    for n, values in rows.items():
                        values.append(r[n])
                    size += len(r["head"]) + len(r["payload"])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pydict(rows, schema=arrow)
                        rows, size = {n: [] for n in arrow.names}, 0
                yield pa.RecordBatch.from_pydict(rows, schema=arrow)

    return _files(spark, path).mapInArrow(parse, schema)


def first_holders(records: DataFrame, least: int = MIN_SHARED_BYTES) -> DataFrame:
    """For each payload of at least ``least`` bytes: its smallest page and that page's record."""
    return records.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.min(F.struct(F.coalesce("page_id", F.lit(NULL_ID)).alias("id"), "record_id")).alias("_first")
    )


def revisits_of(index: DataFrame, least: int = MIN_SHARED_BYTES) -> DataFrame:
    """Place of each record whose payload a smaller page holds, with that page and its record."""
    holders = first_holders(index, least).select(
        "payload_digest", F.col("_first.id").alias("first_page"), F.col("_first.record_id").alias("first_record")
    )
    return index.join(holders, "payload_digest").filter(
        F.coalesce("page_id", F.lit(NULL_ID)) > F.col("first_page")
    ).select("path", "offset", "first_page", "first_record")


def write_warc(files: DataFrame, revisits: DataFrame, path: str) -> None:
    """ARC files as WARC files; records at the places of ``revisits`` are stored without their payload."""

    def convert(name: str, content: bytes, holders: dict[int, tuple[int, str]]):
        for row in arc_rows(name, content):
            page, record = holders.get(row["offset"], (None, None))
            extra = {} if row["page_id"] is None else {"X-Page-Id": str(row["page_id"])}
            extra["X-Payload-Length"] = str(row["payload_bytes"])
            if record is not None and page != NULL_ID:
                extra["X-Refers-To-Page"] = str(page)
            yield warc_record(
                row["record_id"], "response" if record is None else "revisit", row["url"], row["date"], row["mime"],
                row["head"], row["payload"], f"<urn:uuid:{record}>" if record is not None else None, extra,
                row["payload_digest"],
            )

    def segments(held, found):
        pages, records = found.column("first_page").to_pylist(), found.column("first_record").to_pylist()
        holders = dict(zip(found.column("offset").to_pylist(), zip(pages, records)))
        batches = [
            b for name, data in zip(held.column("path").to_pylist(), held.column("content").to_pylist())
            for b in _segments(convert(name, data, holders), b"", b"\r\n\r\n")
        ]
        return pa.Table.from_batches(batches, _arrow("value binary"))

    # A group is one file and the revisits in it, whatever the number of copies of a payload; tasks get a few files.
    count = files.count()
    parts = max(1, min(count, FILE_TASKS), -(-count // TASK_FILES))
    held = files.repartition(parts, "path").groupBy("path")
    _write(held.cogroup(revisits.groupBy("path")).applyInArrow(segments, "value binary"), path, "\r\n\r\n")


WARC_SCHEMA = "page_id long, url string, date string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string, stored_bytes long"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each WARC record; digests of stored payloads are checked."""
    arrow = _arrow(WARC_SCHEMA)

    def number(value):
        return None if value is None else int(value)

    def parse(batches):
        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows = []
                for f, block in parse_warc(gzip.decompress(data)):
                    digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    stored = split_response(block)[1]
                    if f["WARC-Type"] == "response" and hashlib.sha256(stored).hexdigest() != digest:
                        raise ValueError(f"payload of {f['WARC-Record-ID']} does not match its digest")
                    rows.append({
                        "page_id": number(f.get("X-Page-Id")), "url": f["WARC-Target-URI"], "date": f["WARC-Date"],
                        "record_id": f["WARC-Record-ID"], "record_type": f["WARC-Type"],
                        "payload_bytes": int(f["X-Payload-Length"]), "payload_digest": digest,
                        "refers_to": number(f.get("X-Refers-To-Page")), "refers_to_record": f.get("WARC-Refers-To"),
                        "stored_bytes": len(stored),
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return _files(spark, path).mapInArrow(parse, WARC_SCHEMA)


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, least: int = MIN_SHARED_BYTES) -> None:
    """ARC files as WARC files, equal payloads stored once."""
    index = shared_table(read_arc(spark, arc_path, INDEX_SCHEMA))
    write_warc(_files(spark, arc_path), revisits_of(index, least), warc_path)


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC files, the converter and WARC files, read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    arc, warc = _new_folder(spark, "arc"), _new_folder(spark, "warc")
    write_arc(pages, arc)
    convert_arc(spark, arc, warc)
    return read_warc(spark, warc).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stored_bytes"
    )


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS holder FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_SHARED_BYTES} AND page_id > holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_SHARED_BYTES} AND page_id > holder THEN holder END AS refers_to,
  CASE WHEN payload_bytes >= {MIN_SHARED_BYTES} AND page_id > holder THEN 0 ELSE payload_bytes END::BIGINT AS stored_bytes
FROM f
"""
