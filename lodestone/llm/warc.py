"""WARC archives: a distributed writer and a salvage reader.

Writer: one record per page, each its own gzip member, so archives are plain concatenations that any WARC
tool reads. Records of equal payloads (of at least ``min_bytes``) are one response, that of the smallest
page_id, and revisits of it. Spark's text sink writes the bytes: a member always ends with a zero byte (the
top byte of its length; an empty member follows where it doesn't), and that byte is the sink's separator.

Reader: a record counts if its member inflates and passes its CRC (or, uncompressed, its version line,
header and Content-Length fit), its block ends with the record's blank lines, and its digest agrees. After
a failed check the reader looks for the next member or version line that starts a valid record, and logs
the bytes in between as a quarantined gap; later records are recovered.

An archive is read by one task, so the writer bounds archives in records (``records_per_file``).

Defined cases: null html is an empty payload; a null url becomes an empty target; pages that share a
page_id are records of their own; a null page_id is written as an empty id and read back as null; pages
that tie on payload and page_id are all written as response; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.store import new_path

VERSION = b"WARC/1.1\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MAGIC = b"\x1f\x8b\x08"
_EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
URN = "urn:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, digest: str | None = None) -> bytes:
    """An uncompressed record; a revisit has no block of its own but names the payload's digest and length."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    target = re.sub(r"[\r\n]+", "%0A", url or "")
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest or payload_digest(payload)}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head.insert(4, ("WARC-Refers-To", f"<{URN}{refers_to}>"))
        head.insert(5, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """One gzip member that ends with a zero byte."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + _EMPTY


def _to_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")))
        yield pa.record_batch([pa.array([member(record(p, u, h, r))[:-1] for p, u, h, r in rows], pa.binary())], ["value"])


def classified(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to) of each page; refers_to is null for responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sum", F.unhex(F.sha2("payload", 256)))
    # groups are found from digests alone; the join then moves each payload once, to its digest's task
    first = rows.where((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("sum").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sum", "first")
    joined = rows.join(first, "sum", "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 2048) -> str:
    """Write the pages as gzip-member WARC archives under ``path``."""
    lines = classified(pages, min_bytes).mapInArrow(_to_members, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)
    return path


@dataclass
class Found:
    """A record at ``offset``; or, with ``reason``, a quarantined gap of ``length`` bytes."""

    offset: int
    length: int
    headers: dict[str, str] | None = None
    payload: bytes = b""
    reason: str | None = None


class Bad(ValueError):
    """A check that failed."""


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the uncompressed record at ``at``; Bad if any check fails."""
    version = _VERSION.match(data, at)
    if not version:
        raise Bad("no version line")
    close = data.find(b"\r\n\r\n", version.end() - 2)
    if close < 0:
        raise Bad("header does not end")
    headers = {}
    for line in data[version.end() : close].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header line without a colon")
        headers[key.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        raise Bad("no length")
    begin, end = close + 4, close + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Bad("block does not end at its length")
    block = data[begin:end]
    if headers.get("warc-type") != "revisit" and "warc-payload-digest" in headers and headers["warc-payload-digest"] != f"sha1:{payload_digest(block)}":
        raise Bad("digest differs")
    return headers, block, end + 4


def _inflate(data: memoryview, at: int) -> tuple[bytes, int]:
    z, out, end = zlib.decompressobj(31), [], at
    try:
        while not z.eof and end < len(data):
            out.append(z.decompress(data[end : end + 65536]))
            end = min(len(data), end + 65536)
    except zlib.error as e:
        raise Bad(f"member: {e}") from None
    if not z.eof:
        raise Bad("member is cut off")
    return b"".join(out), end - len(z.unused_data)


def _one(data: bytes, view: memoryview, at: int) -> tuple[dict | None, bytes, int]:
    if data.startswith(_MAGIC, at):
        inner, end = _inflate(view, at)
        if not inner:
            return None, b"", end
        headers, block, used = parse_record(inner)
        if used != len(inner):
            raise Bad("bytes after the record in its member")
        return headers, block, end
    headers, block, end = parse_record(data, at)
    return headers, block, end


def _next_start(data: bytes, at: int) -> int:
    """The next place at or after ``at`` that could start a record."""
    zipped = data.find(_MAGIC, at)
    plain = _VERSION.search(data, at)
    starts = [x for x in (zipped, plain.start() if plain else -1) if x >= 0]
    return min(starts, default=len(data))


def salvage(data: bytes) -> Iterator[Found]:
    """Records of an archive in order, and gaps; every byte is in exactly one of them."""
    view, at, bad_from, reason = memoryview(data), 0, None, ""
    while at < len(data):
        try:
            headers, block, end = _one(data, view, at)
        except Bad as e:
            if bad_from is None:
                bad_from, reason = at, str(e)
            at = _next_start(data, at + 1)
            continue
        if bad_from is not None:
            yield Found(bad_from, at - bad_from, reason=reason)
            bad_from = None
        if headers is not None:
            yield Found(at, end - at, headers, block)
        at = end
    if bad_from is not None:
        yield Found(bad_from, len(data) - bad_from, reason=reason)


def _id(value: str | None) -> int | None:
    found = re.fullmatch(rf"<{URN}(-?\d+)>", value or "")
    return int(found[1]) if found else None


READ_SCHEMA = "file string, offset long, length long, gap_reason string, page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in READ_SCHEMA.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows, held = [], 0
            for x in salvage(content.as_buffer().to_pybytes()):
                if x.reason is not None:
                    rows.append((path, x.offset, x.length, x.reason, *[None] * 7))
                else:
                    h = x.headers
                    kind = h.get("warc-type")
                    revisit = kind == "revisit"
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else payload_digest(x.payload)
                    size = h.get("warc-payload-length", "") if revisit else len(x.payload)
                    rows.append((path, x.offset, x.length, None, _id(h.get("warc-record-id")), h.get("warc-target-uri"), kind, _id(h.get("warc-refers-to")), None if revisit else x.payload, int(size) if str(size).isdigit() else None, digest))
                held += len(x.payload)
                if held > 4 << 20:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records and gaps (gap_reason not null) of the archives under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_read, READ_SCHEMA)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages written to the shared folder as archives and read back."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, new_path(spark, "op7-warc"), min_bytes))
