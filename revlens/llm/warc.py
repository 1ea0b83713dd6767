"""WARC archives: writer and salvage reader (operator 9).

The writer stores one gzip member per record.  Records with equal payloads are
found by digest; the one with the largest id is the response, the others are
revisits that name it.  The reader checks every member; after a damaged one it
searches for the next gzip header or version line that starts a valid record,
goes on from there and logs the byte gap.  Inside a member of several records
it does the same over the inflated bytes, and it keeps the whole records
before the place where a member stops inflating or fails its checks.

Defined cases: a null payload is empty; a null url becomes ``urn:page:ID``;
equal payloads with equal ids (repeated rows) are one response and are each
written, so a table gives as many records as rows; a null id is written as an
empty id and read back as null; an empty table gives no records; other columns
are ignored.  Archives live below a folder that every executor reaches.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import ship, written

VERSION = b"WARC/1.1\r\n"
_GZIP = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 16 << 20
_FEED = 1 << 15


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 digest: each five hex digits are
    four base-32 digits."""
    hexed = F.sha1(F.encode(payload, "UTF-8"))
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def classified(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: the response that a
    record repeats, null for responses.  Payloads under ``least`` bytes are
    never revisits."""
    p = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.concat(F.lit("urn:page:"), "page_id"), F.lit("urn:page:")).alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("digest", base32_sha1(F.col("payload")))
    latest = p.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("latest"))
    joined = p.join(latest, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest",
                         F.when(F.col("page_id") != F.col("latest"), F.col("latest"))
                         .when(F.col("page_id").isNull(), F.col("latest")).alias("refers_to"))


def record(page_id: int | None, url: str, payload: str, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record.  A revisit keeps the HTTP head, whose
    Content-Length is that of the full payload, and no payload."""
    body = payload.encode("utf-8")
    name = "" if page_id is None else str(page_id)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{name}>",
            "WARC-Date: 2000-01-01T00:00:00Z",
            f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}",
            f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response"]
    if refers_to is None:
        block += body
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return VERSION + "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int = 3) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``records`` (see ``classified``) below ``folder`` and return
    ``file, n_records`` of every archive.  A file gets its final name only when
    it is whole, and a repeated task writes files of its own: the listing
    that the successful tasks return is what counts."""
    ship(records.sparkSession)
    if "://" not in folder:
        folder = f"file://{folder}" if not folder.startswith("file:") else folder.replace("file:", "file://", 1)
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        out, name, size, count, done = None, "", 0, 0, []

        def close() -> None:
            out.close()
            where.move(f"{root}/_{name}", f"{root}/{name}")
            done.append((name, count))

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = where.open_output_stream(f"{root}/_{name}", compression=None)
                data = _member(record(*row))
                out.write(data)
                size += len(data)
                count += 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())],
            names=["file", "n_records"])

    return written(records.select("page_id", "url", "payload", "digest", "refers_to")
                   .mapInArrow(run, "file string, n_records long"), "warc_listing")


class Read(NamedTuple):
    """A record at ``offset`` (``headers`` set), or a quarantined gap of ``size`` bytes."""
    offset: int
    size: int
    headers: dict[str, str] | None
    block: bytes


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """The record at ``at`` of uncompressed bytes and where it ends, if it is whole."""
    if not data.startswith(b"WARC/1.", at):
        return None
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None
    headers = {}
    for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            return None
        headers[key.strip().lower()] = value.strip()
    if not headers.get("content-length", "").isdigit():
        return None
    begin = stop + 4
    end = begin + int(headers["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        return None
    return headers, data[begin:end], end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """The gzip member at ``at`` as far as it inflates, where that ends, and whether its checks hold."""
    d = zlib.decompressobj(31)
    out, k = [], at
    try:
        while not d.eof and k < len(data):
            out.append(d.decompress(data[k:k + _FEED]))
            k += _FEED
    except zlib.error:     # again up to the failing feed, and that one byte by byte
        d = zlib.decompressobj(31)
        out = [d.decompress(data[i:i + _FEED]) for i in range(at, k, _FEED)]
        try:
            while k < len(data) and not d.eof:
                out.append(d.decompress(data[k:k + 1]))
                k += 1
        except zlib.error:
            return b"".join(out), k, False
    return b"".join(out), min(k, len(data)) - len(d.unused_data), d.eof


def _records(inner: bytes, offset: int, size: int) -> Iterator[Read]:
    """Whole records of inflated bytes; a gap between them has the offset of
    its member and its size in inflated bytes."""
    k, gap = 0, None
    while k < len(inner):
        if got := _parse(inner, k):
            if gap is not None:
                yield Read(offset, k - gap, None, b"")
                gap = None
            yield Read(offset, size, got[0], got[1])
            k = got[2]
        else:
            gap = k if gap is None else gap
            k = inner.find(b"WARC/1.", k + 1)
            k = len(inner) if k < 0 else k
    if gap is not None:
        yield Read(offset, len(inner) - gap, None, b"")


def salvage(data: bytes) -> Iterator[Read]:
    """Records of an archive, and the gaps between them that hold none.  Of a
    damaged member the whole records before the damage are kept; their digests
    tell whether they are intact."""
    at, gap = 0, None
    behind, kept = 0, []      # records kept of a damaged member, and where it stopped inflating
    starts = re.compile(re.escape(_GZIP) + b"|WARC/1\\.")
    while at < len(data):
        found: list[Read] = []
        end = at
        if data.startswith(_GZIP, at):
            inner, stop, whole = _inflate(data, at)
            found = list(_records(inner, at, stop - at))
            if not any(r.headers for r in found):
                found = [Read(at, stop - at, None, b"")] if whole else []
            if not whole:
                found = [r for r in found if r.headers]
                if found:
                    if gap is not None:
                        yield Read(gap, at - gap, None, b"")
                    yield from found
                    gap, behind, kept = at, stop, [(r.headers, r.block) for r in found]
                    found = []
            else:
                end = stop
        elif got := _parse(data, at):
            # Stored (uncompressed) blocks of a damaged member show its records once more.
            if at >= behind or (got[0], got[1]) not in kept:
                end = got[2]
                found.append(Read(at, end - at, got[0], got[1]))
        if found:
            if gap is not None:
                yield Read(gap, at - gap, None, b"")
                gap = None
            yield from found
            at = end
            continue
        if gap is None:
            gap = at
        # A declared length is not trusted after a failed check: search.
        nxt = starts.search(data, at + 1)
        at = nxt.start() if nxt else len(data)
    if gap is not None:
        yield Read(gap, len(data) - gap, None, b"")


_ID = re.compile(r"<urn:page:(-?\d*)>")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives, and a row with ``record_type`` null for
    each quarantined gap.  One file, of bounded size, is in memory at a time;
    ``payloads`` false leaves the payloads out of the rows."""
    ship(spark)
    fields = ("file string, at long, size long, page_id long, payload_bytes long, payload_digest string, "
              "record_type string, refers_to long, digest_ok boolean, url string, payload string")
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(),
             pa.bool_(), pa.string(), pa.string()]

    def number(text: str) -> int | None:
        m = _ID.search(text)
        return int(m[1]) if m and m[1] else None

    def row(file: str, r: Read) -> tuple:
        if r.headers is None:
            return (file, r.offset, r.size) + (None,) * 8
        http, _, payload = r.block.partition(b"\r\n\r\n")
        length = re.search(rb"(?i)content-length:\s*(\d+)", http)
        kind = r.headers.get("warc-type")
        digest = r.headers.get("warc-payload-digest", "").removeprefix("sha1:")
        ok = kind == "revisit" or (base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
                                   and length is not None and int(length[1]) == len(payload))
        return (file, r.offset, r.size, number(r.headers.get("warc-record-id", "")),
                int(length[1]) if length else len(payload), digest, kind,
                number(r.headers.get("warc-refers-to", "")), ok, r.headers.get("warc-target-uri"),
                payload.decode("utf-8", "replace") if payloads and kind == "response" else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0), b.column(1)):
                rows, held = [], 0
                for r in salvage(content.as_py()):
                    rows.append(row(os.path.basename(file.as_py()), r))
                    held += len(r.block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, fields)


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page as a record, then read the listed archives back,
    without payloads.  A gap, or a payload that does not have its digest, is an error."""
    listing = write_archives(classified(pages), folder)
    out = read_archives(pages.sparkSession, folder, payloads=False).drop("payload")
    out = out.join(listing.select("file"), "file", "left_semi")
    damage = F.raise_error(F.concat(F.lit("damaged record in "), "file", F.lit(" at byte "), F.col("at").cast("string")))
    return out.withColumn("page_id", F.when(F.col("digest_ok"), F.col("page_id")).otherwise(damage.cast("long")))
