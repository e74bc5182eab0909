"""Operator 6: WARC archives, written from pages and read back by byte ranges.

Writing: of records with equal payloads of LEAST bytes or more, that of the smallest page_id is a response and the others revisit it. Each task
writes gzip members, one a record, to files of its own in a shared folder; only the files of tasks that succeeded are listed, so a lost
executor leaves files that nobody reads. Folders are reached with pyarrow.fs, so any store that it knows will do.

Reading: a task gets a range of bytes of a file, looks for the gzip magic, validates a candidate by decoding its first bytes to a WARC header,
and owns the records that start in its range; the last may end beyond it. Archives of others are read, too: the names of fields are taken in either case, what is no
response or revisit comes with its type and its block as the payload, and records without a page's id have none. A member that is cut off, cannot be
unpacked, has no header or does not match its digest is a row of type `damaged`, with what is known of it; reading goes on at the next member.

Nulls: a null html is the empty payload; a null page_id is written as none, comes after all others and is read as null; a null url is
empty. Rows that repeat a page_id and payload are responses both if that id is the smallest. Empty payloads count like others; an empty
table gives an empty archive. Columns other than page_id, url and html are not read. round_trip() removes its archives once they have been read.

Payloads are not shuffled: the digests of those that occur twice are sent to all tasks, up to FIRSTS of them; beyond, pages meet them in a join whose hot keys the
adaptive plan splits.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import prepare, remove, settle, shared_dir, sized, table

LEAST, SPLIT, FILE, READ, FIRSTS = 0, 16 << 20, 256 << 20, 1 << 18, 200_000
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    digest = base32_sha1(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}", "WARC-Date: 2026-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, size, files = "", None, 0, []
        for batch in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                revisit = first is not None and page_id != first
                member = pack.compress(record(page_id, url, html.encode(), first, revisit)) + pack.flush()
                out.write(member)
                size += len(member)
                if size >= FILE:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        if files:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _ in files]), pa.array([s for _, s in files], pa.int64())], names=["path", "size"])

    return run


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write the pages to archives in a new folder; the files written: path, size."""
    prepare(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    digest = F.struct(F.sha1("html").alias("sha"), F.octet_length("html").alias("n"))
    firsts = rows.groupBy(digest.alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where(f"copies > 1 and digest.n >= {least}")
    firsts = settle(firsts.select(F.col("digest.sha").alias("sha"), F.col("digest.n").alias("n"), "first"))
    joined = rows.withColumn("sha", F.sha1("html")).withColumn("n", F.octet_length("html")).join(sized(firsts, FIRSTS), ["sha", "n"], "left")
    return settle(joined.select("page_id", "url", "html", "first").mapInArrow(_write(folder), "path string, size long"))


class Reader:
    """Records of a file that start in [start, end)."""

    def __init__(self, path: str, start: int, end: int):
        store, name = fs.FileSystem.from_uri(path)
        self.file, self.start, self.end = store.open_input_file(name), start, end

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def valid(self, at: int) -> bool:
        """Whether a member with a WARC header starts here."""
        try:
            return zlib.decompressobj(31).decompress(self.read(at, 4096), 64).startswith(b"WARC/")
        except zlib.error:
            return False

    def find(self, at: int) -> int:
        """The next member that starts before the end, or -1."""
        while at < self.end:
            piece = self.read(at, READ + len(MAGIC) - 1)
            k = piece.find(MAGIC)
            while k >= 0:
                if at + k >= self.end:
                    return -1
                if self.valid(at + k):
                    return at + k
                k = piece.find(MAGIC, k + 1)
            if len(piece) < READ:
                return -1
            at += READ
        return -1

    def member(self, at: int) -> tuple[bytes, int, bool]:
        """What the member that starts here unpacks to, where it ends, and whether it is whole."""
        unpack, out, place = zlib.decompressobj(31), [], at
        while not unpack.eof:
            piece = self.read(place, READ)
            if not piece:
                return b"".join(out), place, False
            place += len(piece)
            try:
                out.append(unpack.decompress(piece))
            except zlib.error:
                return self.head(at), at + 1, False
        return b"".join(out), place - len(unpack.unused_data), True

    def head(self, at: int) -> bytes:
        """The first bytes of a damaged member, as far as they can be unpacked."""
        unpack, out = zlib.decompressobj(31), []
        data = self.read(at, 4096)
        try:
            for k in range(0, len(data), 64):
                out.append(unpack.decompress(data[k : k + 64]))
        except zlib.error:
            pass
        return b"".join(out)

    def __iter__(self) -> Iterator[tuple[bytes, bool]]:
        """(record, whether its member is whole)"""
        at = self.find(self.start)
        while 0 <= at < self.end:
            data, end, whole = self.member(at)
            yield data, whole
            at = end if whole else at + 1
            if at < self.end and not (whole and self.valid(at)):
                at = self.find(at)
        self.file.close()


def parse(data: bytes, whole: bool = True) -> tuple:
    """READ_SCHEMA of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines) if colon}

    def number(name: str) -> int | None:
        value = fields.get(name, "")
        return int(value) if re.fullmatch(r"-?[0-9]{1,19}", value) else None

    kind, page, url = fields.get("warc-type", "").lower(), number("x-page-id"), fields.get("warc-target-uri", "")
    size, said = number("content-length"), fields.get("warc-payload-digest", "")
    body = rest[: size or 0]
    if not whole or not first.startswith("WARC/") or not kind or size is None or not 0 <= size == len(body):
        return page, url, None, None, None, "damaged", None
    if kind == "revisit":
        return page, url, None, number("x-payload-length"), said.removeprefix("sha1:") or None, kind, number("x-refers-to-page-id")
    payload = body.partition(b"\r\n\r\n")[2] if "application/http" in fields.get("content-type", "").lower() else body
    digest = base32_sha1(payload)
    if said.lower().startswith("sha1:") and said[5:].upper() != digest:
        return page, url, None, None, None, "damaged", None
    return page, url, payload, len(payload), digest, kind, None


def _read():
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [f.split()[0] for f in READ_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                rows, size = [], 0
                for data, whole in Reader(path, start, end):
                    rows.append(parse(data, whole))
                    size += len(data)
                    if len(rows) == 500 or size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def read(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """The records of archives (path, size): page_id, url, payload (null for revisits and damaged ones), payload_bytes, payload_digest, record_type, refers_to."""
    ranges = files.where("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"), "size")
    ranges = settle(ranges.select("path", "start", F.least(F.col("start") + split, "size").alias("end")))
    return ranges.repartition(max(1, ranges.count())).mapInArrow(_read(), READ_SCHEMA)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Per page, as read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    out = settle(read(write(pages, folder, least)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove(pages.sparkSession, folder)
    return out


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def _base32_sql(sha: str) -> str:
    """Each twenty bits, five digits of hex, are four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for k in range(8):
        bits = f"CAST('0x' || substr({sha}, {5 * k + 1}, 5) AS INTEGER)"
        out += [f"substr('{letters}', 1 + (({bits} >> {s}) & 31), 1)" for s in (15, 10, 5, 0)]
    return " || ".join(out)


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, {_base32_sql("sha")} AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM p JOIN f ON p.html = f.html
"""
