"""WARC archives: a writer with deduplicated payloads and a salvage reader.

Writing: of records with one payload of at least MIN_DEDUP bytes the one with the smallest page_id is a response, the
others revisit it. Every record is a gzip member of its own, so that a reader can go on after damage. Files of about
FILE_BYTES are written by Spark's text writer (a row is a whole file), so its commit protocol holds in any store and a
lost task leaves nothing behind; the writer's line feed after the last member is passed over by the reader.

Reading: whole files come through `binaryFile`. A record is checked (version line, headers, length, end mark, digest). After a
failed check the reader searches for the next version line, or in a compressed file for the next gzip member that
inflates, goes on there, and logs the skipped bytes as a gap. A gap is located in the file; one that lies within inflated members
names the file's bytes of these members, and where in the first it begins and in the last it ends (inner_start, inner_end).
Members are inflated one after the other and records handed on at once, so a task holds the file as stored and the records that
are not yet complete; what a member leaves unfinished is given up when the next one begins with a version line.

Defined cases: null html is empty; null urls are an empty target; null page_ids are kept and never revisit; rows that
repeat the smallest page_id are responses; line breaks in urls are percent-encoded; empty tables give empty archives.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import fresh_path, materialize

MIN_DEDUP = 100
VERSION = b"WARC/1.1\r\n"
_ANY_VERSION = (b"WARC/1.1\r\n", b"WARC/1.0\r\n")
_URN = "urn:page:"
#: Compressed bytes of a file, but for one record more.
FILE_BYTES = 32 << 20
#: Bytes inflated at once: what stands behind a member's end is copied.
_STEP = 1 << 14
#: Failures that more bytes could mend.
_NO_END, _CUT = "headers not ended", "record cut short"
_MAGIC = re.compile(rb"\x1f\x8b\x08")


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    start: int

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if self.block.startswith(b"HTTP/") else self.block


class Gap(NamedTuple):
    """Bytes of the file that gave no record; the inner places are offsets in the first and last inflated member."""

    start: int
    end: int
    reason: str
    inner_start: int | None = None
    inner_end: int | None = None


@dataclass
class Salvage:
    records: list[Record] = field(default_factory=list)
    gaps: list[Gap] = field(default_factory=list)


def _next_version(data: bytes, at: int) -> int:
    found = [k for v in _ANY_VERSION if (k := data.find(v, at)) >= 0]
    return min(found, default=-1)


def _record(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """The record at a place and where it ends, or why there is none."""
    if data[at : at + 10] not in _ANY_VERSION:
        return None, at, "no version line"
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return None, at, _NO_END
    headers = {}
    for line in data[at + 10 : head].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "header without a colon"
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None, at, "no length"
    end = head + 4 + int(length)
    if end + 4 > len(data):
        return None, at, _CUT
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "no end mark"
    record = Record(headers, data[head + 4 : end], at)
    said = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and said.startswith("sha256:") and said[7:] != hashlib.sha256(record.payload).hexdigest():
        return None, at, "digest differs"
    return record, end + 4, ""


def _parse(data: bytes, whole: bool) -> Iterator[tuple[Record | None, int, int, str]]:
    """(record, start, end, why not) from the start of data on. If more may follow, it stops at what that could complete."""
    at = 0
    while at < len(data):
        record, end, why = _record(data, at)
        if record:
            yield record, at, end, ""
            at = end
            continue
        nxt = _next_version(data, at + 1)
        if not whole and (nxt < 0 or why in (_NO_END, _CUT)):
            return
        nxt = len(data) if nxt < 0 else nxt
        yield None, at, nxt, why if data[at:nxt].strip(b"\r\n") else ""
        at = nxt


class _Members:
    """Records of inflated members that come one after the other."""

    def __init__(self):
        self.data = b""
        self.base = 0  # place of data in all that was inflated
        self.members: list[tuple[int, int, int]] = []  # place in all that was inflated, and the file's bytes

    def add(self, got: bytes, start: int, end: int) -> Iterator[Record | Gap]:
        if got[:10] in _ANY_VERSION:
            yield from self.settle(True)
        self.members.append((self.base + len(self.data), start, end))
        self.data += got
        yield from self.settle(False)

    def settle(self, whole: bool) -> Iterator[Record | Gap]:
        done = 0
        for record, start, end, why in _parse(self.data, whole):
            done = end
            if record:
                record.start += self.base
                yield record
            elif why:
                first = max(m for m in self.members if m[0] <= self.base + start)
                last = max(m for m in self.members if m[0] < self.base + end)
                yield Gap(first[1], last[2], why, self.base + start - first[0], self.base + end - last[0])
        self.data, self.base = self.data[done:], self.base + done
        self.members = [m for k, m in enumerate(self.members) if k + 1 == len(self.members) or self.members[k + 1][0] > self.base] if self.data else []


def salvage(raw: bytes | memoryview) -> Iterator[Record | Gap]:
    """Records and gaps of an archive, plain or gzip, the latter with any number of members, each holding one record or many."""
    view = memoryview(raw)
    if view[:2] != b"\x1f\x8b" and (not _MAGIC.search(view) or _next_version(bytes(view), 0) >= 0):
        for record, start, end, why in _parse(bytes(view), True):
            if record or why:
                yield record or Gap(start, end, why)
        return
    at, members = 0, _Members()
    while at < len(view):
        if view[at] in b"\r\n":
            at += 1
            continue
        z = zlib.decompressobj(31)
        got = bytearray()
        try:
            for k in range(at, len(view), _STEP):
                got += z.decompress(view[k : k + _STEP])
                if z.eof:
                    break
            why = "" if z.eof else "member cut short"
            used = min(len(view), k + _STEP) - len(z.unused_data) if z.eof else len(view)
        except zlib.error as e:
            why = f"bad member: {e}"
        if why:
            # keep what came out before the damage, then look for the next member that begins well
            used = next((m.start() for m in _MAGIC.finditer(view, at + 1) if _inflates(view, m.start())), len(view))
            yield Gap(at, used, why)
        yield from members.add(bytes(got), at, used)
        at = used
    yield from members.settle(True)


def read_archive(raw: bytes) -> Salvage:
    out = Salvage()
    for found in salvage(raw):
        (out.records if isinstance(found, Record) else out.gaps).append(found)
    return out


def _inflates(raw: memoryview, at: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(raw[at : at + 4096], 16)[:5] == b"WARC/"
    except zlib.error:
        return False


def _with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to. Only payloads that occur twice or more are joined, the texts are not grouped."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    keys = materialize(rows.filter(F.octet_length("html") >= MIN_DEDUP).select("page_id", F.unhex(F.sha2("html", 256)).alias("digest")), "payload-keys")
    repeated = keys.filter("page_id is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = materialize(keys.join(repeated, "digest").filter("page_id <> first").select(F.col("page_id").alias("_again"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")).distinct(), "revisits")
    rows = rows.withColumn("digest", F.sha2("html", 256))
    joined = rows.join(again, (rows.page_id == again._again) & (F.unhex(rows.digest) == again._digest), "left")
    return joined.select("page_id", "url", "html", "digest", "refers_to")


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    rows = _with_revisits(pages)
    urn = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(VERSION.decode() + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")), F.lit("\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.octet_length("html").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                parts.append(z.compress(record.as_buffer()) + z.flush())
                size += len(parts[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["file"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["file"])

    files = rows.select(F.concat(head, block, F.lit("\r\n\r\n")).cast("binary").alias("record")).mapInArrow(members, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").removeprefix(_URN)
    return int(name) if name.lstrip("-").isdigit() else None


_FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, gap_start long, gap_end long, reason string, inner_start long, inner_end long"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _row(found: Record | Gap, name: str) -> tuple:
    if isinstance(found, Gap):
        return (None, None, None, None, None, name, *found)
    of, kind, said = found.headers.get, found.headers.get("warc-type"), found.headers.get("warc-payload-digest", "")
    if kind == "revisit":
        return (_page(of("warc-record-id")), int(of("x-payload-length", 0)), said.removeprefix("sha256:"), kind, _page(of("warc-refers-to"))) + (None,) * 6
    return (_page(of("warc-record-id")), len(found.payload), hashlib.sha256(found.payload).hexdigest(), kind) + (None,) * 7


def read_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of all archives of a folder; records by page, gaps as file, start, end, reason, inner_start, inner_end."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py()
                # a record's text goes when its row is made
                rows = [_row(found, name) for found in salvage(memoryview(batch.column(1)[k].as_buffer()))]
                columns = list(zip(*rows)) if rows else [()] * len(_KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)], names=_NAMES)

    rows = materialize(files.mapInArrow(run, _FOUND), "archive-rows")
    records = rows.filter("record_type is not null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return records, rows.filter("reason is not null").select("file", "gap_start", "gap_end", "reason", "inner_start", "inner_end")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes the archives to the shared folder and reads them back, one row per record."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)[0]
