"""WARC files as a Spark source: gzip members are records, so a file is cut at any byte and each task starts at the first member of its stretch.

``spark.dataSource.register(WarcSource)``, then ``spark.read.format("warc").load(path)``; ``read_warc`` does both.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from webloom.session import ship

SCHEMA = "warc_type string, target_uri string, date string, record_id string, content_type string, http_status int, http_content_type string, payload binary"
#: How a gzip member begins.
MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20


def headers(lines: bytes) -> dict[str, str]:
    """Named fields of a block of header lines, names in lower case, the last of equals."""
    out = {}
    for line in lines.decode("utf-8", "replace").split("\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def unchunked(body: bytes) -> bytes:
    """The body of a transfer in chunks; what doesn't look like one is left as it is."""
    out, at = [], 0
    while (line := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return body
        if size == 0:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size
    return b"".join(out) if out else body


def record(data: bytes) -> tuple | None:
    """A record's row, its HTTP head taken off and its encodings undone; None if it doesn't begin like a record."""
    if not data.startswith(b"WARC/"):
        return None
    head, _, block = data.partition(b"\r\n\r\n")
    about = headers(head)
    length = about.get("content-length", "")
    block = block[: int(length)] if length.isdigit() else block
    status, kind, payload = None, None, block
    if about.get("content-type", "").startswith("application/http") and block.startswith(b"HTTP/"):
        first, _, payload = block.partition(b"\r\n\r\n")
        http = headers(first)
        found = re.match(rb"HTTP/\S+ +(\d{3})", first)
        status, kind = int(found[1]) if found else None, http.get("content-type")
        if "chunked" in http.get("transfer-encoding", "").lower():
            payload = unchunked(payload)
        if http.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
            try:
                payload = zlib.decompressobj(47 if payload.startswith(MAGIC[:2]) or payload[:1] == b"\x78" else -15).decompress(payload)
            except zlib.error:  # crawlers store bodies that they have decoded already
                pass
    return about.get("warc-type"), about.get("warc-target-uri"), about.get("warc-date"), about.get("warc-record-id"), about.get("content-type"), status, kind, payload


def members(file: BinaryIO, start: int, end: int) -> Iterator[bytes]:
    """The contents of the gzip members that begin in [start, end), each whole, wherever it ends.

    From ``start`` on bytes are tried as a member's beginning until one unpacks to a record; after it members follow
    one another. A file without members is taken apart where records begin.
    """
    file.seek(start)
    held, at = b"", start  # unread bytes, and where they begin

    def more() -> bool:
        nonlocal held
        new = file.read(CHUNK)
        held += new
        return bool(new)

    synced = False
    while at < end:
        if not synced:
            place = held.find(MAGIC)
            if place < 0:
                keep = len(MAGIC) - 1
                drop = max(0, len(held) - keep)
                held, at = held[drop:], at + drop
                if not more():
                    return
                continue
            held, at = held[place:], at + place
            while len(held) < 4 * 1024 and more():
                pass
            try:
                synced = zlib.decompressobj(31).decompress(held[: 4 * 1024], 5).startswith(b"WARC/"[:5])
            except zlib.error:
                synced = False
            if not synced:
                held, at = held[1:], at + 1
            continue
        if not held and not more():
            return
        unpack, out, taken = zlib.decompressobj(31), [], 0
        while True:
            try:
                out.append(unpack.decompress(held))
            except zlib.error:
                out, synced = [], False
                break
            if unpack.eof:
                taken += len(held) - len(unpack.unused_data)
                held = unpack.unused_data
                break
            taken, held = taken + len(held), b""
            if not more():
                return  # cut off
        if not synced:
            held, at = held[1:], at + max(1, taken)
            continue
        at += taken
        yield b"".join(out)


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int


def _opened(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, place


def listed(path: str) -> list[tuple[str, int]]:
    """The WARC files at a path, a file or a folder, with their sizes, in order of name."""
    from pyarrow import fs

    system, place = _opened(path)
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = [f for f in system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File and f.path.endswith(".warc.gz")]
    return sorted((prefix + f.path, f.size) for f in found)


class WarcReader(DataSourceReader):
    def __init__(self, paths: list[str], split: int):
        self.paths, self.split = paths, split

    def partitions(self) -> list[Stretch]:
        files = [f for p in self.paths for f in listed(p)]
        if not files:
            raise FileNotFoundError(f"no WARC files in {', '.join(self.paths)}")
        return [Stretch(path, at, min(at + self.split, size)) for path, size in files for at in range(0, max(size, 1), self.split)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        system, place = _opened(partition.path)
        with system.open_input_file(place) as file:
            for data in members(file, partition.start, partition.end):
                row = record(data)
                if row:
                    yield row


class WarcSource(DataSource):
    """Options: ``path`` (a file, a folder, or several, one a line) and ``splitBytes``, the compressed bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        paths = [p for p in self.options.get("path", "").split("\n") if p.strip()]
        if not paths:
            raise ValueError("a path is needed")
        return WarcReader(paths, int(self.options.get("splitBytes", 64 << 20)))


def read_warc(spark: SparkSession, *paths: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Records of WARC files, in columns of ``SCHEMA``."""
    ship(spark)
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("splitBytes", split_bytes).load("\n".join(paths))


def html_of(payload: Column, content_type: Column) -> Column:
    """A page's text in the charset that its head or its first bytes name, UTF-8 else; what can't be read in it is replaced."""

    @F.pandas_udf("string")
    def decoded(payloads, kinds):
        def one(data: bytes | None, kind: str | None) -> str | None:
            if data is None:
                return None
            named = re.search(r"charset=[\"']?([\w.:-]+)", kind or "") or re.search(r"charset=[\"']?([\w.:-]+)", data[:2048].decode("latin-1"))
            try:
                return data.decode(named[1] if named else "utf-8", "replace")
            except LookupError:
                return data.decode("utf-8", "replace")

        import pandas as pd

        return pd.Series([one(d, k) for d, k in zip(payloads, kinds, strict=True)], dtype=object)

    return decoded(payload, content_type)


def warc_pages(records: DataFrame) -> DataFrame:
    """url, date, html of the records that are answers of HTML."""
    good = records.where((F.col("warc_type") == "response") & F.col("http_status").between(200, 299) & F.lower(F.coalesce("http_content_type", F.lit("text/html"))).contains("html"))
    return good.select(F.col("target_uri").alias("url"), "date", html_of(F.col("payload"), F.col("http_content_type")).alias("html"))


#: Bytes of an Arrow batch in place of Spark's default of 64 MB: a task's packs would go into one batch up to that size.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _ship(spark: SparkSession) -> None:
    ship(spark)
    if spark.conf.get(BATCH_BYTES) == f"{64 << 20}b":
        spark.conf.set(BATCH_BYTES, str(4 * CHUNK))


def packed_records(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """warc: pages as gzip members of WARC responses, runs of members of some 1 MB or less."""
    _ship(pages.sparkSession)

    def packed(out: io.BytesIO) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["warc"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = io.BytesIO()
            for url, html in ((u.as_py(), h.as_py()) for u, h in zip(*batch.columns, strict=True)):
                if out.tell() >= CHUNK:
                    yield packed(out)
                    out = io.BytesIO()
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode()
                head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                data = head + body + b"\r\n\r\n"
                deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
                out.write(MAGIC + b"\x00" * 6 + b"\xff" + deflate.compress(data) + deflate.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))
            yield packed(out)

    return pages.select(F.col(url_col), F.col(html_col)).mapInArrow(pack, "warc binary")


def unpacked_records(packs: DataFrame, column: str = "warc") -> DataFrame:
    """The records of whole WARC files or runs of members in a binary column, in columns of ``SCHEMA``."""
    _ship(packs.sparkSession)
    names, kinds = zip(*(c.split() for c in SCHEMA.split(", ")), strict=True)
    types = [{"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[k] for k in kinds]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for member in members(io.BytesIO(data.as_py() or b""), 0, 1 << 62):
                    if (row := record(member)) is not None:
                        rows.append(row)
                        size += len(row[-1])
                    if size > 4 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], list(names))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], list(names))

    return packs.select(column).mapInArrow(unpack, SCHEMA)
