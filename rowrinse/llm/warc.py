"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Every record is a gzip member of its own whose header carries the member's
length, as the format's annex on skip lengths describes. A reader so finds the
next record without decoding this one: it inflates the header lines alone,
holds them against the filters that Spark pushes down, and inflates the rest
only where the payload is asked for. Files are split into partitions by size.

Archives from elsewhere, ``.warc`` or ``.warc.gz``, have no manifest and mostly
no skip lengths. Each of their files is one partition, read as a stream. A plain
file is left behind by seeking over unwanted blocks; in a compressed one the
only way to the next record is to inflate, but nothing is kept.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage,
)

from rowrinse.llm.common import quoted, shared_folder

SCHEMA = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
HEADERS = {"record_type": "WARC-Type", "url": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "page_id": "Page-Id", "refers_to": "Refers-To-Page-Id"}
MANIFEST = "_manifest.json"
UNCOMMITTED = re.compile(r"part-[0-9a-f]{32}\.warc\.gz")
SPLIT = 64 << 20
HEAD = 2048
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'page:{page_id}')}>"


def member(data: bytes) -> bytes:
    """One gzip member with a skip-length field."""
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    whole = 24 + len(body) + len(tail)
    return struct.pack("<4BI2BH2sHII", 31, 139, 8, 4, 0, 0, 255, 12, b"sl", 8, whole, len(data) & 0xFFFFFFFF) + body + tail


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}", "", ""]
    return member("\r\n".join(lines).encode() + block + b"\r\n\r\n")


@dataclass
class Files(WriterCommitMessage):
    name: str
    offsets: list[int]


class WarcWriter(DataSourceWriter):
    """Each task writes a file under a name of its own; only the files in the manifest, written last, count."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Files:
        fs, folder = opened(self.path)
        fs.create_dir(folder, recursive=True)
        name, size, offsets, since = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0], 0
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for r in rows:
                data = record(r["page_id"], r["url"], (r["html"] or "").encode(), r["payload_digest"], r["refers_to"], r["record_type"] == "revisit")
                if size - offsets[-1] >= SPLIT:
                    offsets.append(size)
                out.write(data)
                size += len(data)
        return Files(name, [*offsets, size])

    def commit(self, messages: list) -> None:
        fs, folder = opened(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps([[m.name, m.offsets] for m in messages if m and m.offsets[-1]]).encode())

    def abort(self, messages: list) -> None:
        fs, folder = opened(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{folder}/{m.name}")


class Range(InputPartition):
    def __init__(self, name: str, start: int, stop: int):
        self.name, self.start, self.stop = name, start, stop


class Archive(InputPartition):
    """A whole file that this library did not lay out."""

    def __init__(self, path: str):
        self.path = path


def pass_over(file, n: int, size: int | None) -> None:
    """Go ``n`` bytes on; a stream whose ``size`` is unknown is read through."""
    if size is not None:
        if file.tell() + n > size:
            raise ValueError("an archive ends inside a record")
        file.seek(n, io.SEEK_CUR)
    while size is None and n:
        got = len(file.read(min(n, 1 << 20)))
        if not got:
            raise ValueError("an archive ends inside a record")
        n -= got


def header_lines(file, limit: int | None = None) -> tuple[dict[str, str], int]:
    """Fields up to a blank line, by lower-case name, and the bytes read, at most ``limit``."""
    fields, last, used = {}, None, 0
    while limit is None or used < limit:
        line = file.readline() if limit is None else file.readline(limit - used)
        used += len(line)
        if not line and limit is None:
            raise ValueError("a record without an end of its headers")
        if not line.strip():
            break
        text = line.decode(errors="replace")
        if text[0] in " \t" and last:
            fields[last] += " " + text.strip()
        elif ":" in text:
            last, value = text.split(":", 1)
            last = last.strip().lower()
            fields[last] = value.strip()
    return fields, used


def header_row(fields: dict[str, str]) -> dict:
    """The header columns of a record from its fields by lower-case name."""
    row = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
    row["payload_digest"] = row["payload_digest"] and row["payload_digest"].rsplit(":", 1)[-1]
    row["url"] = row["url"] and row["url"].removeprefix("<").removesuffix(">")
    for c in ("page_id", "refers_to"):
        row[c] = None if row[c] is None else int(row[c])
    return row


class WarcReader(DataSourceReader):
    def __init__(self, path: str, wanted: list[str]):
        self.path, self.wanted, self.tests = path, wanted, []

    def pushFilters(self, filters):
        """Takes equality, membership and not-null tests of header columns; Spark keeps the others."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((column, {f.value}))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, set(f.value)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, None))
            else:
                yield f

    def partitions(self):
        fs, folder = opened(self.path)
        if fs.get_file_info(f"{folder}/{MANIFEST}").type != pyarrow.fs.FileType.File:
            return self.archives(fs, folder)
        with fs.open_input_stream(f"{folder}/{MANIFEST}", compression=None) as file:
            listed = json.loads(file.read())
        out = [Range(name, a, b) for name, offsets in listed for a, b in zip(offsets, offsets[1:])]
        return out or [Range("", 0, 0)]

    def archives(self, fs: pyarrow.fs.FileSystem, path: str) -> list[Archive]:
        """A partition a file; what a writer of this library left without its manifest does not count."""
        info = fs.get_file_info(path)
        if info.type == pyarrow.fs.FileType.File:
            return [Archive(path)]
        listed = fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
        names = sorted(f.path for f in listed if f.is_file and f.path.endswith((".warc", ".warc.gz")) and not UNCOMMITTED.fullmatch(f.base_name))
        if not names:
            raise FileNotFoundError(f"no WARC archives in {self.path}")
        return [Archive(n) for n in names]

    def passes(self, row: dict) -> bool:
        return all(row[c] is not None if allowed is None else row[c] in allowed for c, allowed in self.tests)

    def stream(self, path: str):
        """Rows of a file in order of its records; a digest that came with a record is given as it stands."""
        fs, _ = opened(self.path)
        with fs.open_input_file(path) as raw:
            packed = raw.read(2) == b"\x1f\x8b"
            raw.seek(0)
            file = gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw, 1 << 20)
            size = None if packed else raw.size()
            while line := file.readline():
                if not line.strip():
                    continue
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"{path} has something other than a record where one should start")
                fields, _ = header_lines(file)
                left, row = int(fields["content-length"]), header_row(fields)
                if not self.passes(row):
                    pass_over(file, left, size)
                    continue
                http = {}
                if fields.get("content-type", "").lower().startswith("application/http"):
                    http, used = header_lines(file, left)
                    left -= used
                revisit, row["payload"] = row["record_type"] == "revisit", None
                told = http.get("content-length", "")
                row["payload_bytes"] = left if not revisit else int(told) if told.isdigit() else None
                if "payload" in self.wanted and not revisit:
                    row["payload"] = file.read(left)
                    if len(row["payload"]) < left:
                        raise ValueError("an archive ends inside a record")
                else:
                    pass_over(file, left, size)
                yield tuple(row[c] for c in self.wanted)

    def read(self, partition: Range | Archive):
        if isinstance(partition, Archive):
            yield from self.stream(partition.path)
            return
        if partition.start == partition.stop:
            return
        fs, folder = opened(self.path)
        payload = "payload" in self.wanted
        with fs.open_input_file(f"{folder}/{partition.name}") as file:
            file.seek(partition.start)
            at, waiting = partition.start, b""
            while at < partition.stop:
                while len(waiting) < 24:
                    waiting += file.read(1 << 20)
                length = struct.unpack_from("<I", waiting, 16)[0]
                while len(waiting) < length:
                    waiting += file.read(max(1 << 20, length - len(waiting)))
                row = self.parse(memoryview(waiting)[:length], payload)
                if row is not None:
                    yield tuple(row[c] for c in self.wanted)
                waiting, at = waiting[length:], at + length

    def parse(self, data, payload: bool) -> dict | None:
        """A record as a row, None where a filter drops it; the payload is inflated last, if at all."""
        inflate = zlib.decompressobj(-15)
        head = inflate.decompress(data[24:-8], HEAD)
        while b"\r\n\r\n" not in head:
            more = inflate.decompress(inflate.unconsumed_tail, HEAD)
            if not more:
                raise ValueError("a record without an end of its headers")
            head += more
        lines, _, block = head.partition(b"\r\n\r\n")
        fields = (x.split(": ", 1) for x in lines.decode().split("\r\n")[1:])
        row = header_row({name.lower(): value for name, value in fields})
        if not self.passes(row):
            return None
        while b"\r\n\r\n" not in block:
            block += inflate.decompress(inflate.unconsumed_tail, HEAD)
        http, _, body = block.partition(b"\r\n\r\n")
        row["payload_bytes"] = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
        row["payload"] = None
        if payload and row["record_type"] == "response":
            body += inflate.decompress(inflate.unconsumed_tail) + inflate.flush()
            row["payload"] = body[: row["payload_bytes"]]
            if digest_of(row["payload"]) != row["payload_digest"]:
                raise ValueError(f"the payload of page {row['page_id']} does not have its digest")
        return row


class WarcSource(DataSource):
    """Options: ``path``, a folder or a file; ``columns``, a comma list of the schema's names, to leave the payload undecoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def columns(self) -> list[str]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        chosen = self.options.get("columns")
        return [c for c in names if c in chosen.split(",")] if chosen else names

    def schema(self) -> str:
        return ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] in self.columns())

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.columns())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0, id_col="page_id", url_col="url", html_col="html") -> None:
    """Archive the rows of ``pages``; a payload (null: empty) of at least ``least_bytes`` is stored once.

    The record with the smallest id of those with one payload is the response,
    the others revisit it. Rows that repeat that id are responses too. Null
    ids come last; where all are null, all are responses. An empty table makes
    an archive without records.
    """
    register(pages.sparkSession)
    html = F.coalesce(quoted(html_col), F.lit(""))
    rows = pages.select(quoted(id_col).cast("bigint").alias("page_id"), quoted(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first"))
    joined = rows.join(first, "sha")
    again = (F.octet_length("html") >= least_bytes) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    # 40 hex digits are 32 groups of five bits
    bits = F.concat(*[F.lpad(F.conv(F.substring("sha", 1 + 10 * i, 10), 16, 2), 40, "0") for i in range(4)])
    symbols = [F.substring(F.lit(alphabet), F.conv(F.substring("bits", 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)]
    out = joined.withColumn("bits", bits).withColumn("payload_digest", F.concat(*symbols))
    out = out.select(
        "page_id", "url", "html", "payload_digest", F.when(again, F.col("first")).alias("refers_to"),
        F.when(again, "revisit").otherwise("response").alias("record_type"))
    out.write.format("warc").option("path", path).mode("append").save()


def read_pages(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of archives, of this library or others; ids and digests that a record does not name are null.

    The payload of an HTTP message is its body as stored, of any other record
    its block; a revisit has none, and its size is what its HTTP headers say.
    """
    register(spark)
    reader = spark.read.format("warc").option("path", path)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()


def archive_and_read(pages: DataFrame, **options) -> DataFrame:
    """Rows of the archives of ``pages``, read back with every payload decoded and held against its digest."""
    path = f"{shared_folder(pages.sparkSession)}/warc"
    write_pages(pages, path, **options)
    return read_pages(pages.sparkSession, path)
