from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid

import pytest
from pyspark.sql import functions as F

from rowrinse.llm import warc


@pytest.fixture(scope="module")
def rows():
    texts = ["<p>one</p>", None, "", "<p>one</p>", "é" * 3000, "<p>two</p>", "<p>one</p>", "x" * 300_000]
    out = [(i, f"http://h/{i}?q=a b", t, "extra") for i, t in enumerate(texts)]
    return out + [(None, None, "<p>two</p>", "extra"), (None, "u", "alone", "extra"), out[5]]


@pytest.fixture(scope="module")
def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, refers_to string").repartition(3)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_round_trip(spark, rows, pages, folder):
    warc.write_pages(pages, folder)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_pages(spark, folder).collect()), key=str)
    first = {}
    for i, _, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    wanted = []
    for i, _, t, _ in rows:
        f = first.get(t or "")
        again = f is not None and i != f
        wanted.append((i, len((t or "").encode()), digest(t), "revisit" if again else "response", f if again else None))
    assert got == sorted(wanted, key=str)
    texts = {r.page_id: bytes(r.payload) for r in warc.read_pages(spark, folder).filter("record_type = 'response'").collect() if r.page_id is not None}
    assert texts[4].decode() == rows[4][2] and texts[7].decode() == rows[7][2]


def test_files_are_gzip_members_with_skip_lengths(pages, folder):
    warc.write_pages(pages, folder)
    names = [n for n in os.listdir(folder) if n.endswith(".warc.gz")]
    data = b"".join(gzip.open(f"{folder}/{n}").read() for n in names)
    assert data.count(b"WARC/1.1\r\n") == 11 and data.count(b"WARC-Type: revisit") == 4


def test_filters_are_pushed_and_payloads_left_alone(spark, pages, folder):
    warc.write_pages(pages, folder)
    reader = warc.WarcReader(folder, ["page_id", "record_type"])
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 3)]))
    assert len(left) == 1
    assert {r[1] for p in reader.partitions() for r in reader.read(p)} == {"revisit"}
    df = warc.read_pages(spark, folder, ["page_id", "record_type", "payload_bytes"]).filter(F.col("record_type") == "revisit")
    assert df.count() == 4 and "payload" not in df.columns


def test_small_payloads_may_stay_apart(spark, pages, folder):
    warc.write_pages(pages, folder, least_bytes=11)
    assert {r.record_type for r in warc.read_pages(spark, folder).collect()} == {"response"}


def test_files_outside_the_manifest_do_not_count(spark, pages, folder):
    warc.write_pages(pages, folder)
    with open(f"{folder}/part-lost.warc.gz", "wb") as file:
        file.write(b"left by a task that was lost")
    assert warc.read_pages(spark, folder).count() == 11


def test_damage_is_found():
    data = bytearray(warc.record(1, "u", b"payload", warc.digest_of(b"other"), None, False))
    reader = warc.WarcReader("", ["payload"])
    with pytest.raises(ValueError):
        reader.parse(memoryview(bytes(data)), True)


def test_empty(spark, folder):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_pages(none, folder)
    assert warc.read_pages(spark, folder).count() == 0


def foreign_records():
    """Records as other tools write them, with the row each should become."""
    def make(kind, block, *lines, http=True):
        head = ["WARC/1.0", f"WARC-Type: {kind}", *lines, f"Content-Type: {'application/http; msgtype=x' if http else 'text/plain'}"]
        return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"

    answer = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    body = b"WARC/1.0\r\nWARC-Type: response\r\n\r\n\x1f\x8b\x08" + b"y" * 70_000
    return [
        (make("warcinfo", b"software: x\r\n", http=False), (None, "warcinfo", 13, None, b"software: x\r\n")),
        (make("request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "WARC-Target-URI: http://h/"), ("http://h/", "request", 0, None, b"")),
        (make("response", answer + body, "warc-target-uri: <http://h/>", "WARC-Payload-Digest: sha1:ABC", "X-Long: a", "  b"),
         ("http://h/", "response", len(body), "ABC", body)),
        (make("revisit", answer[:-2] + b"Content-Length: 9\r\n\r\n", "WARC-Target-URI: http://h/2"), ("http://h/2", "revisit", 9, None, None)),
        (make("revisit", b"", "WARC-Target-URI: http://h/3"), ("http://h/3", "revisit", None, None, None)),
        (make("response", b"", "WARC-Target-URI: http://h/4"), ("http://h/4", "response", 0, None, b"")),
    ]


@pytest.mark.parametrize("layout", ["plain", "members", "one member"])
def test_archives_from_elsewhere(spark, tmp_path, layout):
    made = foreign_records()
    parts = [r for r, _ in made]
    data = b"".join(parts) if layout == "plain" else b"".join(map(gzip.compress, parts)) if layout == "members" else gzip.compress(b"".join(parts))
    (tmp_path / "deep").mkdir()
    path = tmp_path / "deep" / ("a.warc" if layout == "plain" else "a.warc.gz")
    path.write_bytes(data)
    (tmp_path / f"part-{'0' * 32}.warc.gz").write_bytes(b"of a write that did not end")
    columns = ["url", "record_type", "payload_bytes", "payload_digest", "payload"]
    wanted = sorted((row for _, row in made), key=str)
    for where in (str(tmp_path), str(path)):
        got = [tuple(r[c] if not isinstance(r[c], bytearray) else bytes(r[c]) for c in columns) for r in warc.read_pages(spark, where).collect()]
        assert sorted(got, key=str) == wanted
    some = warc.read_pages(spark, str(tmp_path), ["url", "record_type", "payload_bytes"]).filter("record_type = 'response' and url = 'http://h/'")
    assert [tuple(r) for r in some.collect()] == [("http://h/", "response", made[2][1][2])]
    path.write_bytes(data[:-9] if layout != "plain" else data[:-30])
    reader = warc.WarcReader(str(path), ["url"])
    with pytest.raises((ValueError, EOFError)):
        [r for p in reader.partitions() for r in reader.read(p)]


def test_a_committed_file_reads_alone(spark, pages, folder):
    warc.write_pages(pages, folder)
    names = [n for n in os.listdir(folder) if n.endswith(".warc.gz")]
    alone = [tuple(r) for n in names for r in warc.read_pages(spark, f"{folder}/{n}").collect()]
    assert sorted(alone, key=str) == sorted((tuple(r) for r in warc.read_pages(spark, folder).collect()), key=str)


def test_no_archives(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        warc.WarcReader(str(tmp_path), ["url"]).partitions()
