import base64
import gzip
import hashlib
import io
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillforge.llm.warc_zip import ZipWriter, directory, op5_zip_ranges, ranges, read_archives, record, split_gzip, split_plain, write_archives

SCHEMA = "page_id long, url string, html string, id string"


def opened(data: bytes) -> pa.BufferReader:
    return pa.BufferReader(data)


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_of_own_and_foreign_archives(zip64):
    members = [("archive/data.warc.gz", b"x" * 100), ("indexes/index.cdx", b"a 0 60\nb 60 40"), ("ö.txt", b"")]
    out = io.BytesIO()
    w = ZipWriter(out, zip64)
    for n, b in members:
        w.member(n, [b[:3], b[3:]])
    w.close()
    data = out.getvalue()
    z = zipfile.ZipFile(io.BytesIO(data))
    assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == members
    assert [(m.name, m.size) for m in directory(opened(data))] == [(n, len(b)) for n, b in members]
    assert [x[1:] for x in ranges(opened(data), 70)] == [(60, 1, True), (40, 1, True)] and [x[1:] for x in ranges(opened(data))] == [(100, 2, True)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as w:
        w.comment = b"PK\x05\x06 in a comment"
        for n, b in members:
            with w.open(zipfile.ZipInfo(n), "w", force_zip64=zip64) as f:
                f.write(b)
    data = out.getvalue()
    (at, size, n, _), = ranges(opened(data))
    assert (data[at : at + size], n) == (b"x" * 100, 2)


def test_errors_and_gzip_members():
    with pytest.raises(ValueError, match="end of central"):
        directory(opened(b"not an archive" * 10))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        w.writestr("archive/data.warc.gz", b"x" * 100)
    with pytest.raises(ValueError, match="compressed"):
        list(ranges(opened(out.getvalue())))
    assert list(split_gzip([gzip.compress(b"a") + gzip.compress(b"")])) == [b"a", b""]
    assert b"urn:page:7>\r\n" in record("7", "http://x/\r\ny", b"", None) and b"%0D%0A" in record("7", "http://x/\r\ny", b"", None)


def pages(rng):
    bodies = ["", "a", "ü" * 40, "\r\n\r\n", "x" * 200_000, *(f"<p>{i}</p>" for i in range(20))]
    rows = [(i, f"http://h/{i}", rng.choice(bodies), "x") for i in range(120)]
    return rows + [(200, None, None, "x"), (201, "u", None, "x"), (5, "again", "only here", "x"), (5, "again", "only here", "x"), (None, "n", "a", "x"), (None, "n", "nobody else", "x")]


def expected(rows, min_bytes=0):
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        refers = first.get(h or "") if len(b) >= min_bytes else None
        refers = None if refers == i else refers
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = pages(random.Random(8))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for min_bytes, size in ((0, 1 << 20), (50, 3000)):
        written = write_archives(frame, f"file://{tmp_path}/{min_bytes}", min_bytes=min_bytes, archive_bytes=size, zip64=size == 3000)
        got = read_archives(written, range_bytes=2000).collect()
        assert sorted(((None if r.record_id is None else int(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in got), key=str) == expected(rows, min_bytes)
        assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
        assert written.agg(F.sum("records")).first()[0] == len(rows)


def test_query_and_empty_table(spark, tmp_path):
    rows = pages(random.Random(9))
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.write.parquet(f"{tmp_path}/a/pages.parquet")
    frame.where("false").write.parquet(f"{tmp_path}/b/pages.parquet")
    assert sorted(map(tuple, op5_zip_ranges(spark, f"{tmp_path}/a").collect()), key=str) == expected(rows)
    assert op5_zip_ranges(spark, f"{tmp_path}/b").count() == 0


def foreign_records():
    made = [record(str(i), f"http://h/{i}", f"body {i}".encode() * 50, None) for i in range(6)]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    bare = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello\r\n\r\n"
    plain = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
    return [info, *made], [bare, plain, info]


def test_foreign_archive_with_members_indexes_and_other_records(spark, tmp_path):
    one, two = foreign_records()
    packed = [gzip.compress(x) for x in one]
    at = [sum(map(len, packed[:i])) for i in range(len(packed))]
    cdx = " CDX N b a m s k r M S V g\n" + "".join(f"k 2020 u text/html 200 AAAA - - {len(p)} {o} one.warc.gz\n" for p, o in zip(packed, at, strict=True))
    second = [gzip.compress(x) for x in two]
    cdxj = f'com,x)/ 2020 {{"url": "u", "offset": "0", "length": "{len(second[0])}", "filename": "archive/two.warc.gz"}}\n'
    path = tmp_path / "foreign.zip"
    with zipfile.ZipFile(path, "w") as w:
        for name, data in {"archive/one.warc.gz": b"".join(packed), "archive/two.warc.gz": b"".join(second), "archive/three.warc": b"".join(two), "archive/four.warc.gz": b"".join(second), "indexes/one.cdx": cdx.encode(), "indexes/two.cdxj.gz": gzip.compress(cdxj.encode())}.items():
            w.writestr(name, data)
    for size in (1, 1 << 20):
        got = read_archives(spark.createDataFrame([(f"file://{path}", "x"), (None, "y")], "path string, size string"), range_bytes=size).collect()
        digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
        want = [(str(i), "response", (f"body {i}".encode() * 50)) for i in range(6)] + [("urn:uuid:1", "response", b"hello")] * 3 + [("urn:uuid:2", "resource", b"xyz")] * 2
        assert sorted((r.record_id, r.record_type, bytes(r.payload)) for r in got) == sorted(want)
        assert all(r.payload_digest == digest(bytes(r.payload)) and r.payload_bytes == len(r.payload) for r in got)


def test_streams_in_pieces():
    one, _ = foreign_records()
    data = b"".join(gzip.compress(x) for x in one)
    for step in (1, 7, 100, len(data)):
        assert list(split_gzip(data[i : i + step] for i in range(0, len(data), step))) == one
        plain = b"".join(one)
        assert [x.rstrip() for x in split_plain(plain[i : i + step] for i in range(0, len(plain), step))] == [x.rstrip() for x in one]
    with pytest.raises(ValueError, match="cut short"):
        list(split_gzip([data[:-3]]))


def test_large_group_of_equal_payloads_by_a_shuffle(spark, tmp_path, monkeypatch):
    rows = [(i, "u", "same" if i % 3 else f"own {i}", "x") for i in range(300)] + [(None, "u", "same", "x")] * 5
    monkeypatch.setattr("quillforge.llm.warc_zip.BROADCAST_ROWS", 0)
    written = write_archives(spark.createDataFrame(rows, SCHEMA).repartition(5), f"file://{tmp_path}/a")
    got = read_archives(written, payloads=False).collect()
    assert sorted(((None if r.record_id is None else int(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in got), key=str) == expected(rows)
