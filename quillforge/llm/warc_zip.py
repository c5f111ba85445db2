"""WARC records in ZIP archives, written and read in place.

An archive holds stored members: `archive/*.warc.gz`, one gzip member for each
record, and `indexes/*.cdxj`, a line with file name, offset and length for each
record.  Both are written as the records come, so a task holds one at a time.
The reader finds the end-of-directory record at the file's end, follows ZIP64
records and extra fields where there are any, takes the members' places from
the central directory and reads single ranges of records from the open file;
nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm import textkit as tk
from quillforge.llm.shared import cut, shared_dir, small_batches

#: Bytes of records from which an archive is closed, and of a range that one task reads, in one go at most.
ARCHIVE_BYTES, RANGE_BYTES = 48 << 20, 1 << 20
#: Bytes that a decompressor takes at once.
_FEED = 1 << 14
#: Up to so many revisits are broadcast to the payloads; for more the payloads are shuffled by id.
BROADCAST_ROWS = 200_000
SALTS = 16
MEMBER = "data.warc.gz"
DATE, _COMPACT_DATE = "1970-01-01T00:00:00Z", "19700101000000"
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF

# ---- fixed values: signatures of the ZIP format, and the revisit profile of the WARC format
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64, _DESCRIPTOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x07\x08"
_FLAGS = 0x808  # names in UTF-8, sizes after the bytes
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# ----


@dataclass
class Member:
    name: str
    method: int
    crc: int
    size: int  # as stored
    header: int  # where its local header begins


# ---- writing


def _extra64(*values: int) -> bytes:
    return struct.pack(f"<HH{len(values)}Q", 1, 8 * len(values), *values) if values else b""


class ZipWriter:
    """An archive of stored members, written as their bytes come: sizes and checksums follow each member and stand in the directory.

    ZIP64 records where offsets or their number ask for them, or, for members too, if told to.
    """

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.directory = out, zip64, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, parts: Iterable[bytes]) -> None:
        raw, header, wide = name.encode(), self.at, self.zip64
        extra, size = (_extra64(0, 0), _MAX32) if wide else (b"", 0)
        self._write(struct.pack("<4sHHHHHIIIHH", _LOCAL, 45 if wide else 20, _FLAGS, 0, 0, 0x21, 0, size, size, len(raw), len(extra)) + raw + extra)
        crc = n = 0
        for part in parts:
            self._write(part)
            crc, n = zlib.crc32(part, crc), n + len(part)
        if n >= _MAX32 and not wide:
            raise ValueError("a member of 4 GB and more needs zip64")
        self._write(struct.pack("<4sIQQ" if wide else "<4sIII", _DESCRIPTOR, crc, n, n))
        far = wide or header >= _MAX32
        extra = _extra64(*([n, n] if wide else []), *([header] if far else []))
        size = _MAX32 if wide else n
        self.directory.append(struct.pack("<4sHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if far else 20, _FLAGS, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, _MAX32 if far else header) + raw + extra)

    def close(self) -> None:
        at, central, count = self.at, b"".join(self.directory), len(self.directory)
        self._write(central)
        if self.zip64 or at >= _MAX32 or count >= _MAX16:
            self._write(struct.pack("<4sQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, count, count, len(central), at))
            self._write(struct.pack("<4sIQI", _LOCATOR64, 0, at + len(central), 1))
            self._write(struct.pack("<4sHHHHIIH", _END, 0, 0, _MAX16, _MAX16, _MAX32, _MAX32, 0))
        else:
            self._write(struct.pack("<4sHHHHIIH", _END, 0, 0, count, count, len(central), at, 0))


def _header_value(value: str) -> str:
    return "".join(c if c not in "\r\n" else f"%{ord(c):02X}" for c in value)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """A response or, with refers_to, a revisit record, which has the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _revisits(rows: DataFrame, min_bytes: int) -> DataFrame:
    """id, sha and first of the rows (id, sha, bytes, order) that have the payload of a row with another and smallest id; no payload is
    moved, and each digest's rows meet only their minimum.
    """
    enough = rows.where(F.col("bytes") >= min_bytes).select("id", "order", "sha")
    firsts = enough.groupBy("sha").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("sha", "first")
    # a digest's rows are dealt to SALTS keys, so that one with very many rows is no single task
    salted = enough.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    spread = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = salted.join(spread, ["sha", "salt"]).where(~F.col("order").eqNullSafe(F.col("first")))
    return found.select("id", "sha", F.col("first").cast("string").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Writes each row of pages as a WARC record into ZIP archives in `folder`, a URI that all executors reach, and returns their
    paths and numbers of records.

    Of rows with equal payloads of at least min_bytes bytes, those with the smallest id are responses and the others revisits of it;
    smaller payloads are all responses.  A null payload is empty; rows with a null id are written too, and as revisits only of rows
    that have one.  Only archives of tasks that succeeded are in the result, whatever lost or repeated tasks have left in the folder.
    """
    spark = pages.sparkSession
    small_batches(spark)
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("order"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    revisits = cut(_revisits(rows.select("id", "order", "sha", F.length("payload").alias("bytes")), min_bytes))
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    revisits = revisits.select(F.col("id").alias("rid"), F.col("sha").alias("rsha"), "refers_to")
    joined = rows.join(revisits, F.col("id").eqNullSafe(F.col("rid")) & (F.col("sha") == F.col("rsha")), "left").select("id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_fs(folder)
        fs.create_dir(base, recursive=True)

        def records() -> Iterator[tuple[str, str | None, bytes, str | None]]:
            for batch in batches:
                for values in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers_to")), strict=True):
                    i, url, body, refers = (v.as_py() for v in values)
                    yield i if i is not None else "", url, body, refers
                tk.give_back()

        source = records()
        for head in source:  # an archive for as long as there are records
            name = f"{uuid.uuid4().hex}.zip"
            index: list[str] = []

            def packed(begin=head, index=index) -> Iterator[bytes]:
                at = 0
                for i, url, body, refers in chain([begin], source):
                    raw = gzip.compress(record(i, url, body, refers), 6, mtime=0)
                    about = {"url": url, "digest": f"sha1:{digest(body)}", "offset": str(at), "length": str(len(raw)), "filename": MEMBER}
                    index.append(f"{i} {_COMPACT_DATE} {json.dumps(about)}\n")
                    yield raw
                    at += len(raw)
                    if at >= archive_bytes:
                        return

            with fs.open_output_stream(f"{base}/{name}") as out:
                archive = ZipWriter(out, zip64)
                archive.member(f"archive/{MEMBER}", packed())
                archive.member("indexes/index.cdxj", (x.encode() for x in index))
                archive.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64())], names=["path", "records"])

    return cut(joined.mapInArrow(run, "path string, records long"))


# ---- reading


def directory(f) -> list[Member]:
    """The central directory of an open archive."""
    size = f.size()
    tail_at = max(0, size - 65557 - 76)  # the end record, its longest comment, and the ZIP64 records before it
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(_END)
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(_END, 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if _MAX16 == count or _MAX32 in (length, at):
        if end < 20 or tail[end - 20 : end - 16] != _LOCATOR64:
            raise ValueError("no ZIP64 locator")
        f.seek(struct.unpack_from("<Q", tail, end - 12)[0])
        end64 = f.read(56)
        if end64[:4] != _END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, at = struct.unpack_from("<QQQ", end64, 32)
    f.seek(at)
    raw, members, p = f.read(length), [], 0
    for _ in range(count):
        if raw[p : p + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, p + 8)
        crc, packed, plain, n, extra, comment = struct.unpack_from("<IIIHHH", raw, p + 16)
        header = struct.unpack_from("<I", raw, p + 42)[0]
        name = raw[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        e, stop = p + 46 + n, p + 46 + n + extra
        while e + 4 <= stop:
            kind, width = struct.unpack_from("<HH", raw, e)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{width // 8}Q", raw, e + 4))
                plain = next(wide) if plain == _MAX32 else plain
                packed = next(wide) if packed == _MAX32 else packed
                header = next(wide) if header == _MAX32 else header
            e += 4 + width
        members.append(Member(name, method, crc, packed, header))
        p = stop + comment
    return members


def content_at(f, m: Member) -> int:
    """Where a stored member's bytes begin: its local header may have other extra fields than the directory."""
    if m.method:
        raise ValueError(f"{m.name} is compressed in the archive; only stored members can be read in place")
    f.seek(m.header)
    head = f.read(30)
    if head[:4] != _LOCAL:
        raise ValueError("broken local header")
    return m.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def index_entries(text: str) -> Iterator[tuple[str | None, int, int]]:
    """(file name, offset, length) of each record in an index: lines that end in JSON fields, the classic eleven columns under a
    heading that names them, or lines that end in offset and length.
    """
    columns = None
    for line in text.splitlines():
        words = line.split()
        if words[:1] == ["CDX"]:
            columns = words[1:]
        elif "{" in line:
            fields = json.loads(line[line.index("{") :])
            if "offset" in fields and "length" in fields:
                yield fields.get("filename"), int(fields["offset"]), int(fields["length"])
        elif columns is not None and len(words) == len(columns):
            fields = dict(zip(columns, words, strict=True))
            if fields.get("V", "-") != "-" and fields.get("S", "-") != "-":
                yield fields.get("g"), int(fields["V"]), int(fields["S"])
        elif columns is None and len(words) >= 2 and words[-1].isdigit() and words[-2].isdigit():
            yield None, int(words[-2]), int(words[-1])


def ranges(f, limit: int = RANGE_BYTES) -> Iterator[tuple[int, int, int, bool]]:
    """(offset in the file, bytes, records, whether they are gzip members) of runs of records, by the archive's indexes.

    A member that no index names is one range, and its number of records -1; an index without file names is that of the member of
    its own stem, or of the only member.
    """
    members = directory(f)
    files = {m.name.rsplit("/", 1)[-1]: m for m in members if m.name.startswith("archive/") and m.name.endswith((".warc", ".warc.gz"))}
    stems = {n.removesuffix(".gz").removesuffix(".warc"): n for n in files}
    found: dict[str, list[tuple[int, int]]] = {}
    for m in members:
        if m.name.startswith("indexes/") and m.name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
            f.seek(content_at(f, m))
            raw = f.read(m.size)
            text = (gzip.decompress(raw) if m.name.endswith(".gz") else raw).decode()
            own = stems.get(m.name.rsplit("/", 1)[-1].split(".cdx")[0]) or (next(iter(files)) if len(files) == 1 else None)
            for name, offset, length in index_entries(text):
                name = name.rsplit("/", 1)[-1] if name else own
                if name in files:
                    found.setdefault(name, []).append((offset, length))
    for name, m in files.items():
        at, packed = content_at(f, m), name.endswith(".gz")
        if name not in found:
            yield at, m.size, -1, packed
            continue
        start = size = n = 0
        for offset, length in sorted(set(found[name])):
            if n and (size + length > limit or start + size != offset):
                yield at + start, size, n, packed
                size = n = 0
            if not n:
                start = offset
            size, n = size + length, n + 1
        if n:
            yield at + start, size, n, packed


#: Kinds of records that have a payload or stand for one; others are passed over.
KINDS = ("response", "revisit", "resource")


def parse_record(raw: bytes) -> dict | None:
    """The fields of a record, or null for one of another kind than KINDS.

    The payload is what follows the HTTP header, or the block where there is none.  A digest that isn't given is computed; a SHA-1
    that is given must hold.  Names lose the scheme and brackets that this module's writer gives them.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = [x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x]
    fields = {k.strip().lower(): v.strip() for k, v in lines}
    kind = fields.get("warc-type")
    if kind not in KINDS:
        return None
    block = rest[: int(fields.get("content-length", len(rest)))]
    if block.startswith(b"HTTP/"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next((int(v) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:") and (v := x.split(b":", 1)[1].strip()).isdigit()), None)
    else:
        payload, length = block, None
    name = lambda v: None if v is None else v.removeprefix("<").removeprefix("urn:page:").removesuffix(">")
    given = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    whole = kind != "revisit"
    if whole and (given is None or len(given) == 32) and (found := digest(payload)) != given:
        if given is not None:
            raise ValueError(f"the payload of {fields.get('warc-record-id')} isn't what its digest says")
        given = found
    return {"record_id": name(fields.get("warc-record-id")) or None, "record_type": kind, "url": fields.get("warc-target-uri"), "payload_digest": given, "payload_bytes": len(payload) if whole else length, "refers_to": name(fields.get("warc-refers-to")), "payload": payload if whole else None}


def split_gzip(blocks: Iterable[bytes]) -> Iterator[bytes]:
    """The contents of gzip members that follow each other, from blocks of their bytes; each byte is looked at once or, at the end of
    a member, twice.
    """
    d, parts = None, []
    for block in blocks:
        for at in range(0, len(block), _FEED):
            data = block[at : at + _FEED]
            while data:
                if d is None:
                    d = zlib.decompressobj(31)
                parts.append(d.decompress(data))
                data = d.unused_data
                if d.eof:
                    yield b"".join(parts)
                    d, parts = None, []
    if d is not None:
        raise ValueError("a gzip member is cut short")


def split_plain(blocks: Iterable[bytes]) -> Iterator[bytes]:
    """Records that stand uncompressed behind each other, by their lengths."""
    held = bytearray()
    need = None
    for block in blocks:
        held += block
        while True:
            if need is None:
                while held[:2] == b"\r\n":
                    del held[:2]
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                size = next((int(x.split(b":", 1)[1]) for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                need = end + 4 + size
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if bytes(held).strip():
        raise ValueError("a record is cut short")


def _blocks(f, at: int, size: int) -> Iterator[bytes]:
    f.seek(at)
    while size:
        data = f.read(min(size, RANGE_BYTES))
        if not data:
            raise ValueError("an archive ends before its records do")
        size -= len(data)
        yield data


_FIELDS = {"record_id": pa.string(), "record_type": pa.string(), "url": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.string(), "payload": pa.binary()}


def read_archives(archives: DataFrame, *, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """archives: path, a URI; null paths are passed over, and a path that comes twice is read twice.  A row per record of KINDS;
    payload is null for revisits, and left out without `payloads`.
    """
    spark = archives.sparkSession

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = _open_fs(path)
                with fs.open_input_file(name) as f:
                    found = list(ranges(f, range_bytes))
                columns = list(zip(*found, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[3], pa.bool_())], names=["path", "at", "size", "packed"])

    names = [n for n in _FIELDS if payloads or n != "payload"]

    def rows_of(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for raw in records:
            if (row := parse_record(raw)) is not None:
                held += len(raw) if payloads else 256
                rows.append([row[n] for n in names])
            if held > RANGE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _FIELDS[n]) for k, n in enumerate(names)], names=names)
                rows, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _FIELDS[n]) for k, n in enumerate(names)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, size, packed in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "size", "packed")), strict=True):
                fs, name = _open_fs(path)
                with fs.open_input_file(name) as f:
                    yield from rows_of((split_gzip if packed else split_plain)(_blocks(f, at, size)))
                tk.give_back()

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    located = archives.where("path is not null").select("path").mapInArrow(locate, "path string, at long, size long, packed boolean").repartition(tasks)
    schema = "record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers_to string" + ", payload binary" * payloads
    return located.mapInArrow(read, schema)


def op5_zip_ranges(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    written = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = read_archives(written, payloads=False)
    return found.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
