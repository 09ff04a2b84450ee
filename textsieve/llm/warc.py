"""WARC records in ZIP-packaged archives: writer, and reader by byte ranges.

An archive is a ZIP file whose members are stored, not compressed anew:
``archive/data.warc.gz`` (one gzip member for each record), an index
``indexes/index.cdx`` with the place of every record, and a small
``datapackage.json``.  All sizes and places are written in ZIP64 form.

The reader parses the end record, the ZIP64 records and the central directory,
finds where a stored member's bytes begin, and reads the index and then single
records as byte ranges of the archive file; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.llm import kernels as K
from textsieve.scratch import Scratch

#: Bytes of records after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdx", "datapackage.json"
DATE = "2024-01-01T00:00:00Z"
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of the response of another page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    target = "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "urn:none")
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    block = http + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, digest, record type, refers_to) of a record; a response's digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(_fields(http)["content-length"])
    page = lambda x: int(x[10:-1]) if x and x.startswith("<urn:page:") else None
    if fields["warc-type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return page(fields["warc-record-id"]), size, digest, fields["warc-type"], page(fields.get("warc-refers-to"))


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def zip_archive(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP file of stored members, with ZIP64 sizes, offsets and end records."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, crc, offset = name.encode(), zlib.crc32(data), len(out)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 0, 0, 0x21, crc, _FULL32, _FULL32, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), offset)
        central += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 0x21, crc, _FULL32, _FULL32, len(raw), len(extra), 0, 0, 0, 0, _FULL32) + raw + extra
    start, n = len(out), len(members)
    out += central
    end64 = len(out)
    out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(central), start)
    out += struct.pack("<IIQI", 0x07064B50, 0, end64, 1)
    out += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, _FULL16, _FULL16, _FULL32, _FULL32, 0)
    return bytes(out)


class ZipReader:
    """Byte ranges of a ZIP file's stored members."""

    def __init__(self, file, size: int):
        self.file, self.members = file, {}
        tail_at = max(0, size - 65557)
        tail = self.read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
        if _FULL16 == n or _FULL32 in (length, start):
            sign, _, at, _ = struct.unpack("<IIQI", self.read(tail_at + end - 20, 20))
            if sign != 0x07064B50:
                raise ValueError("no ZIP64 locator")
            sign, *_, n, length, start = struct.unpack("<IQHHIIQQQQ", self.read(at, 56))
            if sign != 0x06064B50:
                raise ValueError("no ZIP64 end record")
        directory, at = self.read(start, length), 0
        for _ in range(n):
            sign, _, _, _, method, _, _, _, packed, plain, a, b, c, _, _, _, offset = struct.unpack("<IHHHHHHIIIHHHHHII", directory[at : at + 46])
            if sign != 0x02014B50:
                raise ValueError("damaged central directory")
            name, extra = directory[at + 46 : at + 46 + a].decode(), directory[at + 46 + a : at + 46 + a + b]
            while len(extra) >= 4:
                tag, size_ = struct.unpack("<HH", extra[:4])
                if tag == 1:  # values stand here, in this order, for those that are full
                    values = iter(struct.unpack(f"<{size_ // 8}Q", extra[4 : 4 + size_ // 8 * 8]))
                    plain, packed, offset = (next(values) if x == _FULL32 else x for x in (plain, packed, offset))
                extra = extra[4 + size_ :]
            self.members[name] = (method, offset, packed)
            at += 46 + a + b + c

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("the archive ends early")
        return data

    def place(self, name: str) -> tuple[int, int]:
        """(offset in the file, bytes) of a stored member."""
        method, offset, size = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        head = self.read(offset, 30)
        a, b = struct.unpack("<HH", head[26:30])
        return offset + 30 + a + b, size

    def records(self) -> Iterator[bytes]:
        """The records that the index names, each by a read of its range."""
        at, size = self.place(INDEX)
        data, _ = self.place(DATA)
        for line in self.read(at, size).splitlines():
            entry = json.loads(line)
            yield zlib.decompress(self.read(data + entry["offset"], entry["length"]), 31)


def _opened(uri: str):
    """File system and path of a URI: local, hdfs, s3, gs or another that Arrow knows."""
    return pafs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """(archive, records): writes rows (page_id, url, html, refers_to), one record each.

    An archive's name is new for each attempt of a task, and only those of the
    attempts that succeed are returned, so a lost executor leaves no record
    twice or half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index = bytearray(), []

        def close() -> pa.RecordBatch:
            body = "".join(json.dumps(x) + "\n" for x in index).encode()
            package = json.dumps({"profile": "data-package", "resources": [{"path": p, "bytes": len(b)} for p, b in ((DATA, data), (INDEX, body))]}).encode()
            uri = f"{root}/{uuid.uuid4().hex}.wacz"
            fs, path = _opened(uri)
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(zip_archive([(DATA, bytes(data)), (INDEX, body), (PACKAGE, package)]))
            n = len(index)
            data.clear()
            index.clear()
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], names=["archive", "records"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, refers_to = (c[i].as_py() for c in batch.columns)
                member = gzip_member(record(page_id, url, (html or "").encode("utf-8"), refers_to))
                index.append({"id": page_id, "offset": len(data), "length": len(member)})
                data += member
                if len(data) >= ARCHIVE_BYTES:
                    yield close()
        if index:
            yield close()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): a row for each record of rows (archive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = _opened(uri)
                with fs.open_input_file(path) as file:
                    rows = [parse_record(r) for r in ZipReader(file, file.size()).records()]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("archive").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` and read the archives back.

    Of records with equal payloads of at least ``least`` bytes the one with the
    least page_id is the response, the others revisit it; rows that repeat that
    page_id are responses too.  A null html is an empty payload; a null page_id
    names no response, so it revisits one if there is one; a null url becomes
    ``urn:none``.  An empty table gives no rows; only page_id, url and html are
    read.
    """
    spark: SparkSession = pages.sparkSession
    K.tune(spark)
    s = Scratch(spark, "warc")
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", text.alias("html"), F.sha1(text.cast("binary")).alias("digest"))
    same = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("same"), "first")
    linked = rows.join(same, F.col("digest") == F.col("same"), "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    written = s.save(write_archives(linked, s.path("archives")), "written")
    n = max(1, written.count())
    return read_archives(written.repartition(n, "archive"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over the whole table ``pages``."""
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
