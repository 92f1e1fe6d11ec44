"""WARC records in ZIP packages: writing with duplicate payloads as revisits, and reading by ranges.

A package is a ZIP file whose members are stored, not compressed, so that every byte of a member has a known place:
`archive/records.warc.gz` (one gzip member per record) and `indexes/records.cdxj` (one line per record: place and
length within the archive). The reader parses the central directory itself, ZIP64 records included, finds where a
stored member's data begin, reads the index, and then fetches record by record by range. Nothing is extracted.

Which record is the response is settled before writing: pages are reduced to (page_id, digest, length), the smallest
page_id per digest is found with map-side minima, and only ids travel to the pages, by (page_id, digest), so that a
payload of which a third of all pages are copies never meets in one task.

Defined cases: null html is an empty payload; payloads under `least` bytes are all responses; repeated rows are each a
record, and those of the smallest page_id are all responses; a null page_id is never referred to unless a payload has
no other, in which case its records are responses; an empty table gives no package and an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import as_bytes, fresh_path, materialise, opened, pieces_of, table

LEAST = 100
RECORDS, INDEX = "archive/records.warc.gz", "indexes/records.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes after which a task begins another package.
PACKAGE_BYTES = 256 << 20
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


# -- writing


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC 1.1 record. A revisit has no payload; it names the record that has it."""
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{page}>" if page is not None else "<urn:page>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": (url or "urn:unknown").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha256:{digest}",
    }
    if refers_to is not None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if refers_to is None else b"")
    headers |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (names in lower case) and the block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(headers["content-length"])
    if len(rest) < length:
        raise ValueError("WARC record cut short")
    return headers, rest[:length]


class PackageWriter:
    """Writes one package to a stream that needn't be seekable."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.out = self.zip.open(RECORDS, "w", force_zip64=True)
        self.index, self.at, self.payload = io.BytesIO(), 0, 0

    def add(self, page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> None:
        member = gzip.compress(record(page, url, payload, digest, refers_to), 6, mtime=0)
        self.out.write(member)
        line = {"page_id": page, "offset": self.at, "length": len(member)}
        self.index.write(json.dumps(line).encode() + b"\n")
        self.at, self.payload = self.at + len(member), self.payload + len(payload)

    def close(self) -> None:
        self.out.close()
        self.zip.writestr(INDEX, self.index.getvalue())
        self.zip.close()


# -- reading


class Package:
    """The directory of a ZIP file that is read by ranges: file needs size() and read_at(n, offset)."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.members = {}
        entries, size, offset = self._end()
        directory = file.read_at(size, offset)
        at = 0
        for _ in range(entries):
            name, member, n = self._entry(directory, at)
            self.members[name] = member
            at += n

    def _end(self) -> tuple[int, int, int]:
        """(entries, bytes, offset) of the central directory."""
        n = min(self.size, 22 + 0xFFFF)
        tail = self.file.read_at(n, self.size - n)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != n:  # a comment may hold the signature
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no ZIP directory")
        entries, size, offset = struct.unpack_from("<HLL", tail, at + 10)
        if entries == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
            place = self.size - n + at - 20
            locator = self.file.read_at(20, place) if place >= 0 else b""
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            (where,) = struct.unpack_from("<Q", locator, 8)
            end = self.file.read_at(56, where)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 directory")
            entries, size, offset = struct.unpack_from("<QQQ", end, 32)
        return entries, size, offset

    @staticmethod
    def _entry(data: bytes, at: int) -> tuple[str, dict, int]:
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad ZIP directory entry")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, packed, size, n_name, n_extra, n_comment = struct.unpack_from("<LLLHHH", data, at + 16)
        (header,) = struct.unpack_from("<L", data, at + 42)
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        i = 0
        while i + 4 <= len(extra):  # the ZIP64 field holds, in this order, those values that overflow
            kind, n = struct.unpack_from("<HH", extra, i)
            if kind == 1:
                values = list(struct.unpack_from(f"<{n // 8}Q", extra, i + 4))
                if size == 0xFFFFFFFF:
                    size = values.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = values.pop(0)
                if header == 0xFFFFFFFF:
                    header = values.pop(0)
            i += 4 + n
        return name, {"method": method, "size": size, "packed": packed, "header": header, "crc": crc, "encrypted": bool(flags & 1)}, 46 + n_name + n_extra + n_comment

    def place(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member begin in the file, and their number."""
        m = self.members[name]
        if m["method"] != 0 or m["encrypted"]:
            raise ValueError(f"{name} isn't stored as it is")
        local = self.file.read_at(30, m["header"])
        if local[:4] != b"PK\x03\x04":
            raise ValueError("bad ZIP member header")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return m["header"] + 30 + n_name + n_extra, m["size"]

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """A range of a stored member."""
        begin, size = self.place(name)
        length = size - offset if length is None else length
        if offset < 0 or offset + length > size:
            raise ValueError("range outside of the member")
        return self.file.read_at(length, begin + offset)

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """Each record by its index line: one range read each."""
        begin, size = self.place(RECORDS)
        for line in self.read(INDEX).splitlines():
            entry = json.loads(line)
            if entry["offset"] + entry["length"] > size:
                raise ValueError("index points outside of the archive")
            yield parsed(zlib.decompress(self.file.read_at(entry["length"], begin + entry["offset"]), 31))


# -- the operator


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches, "html"):
        payloads = as_bytes(batch.column("html"))
        digests = pa.array((hashlib.sha256(p).digest() for p in payloads), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), digests, pa.array(map(len, payloads), pa.int64())], names=["page_id", "digest", "n"])


def page_rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"))


def writer(folder: str, package_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get(), 0

        def rows():
            for batch in pieces_of(batches, "html"):
                yield from zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), as_bytes(batch.column("html")), batch.column("refers_to").to_pylist(), strict=True)

        todo = rows()
        row = next(todo, None)
        while row is not None:
            path = f"{folder}/part-{task.partitionId():06d}-{made:04d}-{task.taskAttemptId()}.wacz"
            with opened(path, "w") as stream:
                out, n = PackageWriter(stream), 0
                while row is not None and out.payload < package_bytes:
                    page, url, payload, refers_to = row
                    out.add(page, url, payload, hashlib.sha256(payload).hexdigest(), refers_to)
                    n += 1
                    row = next(todo, None)
                out.close()
            made += 1
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_records"])

    return run


def write_packages(pages: DataFrame, least: int = LEAST, package_bytes: int = PACKAGE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages as packages in the shared folder; returns the manifest (path, n_records)."""
    spark = pages.sparkSession
    rows = page_rows(pages, id_col, url_col, html_col)
    keys = rows.mapInArrow(digest_rows, "page_id long, digest binary, n long")
    firsts = keys.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"))
    later = keys.where(F.col("n") >= least).join(firsts, "digest").where("page_id IS NOT NULL AND page_id <> first OR page_id IS NULL AND first IS NOT NULL")
    later = later.select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    digest = F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256))
    planned = rows.withColumn("digest", digest).join(later.toDF("id", "of", "refers_to"), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left")
    planned = planned.select("page_id", "url", "html", "refers_to")
    return materialise(planned.mapInArrow(writer(fresh_path(spark, "warc"), package_bytes), "path string, n_records long"), "warc-manifest")


def read_package(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def number(urn: str) -> int | None:
        return int(urn[len("<urn:page:") : -1]) if urn.startswith("<urn:page:") else None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    for batch in batches:
        for path in batch.column("path").to_pylist():
            with opened(path, "r") as file:
                rows = []
                for headers, block in Package(file).records():
                    kind, said = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(payload).hexdigest() != said:
                            raise ValueError("payload differs from its digest")
                        rows.append((number(headers["warc-record-id"]), len(payload), said, kind, None))
                    else:
                        rows.append((number(headers["warc-record-id"]), None, said, kind, number(headers["warc-refers-to"])))
                    if len(rows) == 10_000:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)


def read_packages(manifest: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to; revisits resolved to their response."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialise(manifest.select("path").repartition(n, "path").mapInArrow(read_package, READ), "warc-records")
    # the response that holds a payload is looked up by (digest, id), the digest telling apart rows of one repeated id
    held = found.where("record_type = 'response'").select(F.col("page_id").alias("at"), F.col("payload_digest").alias("of"), F.col("payload_bytes").alias("bytes")).distinct()
    joined = found.join(held, (F.col("refers_to") == F.col("at")) & (F.col("payload_digest") == F.col("of")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packages(write_packages(table(spark, sf_dir, "pages")))


OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
