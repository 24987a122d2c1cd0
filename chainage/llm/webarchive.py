"""Web archives packaged in ZIP files: written by map tasks, read by byte ranges.

A package holds `archive/data.warc.gz` (one gzip member per WARC record),
`indexes/index.cdxj` (one line per record: the url's sort key, time, and as JSON the record's offset
and length in that member, its digest, type and page) and `datapackage.json`, all stored
without ZIP compression, so that a record is a byte range of the package.

The reader opens a package at its end, follows the end record (and its ZIP64 locator and
record, where there is one) to the central directory, finds the stored members, reads
the index and then single records by range. Nothing is extracted.

Packages are opened through pyarrow's file systems, so they can lie on any of those
(local or shared disks, object stores, HDFS). A task writes under a name of its own
attempt, and only names that reach the job's result are read again: a lost executor
leaves at most an orphan file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATA, INDEX, MANIFEST = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: A package is closed when its data exceed this.
PACKAGE_BYTES = 64 << 20
_TAIL = 22 + (1 << 16) + 20
_DATE, _STAMP = "2024-01-01T00:00:00Z", "20240101000000"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI as Spark writes it."""
    if uri.startswith("file:") or ":/" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)


class Member(NamedTuple):
    name: str
    method: int
    size: int  # bytes in the package
    header: int  # where its local header starts


class Package:
    """Random access to the stored members of a ZIP file of any size."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.members = {m.name: m for m in self._directory()}
        self._data: dict[str, int] = {}

    def read_at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        out = self.file.read(length)
        if len(out) != length:
            raise ValueError(f"package ends at {offset + len(out)}, not {offset + length}")
        return out

    def _directory(self) -> Iterator[Member]:
        tail = self.read_at(max(0, self.size - _TAIL), min(self.size, _TAIL))
        at = len(tail)
        while True:
            at = tail.rfind(b"PK\5\6", 0, at)
            if at < 0:
                raise ValueError("no end record: not a ZIP file")
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break  # a signature inside the comment doesn't reach the file's end exactly
        entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
        locator = at - 20
        if 0xFFFF == entries or 0xFFFFFFFF in (length, offset):
            if locator < 0 or tail[locator : locator + 4] != b"PK\6\7":
                raise ValueError("ZIP64 locator is missing")
            (where,) = struct.unpack_from("<Q", tail, locator + 8)
            record = self.read_at(where, 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("ZIP64 end record is missing")
            entries, length, offset = struct.unpack_from("<QQQ", record, 32)
        directory, p = self.read_at(offset, length), 0
        for _ in range(entries):
            if directory[p : p + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", directory, p + 8)
            size, full, n, x, c = struct.unpack_from("<IIHHH", directory, p + 20)
            (header,) = struct.unpack_from("<I", directory, p + 42)
            name = directory[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = directory[p + 46 + n : p + 46 + n + x], 0
            while e + 4 <= len(extra):
                kind, k = struct.unpack_from("<HH", extra, e)
                if kind == 1:  # 64-bit values, each only where the 32-bit field is full
                    wide = list(struct.unpack_from(f"<{k // 8}Q", extra, e + 4))
                    full = wide.pop(0) if full == 0xFFFFFFFF else full
                    size = wide.pop(0) if size == 0xFFFFFFFF else size
                    header = wide.pop(0) if header == 0xFFFFFFFF else header
                e += 4 + k
            yield Member(name, method, size, header)
            p += 46 + n + x + c

    def start(self, name: str) -> int:
        """Where a stored member's bytes start."""
        if name not in self._data:
            m = self.members[name]
            if m.method:
                raise ValueError(f"{name} is compressed, not stored")
            head = self.read_at(m.header, 30)
            if head[:4] != b"PK\3\4":
                raise ValueError(f"{name} has no local header")
            n, x = struct.unpack_from("<HH", head, 26)
            self._data[name] = m.header + 30 + n + x
        return self._data[name]

    def range(self, name: str, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.members[name].size:
            raise ValueError(f"range is outside {name}")
        return self.read_at(self.start(name) + offset, length)

    def member(self, name: str) -> bytes:
        return self.range(name, 0, self.members[name].size)


class Writer:
    """Writes a package of stored members to a stream; sizes that don't fit 32 bits use ZIP64."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.done, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """Sizes follow the data (flag 8), since the stream can't go back."""
        self.name, self.header, self.crc, self.size = name.encode(), self.at, 0, 0
        self._put(struct.pack("<4s5HIIIHH", b"PK\3\4", 45, 0x808, 0, 0, 0x5821, 0, 0, 0, len(self.name), 0) + self.name)

    def write(self, data: bytes) -> None:
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        self._put(data)

    def end(self) -> None:
        wide = self.zip64 or self.size >= 0xFFFFFFFF
        self._put(struct.pack("<4sIQQ" if wide else "<4sIII", b"PK\7\10", self.crc, self.size, self.size))
        self.done.append((self.name, self.header, self.crc, self.size))

    def close(self) -> None:
        start = self.at
        for name, header, crc, size in self.done:
            wide = self.zip64 or size >= 0xFFFFFFFF or header >= 0xFFFFFFFF
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header) if wide else b""
            s, h = (0xFFFFFFFF, 0xFFFFFFFF) if wide else (size, header)
            self._put(struct.pack("<4s6H3I5HII", b"PK\1\2", 45, 45, 0x808, 0, 0, 0x5821, crc, s, s, len(name), len(extra), 0, 0, 0, 0, h) + name + extra)
        length, n = self.at - start, len(self.done)
        if self.zip64 or start >= 0xFFFFFFFF:
            where = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, length, start))
            self._put(struct.pack("<4sIQI", b"PK\6\7", 0, where, 1))
            n, length, start = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
        self._put(struct.pack("<4s4HIIH", b"PK\5\6", 0, 0, n, n, length, start, 0))
        self.out.close()


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def sort_key(url: str) -> str:
    """A url's key in the index, host parts turned round (com,example)/path), blanks and braces escaped, so that a line's fields end at blanks."""
    plain = re.sub(r"[\x00-\x20\x7f\"{}|\\^`]|\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), url.strip())
    found = re.match(r"(?i)https?://(?:[^/@?#]*@)?([^/:?#]+)(?::(\d+))?(.*)", plain, re.S)
    if not found:
        return plain or "-"
    host, port, rest = found.groups()
    parts = ",".join(reversed(host.lower().removeprefix("www.").split(".")))
    return f"{parts}{f':{port}' if port and port not in ('80', '443') else ''}){rest or '/'}"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC 1.1 record: a response with its payload, or a revisit without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {''.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Bytes: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Date: {_DATE}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record; checks its lengths."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) < n or rest[n:] != b"\r\n\r\n":
        raise ValueError("record length doesn't agree with its header")
    return headers, rest[:n].partition(b"\r\n\r\n")[2]


def resolved(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with digest (SHA-1 of the payload, hex) and refers_to.

    The largest page_id of equal payloads is found by a map-side combined maximum over
    (digest, page_id); only revisits are joined back to the pages, by their page_id.
    A payload is known by its SHA-256, its length and its SHA-1.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    keyed = rows.where(F.octet_length("html") >= least_bytes).where("page_id is not null").select("page_id", F.sha2("html", 256).alias("key"))
    last = keyed.groupBy("key").agg(F.max("page_id").alias("refers_to"))
    revisits = keyed.join(last, "key").where("page_id <> refers_to").select("page_id", "key", "refers_to").distinct()
    joined = rows.withColumn("key", F.sha2("html", 256)).join(revisits, ["page_id", "key"], "left")
    return joined.select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, folder: str, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes packages under folder; (package, records) of each. Evaluate it once, and keep its rows: they are the archive's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, index, packages = None, "", [], []
        files, base = open_fs(folder)

        def close() -> None:
            nonlocal out
            out.end()
            for name, data in ((INDEX, "".join(sorted(index)).encode("utf-8", "surrogatepass")), (MANIFEST, json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())):
                out.begin(name)
                out.write(data)
                out.end()
            out.close()
            packages.append((path, len(index)))
            index.clear()
            out = None

        for b in batches:
            for page, url, html, refers in zip(*(b.column(i) for i in range(4)), strict=True):
                if out is None:
                    files.create_dir(base, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.wacz"
                    path = f"{folder}/{name}"
                    out = Writer(files.open_output_stream(f"{base}/{name}"))
                    out.begin(DATA)
                page, url, refers = page.as_py(), url.as_py(), refers.as_py()
                payload = html.as_py().encode("utf-8", "surrogatepass")
                digest = sha1_base32(payload)
                data = gzip.compress(record(page, url, payload, digest, refers), 1, mtime=0)
                entry = {"offset": out.size, "length": len(data), "digest": f"sha1:{digest}", "type": "response" if refers is None else "revisit", "page": page}
                index.append(f"{sort_key(url)} {_STAMP} {json.dumps(entry)}\n")
                out.write(data)
                if out.size >= package_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in packages], pa.string()), pa.array([n for _, n in packages], pa.int64())], names=["package", "records"])

    return resolved(pages, least_bytes).mapInArrow(run, "package string, records long")


def read(packages: DataFrame) -> DataFrame:
    """Records of packages (package): page_id, payload_bytes, payload_digest, record_type, refers_to, payload, package.

    Each package's index gives the ranges; a response's payload is measured and digested
    from its bytes, a revisit has those of its headers. payload is null for revisits.
    """
    fields = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, package string"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in fields.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                files, path = open_fs(uri)
                with files.open_input_file(path) as file:
                    package, rows, held = Package(file, file.size()), [], 0
                    for line in package.member(INDEX).decode("utf-8", "surrogatepass").splitlines():
                        entry = json.loads(line.split(" ", 2)[2])
                        headers, payload = parse_record(gzip.decompress(package.range(DATA, entry["offset"], entry["length"])))
                        revisit = headers["warc-type"] == "revisit"
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and sha1_base32(payload) != digest:
                            raise ValueError(f"{uri}: payload of page {headers['x-page-id']} doesn't have its digest")
                        page, refers = headers["x-page-id"], headers.get("x-refers-to-page")
                        n = int(headers["x-payload-bytes"]) if revisit else len(payload)
                        rows.append((int(page) if page else None, n, digest, headers["warc-type"], int(refers) if refers else None, None if revisit else payload, uri))
                        held += len(payload)
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return packages.select("package").mapInArrow(run, fields)


def round_trip(pages: DataFrame, folder: str, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write an archive of pages under folder and read its records back, without payloads.

    Defined edge cases: null html is an empty payload; null urls are empty; a null
    page_id is a response of its own; repeated rows are records of their own (of equal
    payloads all rows with the largest page_id are responses); an empty table gives an
    empty archive; other columns are ignored.
    """
    listing = f"{folder}/packages.parquet"
    write(pages, f"{folder}/wacz", least_bytes, package_bytes).write.mode("overwrite").parquet(listing)
    spark = pages.sparkSession
    listed = spark.read.parquet(listing)
    packages = listed.repartition(max(1, listed.count()), "package")
    return read(packages).drop("payload", "package")
