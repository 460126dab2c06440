"""Web archives in ZIP packages: written, and read by range without extraction.

A package is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz``, WARC 1.1 records with a gzip
member for each, and ``indexes/index.cdxj``, a line for each record with its place.  The reader parses the end record,
the ZIP64 end record where there is one, and the central directory; finds a member's first byte from its local header;
reads the index; and then each record by its range.

Of records with equal payloads of at least ``least`` bytes, the one with the largest id is a response and the others
revisit it: they carry the digest and the length of the full payload, and no body.

Defined cases: null html is an empty payload, null urls are empty; rows that share an id have a record each, and refer
to ids; a null id is written as none, and never chosen before an id; an empty table makes no package; other columns are
ignored.  A task that runs again replaces its package as a whole.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, partitions, staged, text_bytes

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Fixed values of the ZIP format: signatures, and the marks of values that stand in ZIP64 fields.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF

# ---------------------------------------------------------------- writing


class PackageWriter:
    """Writes a package as a stream: nothing but the index is held. ``zip64`` forces the long forms."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.open_member, self.zip64 = out, 0, [], None, zip64

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """Starts a stored member whose size isn't known: a data descriptor with 8-byte sizes follows it."""
        raw = name.encode()
        self.open_member = {"name": raw, "header": self.at, "crc": 0, "size": 0}
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._write(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x0808, 0, 0, 0x21, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)
        self.open_member["start"] = self.at

    def add(self, data: bytes) -> int:
        """Adds to the open member; gives the place within it."""
        m = self.open_member
        place = m["size"]
        m["crc"] = zlib.crc32(data, m["crc"])
        m["size"] += len(data)
        self._write(data)
        return place

    def end(self) -> None:
        m = self.open_member
        self._write(b"PK\x07\x08" + struct.pack("<IQQ", m["crc"], m["size"], m["size"]))
        self.members.append(m)

    def close(self) -> None:
        start = self.at
        for m in self.members:
            long_size, long_at = self.zip64 or m["size"] >= FULL32, self.zip64 or m["header"] >= FULL32
            extra = (struct.pack("<QQ", m["size"], m["size"]) if long_size else b"") + (struct.pack("<Q", m["header"]) if long_at else b"")
            extra = struct.pack("<HH", 1, len(extra)) + extra if extra else b""
            size, at = (FULL32 if long_size else m["size"]), (FULL32 if long_at else m["header"])
            self._write(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x0808, 0, 0, 0x21, m["crc"], size, size, len(m["name"]), len(extra), 0, 0, 0, 0, at) + m["name"] + extra)
        size, n = self.at - start, len(self.members)
        if self.zip64 or start >= FULL32 or n >= FULL16:
            end64 = self.at
            self._write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
            self._write(LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
            n, size, start = min(n, FULL16) if not self.zip64 else FULL16, FULL32, FULL32
        self._write(END + struct.pack("<HHHHIIH", 0, 0, n, n, size, start, 0))


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """A WARC record as a gzip member, and its type. A record without ``refers_to`` is a response."""
    kind = "response" if refers_to is None else "revisit"
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url) or "about:blank",
        "WARC-Payload-Digest": f"sha1:{hashlib.sha1(payload).hexdigest()}",
        "WARC-Payload-Length": str(len(payload)),
        "WARC-Page-ID": "" if page_id is None else str(page_id),
    }
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    body = http + (payload if refers_to is None else b"")
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Page-ID": str(refers_to)}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(body))}
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush(), kind


# ---------------------------------------------------------------- reading


@dataclass(frozen=True)
class Member:
    """A stored member: where its bytes begin in the package, and how many they are."""

    name: str
    start: int
    size: int
    crc: int


def members(f, size: int) -> dict[str, Member]:
    """The stored members of a ZIP file, from its directories; ``f`` has ``read_at(bytes, place)``. A few small reads."""
    tail_at = max(0, size - (1 << 16) - 22 - 20)
    tail = f.read_at(size - tail_at, tail_at)
    end = tail.rfind(END, 0, max(0, len(tail) - 18))
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):  # its comment ends the file
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("not a ZIP file: no end record")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if n == FULL16 or FULL32 in (length, start):
        if end < 20 or tail[end - 20 : end - 16] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        at = struct.unpack_from("<Q", tail, end - 12)[0]
        record64 = f.read_at(56, at)
        if record64[:4] != END64:
            raise ValueError("no ZIP64 end record")
        n, length, start = struct.unpack_from("<QQQ", record64, 32)
    directory, at, out = f.read_at(length, start), 0, {}
    for _ in range(n):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        crc, packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", directory, at + 16)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        at += 46 + n_name + n_extra + n_comment
        plain, packed, header = _zip64_fields(extra, plain, packed, header)
        if method != 0 or flags & 1:
            continue  # compressed or encrypted: not to be read by range
        local = f.read_at(30, header)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        skip = sum(struct.unpack_from("<HH", local, 26))
        out[name] = Member(name, header + 30 + skip, plain, crc)
    return out


def _zip64_fields(extra: bytes, *values: int) -> list[int]:
    """Values of all ones stand, in order, in the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            fields, out = extra[at + 4 : at + 4 + n], []
            for v in values:
                if v == FULL32:
                    v, fields = struct.unpack_from("<Q", fields)[0], fields[8:]
                out.append(v)
            return out
        at += 4 + n
    return list(values)


class Package:
    """A package open for reading by range."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self._f = fs.open_input_file(name)
        self.members = members(self._f, self._f.size())

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self._f.close()

    def read(self, member: str, start: int = 0, length: int | None = None) -> bytes:
        m = self.members[member]
        length = m.size - start if length is None else length
        if start < 0 or start + length > m.size:
            raise ValueError(f"{member} has no bytes {start} to {start + length}")
        return self._f.read_at(length, m.start + start)

    def index(self, block: int = 1 << 20) -> Iterator[dict]:
        """The index's lines, read a block at a time."""
        rest, at, size = b"", 0, self.members[INDEX].size
        while at < size:
            n = min(block, size - at)
            *lines, rest = (rest + self.read(INDEX, at, n)).split(b"\n")
            at += n
            yield from map(json.loads, lines)
        if rest:
            yield json.loads(rest)

    def record(self, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        """Headers and payload of the record at a range of the data member."""
        raw = zlib.decompress(self.read(DATA, offset, length), 31)
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {offset}")
        headers = dict(x.split(": ", 1) for x in lines)
        body = rest[: int(headers["Content-Length"])]
        return headers, body.partition(b"\r\n\r\n")[2]


# ---------------------------------------------------------------- Spark


def decided(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id, url, payload, refers_to``: which pages revisit which.

    Only digests are grouped, added up before they move; payloads move once, to their decision.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), text_bytes("html").alias("payload"))
    digests = p.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").alias("n")).filter(F.col("n") >= least)
    twice = digests.groupBy("digest", "n").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("k")).filter("k > 1 AND last IS NOT NULL")
    revisits = digests.join(twice, ["digest", "n"]).filter("page_id IS NULL OR page_id <> last").select("page_id", "digest", F.col("last").alias("refers_to")).distinct()
    return p.join(revisits.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "refers_to"), F.col("page_id").eqNullSafe(F.col("_p")) & (F.sha1("payload") == F.col("_d")), "left").select("page_id", "url", "payload", "refers_to")


def write_packages(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = 1000, zip64: bool = False) -> DataFrame:
    """Writes a package for each task; gives ``part, path, records, bytes``."""
    folder = folder or new_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}.wacz"
        fs, name = pafs.FileSystem.from_uri(path)
        out, lines = None, []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    tmp = f"{name}.{uuid.uuid4().hex}.part"
                    out = fs.open_output_stream(tmp)
                    package = PackageWriter(out, zip64)
                    package.begin(DATA)
                data, kind = record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py())
                lines.append(json.dumps({"page_id": page_id.as_py(), "type": kind, "offset": package.add(data), "length": len(data)}))
        if out is None:
            return
        package.end()
        package.begin(INDEX)
        for at in range(0, len(lines), 10_000):
            package.add(("\n".join(lines[at : at + 10_000]) + "\n").encode())
        package.end()
        package.close()
        out.close()
        fs.move(tmp, name)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path]), pa.array([len(lines)], pa.int64()), pa.array([package.at], pa.int64())], names=["part", "path", "records", "bytes"])

    return staged(spark, decided(pages, least).mapInArrow(write, "part long, path string, records long, bytes long"), "packages")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_packages(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """What the packages' records say, each read by its range; responses' digests and lengths are checked against their payloads."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with Package(path) as package:
                    for line in package.index():
                        head, payload = package.record(line["offset"], line["length"])
                        digest, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Payload-Length"])
                        if head["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"a record of {path} is damaged")
                        page, to = head.get("WARC-Page-ID", ""), head.get("WARC-Refers-To-Page-ID")
                        rows.append((int(page) if page else None, n, digest, head["WARC-Type"], int(to) if to else None))
                        if len(rows) == 10_000:
                            yield _records(rows)
                            rows = []
                yield _records(rows)

    return manifest.select("path").repartition(max(partitions(spark), 1), "path").mapInArrow(read, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
