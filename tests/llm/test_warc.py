"""ZIP packages read by the standard library, records, revisits, ZIP64."""

import hashlib
import io
import zipfile
import zlib

import pytest

from folioscope.llm import warc


class Reads(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


@pytest.mark.parametrize("zip64", [False, True])
def test_package_is_a_zip(zip64):
    out = io.BytesIO()
    w = warc.PackageWriter(out, zip64)
    for name, parts in (("a/b.txt", [b"one", b"two"]), ("é.bin", [b"PK\x05\x06" * 9]), ("empty", [])):
        w.begin(name)
        assert [w.add(p) for p in parts] == [sum(map(len, parts[:i])) for i in range(len(parts))]
        w.end()
    w.close()
    data = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.read("a/b.txt") == b"onetwo"
    got = warc.members(Reads(data), len(data))
    assert {n: data[m.start : m.start + m.size] for n, m in got.items()} == {"a/b.txt": b"onetwo", "é.bin": b"PK\x05\x06" * 9, "empty": b""}
    assert all(zlib.crc32(data[m.start : m.start + m.size]) == m.crc for m in got.values())


def test_reads_others_zip_files():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("stored", b"abc")
        z.writestr("packed", b"x" * 999, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment, with PK\x05\x06 in it"
    data = out.getvalue()
    got = warc.members(Reads(data), len(data))
    assert list(got) == ["stored"] and data[got["stored"].start :][:3] == b"abc"
    with pytest.raises(ValueError):
        warc.members(Reads(b"no zip" * 9), 54)


@pytest.mark.parametrize("zip64", [False, True])
def test_pages(spark, zip64):
    big, other = "é" * 600, "x" * 1000
    rows = [(1, "http://a/ä\n", big), (2, None, big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", other), (8, "u", "x" * 999), (9, "u", "x" * 999), (None, "u", other)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 payload", "2 offset")
    manifest = warc.write_packages(spark, df.repartition(3), zip64=zip64)
    got = {r.page_id: r for r in warc.read_packages(spark, manifest).collect()}
    assert len(got) == len(rows) and sum(r.records for r in manifest.collect()) == len(rows)
    for page, _, html in rows:
        raw = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {p: (r.record_type, r.refers_to) for p, r in got.items() if r.record_type == "revisit"} == {1: ("revisit", 3), 2: ("revisit", 3), None: ("revisit", 7)}
    assert warc.read_packages(spark, warc.write_packages(spark, df.limit(0))).isEmpty()
    with warc.Package(manifest.first().path) as package:
        line = next(package.index())
        head, payload = package.record(line["offset"], line["length"])
        assert head["WARC-Type"] == line["type"] and (line["type"] == "revisit") == (not payload and head["WARC-Payload-Length"] != "0")
