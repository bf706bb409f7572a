import base64
import hashlib
import io

import pytest
import zstandard

from loam.llm import warc

KIND = "page_id long, url string, html string, payload string, file string"


def rows(*pages):
    return [(i, u, h, "p", "f") for i, u, h in pages]


def test_round_trip_and_revisits(spark, tmp_path):
    html = "<p>é✓</p>" * 50
    pages = spark.createDataFrame(rows((5, "http://a/", html), (2, "http://b/\r\nX: y", html), (9, None, html), (1, "http://c", None), (4, "u", ""), (None, "n", html), (7, "big", "x" * 2_000_000), (2, "again", html)), KIND)
    files = warc.write(pages, f"file://{tmp_path}/a", file_bytes=1 << 20)
    got = warc.read(files).collect()
    assert len(got) == 8
    by = {}
    for x in got:
        by.setdefault(x.page_id, []).append(x)
    assert {x.record_type for x in by[2]} == {"response"} and by[5][0].refers_to == by[9][0].refers_to == by[None][0].refers_to == 2
    assert by[4][0].record_type == "revisit" and by[4][0].refers_to == 1 and by[1][0].payload_bytes == 0
    assert bytes(by[7][0].payload) == b"x" * 2_000_000
    d = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert by[5][0].payload_digest == d and by[5][0].payload_bytes == len(html.encode())
    large = warc.archive(pages, f"file://{tmp_path}/b", min_bytes=10)
    assert large.where("page_id = 4").first().record_type == "response" and large.where("page_id = 5").first().record_type == "revisit"


def test_every_record_reads_by_its_frame(spark, tmp_path):
    pages = spark.createDataFrame(rows(*[(i, f"http://h/{i}", f"<html>page {i} " + "same words " * 40) for i in range(300)]), KIND).coalesce(1)
    f = warc.write(pages, f"file://{tmp_path}/c").first()
    data = open(f.file.removeprefix("file://"), "rb").read()
    assert len(data) == f.bytes and data[:4] == (0x184D2A5D).to_bytes(4, "little")
    n = int.from_bytes(data[4:8], "little")
    dict_bytes = zstandard.ZstdDecompressor().decompress(data[8 : 8 + n])
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dict_bytes))
    o = d.decompressobj()
    first = o.decompress(data[8 + n :])
    assert warc.parse(first)[0]["WARC-Type"] == "warcinfo"
    assert warc.parse(d.decompressobj().decompress(o.unused_data))[0]["WARC-Type"] == "response"
    assert f.bytes < sum(len(zstandard.compress(warc.record(i, f"http://h/{i}", b"<html>" + b"same words " * 40, "", None))) for i in range(300))


def test_what_lost_attempts_leave_is_deleted(spark, tmp_path):
    pages = spark.createDataFrame(rows((1, "u", "a"), (1, "u", "a")), KIND)
    first = warc.write(pages, f"file://{tmp_path}/d")
    second = warc.write(pages, f"file://{tmp_path}/d")
    names = {x.file for x in first.union(second).collect()}
    assert {f"file://{p}" for p in (tmp_path / "d").glob("*.zst")} == names
    mark = first.first().file.rpartition("/")[2].split("-")[1]
    (tmp_path / "d" / f"part-{mark}-000000-999-0000.warc.zst").write_bytes(b"half")
    warc._tidy(first, f"file://{tmp_path}/d", mark)
    assert {f"file://{p}" for p in (tmp_path / "d").glob("*.zst")} == names
    ids = [warc.parse(raw)[0]["WARC-Record-ID"] for f in names for raw in warc.read_file(open(f.removeprefix("file://"), "rb"))]
    assert len(set(ids)) == len(ids)


def test_broken_files_are_noticed(tmp_path):
    out = io.BytesIO()
    warc.write_file(out, iter([warc.record(1, "u", b"abc", warc.base32_sha1(b"abc"), None)]), b"x" * 64)
    raw = out.getvalue()
    assert len(list(warc.read_file(io.BytesIO(raw)))) == 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_file(io.BytesIO(raw[:-3])))
    with pytest.raises(ValueError):
        list(warc.read_file(io.BytesIO(b"\0" * 20)))
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", "x", None).replace(b"abc", b"abd"))


def test_empty(spark, tmp_path):
    assert warc.archive(spark.createDataFrame([], KIND), f"file://{tmp_path}/e").count() == 0
