"""WARC/1.1 archives compressed per record with a Zstandard dictionary that leads the file in a skippable frame.

A file is: one skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a Zstandard frame; one warcinfo
record; then records, each a frame of its own made with the dictionary, so that any record can be read by its offset.
The dictionary is built from archived records: of a bounded sample (``SAMPLE_BYTES``), the pages with the least hash, up to
64 Ki characters of each; so one huge page does not fill the sample.  The archive itself holds all pages whole.

Of records with equal payloads (SHA-1) of at least ``min_bytes``, the one with the least page_id is a response and the
others revisit it.

A task's files bear its attempt's number and are never renamed or overwritten.  What write() returns lists the files of the
attempts that were committed; only those are read, and what lost or repeated attempts have left behind is deleted.

Defined results.  Null html: empty payload.  Null url: ``urn:page:<id>``.  Null page_id: after all others; rows that
share the least id of a payload are all responses.  Repeated rows: a record each, with an identifier of its own.  Very long
pages are written whole.  Page ids may have any type that casts to text and back; order among them is their type's.  Columns other than page_id, url and html are not looked at.  Empty input: no file, no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import vectext as V
from loam.llm.common import cut, freed, fresh_dir, hinted, id_type, small_batches

MAGIC = 0x184D2A5D
SAMPLE_BYTES = 8 << 20
DICT_BYTES = 112 << 10
FILE_BYTES = 256 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _line(x: str) -> str:
    """A header value: line ends would end the field."""
    return x.replace("\r", "%0D").replace("\n", "%0A")


def _id(x: int | str) -> str:
    """An id as a header value that unquote() gives back."""
    return quote(str(x), safe=" !#$&'()*+,/:;=?@[]")


def record(page_id: int | str | None, url: str | None, payload: bytes, digest: str, original: tuple[int | str, str | None] | None, date: str = DATE, place: str = "") -> bytes:
    """A response record, or a revisit of the page ``original`` (id, url), whose block is the HTTP header alone.  place:
    what tells the record from all others of an archive."""
    uri = _line(url) if url is not None else "urn:page:None" if page_id is None else f"urn:page:{_id(page_id)}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if original else http + payload
    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"{place}\x01{page_id}\x01{uri}\x01{digest}")
    fields = [("WARC-Type", "revisit" if original else "response"), ("WARC-Record-ID", f"<urn:uuid:{rid}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    if page_id is not None:
        fields.append(("X-Page-Id", _id(page_id)))
    fields.append(("X-Payload-Length", str(len(payload))))
    if original:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", _line(original[1]) if original[1] is not None else f"urn:page:{_id(original[0])}"), ("X-Refers-To-Page-Id", _id(original[0]))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record; raises ValueError if it is not whole."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    block = raw[end + 4 : end + 4 + n]
    if len(block) != n or raw[end + 4 + n :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("broken record")
    return fields, block


def dictionary(sample: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A Zstandard dictionary of sample records; raw content where there are too few to train on."""
    total = sum(map(len, sample))
    try:
        return zstandard.train_dictionary(min(size, max(total // 10, 1024)), sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(sample)[: size // 4].ljust(8, b"\n")


def write_file(out: io.RawIOBase, records: Iterator[bytes], dict_bytes: bytes, level: int = LEVEL) -> tuple[int, int]:
    """Writes the dictionary's frame and the records; returns records and bytes written."""
    packed = zstandard.ZstdCompressor(level=19).compress(dict_bytes)
    out.write(struct.pack("<II", MAGIC, len(packed)) + packed)
    size, n = 8 + len(packed), 0
    c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dict_bytes), write_content_size=True, write_checksum=True)
    for r in records:
        frame = c.compress(r)
        out.write(frame)
        size, n = size + len(frame), n + 1
    return n, size


def read_file(src: io.RawIOBase, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of a file, one at a time; memory holds a chunk and a record."""
    magic, n = struct.unpack("<II", src.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    dict_bytes = zstandard.ZstdDecompressor().decompress(src.read(n))
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dict_bytes))
    held, obj, parts = b"", None, []
    while True:
        if not held:
            held = src.read(chunk)
            if not held:
                break
        if obj is None:
            obj, parts = d.decompressobj(), []
        parts.append(obj.decompress(held))
        held = obj.unused_data if obj.eof else b""
        if obj.eof:
            yield b"".join(parts)
            obj = None
    if obj is not None:
        raise ValueError("truncated file")


def _sample(pages: DataFrame, sample_bytes: int) -> list[bytes]:
    """Records of pages with the least hashes whose payloads sum to about sample_bytes."""
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    h = F.shiftrightunsigned(F.xxhash64("page_id", "url"), 40)
    total = pages.agg(F.sum(size), F.count("*")).first()
    share = 1.0 if not total[0] else min(1.0, sample_bytes / total[0])
    few = pages.where(h < int(share * (1 << 24)) + 1).select("page_id", "url", F.substring("html", 1, 1 << 16).alias("html"), h.alias("h"))
    rows = few.orderBy("h", "page_id").limit(max(1, sample_bytes // 1024)).drop("h").collect()  # about sample_bytes
    return [record(r.page_id, r.url, (r.html or "").encode(), "", None) for r in rows]


def _decided(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload, digest (hex), original: null, or (page_id, url) of the response that the row revisits."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size"))
    slim = cut(rows.where(F.col("size") >= min_bytes).select("page_id", "url", "digest"), "warc-digests")
    # only digests that occur twice matter; a task's rows of a digest are reduced before they move
    same = slim.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("no"), "page_id", "url")).alias("o"), F.count("*").alias("n")).where("n > 1")
    same = cut(same.select(F.col("digest").alias("d"), F.col("o.page_id").alias("first_id"), F.col("o.url").alias("first_url")), "warc-originals")
    out = rows.join(hinted(same), (F.col("digest") == F.col("d")) & (F.col("size") >= min_bytes), "left")
    revisit = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")))
    return out.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("first_id").cast("string")).alias("first_id"), F.when(revisit, F.col("first_url")).alias("first_url"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, sample_bytes: int = SAMPLE_BYTES, dict_bytes: int = DICT_BYTES, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> DataFrame:
    """Archives pages (page_id, url, html) under path; returns (file, records, bytes) of what was written."""
    spark = pages.sparkSession
    small_batches(spark)
    mark = uuid.uuid4().hex[:12]  # of this call's files
    trained = spark.sparkContext.broadcast(dictionary(_sample(pages, sample_bytes), dict_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = pafs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        done: list[tuple[str, int, int]] = []
        used = 0

        def records() -> Iterator[bytes]:
            nth = 0
            for b in V.slices(batches, "payload"):
                for page, url, payload, revisit, first, first_url in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "payload", "revisit", "first_id", "first_url")], strict=True):
                    nth += 1
                    yield record(page, url, payload, base32_sha1(payload), (first, first_url) if revisit else None, place=f"{task}-{attempt}-{nth}")

        feed = records()
        ahead = next(feed, None)
        while ahead is not None:
            name = f"part-{mark}-{task:06d}-{attempt}-{len(done):04d}.warc.zst"
            used = 0

            def some(info=record_info(name)) -> Iterator[bytes]:
                nonlocal ahead, used
                yield info
                while ahead is not None and used < file_bytes:
                    used += len(ahead)
                    now, ahead = ahead, next(feed, None)
                    yield now

            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                n, size = write_file(out, some(), trained.value, level)
            done.append((f"{path}/{name}", n - 1, size))
        if done:
            f, n, s = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(n, pa.int64()), pa.array(s, pa.int64())], ["file", "records", "bytes"])

    files = cut(_decided(pages, min_bytes).mapInArrow(freed(run), "file string, records long, bytes long"), "warc-files")
    _tidy(files, path, mark)
    return files


def _tidy(files: DataFrame, path: str, mark: str) -> None:
    """Deletes archives of this call that are not in its manifest: what attempts that were not committed have written."""
    spark = files.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(p):
        good = {r.file.rpartition("/")[2] for r in files.select("file").toLocalIterator()}
        for f in store.listStatus(p):
            if f.getPath().getName().startswith(f"part-{mark}-") and f.getPath().getName() not in good:
                store.delete(f.getPath(), False)


def record_info(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


READ = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, file string, payload binary"


def read(files: DataFrame, payloads: bool = True, kind: str = "long") -> DataFrame:
    """Every record of the files (column file), ids as of type kind; each payload's digest is computed anew and must match its header's."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "payload"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
    keep = names if payloads else names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("file").to_pylist():
                store, at = pafs.FileSystem.from_uri(file)
                rows: list[tuple] = []
                size = 0
                with store.open_input_stream(at, compression=None) as src:
                    for raw in read_file(src):
                        f, block = parse(raw)
                        if f["WARC-Type"] == "warcinfo":
                            continue
                        body = block.partition(b"\r\n\r\n")[2] if f["WARC-Type"] == "response" else None
                        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        if body is not None and (base32_sha1(body) != digest or len(body) != int(f["X-Payload-Length"])):
                            raise ValueError(f"{file}: payload differs from its digest")
                        rows.append((unquote(f["X-Page-Id"]) if "X-Page-Id" in f else None, f["WARC-Target-URI"], int(f["X-Payload-Length"]), digest, f["WARC-Type"], unquote(f["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in f else None, file, body if payloads else None))
                        size += len(body or b"")
                        if len(rows) >= 4096 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(zip(*rows, strict=True), kinds, keep, strict=False)], keep)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(zip(*rows, strict=True), kinds, keep, strict=False)], keep)

    n = max(1, files.count())
    schema = READ if payloads else READ.rpartition(", ")[0]
    out = files.select("file").repartition(n).mapInArrow(freed(run), schema)
    return out.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def archive(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes pages and reads the archives back, without payloads."""
    path = path or fresh_dir(pages.sparkSession, "warc")
    return read(write(pages, path, **options), payloads=False, kind=id_type(pages, "page_id"))
