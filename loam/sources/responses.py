"""Stored HTTP responses: raw bytes to status, headers and body; redirect chains over a table of responses.

There is no network here: what a crawler has stored is decoded and followed as tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.lineage import cut
from loam.sources.readers import url_parts

# Statuses that redirect, hops that are followed, and the largest body.
REDIRECTS, HOPS, MOST = (301, 302, 307, 308), 5, 10 << 20


class Chunks:
    """Chunked transfer coding, fed piece by piece; body() is what has been decoded so far.

    A chunk is its size in hex, after a semicolon an extension, a line end, the bytes and a line end.  Size 0, a size that is no
    number, or the input's end ends the body; a chunk that is not whole does not count.
    """

    def __init__(self) -> None:
        self.rest, self.out, self.done = b"", [], False

    def feed(self, data: bytes, last: bool = True) -> Chunks:
        """last: nothing follows this piece."""
        held, self.last = self.rest + data, last
        at = 0
        while not self.done:
            end = held.find(b"\r\n", at)
            if end < 0:
                break
            try:
                size = int(held[at:end].split(b";")[0].strip() or b"0", 16)
            except ValueError:
                size = 0
            if size <= 0:
                self.done = True
                break
            if len(held) < end + 2 + size:
                break
            if len(held) < end + 4 + size and not self.last:  # its line end is still to come
                break
            self.out.append(held[end + 2 : end + 2 + size])
            at = end + 4 + size
        self.rest = held[at:]
        return self

    def body(self) -> bytes:
        return b"".join(self.out)


def parse(raw: bytes, most: int = MOST) -> tuple[int, list[tuple[str, str]], bytes]:
    """Status, headers (names in lower case) and body of at most ``most`` bytes; ValueError says what is wrong."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no header end")
    try:
        lines = head.decode().splitlines()
    except UnicodeDecodeError:
        raise ValueError("headers are not UTF-8") from None
    words = lines[0].split() if lines else []
    if len(words) < 2 or not words[1].isdigit():
        raise ValueError("bad status line")
    headers = [(k.strip().lower(), v.strip()) for k, colon, v in (x.partition(":") for x in lines[1:]) if colon]
    length = [v for k, v in headers if k == "content-length"]
    if any(k == "transfer-encoding" and "chunked" in v.lower() for k, v in headers):
        body = Chunks().feed(rest).body()
    else:
        body = rest[: int(length[-1])] if length and length[-1].isdigit() else rest
    return int(words[1]), headers, body[:most]


def decode(rows: DataFrame, id_col: str, raw_col: str, most: int = MOST) -> DataFrame:
    """(id, status, headers, body, error) of each row; null and broken responses have an error and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.binary(), pa.string()]
        for b in batches:
            out = []
            for raw in b.column("raw").to_pylist():
                try:
                    status, headers, body = parse(raw or b"", most)
                    out.append((status, [{"name": k, "value": v} for k, v in headers], body, None))
                except ValueError as e:
                    out.append((None, None, None, str(e)))
            cols = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], ["id", "status", "headers", "body", "error"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(raw_col).alias("raw")).mapInArrow(run, f"id {kind}, status int, headers array<struct<name:string,value:string>>, body binary, error string")


def header(name: str) -> Column:
    """The first header of a name; null without one."""
    return F.get(F.filter("headers", lambda h: h["name"] == name), F.lit(0))["value"]


def canonical(url: Column) -> Column:
    """scheme://host:port/path, so that one address has one name."""
    p = url_parts(url)
    return F.concat(p["scheme"], F.lit("://"), p["host"], F.lit(":"), p["port"].cast("string"), p["path"])


def follow(asked: DataFrame, responses: DataFrame, hops: int = HOPS) -> DataFrame:
    """asked (id, url), responses (url, status, headers, body; one an address) -> (id, url, hops, status, body): the response at
    the end of each chain of redirects.  A chain that goes on after ``hops`` ends with the redirect itself; an address without a
    response has null status.  A hop is a join of slim rows; bodies are joined once, at the end."""
    told = responses.withColumn("at", canonical(F.col("url")))
    loc = F.when(F.col("status").isin(*REDIRECTS), header("location"))
    p = url_parts(F.col("url"))
    goes = F.when(F.startswith(loc, F.lit("http")), loc).otherwise(F.concat(p["scheme"], F.lit("://"), p["host"], F.lit(":"), p["port"].cast("string"), loc))
    links = cut(told.select("at", canonical(goes).alias("to")).where("to is not null"))
    now = asked.select("id", canonical(F.col("url")).alias("at"), F.lit(0).alias("hops"))
    ends = []
    for _ in range(hops):
        j = cut(now.join(links, "at", "left"))
        ends.append(j.where("to is null").select("id", "at", "hops"))
        now = j.where("to is not null").select("id", F.col("to").alias("at"), (F.col("hops") + 1).alias("hops"))
        if now.isEmpty():
            break
    out = now
    for e in ends:
        out = out.unionByName(e)
    return out.join(told.select("at", "status", "body"), "at", "left").select("id", F.col("at").alias("url"), "hops", "status", "body")
