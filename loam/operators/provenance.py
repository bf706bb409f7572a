"""Verifiable provenance: title hashes, MACs, signatures in a small group, claim chains and their codecs.

Whole-number arithmetic above 64 bits has no Spark type, so these are Arrow batches of Python integers; SHA-256 alone is
built in and used as such where nothing else is asked for.
"""

from __future__ import annotations

import hashlib
import hmac
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prime, generator and exponent modulus of the group; seed and multiplier of the title hash.
P, G, Q = 0xFFFFFFFFFFFFFFC5, 7, 0xFFFFFFFFFFFFFFC4
SEED, MULTIPLIER = 0x811C9DC5, 0x01000193
MASK = 2**64 - 1


def title_hash_int(text: str) -> int:
    h = SEED
    for b in text.encode():
        h = (h * MULTIPLIER + b) & MASK
    return h


def title_hash(text: Column | str) -> Column:
    """64-bit hash of a title as 16 hex digits."""

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else f"{title_hash_int(x):016x}")

    return run(text)


def hmac_sha256(key: Column | str, message: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(k: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else hmac.new(a.encode(), b.encode(), hashlib.sha256).hexdigest() for a, b in zip(k, m, strict=True)], dtype=object)

    return run(key, message)


def mac(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 of a binary column under one key, as hex digits: two SHA-256 in the JVM, the pads are constants."""
    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ p for b in k)) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def mac_claim(statement: Column, witness: Column, key: bytes) -> Column:
    """struct(statement, witness_hash, proof, key_hash): the proof binds the statement to the witness's hash."""
    w = F.sha2(witness.cast("binary"), 256)
    return F.struct(statement.alias("statement"), w.alias("witness_hash"), mac(key, F.concat(statement.cast("binary"), F.unhex(w))).alias("proof"), F.lit(hashlib.sha256(key).hexdigest()).alias("key_hash"))


def mac_verify(claim: Column, key: bytes) -> Column:
    same = claim["key_hash"] == hashlib.sha256(key).hexdigest()
    return same & (claim["proof"] == mac(key, F.concat(claim["statement"].cast("binary"), F.unhex(claim["witness_hash"]))))


# Offset and prime of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(text: Column | str) -> Column:
    """FNV-1a of the UTF-8 bytes as 16 hex digits."""

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None:
                return None
            h = FNV_OFFSET
            for b in x.encode():
                h = (h ^ b) * FNV_PRIME & MASK
            return f"{h:016x}"

        return t.map(one)

    return run(text)


def discovery_id(source: Column, title: Column) -> Column:
    return F.concat(F.lit("disc:"), F.regexp_replace(source, r"\.", "_"), F.lit(":"), title_hash(title))


def tx_hash(chain: Column, nonce: Column, op: Column) -> Column:
    """sha256 over big-endian chain and nonce and the operation's text."""
    be = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    return F.sha2(F.concat(be(chain), be(nonce), op.cast("binary")), 256)


def scalar(data: bytes) -> int:
    return int.from_bytes(hashlib.sha256(data).digest()[:8], "big") % Q


def prove(secret: int, message: str) -> tuple[int, int, int]:
    """(commitment, response, public key) with a nonce derived from secret and message."""
    x = secret % Q
    y = pow(G, x, P)
    k = scalar(b"nonce" + x.to_bytes(8, "big") + message.encode())
    r = pow(G, k, P)
    c = scalar(r.to_bytes(8, "big") + y.to_bytes(8, "big") + message.encode())
    return r, (k + c * x) % Q, y


def verify(commitment: int, response: int, public: int, message: str) -> bool:
    c = scalar(commitment.to_bytes(8, "big") + public.to_bytes(8, "big") + message.encode())
    return pow(G, response, P) == commitment * pow(public, c, P) % P


def link_message(claim: str, pos: int, kind: str) -> str:
    return f"{claim}|pos={pos}|type={kind}"


_LINK = "discovery_id long, pos int, claim string, type string, commitment string, response string, public_key string"


_LOW, _FOLD = np.uint64(0xFFFFFFFF), np.uint64(2**64 - P)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b mod P of uint64 arrays, by halves: 2^64 is 59 mod P."""
    half = np.uint64(32)
    a1, a0, b1, b0 = a >> half, a & _LOW, b >> half, b & _LOW
    mid, other, low = a1 * b0, a0 * b1, a0 * b0
    carry = (low >> half) + (mid & _LOW) + (other & _LOW)
    high = a1 * b1 + (mid >> half) + (other >> half) + (carry >> half)
    low = (low & _LOW) | (carry << half)
    # high 59 + low: high 59 has up to 70 bits
    x0, x1 = (high & _LOW) * _FOLD, (high >> half) * _FOLD
    x1 += x0 >> half
    part = ((x1 & _LOW) << half) | (x0 & _LOW)
    out = part + low
    over = (x1 >> half) + (out < part)
    last = out + over * _FOLD
    last += np.where(last < out, _FOLD, np.uint64(0))
    return np.where(last >= np.uint64(P), last - np.uint64(P), last)


@lru_cache(64)
def _powers(base: int) -> np.ndarray:
    """base^(d 256^i) mod P of each byte's place i and value d."""
    return np.array([[pow(base, d << 8 * i, P) for d in range(256)] for i in range(8)], np.uint64)


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base^e mod P of each e of a uint64 array: a product of a table's entries, one a byte."""
    table = _powers(base)
    out = table[0][exponents & np.uint64(255)]
    for i in range(1, 8):
        out = _times(out, table[i][exponents >> np.uint64(8 * i) & np.uint64(255)])
    return out


def prove_all(secret: int, messages: list[bytes]) -> tuple[list[int], list[int], int]:
    """prove() of many messages: commitments, responses and the public key."""
    x = secret % Q
    y = pow(G, x, P)
    nonce, key = b"nonce" + x.to_bytes(8, "big"), y.to_bytes(8, "big")
    k = [scalar(nonce + m) for m in messages]
    r = power(G, np.array(k, np.uint64)).tolist()
    return r, [(a + scalar(b.to_bytes(8, "big") + key + m) * x) % Q for a, b, m in zip(k, r, messages, strict=True)], y


def verify_all(commitments: list[int], responses: list[int], public: int, messages: list[bytes]) -> np.ndarray:
    """verify() of many messages under one public key."""
    key = public.to_bytes(8, "big")
    c = np.array([scalar(r.to_bytes(8, "big") + key + m) for r, m in zip(commitments, messages, strict=True)], np.uint64)
    right = _times(np.array([r % P for r in commitments], np.uint64), power(public % P, c))
    return power(G, np.array(responses, np.uint64)) == right


def _messages(batch: pa.RecordBatch) -> list[bytes]:
    return [link_message(c, p, t).encode() for c, p, t in zip(*[batch.column(c).to_pylist() for c in ("claim", "pos", "type")], strict=True)]


def build_chain(claims: DataFrame, secret: int) -> DataFrame:
    """claims (discovery_id, pos, claim, type) -> links with proofs; numbers as 16 hex digits."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            r, s, y = prove_all(secret, _messages(b))
            hexed = [pa.array([f"{x:016x}" for x in xs], pa.string()) for xs in (r, s, [y] * len(r))]
            yield pa.RecordBatch.from_arrays([*b.columns, *hexed], [*b.schema.names, "commitment", "response", "public_key"])

    return claims.select("discovery_id", F.col("pos").cast("int").alias("pos"), "claim", "type").mapInArrow(run, _LINK)


#: Public keys of a batch that get a table of powers; others are verified one by one.
KEYS = 32


def verify_chain(links: DataFrame) -> DataFrame:
    """(discovery_id, n_links, valid): positions run from 0, one public key, and every proof holds."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            m = np.array(_messages(b), object)
            r, s = (np.array([int(x, 16) for x in b.column(c).to_pylist()], object) for c in ("commitment", "response"))
            coded = b.column("public_key").dictionary_encode()
            ok, which = np.zeros(len(m), bool), coded.indices.to_numpy()
            in_range = np.array([0 <= x < 2**64 and 0 <= y < 2**64 for x, y in zip(r, s, strict=True)], bool)
            for k, y in enumerate(int(x, 16) for x in coded.dictionary.to_pylist()):
                at = np.flatnonzero((which == k) & in_range)
                if 0 <= y < 2**64 and len(coded.dictionary) <= KEYS:
                    ok[at] = verify_all(r[at].tolist(), s[at].tolist(), y, m[at].tolist())
                else:
                    ok[at] = [verify(r[i], s[i], y, m[i].decode()) for i in at] if 0 <= y < 2**64 else False
            yield pa.RecordBatch.from_arrays([b.column("discovery_id"), b.column("pos"), b.column("public_key"), pa.array(ok)], ["discovery_id", "pos", "public_key", "ok"])

    v = links.select("discovery_id", "pos", "claim", "type", "commitment", "response", "public_key").mapInArrow(run, "discovery_id long, pos int, public_key string, ok boolean")
    whole = (F.min("pos") == 0) & (F.max("pos") == F.count("*") - 1) & (F.count_distinct("pos") == F.count("*"))
    return v.groupBy("discovery_id").agg(F.count("*").alias("n_links"), (F.bool_and("ok") & whole & (F.count_distinct("public_key") == 1)).alias("valid"))


def claim_message(statement: str, confidence: float) -> str:
    return f"{statement}|confidence={confidence:.4f}"


def encode_claim(statement: str, confidence: float, numbers: tuple[int, int, int, int, int]) -> bytes:
    """Length, statement, float and five 64-bit numbers, little-endian."""
    s = statement.encode()
    return struct.pack(f"<I{len(s)}sf5Q", len(s), s, confidence, *numbers)


def decode_claim(data: bytes) -> tuple[str, float, tuple[int, ...]]:
    if len(data) < 4:
        raise ValueError("too short")
    (n,) = struct.unpack_from("<I", data)
    if len(data) != 4 + n + 44:
        raise ValueError("wrong length")
    return data[4 : 4 + n].decode(), struct.unpack_from("<f", data, 4 + n)[0], struct.unpack_from("<5Q", data, 8 + n)


def links_json(links: DataFrame) -> DataFrame:
    """(discovery_id, json): the links of a chain in order."""
    s = F.array_sort(F.collect_list(F.struct("pos", "claim", "type", "commitment", "response", "public_key")))
    return links.groupBy("discovery_id").agg(F.to_json(s).alias("json"))


def links_from_json(rows: DataFrame) -> DataFrame:
    kind = "array<struct<pos:int,claim:string,type:string,commitment:string,response:string,public_key:string>>"
    return rows.select("discovery_id", F.explode(F.from_json("json", kind)).alias("l")).select("discovery_id", "l.*")
