"""Vector functions: Column expressions for single vectors, numpy blocks for many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unequal or no length and for (near) zero vectors; within [-1, 1]."""
    na, nb = norm(a), norm(b)
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na >= 1e-8) & (nb >= 1e-8)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb)))).otherwise(0.0)


def softmax(a: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp((x - top) / temperature))
    total = _sum(e)
    return F.transform(e, lambda x: x / total)


def quantize_int8(a: Column) -> Column:
    """struct(scale, q): symmetric, by the greatest magnitude."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127.0).otherwise(1.0)
    return F.struct(scale.alias("scale"), F.transform(a, lambda x: F.round(x.cast("double") / scale).cast("tinyint")).alias("q"))


def quantize_int4(a: Column, block: int = 64) -> Column:
    """array<struct(scale, q)>: one scale for each block; values -7..7."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(block))

    def one(i: Column) -> Column:
        part = F.slice(a, i, F.lit(block))
        top = F.array_max(F.transform(part, lambda x: F.abs(x.cast("double"))))
        scale = F.when(top > 0, top / 7.0).otherwise(1.0)
        return F.struct(scale.alias("scale"), F.transform(part, lambda x: F.round(x.cast("double") / scale).cast("tinyint")).alias("q"))

    return F.transform(starts, lambda i: one(i.cast("int")))


def hashed_ngram_bins(text: Column, dim: int = 256) -> Column:
    """Bins of the two- and three-byte windows of the lower-cased text's UTF-8 bytes."""
    b = F.transform(F.regexp_extract_all(F.hex(F.encode(F.lower(text), "UTF-8")), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))

    def windows(b: Column) -> Column:
        n = F.size(b)
        part = lambda i, k: F.slice(b, F.lit(i), F.greatest(n - k, F.lit(0)))
        two = F.zip_with(part(1, 1), part(2, 1), lambda x, y: x * 31 + y)
        three = F.zip_with(F.zip_with(part(1, 2), part(2, 2), lambda x, y: x * 961 + y * 31), part(3, 2), lambda x, y: x + y)
        return F.transform(F.concat(two, three), lambda x: x % dim)

    # the byte array is bound once, as the one element of an outer array
    return F.flatten(F.transform(F.array(b), windows))


def hashed_ngram_udf(dim: int = 256):
    """The same as normalised vectors, in Arrow batches: for long texts, where byte arrays in the JVM would be slow."""

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        def one(t):
            b = np.frombuffer((t or "").lower().encode(), np.uint8).astype(np.int64)
            v = np.bincount((b[:-1] * 31 + b[1:]) % dim, minlength=dim) if len(b) > 1 else np.zeros(dim, np.int64)
            if len(b) > 2:
                v = v + np.bincount((b[:-2] * 961 + b[1:-1] * 31 + b[2:]) % dim, minlength=dim)
            n = float(np.sqrt((v.astype(float) ** 2).sum()))
            return (v / n if n > 1e-8 else v).astype(np.float32)

        return text.map(one) if len(text) else pd.Series([], dtype=object)

    return embed


def hashed_ngram_counts(rows: DataFrame, id_col: str, text: Column, dim: int = 256) -> DataFrame:
    """(id, bin, n): the bins of hashed_ngram_bins() with their counts; a text's windows are counted where they are, so no window
    becomes a row.  Rows of one id are one text's."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            bins, counts, size = [], [], []
            for t in b.column("text").to_pylist():
                x = np.frombuffer(t or b"", np.uint8).astype(np.int64)
                n = np.bincount((x[:-1] * 31 + x[1:]) % dim, minlength=dim) + np.bincount((x[:-2] * 961 + x[1:-1] * 31 + x[2:]) % dim, minlength=dim)
                some = np.flatnonzero(n)
                bins.append(some)
                counts.append(n[some])
                size.append(len(some))
            upto = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            flat = [pa.array(np.concatenate([*xs, np.zeros(0, np.int64)]).astype(np.int32)) for xs in (bins, counts)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.ListArray.from_arrays(upto, x) for x in flat)], ["id", "bin", "n"])

    # lists are dealt by id, so the sum needs no other shuffle
    lists = rows.select(F.col(id_col).alias("id"), F.encode(F.lower(text), "UTF-8").alias("text")).mapInArrow(run, f"id {kind}, bin array<int>, n array<int>")
    each = lists.repartition("id").select("id", F.explode(F.arrays_zip("bin", "n")).alias("x"))
    return each.groupBy("id", F.col("x.bin").alias("bin")).agg(F.sum("x.n").alias("n"))
