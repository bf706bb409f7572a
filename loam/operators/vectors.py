"""Vector search and similarity joins: normalised numpy blocks in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import vector as V
from loam.lineage import cut, drop

BLOCK = 1024
#: Rows of a block of pairs(), and of it that are multiplied at once.
PAIR_BLOCK, SLICE = 4096, 512


def top_k(rows: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector: a projection and a top-k heap per task."""
    score = V.cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query]))
    return rows.select(F.col(id_col).alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def similar_to(rows: DataFrame, key, k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to a stored one, itself excluded; all scores 0 if it is unknown."""
    found = rows.where(F.col(id_col) == key).select(vector_col).limit(1).collect()
    query = F.array(*[F.lit(float(x)) for x in found[0][0]]) if found else F.array().cast("array<double>")
    score = V.cosine(F.col(vector_col), query)
    return rows.where(F.col(id_col) != key).select(F.col(id_col).alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hybrid_search(rows: DataFrame, query: str, query_vector: Column, k: int, id_col: str, title: str, content: str, vector: Column, pheromone: Column) -> DataFrame:
    """min(1, cosine + .2 if the text holds the query + .1 pheromone), best k, with a preview."""
    low = F.lit(query.lower())
    hit = F.contains(F.lower(F.col(content)), low) | F.contains(F.lower(F.col(title)), low)
    score = F.least(F.lit(1.0), V.cosine(vector, query_vector) + F.when(hit, 0.2).otherwise(0.0) + 0.1 * pheromone)
    return rows.select(F.col(id_col).alias("id"), score.alias("score"), F.substring(F.col(content), 1, 120).alias("preview")).orderBy(F.desc("score"), "id").limit(k)


def _unit(x: pa.Array) -> np.ndarray:
    """Rows of unit length; zero vectors stay.  All vectors have one length."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    m = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    s = np.sqrt((m * m).sum(1, keepdims=True))
    return np.where(s >= 1e-8, m / np.maximum(s, 1e-8), 0.0)


def pairs(rows: DataFrame, threshold: float, both: bool = False, group: str | None = None, within: str | None = None) -> DataFrame:
    """(a, b, cosine) of all pairs with cosine > threshold, a < b (or both orders); rows (id, embedding[, group or within]).

    Rows are dealt into c blocks, and the c (c + 1) / 2 pairs of blocks into tasks: each task multiplies two matrices, so a
    row goes to c tasks and nowhere are pairs below the threshold made into rows.  With ``group`` only rows of unequal groups
    pair, with ``within`` only rows of one (null is none); its rows are dealt into blocks of their own, a large one into many.
    """
    kind = rows.schema["id"].dataType.simpleString()
    name = F.col(within).cast("string") if within else F.lit("")
    r = rows.select("id", F.col("embedding").cast("array<float>").alias("v"), (F.col(group) if group else F.lit(None)).cast("string").alias("g"), name.alias("w"))
    sizes = r.where("w is not null").groupBy("w").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("c"))
    r = r.join(sizes, "w").withColumn("i", F.pmod(F.xxhash64("id"), F.col("c")).cast("int"))
    spread = r.select("w", "id", "v", "g", "i", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("o")).withColumns({"lo": F.least("i", "o"), "hi": F.greatest("i", "o")})

    def multiply(table: pa.Table) -> pa.Table:
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        own = table.column("i").to_numpy()
        left = table.filter(pa.array(own == lo)).combine_chunks()
        right = table.filter(pa.array(own == hi)).combine_chunks()
        ids = table.schema.field("id").type
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], ids), "b": pa.array([], ids), "cosine": pa.array([], pa.float64())})
        x, y = _unit(left.column("v")), _unit(right.column("v")).T
        if group:
            code = pc.fill_null(pa.concat_arrays([*left.column("g").chunks, *right.column("g").chunks]).dictionary_encode().indices, -1).to_numpy()
        found = []
        for at in range(0, len(x), SLICE):
            s = np.clip(x[at : at + SLICE] @ y, -1, 1)
            keep = s > threshold
            if lo == hi:
                keep &= np.arange(s.shape[1])[None, :] > np.arange(at, at + len(s))[:, None]
            if group:
                keep &= code[at : at + len(s), None] != code[None, len(x) :]
            i, j = np.nonzero(keep)
            found.append((i + at, j, s[i, j]))
        i, j, score = (np.concatenate(z) for z in zip(*found, strict=True))
        x, y = left.column("id").take(pa.array(i)), right.column("id").take(pa.array(j))
        swap = pc.greater(x, y)
        return pa.table({"a": pc.if_else(swap, y, x), "b": pc.if_else(swap, x, y), "cosine": score})

    out = spread.groupBy("w", "lo", "hi").applyInArrow(multiply, f"a {kind}, b {kind}, cosine double")
    return out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")) if both else out


#: First undecided rows of a room that are decided at once, and rows of a block that they are held against.
HEAD, REST_BLOCK = 4096, 8192


def unlike_earlier(rows: DataFrame, threshold: float) -> DataFrame:
    """Ids of those rows (id: long, room, embedding) that no kept row of their room with a lesser id resembles above threshold.

    Pairs of alike rows would grow with the square of a room, so none are made.  Of each room the first HEAD undecided rows are
    decided one after the other in a task; what resembles a kept one of them is out of the others, block by block, and the next
    round goes on with what is left.  A round's tasks hold a head and a block, however large the room.
    """
    head, block = HEAD, REST_BLOCK
    left, kept = cut(rows.select("id", "room", F.col("embedding").cast("array<float>").alias("v"))), []
    while True:
        place = F.row_number().over(W.partitionBy("room").orderBy("id"))
        upto = left.select("room", "id").withColumn("k", place).where(F.col("k") <= head).groupBy("room").agg(F.max("id").alias("upto"))
        dealt = left.join(upto, "room")
        new = cut(dealt.where("id <= upto").select("id", "room", "v").groupBy("room").applyInArrow(_first_come(threshold), "id long, room string, v array<float>"))
        kept.append(new.select("id"))
        rest = dealt.where("id > upto").select("id", "room", "v")
        sizes = cut(rest.groupBy("room").agg(F.ceil(F.count("*") / block).cast("int").alias("c")))
        if sizes.isEmpty():
            break
        asks = rest.join(sizes, "room").select("id", "room", "v", F.pmod(F.xxhash64("id"), "c").cast("int").alias("i"), F.lit(True).alias("asks"))
        known = new.join(sizes, "room").select("id", "room", "v", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("i"), F.lit(False).alias("asks"))
        fewer = cut(asks.unionByName(known).groupBy("room", "i").applyInArrow(_unlike(threshold), "id long, room string, v array<float>"))
        drop(left)
        left = fewer
    return reduce(DataFrame.unionByName, kept)


def _first_come(threshold: float):
    """The rows of a table that no kept one before resembles."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        x = _unit(table.column("v"))
        took = np.zeros(len(x), bool)
        for at in range(0, len(x), SLICE):
            y = x[at : at + SLICE]
            free = ~_resembles(y, x[:at][took[:at]], threshold)
            near = np.clip(y @ y.T, -1, 1) > threshold
            for i in range(len(y)):
                if free[i]:
                    free[i + 1 :] &= ~near[i, i + 1 :]
            took[at : at + SLICE] = free
        return table.filter(pa.array(took)).select(["id", "room", "v"])

    return run


def _unlike(threshold: float):
    """The asking rows of a table that none of the others resembles."""

    def run(table: pa.Table) -> pa.Table:
        left, right = table.filter(table.column("asks")).combine_chunks(), table.filter(pc.invert(table.column("asks"))).combine_chunks()
        if left.num_rows and right.num_rows:
            left = left.filter(pa.array(~_resembles(_unit(left.column("v")), _unit(right.column("v")), threshold)))
        return left.select(["id", "room", "v"])

    return run


def _resembles(x: np.ndarray, known: np.ndarray, threshold: float) -> np.ndarray:
    """For each row of x whether any of known does; known rows go by in slices, against what is still without a match."""
    hit = np.zeros(len(x), bool)
    for at in range(0, len(known), SLICE):
        some = np.flatnonzero(~hit)
        y = known[at : at + SLICE].T
        for lo in range(0, len(some), SLICE):
            part = some[lo : lo + SLICE]
            hit[part] = (np.clip(x[part] @ y, -1, 1) > threshold).any(1)
    return hit


def duplicate_of(query: DataFrame, rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, match, score): for each query row (id, room, embedding) the most similar row of its room above threshold; of equal
    ones (to 12 digits) the least id.

    A room's rows are dealt into blocks, and the pairs of blocks into tasks, so a large room is many tasks of bounded size; a
    task multiplies two matrices and gives one row for each query row at most.
    """
    count = lambda df, c: df.groupBy("room").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(c))
    sizes = count(query, "cq").join(count(rows, "cr"), "room")
    block = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    v = F.col("embedding").cast("array<float>").alias("v")
    asks = query.join(sizes, "room").select("room", "id", v, block("cq").alias("i"), spread("cr").alias("j"), F.lit(True).alias("asks"))
    known = rows.join(sizes, "room").select("room", "id", v, spread("cq").alias("i"), block("cr").alias("j"), F.lit(False).alias("asks"))

    def best(table: pa.Table) -> pa.Table:
        left = table.filter(table.column("asks")).combine_chunks()
        right = table.filter(pc.invert(table.column("asks"))).sort_by("id").combine_chunks()
        if not left.num_rows or not right.num_rows:
            return table.select(["id"]).slice(0, 0).append_column("match", table.column("id").slice(0, 0)).append_column("score", pa.array([], pa.float64()))
        s = np.clip(_unit(left.column("v")) @ _unit(right.column("v")).T, -1, 1)
        own = np.array(left.column("id").to_pylist(), object)[:, None] == np.array(right.column("id").to_pylist(), object)[None, :]
        s[own] = -2
        at = np.round(s, 12).argmax(1)  # the first of equal ones
        score = s[np.arange(len(at)), at]
        hit = np.nonzero(score > threshold)[0]
        return pa.table({"id": left.column("id").take(hit), "match": right.column("id").take(at[hit]), "score": score[hit]})

    kind = query.schema["id"].dataType.simpleString()
    out = asks.unionByName(known).groupBy("room", "i", "j").applyInArrow(best, f"id {kind}, match {kind}, score double")
    top = F.min(F.struct((-F.round("score", 12)).alias("s"), F.col("match").alias("match"), F.col("score").alias("score"))).alias("m")
    return out.groupBy("id").agg(top).select("id", "m.match", "m.score")


def mean_pool(rows: DataFrame, key: str, vector_col: str) -> DataFrame:
    """(key, vector): element-wise means."""
    e = rows.select(key, F.posexplode(vector_col).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return e.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def quantise_blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """int4 packing: two values to a byte, scales of 64; batches (id, embedding) -> (id, packed, scales)."""
    for b in it:
        packed, scales = [], []
        for v in b.column("embedding").to_pylist():
            x = np.asarray(v, np.float64)
            pad = np.zeros(-(-len(x) // 64) * 64)
            pad[: len(x)] = x
            blocks = pad.reshape(-1, 64)
            s = np.abs(blocks).max(1) / 7
            s[s == 0] = 1
            y = blocks / s[:, None]
            q = (np.sign(y) * np.floor(np.abs(y) + 0.5)).astype(np.int8).ravel() & 15
            packed.append((q[0::2] | (q[1::2] << 4)).astype(np.uint8).tobytes())
            scales.append(s.tolist())
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(packed, pa.binary()), pa.array(scales, pa.list_(pa.float64()))], ["id", "packed", "scales"])
