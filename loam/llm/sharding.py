"""Sharding by extendible hashing.  DataFrame functions only.

The directory is indexed by the leading bits of a 60-bit hash.  A bucket whose rows exceed the byte limit is
split on the next bit, others are left alone, until every shard fits.  A round settles ``ROUND_BITS`` bits: it
sums the bytes of the at most ``2**ROUND_BITS`` cells of every bucket that is still too large, adds the cells up
level by level, and gives each cell the least depth at which its bucket fits.  Cells that do not fit at full
depth go to the next round; only their rows take part in it.

Rows that agree in all bits of the hash (same id and text) cannot be told apart by it.  If such rows together
exceed the limit they are numbered - within each input partition, then offset by the partitions before - and
filled one after the other into shards of their own, ``<prefix>+<n>``.

Defined results.  Null text: 0 bytes.  A row above the limit makes a shard of its own, with oversized true.
Null and repeated ids are hashed as they are.  Very long texts are measured whole.  Empty input: empty output.  Other columns
pass through, whatever their names.  Columns named as the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.llm.common import BROADCAST_ROWS, cut, hinted
from loam.llm.mixing import DIGITS, row_hash

ROUND_BITS = 12
HASH_BITS = 4 * DIGITS
DEFAULT_BYTES = 64 << 20
NEW = ["n_bytes", "shard", "depth", "shard_bytes", "shard_rows", "oversized"]


def n_bytes(text_col: str):
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")


def _joined(rows: DataFrame, small: DataFrame, on: str, how: str) -> DataFrame:
    """By broadcast only if small is counted and few."""
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small.hint("merge"), on, how)


def _directory(slim: DataFrame, limit: int) -> tuple[list[tuple[int, DataFrame]], DataFrame | None]:
    """Per round the bits that it starts from and its shards: (p: these bits, lo, hi: the hashes from lo to hi, hi included, depth,
    shard, shard_bytes, shard_rows); and the hashes that no bit splits.  The first round's p are its cells, at most
    2**ROUND_BITS; later rounds have a row a shard, not a row a cell, of which there can be as many as rows."""
    rounds, rows, base = [], slim, 0
    while True:
        bits = min(ROUND_BITS, HASH_BITS - base)
        low = HASH_BITS - base - bits
        cells = rows.groupBy(F.shiftright("h", low).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        cells = cut(cells, "shard-cells")
        levels = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(1 if base else 0), F.lit(bits))).alias("d")).withColumn("q", F.expr(f"shiftright(cell, {bits} - d)"))
        # The bucket of a cell at depth d holds at most 2**bits cells.  Its sums are a window, not a join: Spark takes the levels for
        # no larger than the cells' files, and would broadcast them.
        bucket = W.partitionBy("d", "q")
        sums = levels.withColumns({"shard_bytes": F.sum("b").over(bucket), "shard_rows": F.sum("n").over(bucket)})
        first = sums.where(F.col("shard_bytes") <= limit).groupBy("cell").agg(F.min(F.struct("d", "q", "shard_bytes", "shard_rows")).alias("s"))
        depth = (F.col("s.d") + base).cast("int")
        prefix = F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("s.q").cast("string"), 10, 2), depth, F.lit("0")))
        lo = F.expr(f"shiftleft(s.q, {low + bits} - s.d)")
        hi = lo + F.expr(f"shiftleft(1L, {low + bits} - s.d)") - 1
        found = first.select(F.col("cell") if not base else F.shiftright("cell", bits).alias("cell"), "s").distinct()
        rounds.append((base or bits, cut(found.select(F.col("cell").alias("p"), lo.alias("lo"), hi.alias("hi"), depth.alias("depth"), prefix.alias("shard"), "s.shard_bytes", "s.shard_rows"), "shard-directory")))
        large = cells.where(F.col("b") > limit).select(F.col("cell").alias("p"))
        base += bits
        if large.isEmpty():
            return rounds, None
        if base == HASH_BITS:
            return rounds, large.withColumnRenamed("p", "h")
        rows = _joined(rows.withColumn("p", F.shiftright("h", HASH_BITS - base)), large, "p", "left_semi").drop("p")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = DEFAULT_BYTES, keep: bool = True) -> DataFrame:
    """Adds n_bytes, shard (the bits of its prefix), depth, shard_bytes, shard_rows and oversized to every row.

    keep=False returns the id only beside these; then texts are read once.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    slim = cut(docs.select(F.col(id_col).alias("__id"), row_hash(id_col, text_col).alias("h"), n_bytes(text_col).alias("n_bytes")), "shard-slim")
    rounds, same = _directory(slim, limit)
    if keep:
        old = [c for c in docs.columns if c not in NEW]
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in old]).alias("__row"), row_hash(id_col, text_col).alias("h"), n_bytes(text_col).alias("n_bytes"))
        cols = [F.col(f"__row.`{c}`").alias(c) for c in old]
    else:
        rows, cols = slim, [F.col("__id").alias(id_col)]
    apart = None
    if same is not None:
        same = cut(same, "shard-same")
        apart = _numbered(_joined(rows, same, "h", "left_semi"), limit)
        rows = _joined(rows, same, "h", "left_anti")
    parts = ["depth", "shard", "shard_bytes", "shard_rows"]
    for i, (bits, found) in enumerate(rounds):
        found = found.select(F.col("p").alias(f"__p{i}"), "lo", "hi", F.struct(*parts).alias(f"__s{i}"))
        here = (F.shiftright("h", HASH_BITS - bits) == F.col(f"__p{i}")) & F.col("h").between(F.col("lo"), F.col("hi"))
        rows = rows.join(hinted(found, most=BROADCAST_ROWS // 8), here, "left").drop("lo", "hi")
    s = F.coalesce(*[F.col(f"__s{i}") for i in range(len(rounds))])
    out = rows.select(*cols, "n_bytes", s["shard"].alias("shard"), s["depth"].alias("depth"), s["shard_bytes"].alias("shard_bytes"), s["shard_rows"].alias("shard_rows"), F.lit(False).alias("oversized"))
    return out if apart is None else out.unionByName(apart.select(*cols, *NEW))


def _numbered(rows: DataFrame, limit: int) -> DataFrame:
    """Shards of rows that share all bits: as many to a shard as fit; the rows of a hash have equal id and text, so equal size."""
    rows = cut(rows.withColumn("__part", F.spark_partition_id()), "shard-same-rows").withColumn("__nth", F.monotonically_increasing_id())
    rows = cut(rows, "shard-same-numbered")
    counts = rows.groupBy("h", "__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.partitionBy("h").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    at = F.row_number().over(W.partitionBy("h", "__part").orderBy("__nth")) - 1
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))).cast("long"))
    out = rows.withColumn("__at", at).join(before, ["h", "__part"]).withColumn("__k", F.floor((F.col("__at") + F.col("__before")) / each).cast("long"))
    sums = out.groupBy("h", "__k").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    bits = F.lpad(F.conv(F.col("h").cast("string"), 10, 2), HASH_BITS, "0")
    return out.join(sums, ["h", "__k"]).withColumns({"shard": F.concat(bits, F.lit("+"), F.col("__k").cast("string")), "depth": F.lit(HASH_BITS), "oversized": F.col("shard_bytes") > limit})
