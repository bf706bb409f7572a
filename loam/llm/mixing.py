"""Mixing sources to target weights, by hash-threshold histograms.  DataFrame functions only.

Every row gets a 60-bit hash.  Whole passes of a source are taken ``floor(target / size)`` times; the rest
of its target is met by the rows whose hash lies below a threshold.  The threshold is found on histograms:
words are summed by source and hash bucket, the bucket that holds the budget's boundary is refined by the
next bits of the hash, and so on until a bucket holds one hash.  Nothing is sorted but a source's at most
``2**BITS`` buckets.  As the hash order is fixed, a smaller budget takes a subset of a larger one's rows.

Defined results.  Null text: size 0.  A row of size 0 costs nothing and is taken once.  A null source is a source of its own, last in order.  Null or repeated
ids: rows that agree in id and text share a hash and are taken or left together.  The last such row is taken
if that brings the source nearer to its target.  Empty input: empty output.  Very long texts are counted whole.  Other
columns pass through, whatever their names; mix() replaces those named as its results, mixed_rows() none.  All sources' sizes
meet in one task, a row each, so sources are names of collections, not of single hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.llm.common import BROADCAST_ROWS, WORD, cut, hinted, union_all

BITS = 12
DIGITS = 15  # hex digits of the hash: 60 bits, five levels of 12
MOST_TIMES = 3


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(id_col: str, text_col: str) -> Column:
    """60 bits of MD5 over id and text, as a long; SQL can state it too."""
    key = F.concat_ws("\x01", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most_times: float = MOST_TIMES) -> DataFrame:
    """(source, source_size) -> also weight and target: weights go round in the sources' order, a target stops at
    ``most_times`` its source's size and the excess goes to the others by weight.

    The sources in order of size per weight are capped first; so the first source whose share of what is left
    does not exceed its cap ends the capping.  One row per source takes part here.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most_times))
    by_need = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_need.rowsBetween(W.unboundedPreceding, -1), by_need.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    w = w.withColumns({"level": level, "place": F.row_number().over(by_need)})
    free = F.col("level") * F.col("weight") <= F.col("cap")
    at = F.min(F.when(free, F.struct("place", "level"))).over(everything)["level"]
    return w.select("source", "source_size", "weight", F.when(at.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), at * F.col("weight"))).alias("target"))


def plan(slim: DataFrame, weights: tuple[float, ...], share: float, most_times: float) -> DataFrame:
    """slim (source, size, h) -> per source: source_size, target, times (whole passes) and below (one time more if h < below)."""
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    want = source_targets(sizes, weights, share, most_times)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    want = cut(want.withColumn("times", whole).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size")).withColumn("base", F.lit(0).cast("long")), "mix-targets")
    n_sources = want.count()

    found, level = [], 0
    # (source, base, budget): hashes from base on may still take budget words
    open_ = want.select(F.col("source").alias("s"), "base", "budget")
    rows = slim
    while True:
        width = DIGITS * 4 - BITS * (level + 1)
        span = F.shiftright("h", width)
        near = F.col("source").eqNullSafe(F.col("s"))
        inside = near if level == 0 else near & (F.shiftright("h", width + BITS) == F.shiftright("base", width + BITS))
        got = rows.join(F.broadcast(open_) if n_sources <= BROADCAST_ROWS else open_, inside).groupBy("s", "base", "budget", span.alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        upto = F.sum("words").over(W.partitionBy("s").orderBy("bucket"))
        # The boundary bucket is the first in which the words reach the budget.
        got = got.withColumn("upto", upto).where("upto >= budget").withColumn("k", F.row_number().over(W.partitionBy("s").orderBy("bucket"))).where("k = 1")
        got = got.withColumn("left", F.col("budget") - (F.col("upto") - F.col("words")))
        got = cut(got, "mix-boundary")
        done = F.col("lo") == F.col("hi")
        # one hash is left: taken if that comes nearer
        found.append(got.where(done).select(F.col("s"), F.when(F.col("left") * 2 >= F.col("words"), F.col("lo") + 1).otherwise(F.col("lo")).alias("below")))
        open_ = got.where(~done).select("s", F.shiftleft("bucket", width).alias("base"), F.col("left").alias("budget"))
        level += 1
        if width == 0 or open_.isEmpty():
            break
    ends = union_all(found)
    # Without a boundary the words never reach the budget (rounding): all rows are below.
    none = F.lit(1 << (DIGITS * 4))
    out = want.join(ends.hint("merge") if n_sources > BROADCAST_ROWS else F.broadcast(ends), F.col("source").eqNullSafe(F.col("s")), "left")
    return out.select("source", "source_size", "weight", "target", "times", F.when(F.col("budget") <= 0, F.lit(0)).otherwise(F.coalesce("below", none)).cast("long").alias("below"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most_times: float = MOST_TIMES, keep: bool = True) -> DataFrame:
    """Adds size, source_size, target, times (how often the mix has the row) and taken (size * times).

    keep=False returns id and source only beside these; then texts are read once.
    """
    rows = _taken(docs, id_col, text_col, source_col, weights, share, most_times, keep)
    new = ["size", "source_size", "target", "times", "taken"]
    cols = [F.col("__row").getField(c).alias(c) for c in docs.columns if c not in new] if keep else [F.col("__id").alias(id_col), F.col("__source").alias(source_col)]
    return rows.select(*cols, *[F.col(f"__{c}").alias(c) for c in new])


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most_times: float, keep: bool) -> DataFrame:
    """__size, __source_size, __target, __times and __taken of each row, beside its columns as __row, or its __id and __source."""
    size, h = n_words(F.col(text_col)).alias("__size"), row_hash(id_col, text_col).alias("__h")
    slim = cut(docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), size, h), "mix-slim")
    per = cut(plan(slim.select(F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__h").alias("h")), weights, share, most_times), "mix-plan")
    per = per.select(F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("times").alias("__whole"), F.col("below").alias("__below"))
    if keep:
        # the input's columns travel in one, so their names can't clash with those made here
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(source_col).alias("__source"), size, h)
        cols = ["__row"]
    else:
        rows, cols = slim, ["__id", "__source"]
    times = F.when(F.col("__size") == 0, F.lit(1)).otherwise(F.col("__whole") + (F.col("__h") < F.col("__below")).cast("int")).cast("long")
    times = F.least(times, F.lit(int(most_times)).cast("long"))
    joined = rows.join(hinted(per), F.col("__source").eqNullSafe(F.col("__s")), "left")
    return joined.select(*cols, "__size", "__source_size", "__target", times.alias("__times"), (times * F.col("__size")).alias("__taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most_times: float = MOST_TIMES) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of docs, whatever their names."""
    out = _taken(docs, id_col, text_col, source_col, weights, share, most_times, True)
    return out.where("__times > 0").select(F.explode(F.array_repeat("__row", F.col("__times").cast("int"))).alias("__row")).select("__row.*")
