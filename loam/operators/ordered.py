"""Decisions in order, without one task that sees all rows.

A row that comes after a similar accepted one is rejected: the accepted rows are the lexicographically first maximal independent
set of the conflict graph.  It is found in rounds (Blelloch, Fineman and Shun, "Greedy sequential maximal independent set and
matching are parallel on average", 2012): rows without an undecided earlier neighbour are accepted, their neighbours rejected.
A cap on a source's running share is one more rule that looks at all accepted rows before; there rows are counted in segments,
all rows up to the first one that the cap would stop are settled at once, and from there a bounded stretch goes through a plain
fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.lineage import cut

#: Edges of 16 bytes that one task decides, and rows that go through the plain fold at once.
TASK_EDGES, STRETCH = 1_000_000, 1 << 16


def blocked(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """edges (a, b: long; a < b, a is decided first) -> node: what a greedy pass in ascending order rejects.

    A round settles the nodes without an undecided earlier neighbour and all their neighbours, however many.  Once no more than
    task_edges are left one task of that size ends it, so long chains of conflicts cost no long chains of jobs.
    """
    spark = edges.sparkSession
    e, out = cut(edges.select("a", "b").distinct()), []
    while n := e.count():
        if n <= task_edges:
            out.append(cut(e.coalesce(1).sortWithinPartitions("b").mapInArrow(_greedy, "node long")))
            break
        first = e.select(F.col("a").alias("r")).distinct().join(e.select(F.col("b").alias("r")).distinct(), "r", "left_anti")
        lost = cut(e.join(first, F.col("a") == F.col("r"), "left_semi").select(F.col("b").alias("node")).distinct())
        out.append(lost)
        alive = e.join(lost, F.col("b") == F.col("node"), "left_anti")
        e = cut(alive.join(lost, F.col("a") == F.col("node"), "left_anti"))
    nodes = spark.createDataFrame([], "node long")
    for x in out:
        nodes = nodes.union(x)
    return nodes


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges by b: a node is rejected if an earlier neighbour is not."""
    gone: set[int] = set()
    node, hit = None, False
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            if b != node:
                if hit:
                    gone.add(node)
                node, hit = b, False
            hit = hit or a not in gone
    if hit:
        gone.add(node)
    yield pa.RecordBatch.from_arrays([pa.array(sorted(gone), pa.int64())], ["node"])


def numbered(rows: DataFrame, seq: str) -> DataFrame:
    """Adds place: 0, 1, .. in order of seq; ranges of rows are counted, and each is numbered on its own."""
    parts = cut(rows.repartitionByRange(seq).withColumn("__part", F.spark_partition_id()))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    base = parts.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    own = F.row_number().over(W.partitionBy("__part").orderBy(seq))
    return parts.withColumn("__own", own).join(F.broadcast(base.drop("__n")), "__part").withColumn("place", F.col("__base") + F.col("__own") - 1).drop("__part", "__own", "__base")


def shares(taken: DataFrame, key: str) -> DataFrame:
    """taken (place, key) -> also n and c: rows before it, and rows of its key before it; counted by segments of STRETCH places."""
    rows = taken.withColumn("__seg", F.floor(F.col("place") / STRETCH))
    per = rows.groupBy("__seg", key).agg(F.count("*").alias("__c"))
    earlier = lambda *by: W.partitionBy(*by).orderBy("__seg").rowsBetween(W.unboundedPreceding, -1)
    total = per.groupBy("__seg").agg(F.sum("__c").alias("__n"))
    total = total.select(F.col("__seg").alias("__s"), F.coalesce(F.sum("__n").over(earlier()), F.lit(0)).alias("__n"))  # a row a segment
    per = per.select(F.col("__seg").alias("__p"), F.col(key).alias("__key"), F.coalesce(F.sum("__c").over(earlier(key)), F.lit(0)).alias("__c"))
    inside = lambda *by: F.row_number().over(W.partitionBy("__seg", *by).orderBy("place")) - 1
    out = rows.withColumns({"__i": inside(), "__k": inside(key)}).join(total, F.col("__seg") == F.col("__s"))
    out = out.join(per, (F.col("__seg") == F.col("__p")) & F.col("__key").eqNullSafe(F.col(key)))
    return out.select(*taken.columns, (F.col("__n") + F.col("__i")).alias("n"), (F.col("__c") + F.col("__k")).alias("c"))


def admitted(rows: DataFrame, links: DataFrame, max_share: float, stretch: int = STRETCH, task_edges: int = TASK_EDGES) -> DataFrame:
    """place of each accepted row of rows (place: 0, 1, ..; source; cls), links (x, y: classes that resemble each other, both ways).

    A row is accepted if no row of its class, or of one that resembles it, is, and its source has less than max_share of the
    rows accepted before; the very first row always is.  Rows of one class come as one: only the first that its source's share
    lets through can be accepted, so links are between classes, not between all their rows.

    The first stretch goes through a plain fold.  What follows is decided by blocked() as if the share stopped nothing, and
    its counts are compared; up to the first row that the share does stop all is right.  From that row on comes the next fold.
    """
    spark = rows.sparkSession
    end = rows.agg(F.coalesce(F.max("place"), F.lit(-1))).first()[0] + 1
    taken = spark.createDataFrame([], rows.select("place", "source", "cls").schema)
    lo, span = 0, end
    while lo < end:
        # classes that are out: an accepted row is of them, or of one that resembles them
        kinds = taken.select("cls")
        out = cut(kinds.union(links.join(kinds, F.col("x") == F.col("cls"), "left_semi").select("y")).distinct())
        here = rows.where((F.col("place") >= lo) & (F.col("place") < lo + stretch)).join(out, "cls", "left_anti")
        near = links.join(here.select(F.col("cls").alias("x")).distinct(), "x", "left_semi").join(here.select(F.col("cls").alias("y")).distinct(), "y", "left_semi")
        near = near.groupBy(F.col("x").alias("cls")).agg(F.collect_list("y").alias("near"))  # at most the stretch's classes
        per = taken.groupBy("source").count()
        counts = {r.source: r["count"] for r in per.join(here.select("source").distinct(), per["source"].eqNullSafe(here["source"]), "left_semi").collect()}
        fold = here.join(near, "cls", "left").coalesce(1).sortWithinPartitions("place").mapInArrow(_fold(counts, taken.count(), max_share), "place long, source string, cls long")
        taken = cut(taken.unionByName(fold))
        lo += stretch
        if lo >= end:
            break
        kinds = taken.select("cls")
        out = cut(kinds.union(links.join(kinds, F.col("x") == F.col("cls"), "left_semi").select("y")).distinct())
        rest = rows.where((F.col("place") >= lo) & (F.col("place") < lo + span)).join(out, "cls", "left_anti")
        first = cut(rest.groupBy("cls").agg(F.min(F.struct("place", "source")).alias("m")).select("m.place", "m.source", "cls"))
        at = first.select("cls", "place")
        e = links.join(at.toDF("x", "a"), "x").join(at.toDF("y", "b"), "y").where("a < b").select("a", "b")
        free = first.join(blocked(e, task_edges).withColumnRenamed("node", "place"), "place", "left_anti")
        both = cut(taken.withColumn("sure", F.lit(True)).unionByName(free.withColumn("sure", F.lit(False)).select("place", "source", "cls", "sure")))
        counted = shares(both, "source")
        stop = counted.where(~F.col("sure") & (F.col("c") / F.col("n") >= max_share)).agg(F.min("place")).first()[0]
        upto = min(lo + span, end) if stop is None else stop
        taken = cut(both.where(F.col("place") < upto).drop("sure"))
        span = span * 4 if stop is None else max(4 * stretch, 2 * (stop - lo))
        lo = upto
    return taken.select("place")


def _fold(counts: dict, before: int, max_share: float):
    """The rule itself, for rows in order; counts: rows accepted before of each source that occurs here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per, n, kinds = dict(counts), before, set()
        for batch in batches:
            out = []
            for place, source, cls, near in zip(*[batch.column(c).to_pylist() for c in ("place", "source", "cls", "near")], strict=True):
                if cls in kinds or (n and per.get(source, 0) / n >= max_share) or (near and not kinds.isdisjoint(near)):
                    continue
                kinds.add(cls)
                per[source] = per.get(source, 0) + 1
                n += 1
                out.append((place, source, cls))
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["place", "source", "cls"])

    return run
