"""What the operators share: cutting lineage, size-checked joins, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the small side of a join is broadcast.  Its rows are a few numbers, or at most an id and a name: some
#: tens of megabytes in all.
BROADCAST_ROWS = 500_000
#: Bytes of the texts in such a side, where it has ids or names that are texts.
BROADCAST_BYTES = 32 << 20
#: The pattern of one word, for SQL.
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  A temporary one only where that is unset and all
    tasks run on the driver's machine; on a cluster the setting is a must."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="loam-shared-")
        atexit.register(shutil.rmtree, _own[app], True)
    return "file://" + _own[app]


#: Rows of an Arrow batch of texts.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of at most TEXT_ROWS rows (Spark's own default is 10,000): a batch is held whole by the
    JVM and by the worker, so a run of long texts would take much memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def freed(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """task for mapInArrow(), after which its worker gives memory back to the system: workers are used again, and what their
    allocators keep would add up over the stages of a job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # no glibc
                ctypes.CDLL(None).malloc_trim(0)

    return run


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/loam-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            remove(spark, path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and no executor owns the result."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes what cut() wrote; only for tables that no lazy plan still reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/loam-" in path:
            remove(df.sparkSession, path)


def hinted(small: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """small with the hint by which it is to be joined: broadcast only if it has at most ``most`` rows, and its texts at most
    BROADCAST_BYTES together; else by shuffle, where AQE splits skewed keys.  small should be cut() before, so that counting it
    costs little."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in small.dtypes if kind in ("string", "binary")]
    if rows is None or texts:
        rows, size = small.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0)).cast("long")), F.lit(0))).first()
        if size > BROADCAST_BYTES:
            return small.hint("merge")
    return F.broadcast(small) if rows <= most else small.hint("merge")


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Joins small as hinted() says."""
    return big.join(hinted(small, rows, most), on, how)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df bears it; case does not count."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def crc_bucket(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null ids fall in bucket 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % k, F.lit(0))


def _forest(edges: DataFrame, most_nodes: int = 500_000) -> DataFrame:
    """A spanning forest of each partition's edges, as stars; written out anew whenever it holds most_nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root.get(top, top) != top:
                top = root[top]
            while root.get(x, x) != top:
                root[x], x = top, root[x]
            return top

        def stars() -> pa.RecordBatch:
            ends = [(x, find(x)) for x in root]
            ends = [(x, r) for x, r in ends if x != r]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in ends], pa.int64()), pa.array([r for _, r in ends], pa.int64())], ["u", "v"])

        for b in batches:
            for x, y in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                p, q = find(x), find(y)
                root[max(p, q)] = root[min(p, q)] = min(p, q)
            if len(root) > most_nodes:
                yield stars()
        if root:
            yield stars()

    return edges.mapInArrow(freed(run), "u long, v long")


#: Edges of 16 bytes that a single task joins at most.
FOREST_EDGES = 1_000_000


def components(edges: DataFrame, most_rounds: int = 60, forest_edges: int = FOREST_EDGES) -> DataFrame:
    """Connected components of undirected edges (a, b: long): rows (node, component), component the least node.

    Partitions first reduce their edges to forests.  If FOREST_EDGES or fewer are left, one more such pass over them all
    ends it: a task of counted, bounded size.  Else large-star and small-star steps alternate (Kiveris et al.,
    "Connected Components in MapReduce and Beyond", 2014), which keep the number of edges linear and need about
    logarithmically many rounds.  A hub's neighbours are never gathered in one row: each step takes a minimum, with
    partial aggregation.  Tables of minima are broadcast while they are small, by their count.
    """
    spark = edges.sparkSession
    e = cut(_forest(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")).distinct(), "cc")
    told = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    sign = told(e)
    if not sign[0]:
        return spark.createDataFrame([], "node long, component long")
    if sign[0] <= forest_edges:
        return _named(_forest(e.coalesce(1), forest_edges * 2))
    for _ in range(most_rounds):
        small = sign[0] <= BROADCAST_ROWS
        near = lambda t, m: t.join(F.broadcast(m) if small else m, "k")  # noqa: B023, E731
        # large star: neighbours above a node go to the least of its neighbourhood
        both = e.select(F.col("u").alias("k"), F.col("v").alias("y")).union(e.select(F.col("v").alias("k"), F.col("u").alias("y")))
        large = near(both, both.groupBy("k").agg(F.least(F.min("y"), F.first("k")).alias("m"))).where("y > k").select(F.col("y").alias("k"), F.col("m").alias("y")).distinct()
        # small star: neighbours below a node, and the node, go to the least of them
        low = near(large, large.groupBy("k").agg(F.min("y").alias("m")))
        star = low.select(F.explode(F.array(F.struct(F.col("y").alias("u"), F.col("m").alias("v")), F.struct(F.col("k").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").where("u <> v").distinct()
        nxt = cut(star, "cc")
        now = told(nxt)
        drop(e)
        e = nxt
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError("components did not settle")
    return _named(e)


def _named(stars: DataFrame) -> DataFrame:
    e = cut(stars, "cc")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cut(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")


def id_type(df: DataFrame, col: str) -> str:
    """The SQL type of a column; ids keep theirs."""
    return df.schema[col].dataType.simpleString()


def least_count(df: DataFrame, col: str, most: int, rows: Column | None = None) -> int:
    """The least count such that at most ``most`` rows have it or a greater one; from a histogram of counts in steps of about
    1 %, so no row moves to find it."""
    step = F.when(F.col(col) < 64, F.col(col).cast("double")).otherwise(F.floor(F.log2(F.col(col)) * 64) + 10_000)
    hist = df.groupBy(step.alias("z")).agg(F.sum(F.lit(1) if rows is None else rows).alias("n"), F.min(col).alias("low")).toPandas().sort_values("z", ascending=False)
    fit = hist[hist.n.cumsum() <= most]
    if len(fit):
        return int(fit.low.min())
    return int(hist.low.max()) * 2 + 1 if len(hist) else 1


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
