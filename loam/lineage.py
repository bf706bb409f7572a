"""Cutting lineage in loops."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a temporary folder only where that is unset and all tasks run on the
    driver's machine, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="loam-cut-")
        atexit.register(shutil.rmtree, _own[sc.applicationId], True)
    return "file://" + _own[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read again: one run writes it, no executor owns it, and its plan starts there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loam-cut-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def long_rows(spark: SparkSession) -> None:
    """For results with rows of megabytes: Parquet's writer looks at the size of what it holds after 100 rows at the earliest, which
    may be gigabytes a task; from now on after each.  Files hold the same rows."""
    for key in ("parquet.page.size.row.check.min", "parquet.block.size.row.check.min"):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, "1")


def drop(*frames: DataFrame) -> None:
    """Deletes what cut() wrote; only for tables that no lazy plan still reads."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/loam-cut-" in f}:
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            _remove(spark, path)
