"""Labelled documents for fitting: a bounded, documented sample, so that ids and labels can be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import crc_bucket, cut

#: Labelled documents that a fit uses at most (in expectation); above it, those with the least hash of their id.
MOST_LABELLED = 200_000


def training_labels(labels: DataFrame, label: str, most: int | None = MOST_LABELLED, held_out_mod: int | None = 3, id_col: str = "doc_id") -> DataFrame:
    """(__id as text, __y): labelled ids outside the held-out third, one row per id, at most about ``most`` of them
    (None: all).

    Ids labelled more than once count with the greatest label; null ids and null labels don't count.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    if held_out_mod:
        rows = rows.where(crc_bucket(id_col, held_out_mod) != 1)
    rows = rows.groupBy(F.col(id_col).cast("string").alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    rows = cut(rows, "labels")
    n = rows.count() if most is not None else 0
    if most is not None and n > most:
        rows = cut(rows.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(most / n * (1 << 30))), "labels")
    return rows


def labelled(docs: DataFrame, ids: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(__id, __y, __text) of labelled documents.  The ids are few (see MOST_LABELLED), so no text moves."""
    return docs.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(ids), "__id")
