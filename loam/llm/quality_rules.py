"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted target and raw corpus.

The n-grams are runs of four bytes, hashed into 2**16 buckets.  Target: texts of all trusted documents (labels.quality = 1;
their ids are broadcast while they are counted few, else joined by a shuffle).  Raw: all documents.  Both are multinomials with add-one smoothing.  A
document's score is the mean of log2(target / raw) over its n-grams, so length does not count.  The threshold lies
``SPREAD`` times as far below the trusted documents' median as their ``quantile``: outside their bulk, so that minor
languages among them stay.  Both come from all their scores, in steps of 1/1000 bit, so every run gives the same verdicts.

Defined results.  Empty table: no rows.  Null and empty texts: all counts 0, base_failed, not kept, score null; so texts under
four bytes.  Very long texts are read whole, in bounded slices.  Repeated rows are judged each.  A score equal to the
threshold is kept.  Ids may have any type; other columns are not looked at, whatever their names.  Without trusted documents the score is 0 and the base rules alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import docstats as D
from loam.llm import vectext as V
from loam.llm.common import cut, freed, id_type, join_small, small_batches
from loam.llm.labelled import training_labels

BUCKETS = 1 << 16
N = 4
QUANTILE, SPREAD = 0.01, 2.5
MIN_WORDS, MOST_REPEATED = 10, 20


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each position's n-gram, and whether it stays inside its text."""
    if len(buf) < N:
        return np.zeros(0, np.uint16), np.zeros(0, bool)
    m = len(buf) - N + 1
    x = np.zeros(m, np.uint32)
    for j in range(N):
        x = (x << np.uint32(8)) | buf[j : m + j]
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    x *= np.uint32(0x297A2D39)
    inside = np.ones(m, bool)
    for j in range(1, N):
        cut_ = offs[1:-1] - j
        inside[cut_[(cut_ >= 0) & (cut_ < m)]] = False
    return (x >> np.uint32(16)).astype(np.uint16), inside


def _counts(rows: DataFrame, text_col: str, trusted_col: str) -> np.ndarray:
    """Bucket counts over all rows, and over trusted ones: 2 x BUCKETS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in V.slices(batches, text_col):
            buf, offs = V.buffer(b.column(text_col))
            g, inside = grams(buf, offs)
            total[0] += np.bincount(g[inside], minlength=BUCKETS)
            trusted = np.repeat(b.column(trusted_col).to_numpy(zero_copy_only=False), np.diff(offs))[: len(g)]
            if trusted.any():
                total[1] += np.bincount(g[inside & trusted], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total[0]), pa.array(total[1])], ["bucket", "raw", "target"])

    got = rows.select(text_col, trusted_col).mapInArrow(freed(count), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    out = np.zeros((2, BUCKETS), np.int64)
    at = got.column("bucket").to_numpy()
    out[0, at], out[1, at] = got.column("raw").to_numpy(), got.column("target").to_numpy()
    return out


def log_ratio(counts: np.ndarray) -> np.ndarray:
    if counts[1].sum() == 0:
        return np.zeros(BUCKETS, np.float32)
    p = (counts + 1) / (counts.sum(1, keepdims=True) + BUCKETS)
    return np.log2(p[1] / p[0]).astype(np.float32)


def scores(buf: np.ndarray, offs: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Mean log ratio of each text; nan without n-grams."""
    g, inside = grams(buf, offs)
    m = len(g)
    c = np.concatenate([[0.0], np.cumsum(np.where(inside, ratio[g], 0).astype(np.float64))])
    k = np.concatenate([[0], np.cumsum(inside)])
    o = np.minimum(offs, m)
    n = k[o[1:]] - k[o[:-1]]
    return np.where(n > 0, (c[o[1:]] - c[o[:-1]]) / np.maximum(n, 1), np.nan)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quantile: float = QUANTILE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, threshold, kept per row."""
    spark = docs.sparkSession
    small_batches(spark)
    ids = cut(training_labels(labels, "quality", None, None, id_col).where("__y = 1").select("__id", F.lit(True).alias("trusted")), "trusted")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("__id"))
    rows = join_small(rows, ids, ["__id"]).drop("__id").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    ratio = spark.sparkContext.broadcast(log_ratio(_counts(rows, "text", "trusted")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in V.slices(batches):
            buf, offs, w = D.texts(b, "text")
            base = D.base(buf, offs, w)
            s = np.round(scores(buf, offs, ratio.value), 6)
            n, rep = base["n_words"], base["n_repeat_words"]
            cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(base[c]) for c in cols], pa.array((n < MIN_WORDS) | (100 * rep > MOST_REPEATED * n)), pa.array(s, from_pandas=True), b.column("trusted")], ["doc_id", *cols, "base_failed", "score", "trusted"])

    out = rows.mapInArrow(freed(score), f"doc_id {id_type(docs, id_col)}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, trusted boolean")
    out = cut(out, "quality-scores")
    # A histogram in steps of 1/1000 bit; scores lie within +-40 bits, so it has a bounded number of rows.
    hist = out.where("trusted and score is not null").groupBy(F.round("score", 3).alias("v")).agg(F.count("*").alias("n")).toPandas().sort_values("v")
    threshold = -1e9
    if len(hist):
        low, mid = (float(hist.v[hist.n.cumsum() > q * hist.n.sum()].iloc[0]) for q in (quantile, 0.5))
        threshold = mid - SPREAD * (mid - low)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", F.lit(threshold).alias("threshold"), (~F.col("base_failed") & (F.coalesce("score", F.lit(0.0) if threshold == -1e9 else F.lit(-1e9)) >= threshold)).alias("kept"))
