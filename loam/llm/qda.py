"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Class means and covariances come from sums that tasks add up; covariances are shrunk towards their pooled value and its
diagonal (Friedman, "Regularized Discriminant Analysis", 1989).  The score is the posterior of class 1 from the
difference of Mahalanobis log densities, each by the cached Cholesky factor of its class.  The scale of that difference
is fitted on the training rows (Platt), as correlated statistics would make raw posteriors too sure.

Labels are learnt from a bounded sample (labelled.MOST_LABELLED); all documents are scored.

Defined results.  Empty table: no rows.  Null text: as the empty text.  Very long texts are read whole, in bounded slices.
Repeated rows: each scored, and each learnt from if labelled.  Ids may have any type; other columns are not looked at,
whatever their names.  A score equal to the cut-off counts as class 1.  With one class in training the score is that
class's prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import docstats as D
from loam.llm import vectext as V
from loam.llm.common import crc_bucket, cut, freed, id_type, small_batches
from loam.llm.labelled import MOST_LABELLED, training_labels

P = len(D.FEATURES)
POOLED, DIAGONAL = 0.1, 0.05


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    chols: np.ndarray
    logdets: np.ndarray
    log_prior: float
    a: float = 1.0
    b: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        q = []
        for m, c, d in zip(self.means, self.chols, self.logdets, strict=True):
            s = forward(c, (z - m).T)
            q.append(-0.5 * (s * s).sum(0) - 0.5 * d)
        # a bounded root keeps order and tames the tails
        g = q[1] - q[0] + self.log_prior
        return np.sign(g) * np.log1p(np.abs(g))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margin(x) + self.b, -30, 30)))


def forward(c: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Solves c s = z for a lower triangular c by forward substitution."""
    s = np.empty_like(z)
    for i in range(len(c)):
        s[i] = (z[i] - c[i, :i] @ s[:i]) / c[i, i]
    return s


def _fit(n: np.ndarray, s: np.ndarray, ss: np.ndarray, pooled: float, diagonal: float) -> Model:
    """From counts (2), sums (2 x P) and sums of products (2 x P x P)."""
    total = n.sum()
    centre = s.sum(0) / total
    scale = np.sqrt(np.maximum(np.diag(ss.sum(0)) / total - centre**2, 1e-8))
    means, covs = [], []
    for k in (0, 1):
        m = s[k] / n[k]
        c = ss[k] / n[k] - np.outer(m, m)
        means.append((m - centre) / scale)
        covs.append(c / np.outer(scale, scale))
    common = (n[0] * covs[0] + n[1] * covs[1]) / total
    chols, logdets = [], []
    for c in covs:
        c = (1 - pooled) * c + pooled * common
        c = (1 - diagonal) * c + diagonal * np.eye(len(c)) * max(np.trace(c) / len(c), 1e-3)
        ch = np.linalg.cholesky(c)
        chols.append(ch)
        logdets.append(2 * np.log(np.diag(ch)).sum())
    return Model(centre, scale, np.array(means), np.array(chols), np.array(logdets), float(np.log(n[1] / n[0])))


def platt(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, steps: int = 50) -> tuple[float, float]:
    """Logistic fit of y on x by Newton steps with a small ridge."""
    w = np.ones(len(x)) if w is None else w
    t = np.zeros(2)
    A = np.column_stack([x, np.ones(len(x))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(A @ t, -30, 30)))
        g = A.T @ (w * (p - y)) + 1e-3 * t
        h = (A * (w * p * (1 - p))[:, None]).T @ A + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        t -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(t[0]), float(t[1])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", most_labelled: int = MOST_LABELLED, pooled: float = POOLED, diagonal: float = DIAGONAL, cut_off: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of held-out ids are not read."""

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in V.slices(batches):
            x = D.features(*D.texts(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), P).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    small_batches(docs.sparkSession)
    kind = id_type(docs, id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = cut(rows.mapInArrow(freed(stats), f"doc_id {kind}, x array<double>"), "qda-statistics")
    ids = training_labels(labels, label, most_labelled, id_col=id_col)
    train = cut(made.join(F.broadcast(ids), F.col("doc_id").cast("string") == F.col("__id")).select("x", F.col("__y").alias("y")), "qda-train")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((2, 1 + P + P * P))
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, P)
            y = b.column("y").to_numpy()
            for k in (0, 1):
                z = x[y == k]
                acc[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(acc.tolist(), pa.list_(pa.float64()))], ["y", "v"])

    parts = train.mapInArrow(freed(moments), "y int, v array<double>").select("y", F.posexplode("v").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).collect()  # 2 x (1 + P + P*P) numbers
    acc = np.zeros((2, 1 + P + P * P))
    for y, i, v in parts:
        acc[y, i] = v
    n = acc[:, 0]
    held = crc_bucket("doc_id", 3) == 1
    if n.min() < 2:
        const = float(n[1] / n.sum()) if n.sum() else 0.5
        return made.select("doc_id", held.alias("held_out"), F.lit(const).alias("score"), F.lit(int(const >= cut_off)).alias("predicted"))
    model = _fit(n, acc[:, 1 : 1 + P], acc[:, 1 + P :].reshape(2, P, P), pooled, diagonal)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, P)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(model.margin(x), 2)), b.column("y")], ["m", "y"])

    # the margins' histogram in steps of 1/100 (they are logarithms: some thousands of rows at most)
    hist = train.mapInArrow(freed(margins), "m double, y int").groupBy("m", "y").agg(F.count("*").alias("n")).toPandas()
    model.a, model.b = platt(hist.m.to_numpy(), hist.y.to_numpy(), hist.n.to_numpy().astype(float))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column("x").flatten().to_numpy().reshape(-1, P)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    out = made.mapInArrow(freed(apply), f"doc_id {kind}, score double")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut_off).cast("int").alias("predicted"))
