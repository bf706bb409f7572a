"""Toxicity by maximum-scoring segments.

Token log-odds.  For every word the number of toxic and of all labelled texts that contain it.  A word's toxic share has
a Dirichlet (here Beta) prior centred on the share of its stem (its first ``STEM`` bytes), which in turn has one centred
on the overall share; so rare words borrow from their stem and common ones stand on their own.  A word counts from its
first toxic or second labelled text on; before that its stem stands for it.  The token score is the log-odds of that share
against the overall one, less ``DRIFT``: a token that tells nothing costs DRIFT.  There is no cap on words or stems: the
labelled texts are a bounded sample (labelled.MOST_LABELLED), and so is their vocabulary.

Segments.  All maximal-scoring segments of a text are found in one left-to-right pass (Ruzzo & Tompa, 1999): each segment
is linked to the nearest one before it with a smaller left sum, so no segment is passed by twice.  Runs of uninformative
tokens are one step.

Significance.  The best segment of a clean text follows an extreme-value (Gumbel) law whose location grows with the
logarithm of the length (Karlin & Altschul, 1990); location, slope and scale are fitted on clean training texts (by
quantiles).  A segment whose tail probability is below ``ALPHA`` is significant.

Two scans use this.  For passages every occurrence of a word counts, so a passage that comes again is found again.  For a
text's evidence a word counts where it first occurs: the sum of -ln p over the segments that are significant then, each
scan having a law of its own; a logistic fit on training texts turns it into the score.  (Measured on held-out rows at
sf0.1: with all occurrences in the score, too, 135 of 144 toxic texts are found and 14 others; this way 133 and none.)
Those others repeat weak words, of whose texts few are toxic.  clean_rows() therefore also drops texts with a passage that
is significant by strong words alone, which more toxic than clean texts have; there every occurrence counts.

Training texts are in FOLDS folds by their id; for the fits of the laws each is scored by the counts of the other folds,
or rare words would look surer than they are.

Defined results.  Empty table: no rows.  Null, empty and blank texts: no segment, the score of no evidence.  Very long
texts are read whole, in bounded slices.  Repeated rows: each its own row.  Ties (segments of equal score): the earlier
and shorter one is whole.  Ids may have any type.  Other columns are not looked at, whatever their names; clean_rows()
keeps them.  Without toxic or without clean training texts: score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import vectext as V
from loam.llm.common import crc_bucket, cut, freed, id_type, small_batches
from loam.llm.labelled import MOST_LABELLED, labelled, training_labels
from loam.llm.qda import platt

STEM = 6
PRIOR_STEM, PRIOR_WORD = 10.0, 6.0
DRIFT = 0.5
ALPHA = 0.01
FOLDS = 4
MOST_P = 30.0
_PUNCT = np.arange(256, dtype=np.uint8)
_PUNCT[65:91] += 32
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


@dataclass
class Tokens:
    word: np.ndarray
    stem: np.ndarray
    words: V.Words


def tokens(batch: pa.RecordBatch, col: str) -> Tokens:
    """Lower-cased words without ASCII punctuation, and hashes of their first STEM bytes."""
    buf, offs = V.buffer(batch.column(col))
    buf = _PUNCT[buf]
    w = V.words(buf, offs)
    with np.errstate(over="ignore"):
        stem = np.zeros(len(w.hash), V.U)
        for j in range(STEM):
            at = w.start + j
            inside = at < w.end
            stem = stem * V.U(257) + np.where(inside, buf[np.minimum(at, len(buf) - 1)] if len(buf) else 0, 0).astype(V.U)
    return Tokens(w.hash, V.mix(stem), w)


def maximal_segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score) of a sequence in which the tokens at ``at`` score
    ``score`` and every other one -drift.  Linear in len(at)."""
    start: list[int] = []
    end: list[int] = []
    left: list[float] = []  # sum before the segment
    right: list[float] = []  # sum at its end
    back: list[int] = []  # nearest segment before it with a smaller left sum, or -1
    total, last = 0.0, -1
    for i, s in zip(at.tolist(), score.tolist(), strict=True):
        total -= drift * (i - last - 1)
        last = i
        before = total
        total += s
        if s <= 0:
            continue
        a, low = i, before
        j = len(start) - 1
        while j >= 0 and left[j] >= low:
            j = back[j]
        while j >= 0 and right[j] < total:  # joined with segment j and all behind it
            a, low, keep = start[j], left[j], j
            j = back[j]
            del start[keep:], end[keep:], left[keep:], right[keep:], back[keep:]
        start.append(a), end.append(i), left.append(low), right.append(total), back.append(j)
    return [(a, z, r - l) for a, z, l, r in zip(start, end, left, right, strict=True)]


@dataclass
class Law:
    """Extreme-value law of the best segment of a clean text of n tokens."""

    loc: float = 0.0
    slope: float = 0.0
    scale: float = 1.0

    @classmethod
    def of(cls, n: np.ndarray, top: np.ndarray) -> Law:
        """By quantiles, so that a few odd clean texts do not stretch it."""
        ln = np.log(n.astype(float))
        slope = max(float(np.cov(ln, top)[0, 1] / ln.var()), 0.0) if len(top) > 2 and ln.std() > 0 else 0.0
        rest = top - slope * ln
        low, high = np.quantile(rest, [0.5, 0.95]) if len(rest) else (0.0, 1.0)
        gumbel = lambda p: -np.log(-np.log(p))
        scale = max(float(high - low) / float(gumbel(0.95) - gumbel(0.5)), 0.25)
        return cls(float(low) - scale * float(gumbel(0.5)), slope, scale)

    def tail(self, s: float, n: int) -> float:
        """Probability that a clean text of n tokens has a segment of score s or more."""
        z = (s - self.loc - self.slope * np.log(max(n, 1))) / self.scale
        return float(-np.expm1(-np.exp(-min(max(z, -30.0), 700.0))))


@dataclass
class Model:
    words: np.ndarray  # ascending hashes
    w_score: np.ndarray  # a score a word; with folds a row each
    stems: np.ndarray
    s_score: np.ndarray
    first: Law  # of scans in which a word counts once
    every: Law  # of scans in which each occurrence counts
    a: float = 1.0
    b: float = 0.0
    empty: bool = False
    strong: float = np.inf  # score above which a token's toxic share is more than a half

    def token_scores(self, t: Tokens, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions and scores of informative tokens, a known word's own score, else its stem's; and which are the first of
        their word in their text.  fold: that of each text."""
        if not len(t.word) or not len(self.stems) + len(self.words):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
        k = np.minimum(np.searchsorted(self.stems, t.stem), max(len(self.stems) - 1, 0))
        stem = self.stems[k] == t.stem if len(self.stems) else np.zeros(len(t.word), bool)
        j = np.minimum(np.searchsorted(self.words, t.word), max(len(self.words) - 1, 0))
        word = self.words[j] == t.word if len(self.words) else np.zeros(len(t.word), bool)
        at = np.flatnonzero(stem | word)
        doc = np.searchsorted(t.words.first, at, side="right") - 1
        order = np.lexsort((at, t.word[at], doc))
        new = np.ones(len(at), bool)
        new[order[1:]] = (t.word[at][order[1:]] != t.word[at][order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
        pick = lambda x, i: (x[i] if fold is None else x[fold[doc], i]) if x.size else np.zeros(len(i))
        return at, np.where(word[at], pick(self.w_score, j[at]), pick(self.s_score, k[at])), new

    def segments(self, t: Tokens, fold: np.ndarray | None = None) -> list[tuple[list[tuple[int, int, float]], list[tuple[int, int, float]]]]:
        """Of each text the maximal segments of both scans: words counted once, and every time."""
        return self._scans(t, *self.token_scores(t, fold))

    @staticmethod
    def _scans(t: Tokens, at: np.ndarray, s: np.ndarray, new: np.ndarray) -> list[tuple[list[tuple[int, int, float]], list[tuple[int, int, float]]]]:
        cuts = np.searchsorted(at, t.words.first)
        out = []
        for a, z, f in zip(cuts[:-1], cuts[1:], t.words.first[:-1], strict=True):
            p, q, once = at[a:z] - f, s[a:z], new[a:z]
            every = maximal_segments(p, q, DRIFT)
            out.append((every if once.all() else maximal_segments(p[once], q[once], DRIFT), every))
        return out

    def toxic(self, t: Tokens, cut_off: float) -> np.ndarray:
        """Which texts score cut_off or more, or hold a passage that is significant by its strong tokens alone, every
        occurrence counted."""
        at, s, new = self.token_scores(t)
        n = t.words.counts.tolist()
        ev = np.array([self.evidence(o, c) for (o, _), c in zip(self._scans(t, at, s, new), n, strict=True)])
        out = self.score(ev) >= cut_off
        at, s = at[s > self.strong], s[s > self.strong]
        cuts = np.searchsorted(at, t.words.first)
        for i in np.flatnonzero((cuts[1:] > cuts[:-1]) & ~out).tolist():
            a, z = cuts[i], cuts[i + 1]
            out[i] = bool(self.found(self.every, maximal_segments(at[a:z] - t.words.first[i], s[a:z], DRIFT), n[i]))
        return out

    @staticmethod
    def found(law: Law, segs: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float, float]]:
        """The significant ones, each with its tail probability."""
        each = [(a, z, s, law.tail(s, n)) for a, z, s in segs]
        return [x for x in each if x[3] < ALPHA]

    def evidence(self, segs: list[tuple[int, int, float]], n: int) -> float:
        return sum(min(-np.log(max(p, 1e-300)), MOST_P) for *_, p in self.found(self.first, segs, n))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.empty:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(self.a * np.log1p(evidence) + self.b, -30, 30)))


def _model(words: dict[str, np.ndarray], stems: dict[str, np.ndarray], p0: float, without: int | None = None) -> Model:
    """From counts by fold (columns of t and n), without one fold."""
    some = [f for f in range(FOLDS) if f != without]
    logit = lambda p: np.log(p / (1 - p))
    over = float(logit(p0)) + DRIFT
    share = lambda x, prior, mean: np.clip((x["t"][:, some].sum(1) + prior * mean) / (x["n"][:, some].sum(1) + prior), 1e-4, 1 - 1e-4)
    s_share = share(stems, PRIOR_STEM, p0)
    k = np.minimum(np.searchsorted(stems["h"], words["s"]), max(len(stems["h"]) - 1, 0))
    prior = np.where(stems["h"][k] == words["s"], s_share[k], p0) if len(stems["h"]) else np.full(len(words["h"]), p0)
    return Model(words["h"], logit(share(words, PRIOR_WORD, prior)) - over, stems["h"], logit(s_share) - over, Law(), Law(), strong=-over)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED) -> Model:
    """labels: rows of id_col and label."""
    small_batches(docs.sparkSession)
    ids = training_labels(labels, label, most_labelled, id_col=id_col)
    train = labelled(docs, ids, text_col, id_col).withColumn("__f", F.pmod(F.xxhash64("__id"), F.lit(FOLDS)).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in V.slices(batches, "__text"):
            t = tokens(b, "__text")
            y, fold = b.column("__y").to_numpy(), b.column("__f").to_numpy()
            v, first = V.distinct_sets(t.word, t.words.first)
            doc = np.repeat(np.arange(len(y)), np.diff(first))
            u, inv = np.unique(v, return_inverse=True)
            order = np.argsort(t.word, kind="stable")
            stem = t.stem[order][np.searchsorted(t.word[order], u)] if len(u) else np.zeros(0, V.U)
            cell = inv * FOLDS + fold[doc]
            toxic, every = np.bincount(cell, y[doc], len(u) * FOLDS).astype(np.int64), np.bincount(cell, minlength=len(u) * FOLDS)
            at = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays([pa.array(u[at // FOLDS].view(np.int64)), pa.array(stem[at // FOLDS].view(np.int64)), pa.array((at % FOLDS).astype(np.int32)), pa.array(toxic[at]), pa.array(every[at])], ["w", "s", "f", "t", "n"])

    folds = [F.sum(F.when(F.col("f") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for c in "tn" for f in range(FOLDS)]
    sums = [sum((F.col(f"{c}{f}") for f in range(FOLDS)), F.lit(0)).alias(c) for c in "tn"]
    words = cut(train.mapInArrow(freed(count), "w long, s long, f int, t long, n long").groupBy("w", "s").agg(*folds).select("*", *sums), "toxic-words")
    sizes = dict(train.groupBy("__y").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    z = np.zeros(0)
    if not n1 or not n0:
        return Model(z.astype(V.U), z, z.astype(V.U), z, Law(), Law(), empty=True)
    p0 = n1 / (n1 + n0)
    every = [f"{c}{f}" for c in "tn" for f in range(FOLDS)]
    logit = lambda p: F.log(p / (1 - p))
    over = float(np.log(p0 / (1 - p0))) + DRIFT
    # which words and stems the model has depends on counts of all training texts alone
    stems = words.groupBy("s").agg(*[F.sum(c).alias(c) for c in ["t", "n", *every]]).withColumn("share", (F.col("t") + PRIOR_STEM * p0) / (F.col("n") + PRIOR_STEM))
    kept_stems = cut(stems.where(logit(F.col("share")) > over), "toxic-stems")
    w = words.where("t > 0 or n > 1").join(F.broadcast(kept_stems.select("s", "share")), "s", "left")
    share = F.coalesce("share", F.lit(p0))
    kept = w.where((logit((F.col("t") + PRIOR_WORD * share) / (F.col("n") + PRIOR_WORD)) > over) | F.col("share").isNotNull())

    def arrays(df: DataFrame, key: str) -> dict[str, np.ndarray]:
        t = df.toArrow()  # of the vocabulary of a bounded sample
        h = t.column(key).to_numpy().view(V.U)
        o = np.argsort(h)
        out = {"h": h[o], **{c: np.column_stack([t.column(f"{c}{f}").to_numpy()[o] for f in range(FOLDS)]).astype(np.float32) for c in "tn"}}
        return out | {"s": t.column("s").to_numpy().view(V.U)[o]}

    wa, sa = arrays(kept.select("w", "s", *every), "w"), arrays(kept_stems.select("s", *every), "s")
    model = _model(wa, sa, p0)
    by = [_model(wa, sa, p0, f) for f in range(FOLDS)]
    folds = Model(wa["h"], np.array([m.w_score for m in by]), sa["h"], np.array([m.s_score for m in by]), Law(), Law())
    shared = docs.sparkSession.sparkContext.broadcast(folds)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in V.slices(batches, "__text"):
            t = tokens(b, "__text")
            segs = shared.value.segments(t, b.column("__f").to_numpy())
            top = [max((s for *_, s in e), default=0.0) for _, e in segs]
            yield pa.RecordBatch.from_arrays([b.column("__y"), pa.array(t.words.counts), pa.array([[s for *_, s in o] for o, _ in segs], pa.list_(pa.float64())), pa.array(top, pa.float64())], ["y", "n", "s", "top"])

    seen = train.mapInArrow(freed(best), "y int, n long, s array<double>, top double").toPandas()  # at most about MOST_LABELLED rows of a few numbers
    shared.destroy()
    clean = seen[(seen.y == 0) & (seen.n > 0)]
    model.first = Law.of(clean.n.to_numpy(), np.array([max(s, default=0.0) for s in clean.s]))
    model.every = Law.of(clean.n.to_numpy(), clean.top.to_numpy())
    ev = np.array([model.evidence([(0, 0, x) for x in s], int(n)) for s, n in zip(seen.s, seen.n, strict=True)])
    model.a, model.b = platt(np.log1p(ev), seen.y.to_numpy().astype(float))
    return model


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, score, evidence and passages: significant segments as (first word, last word, score, p), words counted from 0."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in V.slices(batches, "text"):
            t = tokens(b, "text")
            n, segs = t.words.counts.tolist(), m.segments(t)
            ev = np.array([m.evidence(o, c) for (o, _), c in zip(segs, n, strict=True)])
            spans = [[{"first": a, "last": z, "score": s, "p": p} for a, z, s, p in m.found(m.every, e, c)] for (_, e), c in zip(segs, n, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(m.score(ev)), pa.array(ev, pa.float64()), pa.array(spans, kind)], ["id", "score", "evidence", "passages"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(freed(run), f"id {id_type(docs, id_col)}, score double, evidence double, passages array<struct<first:long,last:long,score:double,p:double>>")
    return out.withColumnRenamed("id", id_col)


def score(docs: DataFrame, labels: DataFrame, cut_off: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The id, held_out, score, predicted, n_passages, passages of every row."""
    out = scan(docs, fit(docs, labels, id_col=id_col, text_col=text_col, **options), id_col, text_col)
    return out.select(id_col, (crc_bucket(id_col, 3) == 1).alias("held_out"), "score", (F.col("score") >= cut_off).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"), "passages")


def clean_rows(docs: DataFrame, model: Model, cut_off: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below cut_off and hold no passage that is toxic by its strong tokens alone (Model.toxic),
    whatever other columns there are; texts are read once and don't move."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in V.slices(batches, text_col):
            yield b.filter(pa.array(~m.toxic(tokens(b, text_col), cut_off)))

    return docs.mapInArrow(freed(run), docs.schema)
