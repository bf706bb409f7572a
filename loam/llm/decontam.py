"""Benchmark decontamination: every training passage queries a BM25 index of test items with block-max WAND.

Texts are lower-cased and ASCII punctuation counts as space.  A text's passages are windows of ``2 * STRIDE`` words that
start every STRIDE words; an item is indexed in equal pieces of at most STRIDE words, so every occurrence of a piece lies
whole in some passage.

Index.  One posting (piece, impact) per piece and term; the impact is the BM25 weight divided by the piece's sum of weights,
so a passage that holds the whole piece scores 1 and the threshold means the same for every item and at every size.
Document frequencies, their number and mean length are those of all items.  Each term's list has its greatest impact;
its postings are in blocks by ranges of RANGE pieces, each stored with its greatest impact.

Query.  Block-max WAND (Ding & Suel, 2011) with blocks aligned on ranges of pieces (Dimopoulos et al., 2013), a batch of
passages at a time: passages whose lists' greatest impacts do not add up to the threshold are passed over; so are, for
each other passage, ranges whose blocks' greatest impacts do not; postings are read in the blocks that are left only, and
every piece at or above the threshold is retrieved.

Verification is of whole items.  The first three quarters of an item's words are its question, the rest its answer (or the
columns named).  A hit is verified if the passage - for an item of several pieces with as many words on either side as
the item has - holds at least ``OVERLAP`` of the question's and of the answer's word pairs (all of them for items of fewer
than SHORT words).

The documents are read once for every ITEM_WORDS words of items; that bounds the index that goes to all tasks.

Defined results.  Empty tables: no rows, respectively nothing removed.  Null or blank texts and items: never contaminated.
Very long texts are read whole, in bounded slices.  Repeated rows and items: one result row per (doc_id, item_id), the
greatest score, of equal ones the first passage.  A score equal to the threshold is a hit.  Null ids: as a value of their
own.  Ids may have any type.  Other columns are not looked at, whatever their names; clean_rows() keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loam.llm import vectext as V
from loam.llm.common import WORD, freed, id_type, small_batches
from loam.llm.toxicity import _PUNCT

STRIDE = 128
K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.7
SHORT = 8
RANGE = 16
ITEM_WORDS = 1 << 21
ANSWER = 0.25
#: Postings that a batch of passages reads at once.
POSTINGS = 1 << 19
EPS = 1e-9


def word_pairs(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.unique(V.mix(h[:-1] * V.U(0x9E3779B97F4A7C15) + h[1:])) if len(h) > 1 else np.unique(h)


@dataclass
class Item:
    id: object
    question: np.ndarray  # words' hashes
    answer: np.ndarray

    @classmethod
    def of(cls, item: object, question: str | None, answer: str | None) -> Item:
        """answer None: the last quarter of the question's words."""
        buf, offs = V.buffer(pa.array([question or "", answer or ""], pa.string()))
        w = V.words(_PUNCT[buf], offs)
        q, a = w.hash[: w.first[1]], w.hash[w.first[1] :]
        if answer is None and len(q) > 1:
            k = len(q) - max(1, int(len(q) * ANSWER))
            q, a = q[:k], q[k:]
        return cls(item, q, a)

    def pieces(self) -> list[np.ndarray]:
        whole = np.concatenate([self.question, self.answer])
        return np.array_split(whole, -(-len(whole) // STRIDE)) if len(whole) else []


@dataclass
class Statistics:
    """Of the pieces of all items: number, words, and the number of pieces that hold a term."""

    pieces: int
    words: int
    terms: np.ndarray  # ascending hashes
    df: np.ndarray

    @classmethod
    def of(cls, items: Iterator[Item]) -> Statistics:
        n, words, terms, df = 0, 0, np.zeros(0, V.U), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def fold() -> None:
            nonlocal terms, df
            t, c = np.unique(np.concatenate(held), return_counts=True) if held else (terms[:0], df[:0])
            terms, inv = np.unique(np.concatenate([terms, t]), return_inverse=True)
            df = np.bincount(inv, np.concatenate([df, c]), len(terms)).astype(np.int64)
            held.clear()

        for item in items:
            for h in item.pieces():
                n, words = n + 1, words + len(h)
                held.append(np.unique(h))
            if len(held) > 10_000:
                fold()
        fold()
        return cls(n, words, terms, df)


@dataclass
class Index:
    items: list[Item]
    pairs: list[tuple[np.ndarray, np.ndarray]]  # word pairs of each item's question and answer
    item: np.ndarray  # of each piece
    terms: np.ndarray  # ascending hashes
    first: np.ndarray  # postings of term t: first[t]:first[t+1]
    piece: np.ndarray
    impact: np.ndarray
    greatest: np.ndarray  # impact in a term's list
    blocks: np.ndarray  # blocks of term t: blocks[t]:blocks[t+1]
    block_first: np.ndarray  # postings of block b: block_first[b]:block_first[b+1]
    block_range: np.ndarray
    block_greatest: np.ndarray

    @property
    def pieces(self) -> int:
        return len(self.item)


def build(items: list[Item], stats: Statistics | None = None) -> Index:
    stats = stats or Statistics.of(iter(items))
    parts = [(k, h) for k, x in enumerate(items) for h in x.pieces()]
    n = len(parts)
    sets = [np.unique(h, return_counts=True) for _, h in parts]
    t = np.concatenate([s[0] for s in sets]) if n else np.zeros(0, V.U)
    tf = np.concatenate([s[1] for s in sets]).astype(float) if n else np.zeros(0)
    d = np.repeat(np.arange(n), [len(s[0]) for s in sets]) if n else np.zeros(0, np.int64)
    terms, inv = np.unique(t, return_inverse=True)
    df = stats.df[np.searchsorted(stats.terms, terms)]
    length = np.array([len(h) for _, h in parts], float)
    idf = np.log(1 + (stats.pieces - df + 0.5) / (df + 0.5))
    weight = idf[inv] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[d] * stats.pieces / max(stats.words, 1)))
    impact = weight / np.bincount(d, weight, n)[d] if n else weight
    order = np.lexsort((d, inv))
    inv, d, impact = inv[order], d[order], impact[order]
    new = np.ones(len(d), bool)
    new[1:] = (inv[1:] != inv[:-1]) | (d[1:] // RANGE != d[:-1] // RANGE)
    at = np.flatnonzero(new)
    most = lambda starts: np.maximum.reduceat(impact, starts) if len(starts) else np.zeros(0)
    first = np.searchsorted(inv, np.arange(len(terms) + 1))
    pairs = [(word_pairs(x.question), word_pairs(x.answer)) for x in items]
    return Index(items, pairs, np.array([k for k, _ in parts], np.int64), terms, first, d, impact, most(first[:-1]), np.searchsorted(inv[at], np.arange(len(terms) + 1)), np.append(at, len(d)), d[at] // RANGE, most(at))


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of size[0], then those of the next."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _sums(key: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (all below n) and the sums of their x."""
    if n <= 8 * len(key):
        s = np.bincount(key, x, n)
        at = np.flatnonzero(s)
        return at, s[at]
    at, inv = np.unique(key, return_inverse=True)
    return at, np.bincount(inv, x, len(at))


def retrieve(ix: Index, p: np.ndarray, t: np.ndarray, m: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (passage, piece, score) with score >= threshold, of m passages whose distinct (passage, term) pairs are given."""
    low = threshold - EPS
    # lists: passages that no piece can reach the threshold in
    live = (np.bincount(p, ix.greatest[t], m) >= low)[p]
    p, t = p[live], t[live]
    # blocks: ranges of pieces of which none can
    size = ix.blocks[t + 1] - ix.blocks[t]
    block, who = _runs(ix.blocks[t], size), np.repeat(p, size)
    ranges = -(-ix.pieces // RANGE)
    cell = who * ranges + ix.block_range[block]
    cells, bound = _sums(cell, ix.block_greatest[block], m * ranges)
    cells = cells[bound >= low]
    at = np.minimum(np.searchsorted(cells, cell), max(len(cells) - 1, 0))
    live = cells[at] == cell if len(cells) else np.zeros(len(cell), bool)
    block, who = block[live], who[live]
    # postings of the blocks that are left
    size = ix.block_first[block + 1] - ix.block_first[block]
    post = _runs(ix.block_first[block], size)
    key, score = _sums(np.repeat(who, size) * ix.pieces + ix.piece[post], ix.impact[post], m * ix.pieces)
    hit = score >= low
    return key[hit] // ix.pieces, key[hit] % ix.pieces, score[hit]


def passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and end word of each passage; the last windows of a text are not repeated as tails."""
    n = np.diff(first)
    k = np.where(n > 0, np.maximum(-(-n // STRIDE) - 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), k)
    at = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)) * STRIDE
    return doc, at, np.minimum(at + 2 * STRIDE, first[doc + 1])


def _share(pairs: np.ndarray, h: np.ndarray) -> float:
    """Share of an item part's word pairs (of a part of one word, the word) that words h hold."""
    if not len(pairs):
        return 1.0
    here = word_pairs(h) if len(h) > 1 else h[:0]
    return float(np.isin(pairs, here if len(pairs) > 1 else np.concatenate([here, h])).mean())


def find(ix: Index, batch: pa.RecordBatch, text_col: str, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, int, int, float, float, float]]:
    """Verified hits of a batch: row, item's place, passage's first word, score, question overlap, answer overlap."""
    if not len(ix.terms):
        return []
    buf, offs = V.buffer(batch.column(text_col))
    w = V.words(_PUNCT[buf], offs)
    if not len(w.hash):
        return []
    t = np.minimum(np.searchsorted(ix.terms, w.hash), len(ix.terms) - 1)
    doc, a, z = passages(w.first)
    # distinct (passage, term); a word is in at most two passages
    at = np.flatnonzero(ix.terms[t] == w.hash)
    p = np.searchsorted(a, at, side="right") - 1
    twice = (p > 0) & (z[np.maximum(p - 1, 0)] > at)
    n_terms = len(ix.terms)
    pair = np.unique(np.concatenate([p * n_terms + t[at], (p[twice] - 1) * n_terms + t[at[twice]]]))
    p, t = pair // n_terms, pair % n_terms
    out = []
    reads = np.concatenate([[0], np.cumsum(ix.first[t + 1] - ix.first[t])])
    bound = np.searchsorted(p, np.arange(len(doc) + 1))
    lo = 0
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(reads[bound], reads[bound[lo]] + POSTINGS, side="right")) - 1)
        s = slice(bound[lo], bound[hi])
        for i, piece, score in zip(*(x.tolist() for x in retrieve(ix, p[s] - lo, t[s], hi - lo, threshold)), strict=True):
            i += lo
            k = int(ix.item[piece])
            item = ix.items[k]
            n = len(item.question) + len(item.answer)
            d = int(doc[i])
            wide = n if n > STRIDE else 0
            h = w.hash[max(int(a[i]) - wide, int(w.first[d])) : min(int(z[i]) + wide, int(w.first[d + 1]))]
            q, r = (_share(x, h) for x in ix.pairs[k])
            if min(q, r) >= (1.0 if n < SHORT else overlap) - EPS:
                out.append((d, k, int(a[i] - w.first[d]), score, q, r))
        lo = hi
    return out


def indexes(benchmark: DataFrame, id_col: str = "item_id", question_col: str = "text", answer_col: str | None = None, most_words: int = ITEM_WORDS) -> Iterator[Index]:
    """Indexes of about ``most_words`` words of items at most each, with the statistics of all items."""
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    items = benchmark.select(F.col(id_col).alias("id"), F.col(question_col).alias("q"), answer.alias("a")).where("q is not null")
    size = items.agg(F.sum(F.regexp_count(F.concat_ws(" ", "q", "a"), F.lit(WORD)))).first()[0] or 0
    parts = max(1, -(-size // most_words))

    def part(k: int) -> Iterator[Item]:
        rows = items.where(F.pmod(F.xxhash64("id", "q"), F.lit(parts)) == k) if parts > 1 else items
        return (Item.of(*r) for r in rows.sort("id", "q", "a").collect())  # about most_words words at most

    if parts == 1:
        yield build(list(part(0)))
        return
    stats = Statistics.of(x for k in range(parts) for x in part(k))
    for k in range(parts):
        yield build(list(part(k)), stats)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, item_col: str = "item_id", **options) -> DataFrame:
    """doc_id, item_id, passage (its first word), score, question_overlap, answer_overlap: the best verified hit of each pair."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = f"doc_id {id_type(docs, doc_col)}, item_id {id_type(benchmark, item_col)}, passage long, score double, question_overlap double, answer_overlap double"
    item_kind = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for index in indexes(benchmark, item_col, **options):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in V.slices(batches):
                got = find(shared.value, b, "text", threshold, overlap)
                if got:
                    d, k, at, s, q, a = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), pa.array([shared.value.items[x].id for x in k], item_kind), pa.array(at, pa.int64()), pa.array(s, pa.float64()), pa.array(q, pa.float64()), pa.array(a, pa.float64())], ["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap"])

        hits = rows.mapInArrow(freed(run), kind)
        out = hits if out is None else out.unionByName(hits)
    best = F.max_by(F.struct("passage", "score", "question_overlap", "answer_overlap"), F.struct("score", -F.col("passage"))).alias("h")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "h.*")


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, **options) -> DataFrame:
    """The rows of docs without any verified item, whatever other columns there are; texts don't move."""
    small_batches(docs.sparkSession)
    for index in indexes(benchmark, **options):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in V.slices(batches, text_col):
                bad = {x[0] for x in find(shared.value, b, text_col, threshold, overlap)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)]))

        docs = docs.mapInArrow(freed(run), docs.schema)
    return docs
