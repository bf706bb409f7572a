"""Spelling variants: words one edit apart, found by their three rarest positional bigrams, and each word's usual form.

Counting.  A word is a maximal run of ASCII letters and U+00C0 to U+00FF, A-Z lower-cased.  Tasks count their own words and
flush the counts whenever FLUSH words are held, so a task's memory is bounded; sums are made by one shuffle.

Candidates.  Bigrams of a word carry their position and stand in one global order, rarest first.  One edit destroys at most
two bigrams of either word, so of two near words' three rarest at least one is common, and its positions differ by the edit's
shift: not at all for a replaced character, by 0 or 1 for an inserted one.  The common bigram itself is untouched, so the edit
lies in what is left of the word without it, its rest, and there in the first or in the second half: the other half is equal in
both words.  Words meet on bigram, position, length and that half.  A key of more than GROUP words is not paired: its window is
halved again, and so on until it is a single character, where all that meet are near indeed.  So pairs made grow with near pairs
and not with the square of a frequent bigram's words, and nothing is left out.  Pairs are verified on the whole words.

Forms.  A word's form is its near word of greatest count, if that is at least ``ratio`` times its own.  Along forms the counts
grow by that factor, so chains are short; they are followed by doubling.

Defined results.  Null and empty texts and texts without letters have no words; an empty table gives no rows.  Repeated rows
count each.  Ties of count go to the smaller word by code points.  Very long texts and words are read whole.  Ids may have any
type, and null ids count as empty text in the noise; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm import vectext as V
from loam.llm.common import cut, freed, join_small, small_batches

MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: Words of a key that are paired as they are.
GROUP = 32
#: Words whose counts a task holds.
FLUSH = 400_000
#: Bytes of a run up to which checksums are made for many runs at once.
SHORT = 64

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CRC = np.empty(256, np.uint32)  # the usual table, from checksums of single bytes
_CRC[[0xFF ^ i for i in range(256)]] = [zlib.crc32(bytes([i])) ^ 0xFF000000 for i in range(256)]


def letters(part: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of U+00C0 to U+00FF, which are 0xC3 and one more byte in UTF-8."""
    lead = part == 0xC3
    out = _LETTER[part] | lead
    out[1:] |= lead[:-1]
    return out


def checksums(buf: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span, continuing the checksum ``before``; byte by byte over all spans at once."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, n = start[order], size[order]
    state = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    far = int(np.searchsorted(-n, -SHORT, side="left"))
    for i in range(far):
        state[i] = zlib.crc32(buf[at[i] : at[i] + n[i]].tobytes(), int(before[order[i]])) ^ 0xFFFFFFFF
    for j in range(int(n[far]) if far < len(n) else 0):
        to = int(np.searchsorted(-n, -j, side="left"))
        s = state[far:to]
        state[far:to] = _CRC[(s ^ buf[at[far:to] + j]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out = np.empty(len(n), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def count_texts(ids: list, buf: np.ndarray, offs: np.ndarray, min_chars: int, noise: int | None) -> Counter[bytes]:
    """Words of at least min_chars code points and their counts.  With noise, a run for which the crc32 of ``<id>:<run>`` is a
    multiple of it loses the code point at that checksum modulo its length."""
    low = V.lower(buf)
    w = V.words(low, offs, letters)
    leads = np.concatenate([[0], np.cumsum(low == 0xC3)])
    chars = (w.end - w.start) - (leads[w.end] - leads[w.start])
    keep = chars >= min_chars
    start, end, code = w.start[keep], w.end[keep], w.hash[keep]
    out: Counter[bytes] = Counter()
    if not len(start):
        return out
    if noise:
        heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        h = checksums(low, start, end, heads[w.doc[keep]])
        hit = h % np.uint32(noise) == 0
        for i in np.flatnonzero(hit):
            run = low[start[i] : end[i]].tobytes().decode()
            k = int(h[i]) % len(run)
            if len(run) > min_chars:
                out[(run[:k] + run[k + 1 :]).encode()] += 1
        start, end, code = start[~hit], end[~hit], code[~hit]
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    raw = low.tobytes()
    for a, b, c in zip(start[first].tolist(), end[first].tolist(), n.tolist(), strict=True):
        out[raw[a:b]] += c
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, noise: int | None = None) -> DataFrame:
    """word, n: all words of at least min_chars code points that occur min_count times or more in all texts together."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in V.slices(batches):
            held.update(count_texts(b.column("id").to_pylist(), *V.buffer(b.column("text")), min_chars, noise))
            if len(held) > FLUSH:
                yield flushed()
        yield flushed()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(freed(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _rarest(words: DataFrame, k: int = 3) -> DataFrame:
    """word, n, grams: the positions of the k rarest bigrams.  An alphabet of 90 letters bounds the bigrams by 8,100."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("g"))
    counted = {r["g"]: (r["count"], r["g"]) for r in grams.groupBy("g").count().collect()}
    seen = words.sparkSession.sparkContext.broadcast(counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = seen.value
        for b in batches:
            at = [[i for _, i in sorted((order[w[i : i + 2]], i) for i in range(len(w) - 1))[:k]] for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(at, pa.list_(pa.int32()))], ["word", "n", "grams"])

    return words.mapInArrow(freed(run), "word string, n long, grams array<int>")


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (word, n, own, q, p, lx, a, b) with their key.

    q is the bigram's place in the word, p its place in the shorter word or, of two equally long ones, in either; lx is that
    word's length, and a to b the window of its rest in which the edit lies.  own rows are words of length lx, the others are
    longer by the inserted character, and so is their window.
    """
    rest = F.concat(F.expr("substring(word, 1, q)"), F.expr("substring(word, q + 3)"))
    after = F.expr("b + 1 + if(own, 0, 1)")
    shift = F.expr("own or if(q > p, a <= p, b >= p)")  # an insertion before the bigram moves it, one after it does not
    out = rows.where(shift).withColumn("rest", rest)
    return out.withColumn("key", F.xxhash64(F.expr("substring(word, q + 1, 2)"), "p", "lx", "a", "b", F.expr("substring(rest, 1, a)"), F.expr("substr(rest, b + if(own, 1, 2))"))).drop("rest")


def _halves(rows: DataFrame) -> DataFrame:
    m = F.expr("(a + b) div 2").cast("int")
    both = F.array(F.struct(F.col("a"), m.alias("b")), F.struct(m.alias("a"), F.col("b")))
    return rows.withColumn("__w", F.explode(both)).select("word", "n", "own", "q", "p", "lx", "__w.a", "__w.b")


def near_pairs(words: DataFrame, min_chars: int = MIN_CHARS, group: int = GROUP) -> DataFrame:
    """u, v, nu, nv: each two of words (word, n) that differ by exactly one inserted, deleted or replaced code point, once."""
    each = _rarest(words).select("word", "n", F.length("word").alias("l"), F.explode("grams").alias("q"))
    same = F.struct(F.lit(True).alias("own"), F.col("q").alias("p"), F.col("l").alias("lx"))
    longer = lambda p: F.struct(F.lit(False).alias("own"), p.cast("int").alias("p"), (F.col("l") - 1).alias("lx"))
    roles = each.withColumn("r", F.explode(F.array(same, longer(F.col("q")), longer(F.col("q") - 1)))).select("word", "n", "r.own", "q", "r.p", "r.lx")
    roles = roles.where(F.col("own") | ((F.col("p") >= 0) & (F.col("p") <= F.col("lx") - 2) & (F.col("lx") >= min_chars)))
    rows = _keyed(_halves(roles.select("*", F.lit(0).alias("a"), (F.col("lx") - 2).alias("b"))))
    found = []
    while True:
        rows = cut(rows, "spelling-keys")
        large = cut(rows.groupBy("key").agg(F.count("*").alias("c"), F.max(F.col("b") - F.col("a")).alias("wide")).where((F.col("c") > group) & (F.col("wide") > 1)).select("key"), "spelling-large")
        n = large.count()
        if not n:
            found.append(_pairs(rows))
            break
        marked = cut(join_small(rows, large.withColumn("large", F.lit(True)), ["key"], rows=n), "spelling-marked")
        found.append(_pairs(marked.where("large is null")))
        rows = _keyed(_halves(marked.where("large")))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def _pairs(rows: DataFrame) -> DataFrame:
    x = rows.where("own").select("key", F.col("word").alias("u"), F.col("n").alias("nu"))
    y = rows.select("key", "own", F.col("word").alias("v"), F.col("n").alias("nv"))
    met = x.join(y, "key").where("not own or u < v").where(F.levenshtein("u", "v", 1) == 1)
    return met.select("u", "v", "nu", "nv")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int | None = None, group: int = GROUP) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of docs."""
    if ratio < 2:
        raise ValueError("forms end in a word only if counts grow along them: ratio must be 2 or more")
    words = cut(word_counts(docs, id_col, text_col, min_chars, min_count, noise), "spelling-words")
    pairs = near_pairs(words, min_chars, group)
    side = lambda w, n, v, m: F.struct(F.col(w).alias("word"), F.col(n).alias("n"), F.struct((-F.col(m)).alias("m"), F.col(v).alias("v")).alias("best"))
    both = pairs.select(F.explode(F.array(side("u", "nu", "v", "nv"), side("v", "nv", "u", "nu"))).alias("s")).select("s.*")
    near = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    usual = F.col("best.m") * -1 >= F.col("n") * ratio
    near = cut(near.select("word", "n_near", F.when(usual, F.col("best.v")).alias("form"), F.when(usual, -F.col("best.m")).alias("form_n")), "spelling-near")
    near = near.join(_roots(near.where("form is not null").select("word", "form"), ratio), "word", "left")
    full: Column = F.coalesce("root", "word")
    return words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", full.alias("root"))


def _roots(forms: DataFrame, ratio: int) -> DataFrame:
    """word, root: the end of each chain of forms.  Its counts grow by ratio from word to word up to 2**63, so 63 / log2(ratio)
    steps end every chain, and as many doublings as that number has bits."""
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(int(63 / np.log2(ratio)).bit_length()):
        ahead = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not out.join(ahead, "root", "left_semi").limit(1).count():
            break
        out = cut(out.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return out
