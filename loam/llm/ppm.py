"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ORDER bytes, made from all training texts.  Escape estimation is method C
(Moffat, 1990): after a context seen T times with D different successors, a successor seen c times has c / (T + D) and
the escape D / (T + D).  Symbol exclusion: after an escape, the successors of the longer context are left out of the
shorter one's counts.  As the trie counts every position in all orders, a longer context's successors are successors
of the shorter one too; so what an escape excludes depends on the two contexts alone and is computed once per context.
Behind order 0 all bytes not seen there share what is left.

Text model: lower-cased words joined by one space and ended by a line feed, which no word holds; so every text, the
empty one too, has a probability, and the probabilities of all texts add up to 1.

Counts.  Tasks count runs of ORDER + 1 bytes; the counts are summed by key, and shorter contexts' counts are sums over
longer ones'.  The trie that scoring holds in memory keeps whole contexts, the most frequent, up to ``HELD_NODES``
successors, and all contexts of up to LOW bytes.  Positions whose longest context isn't held are looked up in the full
counts, which stay a partitioned table: counts and the positions' distinct keys are dealt by the last LOW + 1 bytes of
their contexts, so all longer contexts a key needs are in its group, whose size has a fixed bound (2^24 keys), and a join
by key brings the results to the texts.  So no count is lost, whatever the input's size.  Only a given ``most_nodes``
makes a smaller model: a text whose longer context isn't kept is then predicted by the shorter one, which stays a proper
distribution.

Base: unigram counts of words, by 64-bit hash; the most frequent MOST_WORDS words go to all tasks, the others meet
the scored texts' words in a shuffle, so no count is lost.

Defined results.  Empty table: no rows.  Null, empty and blank texts: one token (the end).  Very long texts are read whole, in
bounded slices.  Repeated rows: each scored.  Ids may have any type; other columns are not looked at, whatever their names.
Words of equal counts are held or looked up together.  No training text: uniform bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import vectext as V
from loam.llm.common import cut, freed, id_type, least_count, small_batches

ORDER = 5
LOW = 2
#: Successors that a task holds: some 60 bytes each.
HELD_NODES = 1 << 21
MOST_WORDS = 1 << 19
END = 10
U = np.uint64
LOG10_2 = 0.30102999566398120


def stream(buf: np.ndarray, offs: np.ndarray, w: V.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the text model (ORDER line feeds lead each text as its first context) and each text's bounds in them."""
    n = len(offs) - 1
    length = w.end - w.start
    size = V.per_doc_sum(length + 1, w.first)
    size = np.where(w.counts > 0, size, 1)  # the last word's separator is the end
    first = np.concatenate([[0], np.cumsum(size + ORDER)])
    out = np.full(first[-1], END, np.uint8)
    if len(w.hash):
        doc = w.doc
        within = np.cumsum(length + 1) - (length + 1)
        base = np.zeros(n, np.int64)
        has = w.counts > 0
        base[has] = within[w.first[:-1][has]]
        at = first[doc] + ORDER + within - base[doc]
        src = np.repeat(w.start - np.cumsum(length) + length, length) + np.arange(length.sum())
        dst = np.repeat(at - np.cumsum(length) + length, length) + np.arange(length.sum())
        out[dst] = buf[src]
        out[at + length] = 32
        out[first[1:][has] - 1] = END
    return out, first


def keys(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of the ORDER + 1 bytes that end at each predicted position, and each text's bounds among them."""
    x = np.zeros(max(len(s) - ORDER, 0), U)
    for j in range(ORDER + 1):
        x = (x << U(8)) | s[j : len(s) - ORDER + j]
    size = np.diff(first) - ORDER
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(first[:-1] - ends[:-1], size) + np.arange(ends[-1])
    return x[at], ends


@dataclass
class Table:
    """Open-addressed map from keys to rows, looked up in whole arrays."""

    keys: np.ndarray
    slots: np.ndarray
    shift: np.uint64

    @classmethod
    def of(cls, keys: np.ndarray) -> Table:
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2 + 2))))
        shift = U(64 - bits)
        slots = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        at = ((keys * U(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
        mask = (1 << bits) - 1
        while len(left):
            free = slots[at] < 0
            slots[at[free]] = left[free]  # of those that want a slot, the last one gets it
            lost = slots[at] != left
            left, at = left[lost], (at[lost] + 1) & mask
        return cls(keys, slots, shift)

    def find(self, q: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        out = np.full(len(q), -1, np.int32)
        if not len(self.keys) or not len(q):
            return out
        mask = len(self.slots) - 1
        at = ((q * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        row = self.slots[at]
        hit = (row >= 0) & (self.keys[np.maximum(row, 0)] == q)
        out[hit] = row[hit]
        left = np.flatnonzero((row >= 0) & ~hit)
        at = at[left]
        while len(left):
            at = (at + 1) & mask
            row = self.slots[at]
            hit = (row >= 0) & (self.keys[np.maximum(row, 0)] == q[left])
            out[left[hit]] = row[hit]
            on = (row >= 0) & ~hit
            left, at = left[on], at[on]
        return out


@dataclass
class Level:
    """Order k: its contexts and their successors."""

    contexts: Table
    total: np.ndarray  # T and D of a context
    kinds: np.ndarray
    down_total: np.ndarray  # T and D of the next shorter context without this one's successors
    down_kinds: np.ndarray
    nodes: Table  # context << 8 | successor
    count: np.ndarray


class Trie:
    def __init__(self, key: np.ndarray, count: np.ndarray, order: np.ndarray, k_max: int = ORDER, low: tuple[Level, ...] = ()):
        """key (context << 8 | successor), count and order of every node that is kept; whole contexts only.  low: the
        lowest orders, if they are made already."""
        self.levels: list[Level] = list(low)
        self.k_max = k_max
        self.whole = True  # holds every context there is
        for k in range(len(low), k_max + 1):
            m = order == k
            nk, nc = key[m], count[m].astype(np.float64)
            o = np.argsort(nk)
            nk, nc = nk[o], nc[o]
            ctx, first = np.unique(nk >> U(8), return_index=True)
            total = np.add.reduceat(nc, first) if len(nk) else np.zeros(0)
            kinds = np.diff(np.append(first, len(nk))).astype(np.float64)
            nodes = Table.of(nk)
            dt, dk = np.zeros(len(ctx)), np.zeros(len(ctx))
            if k and len(nk):
                low = self.levels[-1]
                mask = U((1 << (8 * k)) - 1)
                shorter = low.nodes.find(nk & mask)
                excluded = np.add.reduceat(low.count[shorter], first)
                parent = low.contexts.find(ctx & (mask >> U(8)))
                dt = low.total[parent] - excluded
                dk = low.kinds[parent] - kinds
            self.levels.append(Level(Table.of(ctx), total, kinds, dt, dk, nodes, nc))

    def log2(self, key: np.ndarray) -> np.ndarray:
        """log2 probability of each key's last byte after the bytes before it."""
        out = np.zeros(len(key))
        left = np.arange(len(key))
        t = d = None  # totals after exclusion of those that have escaped; nan: no context so far
        for k in range(self.k_max, -1, -1):
            lv = self.levels[k]
            mask = U((1 << (8 * (k + 1))) - 1)
            node_key = key[left] & mask
            node = lv.nodes.find(node_key)
            ctx = lv.contexts.find(node_key >> U(8))
            known = ctx >= 0
            c = np.maximum(ctx, 0)
            own_t = lv.total[c] if len(lv.total) else np.zeros(len(left))
            own_d = lv.kinds[c] if len(lv.kinds) else np.zeros(len(left))
            if t is not None:
                fresh = np.isnan(t)
                own_t, own_d = np.where(fresh, own_t, t), np.where(fresh, own_d, d)
            hit = node >= 0
            out[left[hit]] += np.log2(lv.count[node[hit]] / (own_t[hit] + own_d[hit]))
            miss = ~hit
            # an escape costs nothing where exclusion has left no successor
            pay = miss & known & (own_d > 0)
            out[left[pay]] += np.log2(own_d[pay] / (own_t[pay] + own_d[pay]))
            dt = lv.down_total[c[miss]] if len(lv.total) else np.zeros(miss.sum())
            dd = lv.down_kinds[c[miss]] if len(lv.kinds) else np.zeros(miss.sum())
            t, d = np.where(known[miss], dt, np.nan), np.where(known[miss], dd, np.nan)
            left = left[miss]
            if not len(left):
                return out
        seen = self.levels[0].kinds[0] if len(self.levels[0].kinds) else 0
        out[left] -= np.log2(256 - seen)
        return out


def _texts(batch: pa.RecordBatch, col: str) -> tuple[np.ndarray, np.ndarray, V.Words]:
    buf, offs = V.buffer(batch.column(col))
    buf = V.lower(buf)
    return buf, offs, V.words(buf, offs)


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate([h[0] for h in held])
    u, inv = np.unique(k, return_inverse=True)
    return u, np.bincount(inv, np.concatenate([h[1] for h in held]), len(u)).astype(np.int64)


def gather(docs: DataFrame, text_col: str = "text", held_rows: int = 2_000_000) -> DataFrame:
    """(kind, key, n): kind 0 counts of ORDER + 1 bytes, kind 1 counts of words' hashes; summed over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            u, c = _merge(held[kind])
            held[kind] = []
            for i in range(0, len(u), 100_000):
                n = len(u[i : i + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(u[i : i + n].view(np.int64)), pa.array(c[i : i + n])], ["kind", "key", "n"])

        for b in V.slices(batches, text_col):
            buf, offs, w = _texts(b, text_col)
            held[0].append(np.unique(keys(*stream(buf, offs, w))[0], return_counts=True))
            held[1].append(np.unique(w.hash, return_counts=True))
            for kind in (0, 1):
                if sum(len(h[0]) for h in held[kind]) > held_rows:
                    held[kind] = [_merge(held[kind])]
                    if len(held[kind][0][0]) > held_rows // 2:
                        yield from flush(kind)
        for kind in (0, 1):
            if held[kind]:
                yield from flush(kind)

    return docs.select(text_col).mapInArrow(freed(count), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _trie(grams: DataFrame, most_nodes: int, low: int = 0) -> Trie:
    """The kept part of the trie: all contexts of up to low bytes (bounded by 256^(low + 1) successors), others while all are
    at most most_nodes.  Contexts are kept by their count, so a kept context's shorter contexts are kept too."""
    level = grams.select("key", "n")
    levels = []
    for k in range(ORDER, -1, -1):
        if k < ORDER:
            level = level.groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)).alias("key")).agg(F.sum("n").alias("n"))
        level = cut(level, "ppm-level")
        levels.append(level.withColumn("k", F.lit(k)))
    nodes = levels[0]
    for x in levels[1:]:
        nodes = nodes.unionByName(x)
    ctx = cut(nodes.groupBy("k", F.shiftright("key", 8).alias("c")).agg(F.sum("n").alias("t"), F.count("*").alias("d")), "ppm-contexts")
    # nodes by their context's count: exact for counts, so a histogram decides the least count that fits
    size = F.floor(F.log2("t") * 64).cast("int").alias("z")  # steps of about 1 %: a bounded number of rows
    hist = ctx.groupBy(size, (F.col("k") <= low).alias("low")).agg(F.sum("d").alias("d")).toPandas()
    free = most_nodes - hist.d[hist.low].sum()
    hist = hist[~hist.low].sort_values("z", ascending=False)
    fit = hist[hist.d.cumsum() <= free]
    least = int(fit.z.min()) if len(fit) else 1 << 30
    kept = ctx.where((F.floor(F.log2("t") * 64) >= least) | (F.col("k") <= low)).select("k", "c")
    got = nodes.withColumn("c", F.shiftright("key", 8)).join(kept.hint("merge"), ["k", "c"], "left_semi").select("key", "n", "k").toArrow()  # at most most_nodes rows, or the low orders
    trie = Trie(got.column("key").to_numpy().view(U), got.column("n").to_numpy(), got.column("k").to_numpy())
    trie.whole = len(fit) == len(hist)
    return trie


def _rare(grams: DataFrame, asked: DataFrame, low: list[Level], held_rows: int = 500_000) -> DataFrame:
    """(key, p): log2 probability of each asked key (distinct) by the full counts.  low: orders 0 to LOW, complete."""
    shared = asked.sparkSession.sparkContext.broadcast(tuple(low))
    group = (U(8), U((1 << (8 * (LOW + 1))) - 1))

    def answer(k: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        q, key, count = k[n == 0], k[n > 0], n[n > 0]
        if not len(q):
            return
        levels = []
        for order in range(LOW + 1, ORDER + 1):
            u, inv = np.unique(key & U((1 << (8 * (order + 1))) - 1), return_inverse=True)
            levels.append((u, np.bincount(inv, count, len(u)), np.full(len(u), order)))
        p = Trie(*[np.concatenate(x) for x in zip(*levels, strict=True)], low=shared.value).log2(q)
        for i in range(0, len(q), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(q[i : i + 100_000].view(np.int64)), pa.array(p[i : i + 100_000])], ["key", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows, most = 0, held_rows
        for b in batches:
            held.append((b.column("key").to_numpy().view(U), b.column("n").to_numpy()))
            rows += b.num_rows
            if rows > most:  # groups come one after another; the last one may go on
                k, n = (np.concatenate(x) for x in zip(*held, strict=True))
                g = (k >> group[0]) & group[1]
                z = int(np.searchsorted(g, g[-1]))
                yield from answer(k[:z], n[:z])
                held, rows = [(k[z:], n[z:])], len(k) - z
                most = max(held_rows, 2 * rows)
        if held:
            yield from answer(*(np.concatenate(x) for x in zip(*held, strict=True)))

    both = grams.select("key", "n").unionByName(asked.select("key", F.lit(0).cast("long").alias("n")))
    g = F.shiftright("key", 8).bitwiseAND(F.lit(int(group[1])))
    return both.withColumn("g", g).repartition("g").sortWithinPartitions("g").select("key", "n").mapInArrow(freed(run), "key long, p double")


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_nodes: int | None = None, most_words: int = MOST_WORDS, held_nodes: int = HELD_NODES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of every row of docs.

    most_nodes: for a smaller model on purpose; without it the model is all of training's counts.  held_nodes: what tasks
    hold of it; the result does not depend on it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    counts = cut(gather(training, text_col), "ppm-counts")
    trie = _trie(counts.where("kind = 0"), held_nodes, LOW) if most_nodes is None else _trie(counts.where("kind = 0"), most_nodes)
    all_held = trie.whole or most_nodes is not None
    n_texts = training.count()
    words = counts.where("kind = 1")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_tokens, v = int(total) + n_texts, int(kinds) + (n_texts > 0)
    top = words.where(F.col("n") >= least_count(words, "n", most_words)).select("key", "n").toArrow()  # at most most_words rows
    order = np.argsort(top.column("key").to_numpy().view(U))
    all_told = kinds <= most_words
    model = spark.sparkContext.broadcast((trie, Table.of(top.column("key").to_numpy().view(U)[order]), top.column("n").to_numpy()[order].astype(float)))
    floor = n_tokens + 0.5 * (v + 1)
    end = np.log10((n_texts + 0.5) / floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, table, freq = model.value
        for b in V.slices(batches, "text", V.SEG):
            buf, offs, w = _texts(b, "text")
            key, ends = keys(*stream(buf, offs, w))
            p = np.zeros(len(key))
            held = np.ones(len(key), bool) if all_held else trie.levels[ORDER].contexts.find(key >> U(8)) >= 0
            p[held] = trie.log2(key[held])
            total = V.per_doc_sum(p, ends)
            # keys whose context isn't held: each text's distinct ones and how often they come
            doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[~held]
            gram = key[~held]
            order = np.lexsort((gram, doc))
            doc, gram = doc[order], gram[order]
            new = np.flatnonzero(np.concatenate([[len(gram) > 0], (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])])[: len(gram)])
            of = np.searchsorted(doc[new], np.arange(len(ends))).astype(np.int32)
            times = np.diff(np.append(new, len(gram)))
            far = [pa.ListArray.from_arrays(pa.array(of), pa.array(x)) for x in (gram[new].view(np.int64), times.astype(np.int64))]
            row = table.find(w.hash)
            known = row >= 0
            base = np.where(known, np.log10((freq[np.maximum(row, 0)] + 0.5) / floor) if len(freq) else 0, np.log10(0.5 / floor))
            # words beyond the table: their counts come by a join, and replace the count of 0 taken here
            rest = np.flatnonzero(~known) if not all_told else np.zeros(0, np.int64)
            cuts = np.searchsorted(rest, w.first).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(w.counts + 1), pa.array(V.per_doc_sum(known, w.first) + (n_texts > 0)), pa.array(V.per_doc_sum(base, w.first) + end), pa.array(total * LOG10_2), pa.ListArray.from_arrays(pa.array(cuts), pa.array(w.hash[rest].view(np.int64))), *far], ["row", "doc_id", "n_tokens", "n_known", "base", "score", "rest", "grams", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = cut(rows.mapInArrow(freed(run), f"row long, doc_id {id_type(docs, id_col)}, n_tokens long, n_known long, base double, score double, rest array<long>, grams array<long>, times array<long>"), "ppm-scores")
    scored = out
    if not all_told:
        # only words that are not among the frequent ones come here, so none can be hot
        seen = scored.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count("*").alias("m"))
        gain = F.col("m") * (F.log10((F.col("n") + 0.5) / floor) - float(np.log10(0.5 / floor)))
        more = seen.join(words.select("key", "n").hint("merge"), "key").groupBy("row").agg(F.sum("m").alias("more"), F.sum(gain).alias("gain"))
        out = out.join(more.hint("merge"), "row", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("more", F.lit(0)), "base": F.col("base") + F.coalesce("gain", F.lit(0.0))})
    if not all_held:
        far = scored.select("row", F.explode(F.arrays_zip("grams", "times")).alias("x")).select("row", F.col("x.grams").alias("key"), F.col("x.times").alias("m"))
        rare = _rare(counts.where("kind = 0"), far.select("key").distinct(), trie.levels[: LOW + 1])
        more = far.join(rare.hint("merge"), "key").groupBy("row").agg((F.sum(F.col("m") * F.col("p")) * LOG10_2).alias("far"))
        out = out.join(more.hint("merge"), "row", "left").withColumn("score", F.col("score") + F.coalesce("far", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
