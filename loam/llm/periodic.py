"""Periodic runs: all maximal runs of a text's words, from the branching tandem repeats of its suffix tree.

Stoye and Gusfield, "Simple and flexible detection of contiguous repeats using a suffix tree" (2002).  An inner node of the
suffix tree stands for a string w of d words, its leaf list for the places where w occurs.  ww stands at i, and is branching,
if i and i + d are in the leaf lists of two different children.  Every run ends with a branching tandem repeat of its period.
To find them a node looks at the leaves of all its children but the largest (the smaller halves), at i + d and at i - d, so
all nodes together look at O(n log n) leaves.  A repeat is then rotated to the left, word by word, while the word before it
is the word one period later; what results is a maximal run.  Repeats that end at the same word are taken by their period, and
multiples of one inside its run are not rotated again, so runs of few different words (the same word 20,000 times) cost no more.

The trees of a batch of texts are built together, with numpy: suffixes are sorted by doubling, only where they still tie, and
never across texts; inner nodes are the intervals of equal common prefixes in that order.  Words are identified by a 64-bit
hash.  A task holds a batch of about BATCH bytes, or one longer text, and some 100 bytes a word of it.

Defined results.  Empty table: no rows.  Null, empty and blank texts: no words, no runs, collapsed text empty.  A row is judged
by its own text alone, so repeated rows, ties and null ids need no rule.  Very long texts are read whole, a text at a time.
Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import vectext as V
from loam.llm.common import freed, id_type, small_batches

MIN_LENGTH = 12
#: Bytes of texts whose trees are built together, and leaves that nodes look at together.
BATCH, LEAVES = 1 << 18, 1 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


def suffix_order(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffixes in an order that keeps equal beginnings together, each one's place in it, and for k = 0, 1, .. the place at
    which the suffixes begin that agree in the first 2**k words.  Suffixes of different texts agree in nothing."""
    n = len(words)
    with np.errstate(over="ignore"):
        key = V.mix(words + doc.astype(V.U) * V.U(0x9FB21C651E98DF25))
    order = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    place = np.arange(n)

    def group(at: np.ndarray, keys: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Names each of equal keys by the first place; tells which places still tie."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        rank[at] = where[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
        return ~new | ~np.append(new[1:], True)

    tied = group(order, key[order], place)
    levels = [rank.copy()]
    act, where, step = order[tied], place[tied], 1
    while len(act):
        key2 = rank[act] * (n + 2) + rank[np.minimum(act + step, n)] + 1
        by = np.argsort(key2, kind="stable")
        act, key2 = act[by], key2[by]
        order[where] = act
        tied = group(act, key2, where)
        act, where, step = act[tied], where[tied], step * 2
        levels.append(rank.copy())
    return order, rank[:n], levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix shares with the one before it in order."""
    out = np.zeros(len(order) + 1, np.int64)
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    x, y, total = order[at - 1], order[at], np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][x] == levels[k][y]
        hop = same.astype(np.int64) << k
        x, y, total = x + hop, y + hop, total + hop
    out[at] = total
    return out


def inner_nodes(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Children of all inner nodes but each one's largest: the child's interval of places, its node's interval, its depth."""
    b = np.flatnonzero(lcp > 0)
    d = lcp[b]
    least = [lcp]  # least of 2**k prefixes from a place on
    while len(b) and (wide := 1 << len(least)) <= len(lcp):
        m = least[-1]
        nxt = np.minimum(m[: len(m) - wide // 2], m[wide // 2 :])
        if not nxt.any():
            break
        least.append(nxt)
    hi, lo = b + 1, b.copy()
    for k in range(len(least) - 1, -1, -1):
        m = least[k]
        go = hi < len(m)
        go &= m[np.minimum(hi, len(m) - 1)] >= d
        hi += go.astype(np.int64) << k
        back = lo - (1 << k)
        go = back >= 0
        go &= m[np.clip(back, 0, len(m) - 1)] >= d
        lo -= go.astype(np.int64) << k
    lo -= 1  # the suffix before the first that shares d words
    by = np.argsort(lo * (len(lcp) + 1) + hi, kind="stable")
    b, d, lo, hi = b[by], d[by], lo[by], hi[by]
    first = np.ones(len(b), bool)
    first[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    last = np.append(first[1:], True)[: len(b)]
    # a child ends at each boundary of its node, and one more at the node's end
    start = np.concatenate([np.where(first, lo, np.roll(b, 1)), b[last]])
    end = np.concatenate([b, hi[last]])
    node = np.concatenate([np.cumsum(first) - 1, np.arange(int(first.sum()))])
    size = end - start
    most = np.zeros(int(first.sum()), np.int64)
    np.maximum.at(most, node, size)
    large = np.flatnonzero(size == most[node])
    keep = np.ones(len(size), bool)
    keep[large[np.unique(node[large], return_index=True)[1]]] = False
    node = node[keep]
    return start[keep], end[keep], lo[first][node], hi[first][node], d[first][node]


def branching_repeats(order: np.ndarray, rank: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and periods of all branching tandem repeats, by end and then period."""
    start, end, lo, hi, d = inner_nodes(lcp)
    size = end - start
    n, ends, periods = len(order), [], []
    upto = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LEAVES, side="right")))
        s = size[at:to]
        child = np.repeat(np.arange(at, to), s)
        leaf = order[np.arange(len(child)) + np.repeat(start[at:to] - (np.cumsum(s) - s), s)]
        dd = d[child]
        for other, left in ((leaf + dd, leaf), (leaf - dd, leaf - dd)):
            inside = (other >= 0) & (other < n)
            r = rank[np.where(inside, other, 0)]
            hit = np.flatnonzero(inside & (r >= lo[child]) & (r < hi[child]) & ((r < start[child]) | (r >= end[child])))
            ends.append(left[hit] + 2 * dd[hit])
            periods.append(dd[hit])
        at = to
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.unique(np.concatenate(ends) * (n + 1) + np.concatenate(periods))
    return code // (n + 1), code % (n + 1)


def rotate(word: np.ndarray, floor: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Where the runs begin that end with a tandem repeat: to the left as long as words one period apart are equal."""
    pos = end - 2 * period - 1
    act, width = np.arange(len(end)), 8
    while len(act):
        left = []
        for part in np.array_split(act, max(1, len(act) * width // LEAVES)):
            at = pos[part, None] - np.arange(width)
            ok = at >= floor[part, None]
            at = np.maximum(at, 0)
            ok &= word[at] == word[at + period[part, None]]
            full = ok.all(1)
            pos[part] -= np.where(full, width, np.argmin(ok, 1))
            left.append(part[full])
        act, width = np.concatenate(left), min(width * 2, 4096)
    return pos + 1


def find(words: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all maximal runs of at least max(min_length, 2 periods) words; words of document d are
    first[d]:first[d + 1], and the runs come by start and then period."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if len(words) < 2:
        return (np.zeros(0, np.int64),) * 3
    order, rank, levels = suffix_order(words, doc)
    end, period = branching_repeats(order, rank, common_prefixes(order, levels))
    found = []
    while len(end):
        lead = np.ones(len(end), bool)
        lead[1:] = end[1:] != end[:-1]
        e, q = end[lead], period[lead]
        s = rotate(levels[0], first[doc[e - 1]], e, q)
        found.append(np.stack([s, e, q]))
        of = np.cumsum(lead) - 1
        rest = ~lead & ~((period % q[of] == 0) & (end - 2 * period >= s[of]))
        end, period = end[rest], period[rest]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    s, e, q = np.concatenate(found, 1)
    long = e - s >= np.maximum(min_length, 2 * q)
    s, e, q = s[long], e[long], q[long]
    by = np.lexsort((e, q, s))
    return s[by], e[by], q[by]


def planted(ids: list, first: np.ndarray) -> np.ndarray:
    """The word that stands at each place when every tenth text by crc32 of its id is made periodic from some word on."""
    src = np.arange(first[-1])
    for k, i in enumerate(ids):
        h = zlib.crc32(("" if i is None else str(i)).encode())
        n = int(first[k + 1] - first[k])
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            src[first[k] + a : first[k + 1]] = first[k] + a + np.arange(n - a) % p
    return src


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, plant: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of each document: its words
    joined by one space, without those that a run repeats.  plant: texts are first made periodic as in planted()."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in V.slices(batches, most=BATCH):
            buf, offs = V.buffer(b.column("text"))
            w = V.words(buf, offs)
            src = planted(b.column("id").to_pylist(), w.first) if plant else np.arange(len(w.hash))
            s, e, q = find(w.hash[src], w.first, min_length)
            at = np.searchsorted(s, w.first)
            base = np.repeat(w.first[:-1], np.diff(at))
            spans = pa.StructArray.from_arrays([pa.array(s - base), pa.array(e - s), pa.array(q)], ["start", "length", "period"])
            edge = np.zeros(len(src) + 1, np.int64)
            np.add.at(edge, s + q, 1)
            np.add.at(edge, e, -1)
            kept = np.cumsum(edge[:-1]) == 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w.counts), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans), _joined(buf, w, src, kept)], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(freed(run), f"doc_id {id_type(docs, id_col)}, n_words long, runs {RUNS}, collapsed string")


def _joined(buf: np.ndarray, w: V.Words, src: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each document with one space between them."""
    at = src[kept]
    size = w.end[at] - w.start[at] + 1
    upto = np.concatenate([[0], np.cumsum(size)])
    out = np.append(buf, np.uint8(32))[np.arange(upto[-1]) + np.repeat(w.start[at] - upto[:-1], size)]
    out[upto[1:] - 1] = 32
    edge = upto[np.concatenate([[0], np.cumsum(kept)])[w.first]]  # where each document's words begin, with a space after the last
    gone = edge[1:][np.diff(edge) > 0] - 1
    keep = np.ones(len(out), bool)
    keep[gone] = False
    offsets = edge - np.searchsorted(gone, edge)
    return pa.LargeStringArray.from_buffers(len(edge) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[keep])).cast(pa.string())
