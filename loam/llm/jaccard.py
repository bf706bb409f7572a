"""N-gram Jaccard join: an exact metric-space join, d = 1 - Jaccard, of all documents' shingle sets.

Documents with equal sets are one point.  Let e be the greatest distance of a link.

1. Voronoi regions of document pivots, over all points.  The pivots are documents of a bounded sample (``SAMPLE_BYTES`` of
   text by least hash, each text once), more than 2 * RADIUS apart from each other; the PIVOTS with the most sampled
   documents around them stay.  A point within RADIUS of its nearest pivot is at home in that pivot's region, and visits
   the regions of other pivots p with d(p) <= min(RADIUS + e, nearest + 2e).  A point with no pivot that near is at home
   outside, and visits the regions of pivots at d <= RADIUS + e.  By the triangle inequality a point at home in a region
   meets everything it links to there.  Points within e of a pivot link to it; those with d(p) < least - e, where least is
   the least distance of a point that does not link to p, have no other links that matter and go no further.
2. Points at home outside are at distance 1, or nearly so, from all pivots and mostly from each other, so no document tells
   them apart.  Their pivots are the one-shingle sets.  A set is at distance 1 - 1/n from each of its own shingles and
   1 from all others, so ties are broken by a fixed rank of shingles, common ones last.  If two sets link, their least
   common shingle is among the first n - ceil(t n) + 1 of either: those are the windows to which a set is replicated as
   a boundary document.  Cells with equal members are one.  In a cell, a bitmap of each set bounds every distance from
   below: a shingle flips one bit, so two sets differ in at least as many members as their bitmaps in bits (Sandes et
   al., "Bitmap filter", 2020).  A bitmap has about as many bits as its set has members, at least BITS; the longer of two
   is folded to the size of the shorter.  Pairs whose bound admits a link tie points to a region; a region's points come
   together once, whatever the number of their cells.
3. Regions of either kind are joined recursively: pivots of their own create Voronoi regions with windows of
   ``nearest + 2e``, points at d <= e of a pivot link to it, and the triangle inequality bounds which points still need
   comparing.  A region above ``most_bytes`` takes up to LEVELS such levels as Spark jobs, REGION_PIVOTS pivots each; what
   no pivot tells apart even then is joined by pairs of blocks.

Every comparison that decides a link is exact on whole sets of 64-bit shingle hashes and in whole numbers:
den * intersection >= num * union.

Defined results.  Empty table: no rows.  Null, empty and blank texts: empty set, linked with nothing.  Very long texts are
read whole, in slices of bounded scratch.  Ids may have any type that has an order.  Rows with equal ids: each row has its
own set, and the component of an id's rows is that of their links.  Null ids take part, but never name a component unless
all its ids are null (then null).  Ties are on the side of the link.  Columns of the input other than id and text are not
looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.llm import vectext as V
from loam.llm.common import BROADCAST_ROWS, components, cut, drop, freed, hinted, id_type, least_count, small_batches, unused

#: Shingles that are ranked last: at most so many, the most frequent; any choice gives the same links.
MOST_COMMON = 1 << 18
#: Shingles among which a task looks for common ones.
WINDOW = 1_000_000
#: Bytes of text of the sample that document pivots come from, the most pivots, and the radius of a pivot's own region.
SAMPLE_BYTES = 4 << 20
PIVOTS = 1024
RADIUS = 0.3
#: (document, pivot) meetings on a shingle that are counted at once.
MEETINGS = 1 << 19
#: Bytes of sets up to which a region is joined within a task.
REGION_BYTES = 8 << 20
#: Points up to which a cell is compared by bounds; a larger one is a region as it is.
CELL_POINTS = 4096
#: Least bits of a bitmap.
BITS = 1024
REGION_PIVOTS, LEVELS = 8, 4


def sets_of(batch: pa.RecordBatch, text_col: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct k-word shingles, ascending; the whole sequence as one where there are fewer words."""
    buf, offs = V.buffer(batch.column(text_col))
    w = V.words(V.lower(buf), offs)
    s, first = V.shingles(w, k)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        own = np.array([V.mix(np.array([len(w.hash[w.first[d] : w.first[d + 1]])], V.U) + np.bitwise_xor.reduce(V.mix(w.hash[w.first[d] : w.first[d + 1]] + np.arange(w.counts[d]).astype(V.U) * V.U(0x9E3779B97F4A7C15))))[0] for d in short], V.U)
        s = np.insert(s, first[short], own)
        first = first + np.concatenate([[0], np.cumsum(np.isin(np.arange(len(first) - 1), short))])
    return V.distinct_sets(s, first)


def need(n: np.ndarray | int, num: int, den: int):
    """Least overlap that a set of n needs with any set it links to."""
    return -(-num * n // den)


def prefix_len(n, num: int, den: int):
    return n - need(n, num, den) + 1


def rank(values: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The fixed order of shingles: by hash, common ones (ascending hashes, ranks) last and the more frequent the later."""
    key = values >> V.U(1)
    h, r = common
    if len(h):
        at = np.searchsorted(h, values)
        at[at == len(h)] = 0
        hit = h[at] == values
        key[hit] = V.U(1 << 63) + r[at[hit]]
    return key


def _common(docs: DataFrame, text_col: str, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles: counted within tasks where they occur in two texts or more, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(WINDOW, V.U)
        used = 0

        def flush(part: np.ndarray) -> pa.RecordBatch:
            part.sort()
            at = np.flatnonzero(part[1:] == part[:-1])  # places that equal the next
            new = np.concatenate([[True], np.diff(at) > 1]) | (np.concatenate([[True], part[at[1:]] != part[at[:-1]]])) if len(at) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            c = np.diff(np.append(start, len(at))) + 1
            return pa.RecordBatch.from_arrays([pa.array(part[at[start]].view(np.int64)), pa.array(c)], ["h", "c"])

        for b in V.slices(batches, text_col):
            v, _ = sets_of(b, text_col, k)
            while len(v):
                n = min(len(v), WINDOW - used)
                held[used : used + n] = v[:n]
                used, v = used + n, v[n:]
                if used == WINDOW:
                    yield flush(held)
                    used = 0
        if used:
            yield flush(held[:used])

    got = cut(docs.select(text_col).mapInArrow(freed(count), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "jaccard-counts")
    top = got.where(F.col("c") >= least_count(got, "c", most)).toArrow()  # at most `most` pairs of numbers
    drop(got)
    h, c = top.column("h").to_numpy().view(V.U), top.column("c").to_numpy()
    by_count = np.lexsort((h, c))
    places = np.empty(len(h), V.U)
    places[by_count] = np.arange(len(h), dtype=V.U)
    by_hash = np.argsort(h)
    return h[by_hash], places[by_hash]


def bitmap(v: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set, as 64-bit words: bit i tells whether an odd number of members fall on it."""
    size = max(BITS, 1 << max(len(v) - 1, 0).bit_length())
    odd = np.bincount((V.mix(v + V.U(0xA4093822299F31D0)) & V.U(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(odd).view(V.U)


def fold(rows: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of the same sets with fewer bits."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


@dataclass
class Pivots:
    """Document pivots: for each shingle of theirs (ascending) the pivots that hold it."""

    shingle: np.ndarray
    first: np.ndarray
    pivot: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Pivots:
        size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, V.U)
        who = np.repeat(np.arange(len(sets), dtype=np.int32), size)
        order = np.argsort(flat, kind="stable")
        shingle, first = np.unique(flat[order], return_index=True)
        return cls(shingle, np.append(first, len(flat)), who[order], size)

    def overlaps(self, v: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Sizes of the intersections of sets with all pivots, in runs: the run's first set, and a row per set."""
        m = len(self.size)
        at = np.minimum(np.searchsorted(self.shingle, v), max(len(self.shingle) - 1, 0))
        hit = np.flatnonzero(self.shingle[at] == v) if len(self.shingle) else np.zeros(0, np.int64)
        at = at[hit]
        times = self.first[at + 1] - self.first[at]
        meets = np.concatenate([[0], np.cumsum(times)])
        bound = np.searchsorted(hit, first)  # hits before each set
        a = 0
        while a < len(first) - 1:
            z = a + 1
            while z < len(first) - 1 and meets[bound[z + 1]] - meets[bound[a]] <= MEETINGS and (z + 1 - a) * m <= MEETINGS:
                z += 1
            lo, hi = bound[a], bound[z]
            k = times[lo:hi]
            post = np.repeat(self.first[at[lo:hi]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            doc = np.repeat(np.searchsorted(first, hit[lo:hi], side="right") - 1 - a, k)
            yield a, np.bincount(doc * m + self.pivot[post], minlength=(z - a) * m).reshape(z - a, m)
            a = z

    def regions(self, v: np.ndarray, first: np.ndarray, num: int, den: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether each set is at home outside; and (set, pivot, distance, linked) of each region it takes part in."""
        n = np.diff(first)
        e = 1 - num / den
        outside = n > 0
        got = []
        for a, o in self.overlaps(v, first) if len(self.size) else ():
            own = n[a : a + len(o), None]
            union = own + self.size[None, :] - o
            d = np.where(own > 0, 1 - o / np.maximum(union, 1), 2.0)
            near = d.min(1)
            home = near <= radius
            outside[a : a + len(o)] &= ~home
            window = np.where(home, np.minimum(radius + e, near + 2 * e), radius + e)
            i, p = np.nonzero(d <= window[:, None] + 1e-9)
            got.append((i + a, p, d[i, p], den * o[i, p] >= num * union[i, p]))
        if not got:
            z = np.zeros(0, np.int64)
            return outside, z, z, z.astype(float), z.astype(bool)
        return outside, *(np.concatenate(x) for x in zip(*got, strict=True))


def _pivots(docs: DataFrame, text_col: str, k: int, sample_bytes: int, most: int, radius: float) -> Pivots:
    """Pivots among the non-empty texts with the least hashes, each text once, of about sample_bytes in all."""
    text = docs.select(F.col(text_col).alias("t")).where(F.octet_length("t") > 0)
    total = text.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    share = min(1.0, sample_bytes / max(total, 1))
    h = F.shiftrightunsigned(F.xxhash64("t"), 32)
    few = text.select("t", h.alias("h")).where(F.col("h") < int(share * (1 << 32)))
    few = few.groupBy("h").agg(F.first("t").alias("t")).orderBy("h").toArrow()  # about sample_bytes at most: copies count once
    sets: dict[bytes, np.ndarray] = {}
    for b in V.slices(few.to_batches(), "t"):
        v, first = sets_of(b, "t", k)
        for a, z in zip(first[:-1], first[1:], strict=True):
            if z > a:
                sets.setdefault(v[a:z].tobytes(), v[a:z])
    return Pivots.of(apart(list(sets.values()), most, 2 * radius))


def apart(sets: list[np.ndarray], most: int, radius: float) -> list[np.ndarray]:
    """Sets more than radius apart, taken greedily in their order; of these the most with the most sets around them."""
    if not sets:
        return []
    every = Pivots.of(sets)
    first = np.concatenate([[0], np.cumsum(every.size)])
    taken = np.zeros(len(sets), bool)
    around = np.zeros(len(sets), np.int64)
    for a, o in every.overlaps(np.concatenate(sets), first):
        for i, row in enumerate(o, a):
            near = taken & (1 - row / (every.size[i] + every.size - row) <= radius)
            if near.any():
                around[near] += 1
            else:
                taken[i] = True
    at = np.flatnonzero(taken)
    at = at[np.argsort(-around[at], kind="stable")][:most]
    return [sets[i] for i in at]


def _points(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, common, pivots, radius: float) -> DataFrame:
    """doc_id, n, the set's 128-bit key, the regions of document pivots it takes part in, and of sets at home outside the
    ranks of the prefix and the bitmap."""
    kind = pa.list_(pa.struct([("p", pa.int32()), ("d", pa.float64()), ("ok", pa.bool_())]))

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked_last = common.value
        for b in V.slices(batches, "text"):
            v, first = sets_of(b, "text", k)
            n = np.diff(first)
            h1, h2 = set_keys(v, first)
            outside, doc, p, d, ok = pivots.value.regions(v, first, num, den, radius)
            at = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32))
            near = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(p.astype(np.int32)), pa.array(d), pa.array(ok)], fields=list(kind.value_type)))
            key = rank(v, ranked_last)
            order = np.lexsort((key, np.repeat(np.arange(len(n)), n)))
            place = np.arange(len(v)) - np.repeat(first[:-1], n)
            size = np.where(outside, prefix_len(n, num, den), 0)
            pre = key[order][place < np.repeat(size, n)]
            offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            bits = pa.array([bitmap(v[x:y]).tobytes() if out else None for x, y, out in zip(first[:-1], first[1:], outside, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(h1), pa.array(h2), near, pa.ListArray.from_arrays(pa.array(offs), pa.array(pre.view(np.int64))), bits], ["doc_id", "n", "h1", "h2", "near", "prefix", "bits"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(freed(point), f"doc_id {id_type(docs, id_col)}, n long, h1 long, h2 long, near array<struct<p:int,d:double,ok:boolean>>, prefix array<long>, bits binary")


def set_keys(v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set's members."""
    with np.errstate(over="ignore"):
        sums = []
        for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
            c = np.concatenate([[V.U(0)], np.cumsum(V.mix(v + V.U(salt)), dtype=V.U)])
            sums.append((c[first[1:]] - c[first[:-1]]).view(np.int64))
    return sums[0], sums[1]


# ---------------------------------------------------------------- cells


class Bits:
    """Bitmaps of a group of sets of n members, compared at the size of the smaller one."""

    def __init__(self, n: np.ndarray, bits: list[np.ndarray], num: int, den: int):
        self.n, self.bits, self.num, self.den = n, bits, num, den
        self.words = np.array([len(x) for x in bits])
        self.kinds = np.unique(self.words).tolist()
        self.place = np.zeros(len(bits), np.int64)
        self.rows: dict[tuple[int, int], np.ndarray] = {}
        for w in self.kinds:
            at = np.flatnonzero(self.words == w)
            self.place[at] = np.arange(len(at))
            self.rows[w, w] = np.array([bits[i] for i in at])

    def _folded(self, w: int, t: int) -> np.ndarray:
        if (w, t) not in self.rows:
            self.rows[w, t] = fold(self.rows[w, w], t)
        return self.rows[w, t]

    def admitted(self, i: int, js: np.ndarray) -> np.ndarray:
        """Those of js whose bitmaps and sizes admit a link with i: sets that link differ in at most
        (den - num) / (den + num) of n_i + n_j members."""
        js = js[self.den * np.minimum(self.n[i], self.n[js]) >= self.num * np.maximum(self.n[i], self.n[js])]
        differ = np.zeros(len(js), np.int64)
        for w in self.kinds:
            k = np.flatnonzero(self.words[js] == w) if len(self.kinds) > 1 else slice(None)
            t = min(w, int(self.words[i]))
            differ[k] = np.bitwise_count(self._folded(w, t)[self.place[js[k]]] ^ fold(self.bits[i][None, :], t)).sum(1, dtype=np.int64)
        return js[differ * (self.den + self.num) <= (self.den - self.num) * (self.n[i] + self.n[js])]


def cell_ties(member: np.ndarray, n: np.ndarray, bits: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Ties (a, b) that connect all members of a cell between which the bitmaps admit a link."""
    m = len(member)
    label = np.arange(m)
    ties: list[tuple[int, int]] = []
    maps = Bits(n, bits, num, den)
    for i in range(m - 1):
        if len(ties) == m - 1:
            break
        js = np.arange(i + 1, m)
        for j in maps.admitted(i, js[label[js] != label[i]]):
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                ties.append((int(member[i]), int(member[j])))
    return ties


def _cells(points: DataFrame) -> DataFrame:
    """(cell, rid, m, r0): the members of each cell of two points or more; of cells with equal members one.

    m is the cell's number of members and r0 its least.  Rows are 16 bytes and a cell's are read in a stream, so a
    common shingle's cell needs no memory of its own.
    """
    rows = points.select("rid", F.explode("prefix").alias("s"))
    w = W.partitionBy("s")
    some = lambda *x: F.sum(F.shiftright(F.xxhash64("rid", *x), 20)).over(w)
    meet = rows.withColumns({"m": F.count("*").over(w), "r0": F.min("rid").over(w), "x": some(), "y": some(F.lit(7))}).where("m > 1")
    meet = cut(meet, "jaccard-meet")
    one = meet.groupBy("m", "x", "y").agg(F.min("s").alias("s"))
    return meet.join(one.hint("merge"), ["m", "x", "y", "s"], "left_semi").select(F.col("s").alias("cell"), "rid", "m", "r0")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys in a partition sorted by key."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        ks = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(ks[1:] != ks[:-1]) + 1).tolist(), len(ks)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if held and ks[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = ks[a]
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def _tied(points: DataFrame, cells: DataFrame, num: int, den: int, most: int) -> DataFrame:
    def ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "cell"):
            bits = [np.frombuffer(x.as_py(), V.U) for x in t.column("bits")]
            got = cell_ties(t.column("rid").to_numpy(), t.column("n").to_numpy(), bits, num, den)
            if got:
                a, b = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = cells.where(F.col("m") <= most).select("cell", "rid").join(points.select("rid", "n", "bits").hint("merge"), "rid")
    small = rows.repartition("cell").sortWithinPartitions("cell", "rid").mapInArrow(freed(ties), "a long, b long")
    # a larger cell's members are tied as they are: a region too large is no loss, a region too small would be
    return small.unionByName(cells.where((F.col("m") > most) & (F.col("rid") != F.col("r0"))).select(F.col("r0").alias("a"), F.col("rid").alias("b")))


# ---------------------------------------------------------------- regions


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def overlaps(p: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of one ascending set with others, none of them empty."""
    flat = np.concatenate(others)
    at = np.searchsorted(p, flat)
    at[at == len(p)] = 0
    starts = np.concatenate([[0], np.cumsum([len(x) for x in others[:-1]])]).astype(np.int64)
    return np.add.reduceat((p[at] == flat).astype(np.int64), starts)


def join_region(sets: list[np.ndarray], num: int, den: int, leaf: int = 24, pivots: int = 16) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links that connect all linked points of a region: component label (least index) per point, and the links found.

    Pivots, each far from those before it, are compared with all points; points within e of a pivot link to it.  If the
    windows of the pivots' Voronoi regions are narrow, the regions - each with the boundary points of others, which lie
    within nearest + 2e of its pivot - are joined recursively.  Where they are wide (points that are all near, or all
    far) the points are taken one by one, those of the smallest component first: a point is compared with those points of
    other components that neither the triangle inequality over all pivots nor sizes and bitmaps keep apart from it, and is
    then done.  That ends when one component is left.
    """
    m = len(sets)
    root = np.arange(m)  # always flat: the label of each point
    links: list[tuple[int, int]] = []
    e = 1 - num / den + 1e-9
    n = np.array([len(s) for s in sets], np.int64)
    maps = Bits(n, [bitmap(s) for s in sets], num, den) if m > 2 else None

    def tie(i: int, j: int) -> None:
        a, b = sorted((root[i], root[j]))
        if a != b:
            root[root == b] = a
            links.append((i, j))

    def against(p: int, idx: np.ndarray) -> np.ndarray:
        """Distances of idx to point p; ties those that link."""
        o = overlaps(sets[p], [sets[i] for i in idx])
        u = n[p] + n[idx] - o
        for i in idx[den * o >= num * u]:
            tie(p, int(i))
        return 1 - o / u

    def solve(idx: np.ndarray) -> None:
        if len(idx) < 2 or len(np.unique(root[idx])) == 1:
            return
        rows: list[np.ndarray] = []
        chosen = [int(np.flatnonzero(idx == idx[0])[0])]
        if len(idx) > leaf:
            far = np.full(len(idx), np.inf)
            while True:
                rows.append(against(int(idx[chosen[-1]]), idx))
                far = np.minimum(far, rows[-1])
                nxt = int(np.argmax(far))
                if len(rows) == pivots or far[nxt] <= e or len(np.unique(root[idx])) == 1:
                    break
                chosen.append(nxt)
        dist = np.array(rows).reshape(len(rows), len(idx))
        if len(rows) > 1:
            near, least = dist.argmin(0), dist.min(0)
            parts = [idx[dist[k] <= least + 2 * e] for k in range(len(rows)) if (near == k).any()]
            if sum(map(len, parts)) <= 1.3 * len(idx) and max(map(len, parts)) <= 0.8 * len(idx):
                for part in parts:
                    solve(part)
                return
        left = np.ones(len(idx), bool)
        left[chosen[: len(rows)]] = False  # the pivots have met everything
        while True:
            at = np.flatnonzero(left)
            label, count = np.unique(root[idx[at]], return_counts=True)
            if len(label) < 2:
                return
            own = root[idx[at]] == label[count.argmin()]
            p = int(at[own][0])
            js = at[root[idx[at]] != root[idx[p]]]
            if len(rows) and len(js):
                js = js[(np.abs(dist[:, js] - dist[:, [p]]) <= e).all(0)]
            near = maps.admitted(int(idx[p]), idx[js]) if maps else idx[js]
            if len(near):
                against(int(idx[p]), near)
            left[p] = False

    solve(np.argsort(n, kind="stable"))
    return root, links


def _region_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows (region, rid, members) -> (a, b): each linked point b with the least point a of its class in the region."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "region"):
            rid = t.column("rid").to_numpy()
            one = np.concatenate([[True], rid[1:] != rid[:-1]])  # a set may come from several rows of one id
            t, rid = t.filter(pa.array(one)), rid[one]
            sets = [np.frombuffer(x.as_buffer(), V.U) for c in t.column("members").chunks for x in c]
            label, _ = join_region(sets, num, den)
            b = np.flatnonzero(label != np.arange(len(label)))
            a = label[b]
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(rid[a]), pa.array(rid[b])], ["a", "b"])

    return rows.repartition("region").sortWithinPartitions("region", "rid").mapInArrow(freed(join), "a long, b long")


def _pivot_level(rows: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """One level of large regions as a Spark job: the pivots of a region go to its points wherever they are.

    Returns the links to pivots, and the points that remain: those that for no pivot are linked to it and farther than e
    from everything outside its links.
    """
    order = W.partitionBy("region").orderBy(F.xxhash64("rid"), "rid")
    first = rows.select("region", "rid").withColumn("k", F.row_number().over(order)).where(F.col("k") <= REGION_PIVOTS)
    each = F.array_sort(F.collect_list(F.struct("k", "rid", "members")))  # at most REGION_PIVOTS
    pivots = cut(rows.join(F.broadcast(first) if first.count() <= 10_000 else first, ["region", "rid"]).groupBy("region").agg(each.alias("pivots")), "jaccard-pivots")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for region, rid, members, ps in zip(b.column("region").to_pylist(), b.column("rid").to_pylist(), b.column("members"), b.column("pivots").to_pylist(), strict=True):
                s = np.frombuffer(members.as_buffer(), V.U)
                for p in ps:
                    q = np.frombuffer(p["members"], V.U)
                    o = overlap(s, q)
                    u = len(s) + len(q) - o
                    out.append((region, rid, p["rid"], 1 - o / u, den * o >= num * u))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["region", "rid", "pivot", "d", "ok"])

    few = pivots.count() <= 200  # each holds some tens of kilobytes
    at = cut(rows.join(F.broadcast(pivots) if few else pivots.hint("merge"), "region").mapInArrow(freed(measure), "region long, rid long, pivot long, d double, ok boolean"), "jaccard-distances")
    least = at.where("not ok").groupBy("region", "pivot").agg(F.min("d").alias("least"))
    e = 1 - num / den
    settled = F.col("ok") & (F.col("least").isNull() | (F.col("d") < F.col("least") - e - 1e-9)) | (F.col("rid") == F.col("pivot"))
    gone = at.join(F.broadcast(least) if few else least, ["region", "pivot"], "left").where(settled).select("region", "rid").distinct()
    return at.where("ok and rid <> pivot").select(F.col("pivot").alias("a"), F.col("rid").alias("b")), cut(rows.join(gone, ["region", "rid"], "left_anti"), "jaccard-rest")


def _blocks(rows: DataFrame, size: DataFrame, most_bytes: int) -> DataFrame:
    """Large regions as all pairs of their blocks, each pair a region that fits; a row goes to as many as there are blocks."""
    n = F.greatest(F.lit(2), F.ceil(2 * F.col("b") / most_bytes)).cast("int")
    r = rows.join(size.where(F.col("b") > most_bytes).select("region", n.alias("c")), "region").withColumn("own", F.pmod(F.xxhash64("rid", F.lit(3)), F.col("c")).cast("int"))
    r = r.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    return r.select(F.xxhash64("region", F.least("own", "o"), F.greatest("own", "o")).alias("region"), "rid", "members")


def _near(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of regions of document pivots: the links to pivots (a, b), and (rid, region) of the points that are left to join."""
    at = cut(points.select("rid", F.explode("near").alias("x")).select("rid", "x.*"), "jaccard-near")
    least = at.groupBy("p").agg(F.min(F.when(~F.col("ok"), F.col("d"))).alias("least"), F.min(F.when(F.col("d") == 0, F.col("rid"))).alias("pivot"))  # a row a pivot
    at = at.join(F.broadcast(least), "p")
    return at.where("ok and rid <> pivot").select(F.col("pivot").alias("a"), F.col("rid").alias("b")), at


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, most_common: int, most_bytes: int, cell_points: int, sample_bytes: int, pivots: int, radius: float) -> DataFrame:
    """doc_id, n, h1, h2, cls (a number of the class, null for empty sets) and component_id of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    common = spark.sparkContext.broadcast(_common(docs, text_col, k, most_common))
    chosen = spark.sparkContext.broadcast(_pivots(docs, text_col, k, sample_bytes, pivots, radius))
    each = cut(_points(docs, id_col, text_col, k, num, den, common, chosen, radius), "jaccard-documents")
    common.destroy()
    chosen.destroy()
    kinds = each.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("near", "prefix", "bits")])
    points = cut(kinds.withColumn("rid", F.monotonically_increasing_id()), "jaccard-points")
    slim = cut(each.select("doc_id", "n", "h1", "h2"), "jaccard-slim")
    drop(each)
    direct, at = _near(points)
    e = 1 - num / den
    # settled: linked to the pivot, and farther than e from all that do not
    settled = F.col("ok") & (F.col("least").isNull() | (F.col("d") < F.col("least") - e - 1e-9))
    unsettled = at.groupBy("rid").agg(F.bool_or(settled).alias("gone"), F.collect_list(F.struct("p", "least", "ok")).alias("ps")).where("not gone")  # at most PIVOTS
    regions = cut(unsettled.select("rid", F.explode(F.transform(F.filter("ps", lambda x: x["least"].isNotNull()), lambda x: -1 - x["p"].cast("long"))).alias("region")), "jaccard-regions")
    outside = points.where(F.size("prefix") > 0)
    ties = components(_tied(points, cut(_cells(outside), "jaccard-cells"), num, den, cell_points))
    both = regions.unionByName(ties.select(F.col("node").alias("rid"), F.col("component").alias("region")))
    tied = both.groupBy("rid").agg(F.collect_list("region").alias("regions"))  # at most PIVOTS + 1
    tied = cut(points.select("rid", "h1", "h2", "n", "doc_id").join(tied.hint("merge"), "rid"), "jaccard-tied")
    links = _links(docs, tied, text_col, id_col, k, num, den, most_bytes).unionByName(direct)
    found = components(cut(links, "jaccard-links"))
    named = points.select("rid", "h1", "h2", "n", "doc_id").join(found.withColumnRenamed("node", "rid").hint("merge"), "rid")
    named = cut(named, "jaccard-named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = named.join(least, "component").select("h1", "h2", "n", "least", "component")
    # one row per set; a set with many documents makes skewed keys here, which AQE splits
    own = points.select("h1", "h2", "n", "doc_id", "rid").join(named.hint("merge"), ["h1", "h2", "n"], "left")
    own = own.select("h1", "h2", "n", F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("component", "rid").alias("cls"))
    out = slim.join(own.hint("merge"), ["h1", "h2", "n"], "left")
    return out.select("doc_id", "n", "h1", "h2", "cls", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


_OPTIONS = {"k": 4, "num": 85, "den": 100, "most_common": MOST_COMMON, "most_bytes": REGION_BYTES, "cell_points": CELL_POINTS, "sample_bytes": SAMPLE_BYTES, "pivots": PIVOTS, "radius": RADIUS}


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Two documents link when den * |intersection| >= num * |union| of their sets of k-word shingles.
    """
    return _classes(docs, id_col, text_col, **_OPTIONS | options).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _links(docs: DataFrame, tied: DataFrame, text_col: str, id_col: str, k: int, num: int, den: int, most_bytes: int) -> DataFrame:
    """Links within regions, from sets made anew of the texts of the points' first documents."""
    n = tied.count()
    want = tied.select(F.col("doc_id").alias("__want"), "rid", "regions", F.col("h1").alias("__h1"), F.col("h2").alias("__h2"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    texts = texts.join(F.broadcast(want) if n <= BROADCAST_ROWS else want.hint("merge"), F.col("__id").eqNullSafe(F.col("__want")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in V.slices(batches, "__text"):
            v, first = sets_of(b, "__text", k)
            h1, h2 = set_keys(v, first)
            # rows of one id may have other texts than the point's
            own = np.flatnonzero((h1 == b.column("__h1").to_numpy()) & (h2 == b.column("__h2").to_numpy()))
            raw, take = v.tobytes(), pa.array(own)
            yield pa.RecordBatch.from_arrays([b.column("regions").take(take), b.column("rid").take(take), pa.array([raw[8 * first[i] : 8 * first[i + 1]] for i in own], pa.binary())], ["regions", "rid", "members"])

    made = texts.mapInArrow(freed(build), "regions array<long>, rid long, members binary").select(F.explode("regions").alias("region"), "rid", "members")
    size = cut(tied.select(F.explode("regions").alias("region"), "n").groupBy("region").agg((F.sum("n") * 8).alias("b"), F.count("*").alias("m")), "jaccard-sizes")
    large = size.where((F.col("b") > most_bytes) & (F.col("m") > 2)).select("region")
    if large.isEmpty():
        return _region_links(made, num, den)
    here = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large.hint("merge")
    out = cut(_region_links(made.join(here, "region", "left_anti"), num, den), "jaccard-found")
    rows = cut(made.join(here, "region", "left_semi").dropDuplicates(["region", "rid"]), "jaccard-large")
    for _ in range(LEVELS):
        got, left = _pivot_level(rows, num, den)
        drop(rows)
        out = out.unionByName(got)
        size = cut(left.groupBy("region").agg(F.sum(F.octet_length("members")).alias("b"), F.count("*").alias("m")), "jaccard-sizes")
        large = size.where((F.col("b") > most_bytes) & (F.col("m") > 2)).select("region")
        out = out.unionByName(cut(_region_links(left.join(large, "region", "left_anti"), num, den), "jaccard-found"))
        rows = cut(left.join(large, "region", "left_semi"), "jaccard-large")
        drop(left)
        if rows.isEmpty():
            return out
    return out.unionByName(_region_links(_blocks(rows, size, most_bytes), num, den))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class: that with the least id (null last), then the least key of its set.  Rows with empty
    sets all stay.  The other columns of docs, whatever their names, stay as they are."""
    o = _OPTIONS | options
    rows = cut(_classes(docs, id_col, text_col, **o), "jaccard-classes")
    stay = rows.where("n > 0").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h1", "h2")).alias("s"))
    name_id, name_odd = unused(docs, "__id", "__odd")  # as docs may have columns of any names
    stay = cut(stay.select(F.col("s.doc_id").alias("__id"), F.col("s.h1").alias("__h1"), F.col("s.h2").alias("__h2")), "jaccard-stay")
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("c"))
    odd = cut(ids.where("c > 1 or doc_id is null").select(F.col("doc_id").alias(name_odd)), "jaccard-odd")
    empty = rows.where("n = 0").select(F.col("doc_id").alias("__id"))
    keep = hinted(cut(stay.select("__id").unionByName(empty).withColumnRenamed("__id", name_id), "jaccard-keep"))
    if odd.isEmpty():
        return docs.join(keep, F.col(id_col) == F.col(name_id), "left_semi")
    # ids that several rows share, or none: a row is told by its id and its set
    is_odd = F.col(id_col).eqNullSafe(F.col(name_odd))
    odd = hinted(odd)
    plain = docs.join(odd, is_odd, "left_anti").join(keep, F.col(id_col) == F.col(name_id), "left_semi")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in V.slices(batches, "__text"):
            v, first = sets_of(b, "__text", o["k"])
            h1, h2 = set_keys(v, first)
            yield pa.RecordBatch.from_arrays([b.column("__row"), b.column("__key"), pa.array(np.diff(first)), pa.array(h1), pa.array(h2)], ["__row", "__key", "__n", "__a", "__b"])

    each = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    row = docs.join(odd, is_odd, "left_semi").select(each.alias("__row"), F.col(id_col).alias("__key"), F.col(text_col).alias("__text"))
    kind = row.schema["__row"].dataType.simpleString()
    row = cut(row.mapInArrow(freed(keyed), f"__row {kind}, __key {id_type(docs, id_col)}, __n long, __a long, __b long"), "jaccard-rows")
    same = F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__a") == F.col("__h1")) & (F.col("__b") == F.col("__h2"))
    one = row.where("__n > 0").join(stay.hint("merge"), same, "left_semi").dropDuplicates(["__key", "__a", "__b"])
    back = row.where("__n = 0").unionByName(one).select("__row.*")
    return plain.unionByName(back)
