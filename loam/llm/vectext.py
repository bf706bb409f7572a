"""Whole-text tokenisation over Arrow string columns, vectorised with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  In UTF-8 those six bytes never
occur inside a longer character, so cutting bytes gives the same words as cutting characters.
Words are identified by a 64-bit hash (a polynomial in the word's bytes, then an avalanche).
Two different words share a hash with probability 2**-64 per pair.

Work is done in segments of about ``SEG`` bytes cut at white space, so that the scratch arrays
stay bounded however long a document is; only a single word longer than that makes a longer segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEG = 1 << 18
U = np.uint64
_P = 0x9E3779B97F4A7C15
_M1, _M2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
_S33 = U(33)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche: every input bit reaches every output bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


class _Powers:
    """p**i and p**-i modulo 2**64."""

    held: tuple[np.ndarray, np.ndarray] | None = None

    @staticmethod
    def make(n: int) -> tuple[np.ndarray, np.ndarray]:
        inv = pow(_P, -1, 1 << 64)
        with np.errstate(over="ignore"):
            return tuple(np.concatenate([[U(1)], np.full(n - 1, U(x))]).cumprod(dtype=U) for x in (_P, inv))

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """At least n of each; kept for segments of the usual length, made anew for longer ones."""
        if n > SEG + 1:
            return cls.make(n)
        if cls.held is None:
            cls.held = cls.make(SEG + 1)
        return cls.held


@dataclass
class Words:
    """Words of a run of documents: byte span, 64-bit hash; ``first[d]:first[d+1]`` are those of document d."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def _cuts(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Segments of about SEG bytes that end after white space or at a document's end."""
    at, n = 0, len(buf)
    while at < n:
        to = at + SEG
        if to >= n:
            yield at, n
            return
        k = int(np.searchsorted(offsets, to, side="right")) - 1
        doc = int(offsets[k])
        window = np.flatnonzero(_SPACE[buf[max(at, to - 65536) : to]])
        best = max(doc if doc > at else 0, max(at, to - 65536) + int(window[-1]) + 1 if len(window) else 0)
        if best <= at:  # a very long word: go on to where it ends
            step = to
            while step < n:
                ahead = np.flatnonzero(_SPACE[buf[step : step + SEG]])
                if len(ahead):
                    step += int(ahead[0]) + 1
                    break
                step = min(n, step + SEG)
            nxt = int(np.searchsorted(offsets, at, side="right"))
            best = min(step, max(int(offsets[nxt]), at + 1)) if nxt < len(offsets) else step
        yield at, best
        at = best


def words(buf: np.ndarray, offsets: np.ndarray, member: Callable[[np.ndarray], np.ndarray] | None = None) -> Words:
    """Words of each document; member tells which bytes belong to one (white space must not), where they are others than above."""
    starts, ends, hashes = [], [], []
    with np.errstate(over="ignore"):
        for a, b in _cuts(buf, offsets):
            part = buf[a:b]
            word = ~_SPACE[part] if member is None else member(part)
            cut = offsets[np.searchsorted(offsets, a, side="right") : np.searchsorted(offsets, b, side="left")] - a
            before = np.empty_like(word)
            before[0] = False
            before[1:] = word[:-1]
            before[cut] = False
            after = np.empty_like(word)
            after[-1] = False
            after[:-1] = word[1:]
            after[cut - 1] = False
            s = np.flatnonzero(word & ~before)
            e = np.flatnonzero(word & ~after) + 1
            up, down = _Powers.get(b - a + 1)
            h = np.zeros(b - a + 1, U)
            np.cumsum((part.astype(U) + U(1)) * up[: b - a], out=h[1:])
            hashes.append(mix((h[e] - h[s]) * down[s] + (e - s).astype(U)))
            starts.append(s + a)
            ends.append(e + a)
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    start = cat(starts, np.int64)
    return Words(start, cat(ends, np.int64), cat(hashes, U), np.searchsorted(start, offsets))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words that stays in a document, and where each document's runs begin."""
    n, counts = len(w.hash), w.counts
    runs = np.maximum(counts - k + 1, 0)
    first = np.concatenate([[0], np.cumsum(runs)])
    if n < k or first[-1] == 0:
        return np.zeros(0, U), first
    with np.errstate(over="ignore"):
        h = w.hash[: n - k + 1].copy()
        for j in range(1, k):
            h = h * U(_P) + w.hash[j : n - k + 1 + j]
        h = mix(h)
    at = np.repeat(w.first[:-1] - first[:-1], runs) + np.arange(first[-1])
    return h[at], first


def distinct_sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values in ascending order, and where each document's begin."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[keep], d[keep]
    return v, np.searchsorted(d, np.arange(len(first)))


def per_doc_sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(x)])
    return c[first[1:]] - c[first[:-1]]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 * SEG) -> Iterator[pa.RecordBatch]:
    """Rows in order, in batches whose texts hold about ``most`` bytes; one longer text makes a batch of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        at = 0
        while at < len(size):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def hash_words(words_: list[str]) -> np.ndarray:
    """Hashes of given words, as words() makes them."""
    buf, offs = buffer(pa.array(words_, pa.string()))
    w = words(buf, offs)
    if len(w.hash) != len(words_):
        raise ValueError("each entry must be exactly one word")
    return w.hash
