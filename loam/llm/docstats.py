"""Statistics of whole texts, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from loam.llm import vectext as V


def _lut(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL = _lut(b"#*$%&|<>")
_UPPER = _lut(bytes(range(65, 91)))
_DIGIT = _lut(b"0123456789")
_PUNCT = _lut(b".,;:?!")
_BANG = _lut(b"!")
_LINE = _lut(b"\n")


def _count(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """True bytes per document."""
    at = np.flatnonzero(mask)
    return np.diff(np.searchsorted(at, offs))


def dup_lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines (split at \\n) with a word, and those of them equal to an earlier line of the text."""
    n = len(offs) - 1
    lines, dups = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(n):
        parts = [x for x in buf[offs[d] : offs[d + 1]].tobytes().split(b"\n") if x and not x.isspace()]
        lines[d], dups[d] = len(parts), len(parts) - len(set(parts))
    return lines, dups


def repeat_words(w: V.Words, k: int = 5) -> np.ndarray:
    """Words in k-word windows that occur twice or more in their text, the first occurrence included."""
    s, first = V.shingles(w, k)
    out = np.zeros(len(w.first) - 1, np.int64)
    if not len(s):
        return out
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((s, doc))
    v, d = s[order], doc[order]
    same = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    again = np.zeros(len(v), bool)
    again[1:] |= same
    again[:-1] |= same
    at = order[again]
    if not len(at):
        return out
    place = at - first[doc[at]] + w.first[doc[at]]  # the window's first word
    edge = np.zeros(len(w.hash) + k + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + k, -1)
    inside = np.cumsum(edge)[: len(w.hash)] > 0
    return V.per_doc_sum(inside, w.first)


def base(buf: np.ndarray, offs: np.ndarray, w: V.Words) -> dict[str, np.ndarray]:
    """n_words, word_chars (code points), n_symbols, n_dup_lines, n_repeat_words of each text."""
    inner = ~V._SPACE[buf] & ((buf & 0xC0) != 0x80)
    lines, dups = dup_lines(buf, offs)
    return {"n_words": w.counts.astype(np.int64), "word_chars": _count(inner, offs), "n_symbols": _count(_SYMBOL[buf], offs), "n_dup_lines": dups, "n_repeat_words": repeat_words(w), "n_lines": lines}


def texts(batch: pa.RecordBatch, col: str) -> tuple[np.ndarray, np.ndarray, V.Words]:
    buf, offs = V.buffer(batch.column(col))
    return buf, offs, V.words(buf, offs)


#: Names of features(), in order.
FEATURES = ["log_words", "word_length", "symbols", "upper", "digits", "punctuation", "bangs", "spaces", "dup_lines", "repeats", "distinct", "line_length", "non_ascii", "byte_entropy"]


def features(buf: np.ndarray, offs: np.ndarray, w: V.Words) -> np.ndarray:
    """Transformed statistics, one row per text: shares as square roots, which evens their spread, sizes as logarithms."""
    b = base(buf, offs, w)
    size = np.maximum(np.diff(offs), 1)
    n = np.maximum(b["n_words"], 1)
    share = lambda mask: np.sqrt(_count(mask, offs) / size)
    distinct = np.diff(V.distinct_sets(w.hash, w.first)[1])
    ent = np.zeros(len(size))
    for d in range(len(size)):
        if offs[d + 1] > offs[d]:
            p = np.bincount(buf[offs[d] : offs[d + 1]], minlength=256)
            p = p[p > 0] / size[d]
            ent[d] = -(p * np.log2(p)).sum()
    return np.column_stack([
        np.log1p(b["n_words"]), np.log1p(b["word_chars"] / n), share(_SYMBOL[buf]), share(_UPPER[buf]), share(_DIGIT[buf]), share(_PUNCT[buf]), share(_BANG[buf]), share(V._SPACE[buf]),
        np.sqrt(b["n_dup_lines"] / np.maximum(b["n_lines"], 1)), np.sqrt(b["n_repeat_words"] / n), distinct / n, np.log1p(b["n_words"] / np.maximum(b["n_lines"], 1)), share(buf >= 128), ent,
    ])
