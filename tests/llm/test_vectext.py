import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm import docstats as D
from loam.llm import vectext as V

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall(text or "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é✓\n\t\x0b\x1c ", max_size=40)), max_size=8))
def test_words_are_the_pattern_s_words(texts):
    buf, offs = V.buffer(pa.array(texts, pa.string()))
    w = V.words(buf, offs)
    got = [[buf[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [split(t) for t in texts]
    known = {}
    for h, a, b in zip(w.hash.tolist(), w.start, w.end, strict=True):
        assert known.setdefault(buf[a:b].tobytes(), h) == h
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("seg", [3, 7, 64])
def test_segments_change_nothing(monkeypatch, seg):
    texts = ["alpha beta  gamma", "", "x" * 50, " a bc ", "z", None, "w " * 40]
    buf, offs = V.buffer(pa.array(texts, pa.string()))
    want = V.words(buf, offs)
    monkeypatch.setattr(V, "SEG", seg)
    got = V.words(buf, offs)
    for a in ("start", "end", "hash", "first"):
        assert np.array_equal(getattr(want, a), getattr(got, a))


def test_slices_keep_all_rows():
    t = pa.table({"text": ["a" * n for n in (5, 100, 1, 1, 1)] + [None]})
    got = list(V.slices(iter(t.to_batches()), most=10))
    assert sum(b.num_rows for b in got) == 6 and max(b.num_rows for b in got) < 6


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#é", max_size=60), min_size=1, max_size=6))
def test_base_counts(texts):
    col = pa.array(texts, pa.string())
    buf, offs = V.buffer(col)
    got = D.base(buf, offs, V.words(buf, offs))
    for i, t in enumerate(texts):
        w = split(t)
        lines = [x for x in t.split("\n") if split(x)]
        wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        inside = {k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(5)}
        assert [int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [len(w), sum(map(len, w)), t.count("#"), len(lines) - len(set(lines)), len(inside)]
