"""License scans, periodic runs and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loam.llm import licenses, periodic, queries, spelling
from loam.llm import vectext as V

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- licenses


def ends(parts, words, i, done, top, saw):
    """All (place, mandatory words) after parts, read from place i on; saw() gets the count at every word read."""
    out = {(i, done)}
    for p in parts:
        nxt = set()
        for at, d in out:
            if isinstance(p, str):
                if at < len(words) and words[at] == p:
                    saw(d + top)
                    nxt.add((at + 1, d + top))
            elif p[0] == "optional":
                nxt |= {(at, d)} | ends(p[1], words, at, d, False, saw)
            elif p[0] == "one":
                for wording in p[1]:
                    nxt |= ends(wording, words, at, d, False, saw)
            else:
                for k in range(p[1], p[2] + 1):
                    if at + k <= len(words):
                        nxt.add((at + k, d))
                for _ in range(min(p[2], len(words) - at)):
                    saw(d)
        out = nxt
    return out


def scan_by_hand(text, templates):
    words, found, score = licenses.words_of(text or ""), [], 0.0
    for s in range(len(words)):
        for name, markup in templates.items():
            parts, best = licenses.parse(markup), [0]
            m = sum(isinstance(p, str) for p in parts)
            got = {e for e, _ in ends(parts, words, s, 0, True, lambda d: best.append(d))}  # noqa: B023
            if got:
                found.append((name, s, max(got)))
                score = 1.0
            elif m > 1:
                score = max(score, (max(best) - 1) / (m - 1))
    return len(words), found, score


TEMPLATES = {
    "plain": "a b c",
    "optional": "x <<beginOptional>>y <<beginOptional>>z<<endOptional>><<endOptional>> w",
    "free": 'a <<var;name="n";match=".{1,3}">> c <<var;name="m";match=".{0,2}">> d',
    "one": '<<var;name="n";match="(a|b c)">> x <<var;name="e";match="(y|)">>',
    "twice": "a a b",
    "lead": "<<beginOptional>>b<<endOptional>> c c",
}


def test_scan_equals_plain_version(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdwxyzq") for _ in range(r.randrange(0, 30))) for _ in range(150)]
    texts += [None, "", " ., ", "A-B_c!", "a\x00b\x7fc é c c", "a a a b c c d"]
    df = spark.createDataFrame([(i, t, "m", "s") for i, t in enumerate(texts)], "doc_id long, text string, matches string, id string")
    for x in licenses.scan(df, TEMPLATES).collect():
        n, found, score = scan_by_hand(texts[x.doc_id], TEMPLATES)
        order = list(TEMPLATES)
        assert x.n_words == n and [(m.template, m.start, m.end) for m in x.matches] == sorted(found, key=lambda f: (f[1], order.index(f[0])))
        assert x.score == pytest.approx(score), texts[x.doc_id]


def test_templates_accept_their_wordings(spark):
    texts = {
        "gpl-3.0": "x. This program is distributed under the terms of the GNU General Public License, version 3 or (at your option) any later version. y",
        "cc-by-sa-4.0": "Published under a Creative Commons Attribution-ShareAlike License, version 4.0",
        "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "all-rights-reserved": "(c) 2020 Somebody. All rights reserved.",
        "mit": "Released under the MIT License",
    }
    mit = licenses.TEMPLATES["mit-text"].replace('<<var;name="holder";match=".{1,12}">>', "the authors or copyright holders")
    texts["mit-text"] = re.sub(r"<<\w+Optional>>", "", mit.replace("including the next paragraph", ""))
    df = spark.createDataFrame([(k, v) for k, v in texts.items()] + [("none", texts["mit-text"].replace("sublicense", "sub license"))], "doc_id string, text string")
    got = {x.doc_id: ({m.template for m in x.matches}, x.score) for x in licenses.scan(df).collect()}
    for k in texts:
        assert k in got[k][0] and got[k][1] == 1.0
    assert not got["none"][0] and 0.2 < got["none"][1] < 1


def test_bad_templates_are_refused():
    for markup in ("<<beginOptional>>a<<endOptional>>", '<<var;name="a";match=".{1,2}">> b', "a <<beginOptional>>b", "a<<endOptional>>", '<<var;name="a";match=".+">> b', ""):
        with pytest.raises(ValueError):
            licenses.compile_templates({"t": markup})


def test_op11_base(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for x in queries.op11(spark, SF).collect():
        w = licenses.words_of(rows[x.doc_id] or "")
        places = [(k, i) for k, p in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for _, i in places]
        labels = {k for k, _ in places}
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert x.base_labels == ",".join(sorted(labels)) and labels <= set(x.labels.split(",")) and x.labels == ",".join(sorted(set(x.labels.split(",")))) and 0 <= x.score <= 1


# ---------------------------------------------------------------- periodic runs


def runs_by_hand(words, least):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda t: (t[0], t[2]))


@pytest.mark.parametrize("leaves", [1 << 20, 5])
def test_runs_equal_brute_force(monkeypatch, leaves):
    monkeypatch.setattr(periodic, "LEAVES", leaves)
    r = random.Random(leaves)
    for _ in range(300):
        docs = []
        for _ in range(r.randrange(1, 5)):
            n, a = r.randrange(0, 50), r.randrange(1, 5)
            part = [r.randrange(a) for _ in range(r.randrange(1, 9))]
            d = (part * 50)[:n] if r.random() < 0.6 else [r.randrange(a) for _ in range(n)]
            for _ in range(r.randrange(3)):
                if d:
                    d[r.randrange(len(d))] = r.randrange(a)
            docs.append(d)
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        least = r.choice([2, 4, 12])
        s, e, q = periodic.find(V.mix(np.array([x + 1 for d in docs for x in d], np.uint64)), first, least)
        want = [(a + f, a + f + b, c) for d, f in zip(docs, first, strict=False) for a, b, c in runs_by_hand(d, least)]
        assert list(zip(s.tolist(), e.tolist(), q.tolist(), strict=True)) == [tuple(map(int, x)) for x in want]


def test_op12_equals_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {x.doc_id: x for x in queries.op12(spark, SF).collect()}
    assert len(got) == len(rows)
    for row in rows[:120]:
        w = re.findall(r"[^\x20\x09-\x0D]+", row.text or "")
        n, h = len(w), zlib.crc32(str(row.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = runs_by_hand(w, 12)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        x = got[row.doc_id]
        assert x.n_runs == len(found)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n_},{q}\n" for s, n_, q in found).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(" ".join(y for i, y in enumerate(w) if i not in gone).encode()).hexdigest()
        top = min(found, key=lambda f: (-f[1], f[0], f[2]), default=(None,) * 3)
        assert (x.start, x.length, x.period) == top and x.exponent_milli == (top[1] * 1000 // top[2] if found else None)


# ---------------------------------------------------------------- spelling


def near_by_hand(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("group", [2, 32])
def test_near_pairs_equal_brute_force(spark, group):
    r = random.Random(group)
    base = ["".join(r.choice("abé") for _ in range(r.randrange(6, 10))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "bababab", "abababab"]
    words = set(base)
    for w in base:
        for _ in range(3):
            i = r.randrange(len(w))
            words.add(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abéc") + w[i:], w[:i] + r.choice("abéc") + w[i + 1 :]]))
    words = sorted(w for w in words if len(w) >= 6)
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = sorted(tuple(sorted((x.u, x.v))) for x in spelling.near_pairs(df, group=group).collect())
    assert got == [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near_by_hand(a, b)]


def test_variants_of_noisy_texts(spark):
    r = random.Random(1)
    names = ["président", "election", "elections", "government", "Parliament", "ñandúes"]
    texts = [None, "", "12 ; 34", "x" * 5000] + [" ".join(r.choice(names) + r.choice(["", ",", "-x"]) for _ in range(60)) for _ in range(40)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    n = Counter()
    for i, t, _, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 3 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] += len(w) >= 6
    n = {w: c for w, c in n.items() if c >= 5}
    got = {x.word: x for x in spelling.variants(df, noise=3).collect()}
    assert set(got) == set(n)
    form = {}
    for w in n:
        near = [v for v in n if near_by_hand(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
        assert (got[w].n, got[w].n_near, got[w].form, got[w].form_n) == (n[w], len(near), form[w], n.get(form[w]))
    for w in n:
        at = w
        while form[at]:
            at = form[at]
        assert got[w].root == at
    assert any(form.values()) and spelling.variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(df, ratio=1)


def test_checksums_of_any_length():
    parts = [b"", b"a", b"abc", b"x" * 200, bytes(range(256)), b"q" * 64]
    buf = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    before = np.arange(len(parts), dtype=np.uint32) * 977
    got = spelling.checksums(buf, end - np.array([len(p) for p in parts]), end, before)
    assert got.tolist() == [zlib.crc32(p, int(b)) for p, b in zip(parts, before, strict=True)]


def test_defined_cases_of_the_scans(spark, edge, empty):
    """Null, empty, long and repeated texts, null ids, clashing columns."""
    for f in (licenses.scan, periodic.runs):
        assert f(edge).count() == edge.count() and f(empty).count() == 0
    runs = {x.doc_id: x for x in periodic.runs(edge, plant=True).collect()}
    assert runs[0].collapsed == "" and runs[0].runs == [] and runs[0].n_words == 0
    one = pa.array(["a b a b a b a b a b a b a", ""])
    buf, offs = V.buffer(one)
    w = V.words(buf, offs)
    assert [x.tolist() for x in periodic.find(w.hash, w.first)] == [[0], [13], [2]]
    assert spelling.variants(edge).where("word is null").count() == 0
