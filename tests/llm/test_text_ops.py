"""Quality rules, decontamination, toxicity, discriminant, Jaccard join, language model."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.llm import decontam, jaccard, ppm, qda, quality_rules, toxicity
from loam.llm import vectext as V

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


# ---------------------------------------------------------------- Jaccard


def classes_by_hand(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and den * o >= num * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def groups(seed):
    r = random.Random(seed)
    rows = []
    passage = [f"p{i}" for i in range(60)]
    for _ in range(25):
        base = [r.choice("abcdefghij") + str(r.randrange(60)) for _ in range(r.choice([2, 6, 30, 120, 300]))]
        if r.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(r.choice([1, 1, 3, 9])):
            w = base[:]
            for _ in range(r.randrange(0, 2 + len(w) // 30)):
                w[r.randrange(len(w))] = "Z" + str(r.randrange(100))
            rows.append((len(rows) * 7 + 3, " ".join(w)))
    return rows


@pytest.mark.parametrize("options", [{}, {"pivots": 0, "cell_points": 2}, {"pivots": 5, "most_bytes": 500, "cell_points": 3}, {"most_common": 3, "k": 5, "num": 80, "sample_bytes": 4000}])
def test_jaccard_classes(spark, options):
    rows = groups(len(options))
    want = classes_by_hand(rows, options.get("k", 4), options.get("num", 85), 100)
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_region_join_is_exact(seed):
    r = random.Random(seed)
    sets = []
    for _ in range(r.randrange(1, 5)):
        base = r.sample(range(10**6), r.randrange(5, 60))
        for _ in range(r.randrange(1, 30)):
            s = set(base)
            for _ in range(r.randrange(0, 6)):
                s.discard(r.choice(base))
                s.add(r.randrange(10**6))
            sets.append(np.array(sorted(s), np.uint64))
    label, _ = jaccard.join_region(sets, 85, 100, leaf=6)
    m = len(sets)
    root = list(range(m))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(m):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(m)] == label.tolist()


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(0)
    for n in (3, 700, 5000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], r.integers(0, 2**63, n).astype(np.uint64)]))
        x, y = jaccard.bitmap(a)[None, :], jaccard.bitmap(b)[None, :]
        t = min(x.shape[1], y.shape[1])
        assert np.bitwise_count(jaccard.fold(x, t) ^ jaccard.fold(y, t)).sum() <= len(np.setxor1d(a, b))


def test_jaccard_edges(edge, empty):
    got = jaccard.classes(edge).collect()
    assert len(got) == edge.count()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, set()).add((x.n_shingles, x.component_id))
    assert by[0] == {(0, 0)} and by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(1, 3)} and by[4] == {(1, 3)}
    words = edge.where("doc_id = 6").first().text.split()
    assert by[6] == by[7] == {(len(set(zip(words, words[1:], words[2:], words[3:], strict=False))), 6)}
    assert by[9] == by[10] == {(1, 9)}
    assert by[None] == {(1, 5), (0, None)}
    assert jaccard.classes(empty).count() == 0
    kept = jaccard.one_of_each(edge)
    assert kept.columns == edge.columns
    ids = sorted(x.doc_id for x in kept.where("doc_id is not null").collect())
    assert ids == [0, 1, 2, 3, 5, 6, 8, 9, 11]


# ---------------------------------------------------------------- decontamination


def pieces_by_hand(text, answer=None):
    """Words of an item's question and answer, and its pieces."""
    w = text.lower().split()
    q, a = (w, answer.lower().split()) if answer is not None else (w[: len(w) - max(1, len(w) // 4)], w[len(w) - max(1, len(w) // 4) :]) if len(w) > 1 else (w, [])
    whole = q + a
    k = -(-len(whole) // 128)
    size = [len(whole) // k + (i < len(whole) % k) for i in range(k)]
    return q, a, [whole[sum(size[:i]) : sum(size[: i + 1])] for i in range(k)]


def hits_by_hand(texts, items, threshold, overlap):
    """(text, item) -> greatest score, by scoring every passage against every piece."""
    made = {i: pieces_by_hand(*x) for i, x in items.items()}
    every = [p for _, _, ps in made.values() for p in ps]
    df = {t: sum(t in p for p in every) for p in every for t in p}
    mean = sum(map(len, every)) / len(every)
    idf = lambda t: math.log(1 + (len(every) - df[t] + 0.5) / (df[t] + 0.5))
    weight = lambda t, p: idf(t) * p.count(t) * 2.2 / (p.count(t) + 1.2 * (0.25 + 0.75 * len(p) / mean))
    pairs = lambda w: set(zip(w, w[1:], strict=False)) if len(w) > 1 else set(w)
    out = {}
    for d, text in enumerate(texts):
        w = text.lower().split()
        for at in range(0, max(len(w) - 128, 1), 128):
            here = set(w[at : at + 256])
            for i, (q, a, ps) in made.items():
                score = max(sum(weight(t, p) for t in set(p) & here) / sum(weight(t, p) for t in set(p)) for p in ps)
                n = len(q) + len(a)
                wide = n if n > 128 else 0
                h = w[max(at - wide, 0) : at + 256 + wide]
                seen = pairs(h) | set(h)
                share = min(len(pairs(x) & seen) / len(pairs(x)) if x else 1.0 for x in (q, a))
                if score >= threshold - 1e-9 and share >= (1 if n < 8 else overlap) - 1e-9:
                    out[d, i] = max(out.get((d, i), 0), score)
    return out


def contaminated_texts(seed, n_items=50, words=(10, 40)):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    items = {i: (" ".join(r.choice(vocab) for _ in range(r.randrange(*words))), None) for i in range(n_items)}
    texts = [" ".join([r.choice(vocab) for _ in range(r.randrange(0, 700))] + (items[r.randrange(n_items)][0].upper().split() if r.random() < 0.5 else []) + [r.choice(vocab) for _ in range(r.randrange(0, 300))]) for _ in range(60)]
    return items, [t for t in texts if t]


@pytest.mark.parametrize("words", [(10, 40), (60, 400)])
def test_hits_equal_scoring_everything(spark, words):
    items, texts = contaminated_texts(4, 50, words)
    want = hits_by_hand(texts, items, 0.5, 0.7)
    df, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(i, t) for i, (t, _) in items.items()], "item_id string, text string" if words[0] > 50 else "item_id long, text string")
    for most in (1 << 21, 700):  # one index, several
        got = {(x.doc_id, int(x.item_id)): x.score for x in decontam.contaminated(df, bench, threshold=0.5, most_words=most).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert len({d for d, _ in want}) >= 20


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_retrieval_finds_all_above(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    ix = decontam.build([decontam.Item.of(i, " ".join(r.choice(vocab) for _ in range(r.randrange(8, 30))), None) for i in range(60)])
    queries = [np.unique(r.choices(range(len(ix.terms)), k=25)) for _ in range(4)]
    full = np.zeros((4, 60))
    for i, q in enumerate(queries):
        for t in q:
            full[i, ix.piece[ix.first[t] : ix.first[t + 1]]] += ix.impact[ix.first[t] : ix.first[t + 1]]
    for th in (0.3, 0.6, 0.9):
        p, piece, score = decontam.retrieve(ix, np.repeat(np.arange(4), [len(q) for q in queries]), np.concatenate(queries), 4, th)
        assert set(zip(p.tolist(), piece.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(full >= th - 1e-9)), strict=True))
        assert score == pytest.approx(full[p, piece])


def test_blocks_hold_their_greatest_impact():
    items, _ = contaminated_texts(1)
    ix = decontam.build([decontam.Item.of(i, *x) for i, x in items.items()])
    for t in range(len(ix.terms)):
        assert ix.greatest[t] == ix.impact[ix.first[t] : ix.first[t + 1]].max()
        b = np.arange(ix.blocks[t], ix.blocks[t + 1])
        assert ix.block_first[b[0]] == ix.first[t] and ix.block_first[b[-1] + 1] == ix.first[t + 1]
        for k in b:
            s = slice(ix.block_first[k], ix.block_first[k + 1])
            assert ix.block_greatest[k] == ix.impact[s].max() and set(ix.piece[s] // decontam.RANGE) == {ix.block_range[k]}


@pytest.mark.parametrize("n_question", [123, 128, 395])
def test_short_answers_of_long_items_are_verified(spark, n_question):
    r = random.Random(n_question)
    q, a = " ".join(f"q{r.randrange(5000)}" for _ in range(n_question)), "the answer is short ok"
    pad = " ".join(f"p{i}" for i in range(150))
    df = spark.createDataFrame([(1, f"{pad} {q} {a} {pad}"), (2, f"{pad} {q} no such thing here at all {pad}"), (3, pad)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, q, a)], "item_id long, text string, answer string")
    assert [(x.doc_id, x.item_id, x.answer_overlap) for x in decontam.contaminated(df, bench, answer_col="answer").collect()] == [(1, 7, 1.0)]


def test_planted_items_are_found(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {(d.doc_id, i.item_id) for i in items.collect() for d in docs.collect() if i.text in d.text}
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(docs, items).collect()}
    assert want <= got and len(got - want) <= 2
    clean = decontam.clean_rows(docs, items)
    assert {x.doc_id for x in clean.select("doc_id").collect()} == {x.doc_id for x in docs.collect()} - {d for d, _ in got}
    assert {(x.doc_id, x.item_id) for x in decontam.contaminated(docs, items, most_words=900).collect()} == got


def test_decontamination_edges(edge, empty, spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (4, "tie tie tie tie tie tie"), (None, "one"), (5, " ".join(f"q{i}" for i in range(400)))], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(edge, items).collect()}
    assert {(5, 3), (None, 3), (9, 4), (10, 4), (3, None), (4, None)} <= got and not {d for d, _ in got} & {0, 1, 2}
    assert decontam.contaminated(empty, items).count() == 0
    none = items.limit(0)
    assert decontam.contaminated(edge, none).count() == 0 and decontam.clean_rows(edge, none).count() == edge.count()
    assert decontam.clean_rows(edge, items).columns == edge.columns


# ---------------------------------------------------------------- toxicity


def segments_by_hand(x):
    """All maximal-scoring segments: the best one, then the same on either side."""
    best = None
    for i in range(len(x)):
        for j in range(i, len(x)):
            s = sum(x[i : j + 1])
            if s > 1e-9 and (best is None or s > best[2] + 1e-9 or abs(s - best[2]) < 1e-9 and j - i < best[1] - best[0]):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    right = [(a + j + 1, b + j + 1, t) for a, b, t in segments_by_hand(x[j + 1 :])]
    return segments_by_hand(x[:i]) + [best] + right


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([2.0, 3.5, -1.0, 1.25]), max_size=14))
def test_maximal_segments(x):
    at = np.array([i for i, v in enumerate(x) if v != -1.0], np.int64)
    got = toxicity.maximal_segments(at, np.array([x[i] for i in at]), 1.0)
    want = segments_by_hand(x)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert [s for _, _, s in got] == pytest.approx([s for _, _, s in want])


def test_segments_take_linear_time():
    n = 200_000
    # left sums fall all along, so no segment is joined with another and all stay open
    begun = time.perf_counter()
    got = toxicity.maximal_segments(np.arange(n) * 5, np.full(n, 3.0), 1.0)
    assert len(got) == n and time.perf_counter() - begun < 3


def test_passages_that_come_again_are_found():
    h = V.hash_words(["bad", "worse", "worst"])
    m = toxicity.Model(np.sort(h), np.full(3, 4.0), np.zeros(0, V.U), np.zeros(0), toxicity.Law(), toxicity.Law())
    t = toxicity.tokens(pa.record_batch({"text": ["bad worse worst " + "x " * 50 + "bad worse worst"]}), "text")
    once, every = m.segments(t)[0]
    assert once == [(0, 2, 12.0)] and every == [(0, 2, 12.0), (53, 55, 12.0)]


def test_one_strong_word_again_and_again_is_dropped(spark):
    """A word counts once for the score; a long text that repeats a single toxic word is dropped nevertheless, one that
    repeats a weak word is not.  Laws and weights as fitted on 100 MB."""
    h, order = V.hash_words(["scum", "meh"]), np.argsort(V.hash_words(["scum", "meh"]))
    laws = toxicity.Law(-1.0, 0.3, 0.6), toxicity.Law(-3.4, 0.73, 0.68)
    m = toxicity.Model(h[order], np.array([6.0, 1.0])[order], np.zeros(0, V.U), np.zeros(0), *laws, 7.5, -18.9, strong=1.6)
    side = "x " * 5000
    texts = [side, side + "scum " * 20 + side, side + "meh " * 40 + side, "scum", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = {x.doc_id: x.score for x in toxicity.scan(df, m).collect()}
    assert score[1] < 0.7 and [x.doc_id for x in toxicity.scan(df, m).where("size(passages) > 0").orderBy("doc_id").collect()] == [1, 2, 3]
    assert sorted(x.doc_id for x in toxicity.clean_rows(df, m).collect()) == [0, 2, 4]


def toxicity_by_hand(rows, labels, folds, queries):
    """Score and passages of each query text, with dictionaries."""
    D = toxicity.DRIFT
    punct = re.compile(r"[!-/:-@\[-`{-~]")
    words = lambda t: WORD.findall(punct.sub(" ", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    stem = lambda w: w.encode()[: toxicity.STEM]
    logit = lambda p: math.log(p / (1 - p))
    train = [(words(t), labels[d], folds[d]) for d, t in rows if d in labels and zlib.crc32(str(d).encode()) % 3 != 1]
    p0 = sum(y for _, y, _ in train) / len(train)
    over = logit(p0) + D

    def counts(key, without):
        t, n = Counter(), Counter()
        for ws, y, f in train:
            if f != without:
                for k in [key(w) for w in set(ws)]:
                    n[k] += 1
                    t[k] += y
        return t, n

    st_all, sn_all = counts(stem, None)
    kept_stems = {s for s in sn_all if logit((st_all[s] + 10 * p0) / (sn_all[s] + 10)) > over}
    wt_all, wn_all = counts(lambda w: w, None)
    s_share = {s: (st_all[s] + 10 * p0) / (sn_all[s] + 10) for s in kept_stems}
    kept = {w for w in wn_all if (wt_all[w] or wn_all[w] > 1) and (stem(w) in kept_stems or logit((wt_all[w] + 6 * p0) / (wn_all[w] + 6)) > over)}

    def scorer(without):
        st_, sn = counts(stem, without)
        wt, wn = counts(lambda w: w, without)
        clip = lambda p: min(max(p, 1e-4), 1 - 1e-4)
        share = {s: clip((st_[s] + 10 * p0) / (sn[s] + 10)) for s in kept_stems}
        ws = {w: logit(clip((wt[w] + 6 * share.get(stem(w), p0)) / (wn[w] + 6))) - over for w in kept}
        return lambda w: ws[w] if w in ws else logit(share[stem(w)]) - over if stem(w) in share else None

    def scans(ws, f):
        each, seen = [f(w) for w in ws], set()
        once = [None if w in seen or seen.add(w) else x for w, x in zip(ws, each, strict=True)]
        return [segments_by_hand([-D if x is None else x for x in xs]) for xs in (once, each)]

    by = [scorer(f) for f in range(toxicity.FOLDS)]
    got = [(len(ws), y, *scans(ws, by[f])) for ws, y, f in train]
    top = lambda segs: max((s for *_, s in segs), default=0.0)
    laws = [toxicity.Law.of(np.array([x[0] for x in got if not x[1] and x[0]]), np.array([top(x[k]) for x in got if not x[1] and x[0]])) for k in (2, 3)]
    ev = lambda segs, n: sum(min(-math.log(max(p, 1e-300)), 30) for p in (laws[0].tail(s, n) for *_, s in segs) if p < 0.01)
    a, b = qda.platt(np.array([math.log1p(ev(x[2], x[0])) for x in got]), np.array([float(x[1]) for x in got]))
    full, out = scorer(None), []
    for t in queries:
        ws = words(t)
        once, every = scans(ws, full)
        out.append((1 / (1 + math.exp(-(a * math.log1p(ev(once, len(ws))) + b))), [(x, z) for x, z, s in every if laws[1].tail(s, len(ws)) < 0.01]))
    return out


def test_toxicity_equals_plain_version(spark):
    r = random.Random(9)
    clean, bad = [f"w{i}" for i in range(60)], ["idiot", "idiots", "fool", "scum", "foolish"]
    rows = []
    for i in range(240):
        w = [r.choice(clean) for _ in range(r.randrange(0, 25))]
        if i % 4 == 0:
            w[len(w) // 2 : len(w) // 2] = [r.choice(bad) for _ in range(5)]
        elif i % 10 == 1:
            w.append(r.choice(bad))
        rows.append((i, " ".join(w).capitalize() + r.choice([".", "!", ""])))
    labels = {i: int(i % 4 == 0) for i in range(240) if i % 7}
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    folds = {x.doc_id: x.f for x in df.selectExpr("doc_id", f"cast(pmod(xxhash64(cast(doc_id as string)), {toxicity.FOLDS}) as int) f").collect()}
    got = {x.doc_id: x for x in toxicity.score(df, lab).collect()}
    want = toxicity_by_hand(rows, labels, folds, [t for _, t in rows])
    for (i, _), (score, spans) in zip(rows, want, strict=True):
        assert got[i].score == pytest.approx(score, abs=1e-6) and [(p["first"], p["last"]) for p in got[i].passages] == spans
    assert sum(map(len, (s for _, s in want))) > 20


def test_toxicity_held_out(spark, labels):
    d = "/root/testdata/sf0.1"
    lab = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(spark.read.parquet(f"{d}/documents.parquet"), lab).join(lab, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97
    assert got.toxic[got.predicted == 1].mean() > 0.97 and got.predicted[got.toxic == 1].mean() > 0.85


def test_toxicity_edges(edge, empty, spark, docs, labels):
    m = toxicity.fit(docs, labels)
    got = toxicity.scan(edge, m).collect()
    assert len(got) == edge.count() and all(0 <= x.score <= 1 for x in got)
    base = next(x.score for x in got if x.doc_id == 0)
    assert all(x.score == base and not x.passages for x in got if x.doc_id in (0, 1, 2))
    assert toxicity.scan(empty, m).count() == 0
    assert toxicity.clean_rows(edge, m).columns == edge.columns
    assert {x.score for x in toxicity.score(edge, no_labels(spark)).collect()} == {0.0}


# ---------------------------------------------------------------- quality


def test_rules(spark, docs, labels):
    got = quality_rules.judge(docs, labels).toPandas().set_index("doc_id")
    lab = labels.toPandas().set_index("doc_id").quality
    kept = got.kept[lab.index]
    assert kept[lab == 1].mean() > 0.93 and kept[lab == 0].mean() < 0.15
    assert got.equals(quality_rules.judge(docs.repartition(5), labels).toPandas().set_index("doc_id").loc[got.index])
    assert not got.kept[got.base_failed].any()


def bucket_by_hand(gram):
    x = int.from_bytes(gram, "big")
    x ^= x >> 15
    x = x * 0x2C1B3C6D & 0xFFFFFFFF
    x ^= x >> 12
    return (x * 0x297A2D39 & 0xFFFFFFFF) >> 16


def test_verdicts_equal_plain_version(spark, docs, labels):
    rows = docs.where("doc_id < 300").collect()
    trusted = {x.doc_id for x in labels.where("quality = 1").collect()}
    grams = {r.doc_id: [bucket_by_hand(t[i : i + 4]) for t in [(r.text or "").encode()] for i in range(len(t) - 3)] for r in rows}
    raw, target = Counter(), Counter()
    for d, g in grams.items():
        raw.update(g)
        if d in trusted:
            target.update(g)
    nr, nt = sum(raw.values()) + 65536, sum(target.values()) + 65536
    ratio = {b: math.log2((target[b] + 1) / nt) - math.log2((raw[b] + 1) / nr) for b in raw}
    score = {d: sum(ratio[b] for b in g) / len(g) if g else None for d, g in grams.items()}
    of_trusted = sorted(round(v, 3) for d, v in score.items() if d in trusted and v is not None)
    at = lambda q: of_trusted[min(int(q * len(of_trusted)), len(of_trusted) - 1)]
    threshold = at(0.5) - 2.5 * (at(0.5) - at(0.01))
    got = quality_rules.judge(docs.where("doc_id < 300"), labels).collect()
    assert len(got) == len(rows) and len(of_trusted) > 20
    for x in got:
        want = score[x.doc_id]
        assert (x.score is None) == (want is None) and (want is None or x.score == pytest.approx(want, abs=2e-5))
        assert x.threshold == pytest.approx(threshold, abs=4e-3)
        if want is None or abs(want - threshold) > 0.01:
            assert x.kept == (not x.base_failed and want is not None and want >= threshold)


def test_rules_edges(edge, empty, spark, labels):
    got = quality_rules.judge(edge, labels).collect()
    assert len(got) == edge.count()
    assert all(x.base_failed and not x.kept and x.n_words == 0 for x in got if x.doc_id in (0, 1, 2))
    assert quality_rules.judge(empty, labels).count() == 0
    none = quality_rules.judge(edge, no_labels(spark)).collect()
    assert all(x.kept == (not x.base_failed) for x in none)


def test_discriminant(spark, docs, labels):
    got = qda.score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95


def test_discriminant_equals_plain_version(spark, docs, labels):
    some = docs
    lab = {x.doc_id: x.quality for x in labels.collect()}
    rows = [(r.doc_id, r.text) for r in some.collect()]
    x = np.array([qda.D.features(*qda.D.texts(pa.record_batch({"text": pa.array([t], pa.string())}), "text"))[0] for _, t in rows])
    y = np.array([-1 if d not in lab or zlib.crc32(str(d).encode()) % 3 == 1 else lab[d] for d, _ in rows])
    z = (x - x[y >= 0].mean(0)) / np.maximum(x[y >= 0].std(0), 1e-4)
    n = [(y == k).sum() for k in (0, 1)]
    cov = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    common = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    q = []
    for k in (0, 1):
        c = 0.9 * cov[k] + 0.1 * common
        c = 0.95 * c + 0.05 * np.eye(len(c)) * np.trace(c) / len(c)
        d = z - z[y == k].mean(0)
        q.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    g = q[1] - q[0] + math.log(n[1] / n[0])
    margin = np.sign(g) * np.log1p(np.abs(g))
    a, b = qda.platt(np.round(margin[y >= 0], 2), y[y >= 0].astype(float))
    want = dict(zip([d for d, _ in rows], 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30))), strict=True))
    got = {r.doc_id: r.score for r in qda.score(some, labels).collect()}
    assert got.keys() == want.keys() and min(n) > 20
    assert all(got[d] == pytest.approx(want[d], abs=1e-4) for d in want)


def test_triangular_solve():
    c = np.linalg.cholesky(np.array([[4.0, 1, 0.5], [1, 3, 0.2], [0.5, 0.2, 2]]))
    z = np.arange(6.0).reshape(3, 2)
    assert c @ qda.forward(c, z) == pytest.approx(z)


def test_ids_may_be_texts(spark, docs, labels):
    few = docs.where("doc_id < 40").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    named = labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    for out in (quality_rules.judge(few, named), toxicity.score(few, named), qda.score(few, named), jaccard.classes(few), ppm.score(few, few), decontam.contaminated(few, spark.read.parquet(f"{SF}/benchmark.parquet"))):
        assert out.schema["doc_id"].dataType.simpleString() == "string" and {r.doc_id[:1] for r in out.collect()} <= {"d"}


def test_discriminant_edges(edge, empty, spark, docs, labels):
    both = docs.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    got = qda.score(both, labels)
    assert got.count() == docs.count() + edge.count() and got.where("not (score between 0 and 1)").count() == 0
    assert qda.score(empty, labels).count() == 0
    assert {x.score for x in qda.score(edge, no_labels(spark)).collect()} == {0.5}


# ---------------------------------------------------------------- language model


class Slow:
    """The same model with dictionaries."""

    def __init__(self, streams, order):
        self.order, self.c = order, {}
        for s in streams:
            for i in range(order, len(s)):
                for k in range(order + 1):
                    d = self.c.setdefault(s[i - k : i], {})
                    d[s[i]] = d.get(s[i], 0) + 1

    def log2(self, ctx, b):
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            d = self.c.get(ctx[len(ctx) - k :] if k else b"")
            if d is None:
                continue
            left = {x: n for x, n in d.items() if x not in excluded}
            total = sum(left.values()) + len(left)
            if b in left:
                return out + math.log2(left[b] / total)
            if left:
                out += math.log2(len(left) / total)
            excluded |= set(d)
        return out - math.log2(256 - len(excluded))


def stream_by_hand(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x).encode() for x in WORD.findall(text or "")]
    return b"\n" * ppm.ORDER + b" ".join(w) + b"\n"


def test_ppm_equals_slow_model(spark):
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcé") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(0, 30))) for _ in range(60)] + [None, "", "New WORDS zzz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = df.where("doc_id % 2 = 0")
    got = {x.doc_id: x for x in ppm.score(df, train).collect()}
    slow = Slow([stream_by_hand(t) for i, t in enumerate(texts) if i % 2 == 0], ppm.ORDER)
    words = [x.lower() for i, t in enumerate(texts) if i % 2 == 0 for x in [*WORD.findall(t or ""), "\n"]]
    n, v = len(words), len(set(words))
    for i, t in enumerate(texts):
        s = stream_by_hand(t)
        want = sum(slow.log2(s[j - ppm.ORDER : j], s[j]) for j in range(ppm.ORDER, len(s))) * math.log10(2)
        toks = [x.lower() for x in WORD.findall(t or "")] + ["\n"]
        base = sum(math.log10((words.count(x) + 0.5) / (n + 0.5 * (v + 1))) for x in toks)
        x = got[i]
        assert x.score == pytest.approx(want) and x.base_score == pytest.approx(base)
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(toks), sum(y in words for y in toks), n)


def test_ppm_bounds_change_no_counts(spark, docs):
    some = docs.where("doc_id < 60")
    a = {x.doc_id: x for x in ppm.score(some, some).collect()}
    b = {x.doc_id: x for x in ppm.score(some, some, most_words=50, most_nodes=3000).collect()}
    assert all(b[d].base_score == pytest.approx(a[d].base_score) and b[d].n_known == a[d].n_known for d in a)
    assert sum(x.score for x in b.values()) < sum(x.score for x in a.values())


@pytest.mark.parametrize("share", [0, 0.6])
def test_ppm_held_part_changes_no_score(spark, docs, share):
    train = docs.where("doc_id < 8")
    some = docs.where("doc_id between 4 and 14").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "unseen éü zzz unseen zzz")], "doc_id long, text string"))
    slow = Slow([stream_by_hand(x.text) for x in train.collect()], ppm.ORDER)
    nodes = sum(len(d) for d in slow.c.values())
    got = {x.doc_id: x.score for x in ppm.score(some, train, held_nodes=int(nodes * share)).collect()}
    for x in some.collect():
        s = stream_by_hand(x.text)
        assert got[x.doc_id] == pytest.approx(sum(slow.log2(s[j - ppm.ORDER : j], s[j]) for j in range(ppm.ORDER, len(s))) * math.log10(2))


def test_ppm_is_a_distribution(spark):
    df = spark.createDataFrame([(0, "abra cadabra"), (1, "bar abba")], "doc_id long, text string")
    trie = ppm._trie(ppm.gather(df).where("kind = 0"), 1 << 16)
    for ctx in (b"\n\n\n\n\n", b" abra", b"zzzzz", b"zzzab"):
        keys = np.array([int.from_bytes(ctx + bytes([b]), "big") for b in range(256)], np.uint64)
        assert (2.0 ** trie.log2(keys)).sum() == pytest.approx(1)


def test_ppm_edges(edge, empty, spark, docs):
    got = ppm.score(edge, docs.where("doc_id < 100")).collect()
    assert len(got) == edge.count() and all(x.score < 0 for x in got)
    assert {x.n_tokens for x in got if x.doc_id in (0, 1, 2)} == {1}
    assert ppm.score(empty, docs.where("doc_id < 10")).count() == 0
    none = ppm.score(edge, empty).collect()
    assert all(x.train_tokens == 0 and x.n_known == 0 for x in none)


def test_crc_is_zlib_s(docs):
    from loam.llm.common import crc_bucket

    got = {x.doc_id: x.b for x in docs.select("doc_id", crc_bucket("doc_id", 5).alias("b")).collect()}
    assert got == {d: zlib.crc32(str(d).encode()) % 5 for d in got}
