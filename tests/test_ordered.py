"""Decisions in order against plain folds; best matches, link joins and seeded samples against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.functions import vector as V
from loam.operators import corpus, novelty, ooda, ordered, vectors
from loam.operators import store as S


@pytest.mark.parametrize("task_edges", [0, 40, 1_000_000])
def test_rounds_reject_what_a_greedy_pass_does(spark, task_edges):
    r = random.Random(task_edges)
    edges = {tuple(sorted(r.sample(range(60), 2))) for _ in range(110)} | {(i, i + 1) for i in range(60, 75)}
    near = {}
    for a, b in edges:
        near.setdefault(b, []).append(a)
    out = set()
    for b in sorted(near):
        if any(a not in out for a in near[b]):
            out.add(b)
    df = spark.createDataFrame(sorted(edges) * 2, "a long, b long")
    assert {x.node for x in ordered.blocked(df, task_edges).collect()} == out
    assert ordered.blocked(df.where("false")).count() == 0


def admit_by_hand(rows, min_novelty, max_share):
    took, n = [], Counter()
    for seq, source, title, _ in sorted(rows):
        w = title.split()
        g = set(zip(w, w[1:], strict=False))
        fine = not took or n[source] / len(took) < max_share
        if took:
            nov = 1 - max(len(g & h) / len(g | h) for h in took) if len(w) > 1 else 0.5
            fine &= nov >= min_novelty
        if fine:
            took.append(g)
            n[source] += 1
            yield seq


@pytest.mark.parametrize(("stretch", "hot"), [(40, 0.3), (30, 0.8), (1 << 16, 0.6)])
def test_admission_equals_the_plain_fold(spark, monkeypatch, stretch, hot):
    """Shares that bind often and rarely, copies, chains of similar titles; stretches of any size."""
    monkeypatch.setattr(ordered.admitted, "__defaults__", (stretch, 5))
    monkeypatch.setattr(ordered, "STRETCH", stretch)
    r = random.Random(stretch)
    words, rows, last = [f"w{i}" for i in range(40)], [], None
    for i in range(160):
        kind = r.random()
        if last and kind < 0.3:
            t = list(r.choice(rows)[2].split())
            if kind < 0.2:
                t[r.randrange(len(t))] = r.choice(words)
        else:
            t = [r.choice(words) for _ in range(r.randrange(6, 14))]
        last = t
        rows.append((i * 3, "hot" if r.random() < hot else r.choice("abcd"), " ".join(t), 0.9))
    monkeypatch.setattr("loam.operators.gates.MIN_RELIABILITY", 0.0)
    df = spark.createDataFrame(rows, "seq long, source string, title string, confidence double").repartition(5)
    want = list(admit_by_hand(rows, 0.4, 0.5))
    got = corpus.admit(df, min_novelty=0.4, max_share=0.5)
    assert sorted(x.seq for x in got.where("accepted").collect()) == want
    took = {x.seq: x.novelty for x in got.where("accepted").collect()}
    sets = {s: set(zip(t.split(), t.split()[1:], strict=False)) for s, _, t, _ in rows}
    for k, s in enumerate(want):
        assert took[s] == pytest.approx(1 - max((len(sets[s] & sets[o]) / len(sets[s] | sets[o]) for o in want[:k]), default=0.0))


def test_titles_are_decided_in_order(spark):
    r = random.Random(4)
    names = [f"n{i}" for i in range(12)]
    part = lambda: " ".join(r.choice(names) for _ in range(r.choice([1, 1, 2, 3])))
    hyps = [(i, part(), part(), r.choice([0.2, 0.5, 0.9])) for i in range(150)]
    known = [("n1 n2 → n3",), ("n4 → n5",), ("n4 → n5",)]
    have, want = [k[0].split() for k in known], {}
    for i, c, e, conf in hyps:
        w = f"{c} → {e}".split()
        if conf < 0.3:
            continue
        nov = 1 - max(2 * sum(x in k for x in w) / (len(w) + len(k)) for k in have)
        if nov >= 0.3:
            have.append(w)
            want[i] = nov
    df = spark.createDataFrame(hyps, "seq long, cause string, effect string, confidence double")
    got = ooda.decide(df, spark.createDataFrame(known, "title string"), min_confidence=0.3).collect()
    assert {x.seq: pytest.approx(x.novelty) for x in got} == want and len(want) > 20
    assert {x.seq for x in ooda.decide(df.limit(1), spark.createDataFrame([], "title string")).collect()} <= {0}


def test_unique_insert_equals_one_by_one(spark):
    r = random.Random(2)
    words = ["ant", "bee", "cat", "dog", "eel", "fox"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 5))) for _ in range(80)]
    rooms = spark.createDataFrame([("r1",), ("r2",)], "id string")
    rows = [(i, r.choice(["r1", "r1", "r2", "none"]), f"t{i}", x) for i, x in enumerate(texts)]
    new = spark.createDataFrame(rows, "seq int, room_id string, title string, content string")
    empty = spark.createDataFrame([], "id string, room_id string, title string, content string, embedding array<float>")
    drawers = S.insert_drawers(empty, rooms, spark.createDataFrame([(0, "r1", "x", "ant bee"), (1, "r2", "y", "fox fox")], new.schema))[0]
    vec = {x.seq: np.array(x.v, float) for x in new.select("seq", V.hashed_ngram_udf()("content").alias("v")).collect()}
    held = {"r1": [], "r2": []}
    for x in drawers.collect():
        held[x.room_id].append(np.array(x.embedding, float))
    want = {}
    for i, room, _, _ in rows:
        if room in held:
            v, n = vec[i], np.linalg.norm(vec[i])
            want[i] = not any(n * np.linalg.norm(u) > 1e-8 and v @ u / (n * np.linalg.norm(u)) > 0.6 for u in held[room])
            if want[i]:
                held[room].append(v)
    kept, told = S.insert_unique(drawers, rooms, new, 0.6)
    assert {x.seq: x.is_new for x in told.collect()} == want and 0 < sum(want.values()) < len(want)
    assert kept.count() == 2 + sum(want.values()) == kept.select("id").distinct().count()


def test_what_earlier_rows_resemble_goes_without_pairs(spark, monkeypatch):
    """Two thirds are alike, so their pairs would be some 9,000; rooms of several heads and blocks equal the plain fold."""
    for k, v in (("HEAD", 16), ("REST_BLOCK", 32), ("SLICE", 5)):
        monkeypatch.setattr(vectors, k, v)
    monkeypatch.setattr(vectors, "pairs", None)
    r = np.random.default_rng(3)
    base = r.normal(size=8)
    rows = [(int(i), "ab"[int(i % 5 == 0)], (base + r.normal(size=8) * 0.1 if i % 3 else r.normal(size=8)).astype(np.float32).tolist()) for i in r.permutation(200)]
    held, want = {"a": [], "b": []}, set()
    for i, room, v in sorted(rows):
        u = np.array(v) / np.linalg.norm(v)
        if not any(u @ w > 0.8 for w in held[room]):
            held[room].append(u)
            want.add(i)
    got = vectors.unlike_earlier(spark.createDataFrame(rows, "id long, room string, embedding array<float>"), 0.8).collect()
    assert sorted(x.id for x in got) == sorted(want) and len(want) > 40


@pytest.mark.parametrize(("block", "dense"), [(2048, 1 << 14), (7, 3), (7, 0)])
def test_best_matches_equal_brute_force(spark, monkeypatch, block, dense):
    monkeypatch.setattr(novelty, "BLOCK_ROWS", block)
    import loam.operators.novelty as n

    r = random.Random(block)
    lists = [[r.choice("abcdefgh") + str(r.randrange(3)) for _ in range(r.randrange(0, 9))] for _ in range(50)]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lists)], "id long, t string")
    known = df.where("id % 2 = 0")
    dice = {x.id: x.novelty for x in n.dice_novelty(df, known, "id", "t", "id", "t").collect()}
    gram = {x.id: x.novelty for x in n.ngram_novelty(df, known, "id", "t", "id", "t").collect()}
    grams = [x + [f"{a} {b}" for a, b in zip(x, x[1:], strict=False)] for x in lists]
    for i, x in enumerate(lists):
        best = max((2 * sum(w in lists[j] for w in x) / (len(x) + len(lists[j])) for j in range(0, 50, 2) if x or lists[j]), default=0.0)
        assert dice[i] == pytest.approx(1 - best)
        g = grams[i]
        share = lambda h: sum(w in h for w in g) / (len(g) + len(h) - sum(w in h for w in g)) if h else 0.0  # noqa: B023, E731
        assert gram[i] == pytest.approx(max(0.0, 1 - max(share(grams[j]) for j in range(0, 50, 2))) if g else 0.0)
    a, b = np.array([3, 3, 5, 9]), np.array([3, 5, 7])
    monkeypatch.setattr(novelty, "DENSE", dense)
    assert novelty.common_counts(a, np.array([0, 0, 1, 1]), b, np.array([0, 1, 1]), 2, 2).tolist() == [[2, 0], [0, 1]]


@pytest.mark.parametrize("held", [8192, 0])
def test_few_known_rows_go_to_the_asking_ones(spark, monkeypatch, held):
    """Where the known rows are few no asking row is dealt or written; results are the same where they are not."""
    texts = [(i, None if i == 7 else " ".join("abcde"[(i * j) % 5] for j in range(i % 6))) for i in range(40)]
    df = spark.createDataFrame(texts, "id long, t string")
    known = df.where("id % 4 = 3")
    monkeypatch.setattr(novelty, "HELD_ROWS", held)
    monkeypatch.setattr(novelty, "SLICE_VALUES", 9)
    if held:
        monkeypatch.setattr(novelty, "_met", None)
        wrote, keep = [], novelty.cut
        monkeypatch.setattr(novelty, "cut", lambda x: wrote.append(keep(x)) or wrote[-1])
    got = {x.id: x.novelty for x in novelty.dice_novelty(df, known, "id", "t", "id", "t").collect()}
    if held:
        assert [x.count() for x in wrote] == [known.count()]
    for i, text in texts:
        x = (text or "").split()
        best = max((2 * sum(w in y for w in x) / (len(x) + len(y)) for j, k in texts if j % 4 == 3 and (y := (k or "").split())), default=0.0) if x else 0.0
        assert got[i] == pytest.approx(1 - best), i
    gram = {x.id: x.novelty for x in novelty.ngram_novelty(df, known, "id", "t", "id", "t").collect()}
    assert gram[0] == 0.0 and gram[7] == 1.0 and len(gram) == 40


@pytest.mark.parametrize("hot", [0, 5, 1 << 14])
def test_short_lists_meet_without_blocks(spark, monkeypatch, hot):
    """Lists around the short length, with repeats, one value in nearly all: links and best scores are those of all pairs."""
    monkeypatch.setattr(novelty, "HOT", hot)
    r = random.Random(5)
    lists = {i: ([9] if r.random() < 0.9 else []) + [r.randrange(9) for _ in range(r.choice([0, 1, 2, 2, 2, 3, 3, 4, 6]))] for i in range(-20, 90)}
    df = spark.createDataFrame(list(lists.items()), "id long, g array<long>")
    dice = {(a, b): 2 * sum(v in x for v in y) / (len(x) + len(y)) for a, x in lists.items() for b, y in lists.items() if a < b and x and y}
    for t in (0.4, 0.7):
        got = [(x.a, x.b) for x in novelty.dice_links(df, t).collect()]
        assert len(got) == len(set(got)) and set(got) == {k for k, s in dice.items() if s > t}
    best = {x.id: x.best for x in novelty.best_dice(df).collect()}
    assert min(best) >= 0
    for i in range(90):
        assert best.get(i, 0) == pytest.approx(max((s for (_, b), s in dice.items() if b == i), default=0.0))
    # short lists alone make no pairs of blocks
    monkeypatch.setattr(novelty, "best_match", None)
    assert novelty.best_dice(df.where(F.size("g") <= novelty.SHORT)).count()


def test_pairs_name_every_row_of_a_class(spark):
    r = random.Random(7)
    sets = [sorted(r.sample("abcdefghij", r.randrange(0, 7))) for _ in range(60)]
    sets += [sets[3]] * 4
    df = spark.createDataFrame([(i, x) for i, x in enumerate(sets)], "id long, v array<string>")
    from pyspark.sql import functions as F

    got = sorted((x.a, x.b, round(x.jaccard, 9)) for x in novelty.jaccard_pairs(df, "id", F.col("v"), 0.4).collect())
    want = [(i, j, round(len(set(x) & set(y)) / len(set(x) | set(y)), 9)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) > 0.4]
    assert got == want


def test_samples_do_not_depend_on_the_layout(spark):
    rows = [(i, i % 3, (i % 10) / 10) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, tier int, pheromone double")
    for s in ("pheromone", "uniform", "stigmergic", "mixed", "curriculum"):
        a, b = ({x.id for x in corpus.sample(df.repartition(n), s, 40, seed=5).collect()} for n in (2, 7))
        assert a == b and 30 <= len(a) <= 40
    assert {x.id for x in corpus.sample(df, "uniform", 40, seed=6).collect()} != {x.id for x in corpus.sample(df, "uniform", 40, seed=5).collect()}
    from pyspark.sql import functions as F

    none = df.withColumn("pheromone", F.lit(0.0))
    assert {x.id for x in corpus.sample(none, "pheromone", 9).collect()} == {x.id for x in corpus.sample(df, "uniform", 9).collect()}
    heavy = sum(x.pheromone > 0.5 for s in range(20) for x in corpus.sample(df, "pheromone", 20, seed=s).collect())
    assert 220 < heavy < 330  # of 400; two thirds of the weight


def test_best_match_within_one_table_deals_each_pair_of_blocks_once(spark, monkeypatch):
    """A value of a single row stays at home, a pair of blocks is one task for both sides, and results are those of all pairs."""
    monkeypatch.setattr(novelty, "TASK_ROWS", 7)
    monkeypatch.setattr(novelty, "BLOCK_ROWS", 3)
    r = random.Random(12)
    sets = {i: {*r.sample(range(40), r.randrange(1, 9)), 1000 + i} for i in range(50)}
    df = spark.createDataFrame([(i, sorted(x), len(x)) for i, x in sets.items()], "id long, g array<long>, n long")
    met = novelty._met(df, df.select(F.explode("g").alias("v")).groupBy("v").count().where("count > 1").select("v"))
    assert all(max(x.g) < 1000 and x.n == len(sets[x.id]) for x in met.collect())
    got = {x.id: x.best for x in novelty.best_match(df, None, "jaccard").collect()}
    for i, x in sets.items():
        assert got.get(i, 0) == pytest.approx(max((len(x & sets[j]) / len(x | sets[j]) for j in range(i)), default=0.0))


@pytest.mark.parametrize("t", [0.0, 0.3, 0.5, 0.75])
def test_only_pairs_that_can_pass_are_compared(spark, monkeypatch, t):
    """Pairs are those of brute force, and whole sets move for few others: here each two sets share rare values in vain."""
    r, cuts = random.Random(7), []
    sets = [{*range(5), *r.sample(range(5, 2000), 50)} for _ in range(30)]
    sets += [x - {*r.sample(sorted(x), len(x) // k)} for x, k in zip(sets, (8, 12) * 8)]
    df = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "cls long, g array<long>")
    keep = novelty.cut
    monkeypatch.setattr(novelty, "cut", lambda x: cuts.append(keep(x)) or cuts[-1])
    got = {(x.a, x.b) for x in novelty.class_pairs(df, t).collect()}
    share = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(len(sets)) for i in range(j)}
    assert got == {k for k, s in share.items() if s > t}
    assert t < 0.5 or cuts[-1].count() * 2 < len(share), (cuts[-1].count(), len(got), len(share))


@pytest.mark.parametrize("copies", [500_000, 0])
def test_sets_are_written_once(spark, monkeypatch, copies):
    """Classes are named by ids alone: sets are written once and read there, whatever the number of copies (no ids to all tasks: twice)."""
    r, wrote, keep = random.Random(3), [], novelty.cut
    sets = [sorted(r.sample(range(12), r.randrange(0, 7))) for _ in range(50)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(sets + sets[:20])], "id long, v array<long>")
    monkeypatch.setattr(novelty, "COPIES", copies)
    monkeypatch.setattr(novelty, "cut", lambda x: wrote.append(x.dtypes) or keep(x))
    got = {(x.a, x.b) for x in novelty.jaccard_pairs(df, "id", F.col("v"), 0.5).collect()}
    every = [set(x) for x in sets + sets[:20]]
    assert got == {(i, j) for j, y in enumerate(every) for i, x in enumerate(every[:j]) if x and y and len(x & y) / len(x | y) > 0.5}
    assert sum(("g", "array<bigint>") in x for x in wrote) == (1 if copies else 2)
