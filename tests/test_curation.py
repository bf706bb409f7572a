"""Gates, admission, novelty and text functions against golden values and plain folds."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loam.functions import bpe
from loam.functions import dynamics as D
from loam.functions import text as T
from loam.functions import vector as V
from loam.operators import corpus, gates
from loam.sources import readers


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(
    ("text", "pieces"),
    [
        ("The capital of France is", ["The", " capital", " of", " France", " is"]),
        ("What's the weather like?", ["What", "'s", " the", " weather", " like", "?"]),
        ("1234 tokens", ["123", "4", " tokens"]),
        ("Hello, world!", ["Hello", ",", " world", "!"]),
        ("  leading spaces", [" ", " leading", " spaces"]),
        ("newline\nhere", ["newline", "\n", "here"]),
        ("x=42+3", ["x", "=", "42", "+", "3"]),
    ],
)
def test_pretokenizer(spark, text, pieces):
    import regex

    assert one(spark, T.pretokenize(F.lit(text)))[0] == pieces
    assert regex.findall(T.PRETOKEN, text) == pieces


def test_bpe_round_trip_and_ids():
    chars = bpe.byte_chars()
    vocab = {c: i for i, c in enumerate(chars)} | {"He": 256, "ll": 257}
    tok = bpe.Tokenizer(vocab, {("H", "e"): 0, ("l", "l"): 1}, {"<|end|>": 300})
    assert tok.encode("Hello")[:2] == [256, 257]
    assert tok.encode("a<|end|>b") == [vocab["a"], 300, vocab["b"]]
    for text in ("Hello wörld ✓", "", "tab\tline\n"):
        assert tok.decode(tok.encode(text)) == text
    data = json.dumps({"model": {"vocab": vocab, "merges": ["H e", "l l"]}, "added_tokens": [{"id": 300, "content": "<|end|>"}]})
    assert bpe.Tokenizer.from_json(data) == tok


def test_text_functions(spark):
    r = one(spark, T.slugify(F.lit("  Hello, World--42 ")), T.xml_tag(F.lit('<title type="html">Test Title</title>'), "title"), T.xml_tag(F.lit("<a>x</a>"), "title"), T.chunks(F.lit("aéb✓c"), 4), T.bigrams(T.words(F.lit("a b  c"))), T.bigrams(T.words(F.lit("a"))), T.space_pieces(F.lit("a bc d")))
    assert list(r) == ["hello_world_42", "Test Title", None, ["aéb", "✓c"], ["a b", "b c"], [], ["a", "Ġbc", "Ġd"]]


def test_think(spark):
    strip = lambda x: one(spark, T.strip_think(F.lit(x)))[0]
    assert strip("<think>hm</think>Paris is it.") == "Paris is it."
    assert strip("<think>a</think>One. <think>b</think>Two.") == "One. Two."
    assert strip("Plain answer.") == "Plain answer."
    assert strip("Answer first. <think>never closed") == "Answer first."
    assert strip("<think>x</think Okay\nThe sky is blue.") == "The sky is blue."
    assert strip("<think>Okay so\nThe capital is Paris.\nHmm</think>") == "The capital is Paris."
    assert strip("Good answer here.\n\nOkay") == "Good answer here."
    assert one(spark, T.think_budget(F.lit("<think>a b c d"), 2))[0] == "<think>a b</think>"


def test_golden_numbers(spark):
    f = F.lit
    got = one(
        spark, D.decay_exponential(f(1.0), 0.02), D.decay_linear(f(1.0), 0.1), D.decay_linear(f(0.05), 0.1), *D.edge_decay(f(1.0), f(1.0), f(1.0)), D.pheromone_factor(f(1.0), f(1.0), f(1.0)), D.calibrated_decay(0.05, f(0.8), f(0.5)),
        D.calibrated_decay(0.05, f(0.5), f(0.1)), D.calibrated_decay(0.10, f(0.05), f(0.5)), D.edge_cost(f(1.0), f(0.0), f("leads_to")), D.edge_cost(f(0.0), f(1.0), f("CONTAINS")), D.annealed(1.0, 0.1, f(0.5)), D.normal_cdf(f(0.0)), D.normal_cdf(f(1.96)), D.normal_cdf(f(-8.0)), D.heuristic(f(1.0), f(5)),
    )
    want = [0.98, 0.9, 0, 0.99, 0.97, 0.90, 1, 0.075, 0.10, 0.05, 0.42, 0.46, 0.55, 0.5, 0.975, 0, 0]
    assert [float(x) for x in got] == pytest.approx(want, abs=1e-4)
    c = one(spark, *[V.cosine(F.array(*map(f, a)), F.array(*map(f, b))) for a, b in (([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]))])
    assert list(c) == pytest.approx([0, 1, 0, -1])


def test_quality_gate_and_labels(spark):
    s, r = gates.quality_gate(F.lit(0.95), F.lit(0.9), F.lit(5), F.lit(0.05))
    bad = gates.quality_gate(F.lit(0.1), F.lit(0.9), F.lit(1), F.lit(0.05))[1]
    assert list(one(spark, gates.quality_label(s), r, bad, gates.quality_label(F.lit(0.65)))) == ["excellent", None, "confidence; evidence", "acceptable"]
    q = gates.admission_quality(F.lit(0.6727), F.lit(0.6), F.lit(1.0))
    assert one(spark, q)[0] == pytest.approx(0.7576, abs=1e-4)


def fold(rows, min_novelty, max_share):
    """Admission, one row after the other."""
    accepted, out = [], {}
    grams = lambda t: {tuple(t.split()[i : i + 2]) for i in range(len(t.split()) - 1)}
    for seq, source, title, conf in rows:
        n = len(accepted)
        g = grams(title)
        nov = 1.0 if not n else 0.5 if len(title.split()) < 2 else 1 - max((len(g & h) / len(g | h) for _, h in accepted if h), default=0.0)
        rel = gates.RELIABILITY.get(source, gates.DEFAULT_RELIABILITY)
        ok = conf >= 0.4 and rel >= 0.4 and len(title.split()) >= 3 and nov >= min_novelty and (not n or sum(s == source for s, _ in accepted) / n < max_share)
        if ok:
            accepted.append((source, g))
        out[seq] = (ok, round((conf + rel + nov) / 3, 9) if ok else None)
    return out


@pytest.mark.parametrize(("novelty", "share"), [(0.25, 0.5), (0.5, 0.6), (0.9, 0.4)])
def test_admission_equals_fold(spark, novelty, share):
    r = random.Random(7)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, r.choice(["arxiv", "who_gho", "x", "y"]), " ".join(r.choice(words) for _ in range(r.randrange(1, 9))), r.random()) for i in range(150)]
    df = spark.createDataFrame(rows, "seq long, source string, title string, confidence double")
    got = {x.seq: (x.accepted, round(x.quality, 9) if x.accepted else None) for x in corpus.admit(df, novelty, share).collect()}
    assert got == fold(rows, novelty, share)


def test_admission_runs_on_whole_texts(spark, tmp_path):
    from loam.plans import curation

    tail = " ".join(f"t{i}" for i in range(30))
    texts = ["same first line here\n" + " ".join(f"w{i}" for i in range(30)), "same first line here\n" + tail, "another first line there\n" + tail]
    df = spark.createDataFrame([(i, t, f"s{i}", 800) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.seq: x.accepted for x in curation.corpus_admission(spark, str(tmp_path)).collect()}
    assert got == {0: True, 1: True, 2: False}


def test_diversity_is_strict(spark):
    rows = [(0, "arxiv", "one two three four", 0.8), (1, "nasa_power", "five six seven eight", 0.8), (2, "arxiv", "nine ten eleven twelve", 0.8)]
    df = spark.createDataFrame(rows, "seq long, source string, title string, confidence double")
    assert [x.accepted for x in corpus.admit(df).orderBy("seq").collect()] == [True, True, False]


def test_sampling_follows_weights(spark):
    df = spark.createDataFrame([(i, 0, 0.9 if i < 50 else 0.01) for i in range(100)], "id long, tier int, pheromone double")
    hits = sum(x.id < 50 for s in range(5) for x in corpus.sample(df, "pheromone", 10, seed=s).collect())
    assert hits > 40
    assert [x.id for x in corpus.sample(df, "curriculum", 3).collect()] == [0, 1, 2]
    assert corpus.sample(df.limit(0), "mixed", 5).count() == 0
    assert corpus.weighted_pick([0.0, 1.0, 0.0], 1) == [1]


def test_readers(spark):
    body = '{"properties":{"parameter":{"T2M":{"20240101":5.2,"20240102":6.1,"20240103":-999},"PRECTOTCORR":{"20240101":0.3,"20240102":1.2}}}}'
    rows = readers.daily_points(spark.createDataFrame([(1, body), (2, '{"properties":{"parameter":{}}}')], "id long, body string")).collect()
    assert {(x.id, x.date): x["values"] for x in rows if x.date in ("20240101", "20240102")} == {(1, "20240101"): {"T2M": 5.2, "PRECTOTCORR": 0.3}, (1, "20240102"): {"T2M": 6.1, "PRECTOTCORR": 1.2}}
    assert [x.raw for x in rows if x.id == 2] == ['{"properties":{"parameter":{}}}']
    ind = '{"value":[{"IndicatorCode":"BMI","SpatialDim":"USA","TimeDim":2020,"NumericValue":28.5},{"IndicatorCode":"BMI","SpatialDim":"GBR","TimeDim":2019,"NumericValue":27.1}]}'
    assert [(x.place, x.value) for x in readers.indicators(spark.createDataFrame([(1, ind), (2, '{"value":[]}')], "id long, body string")).orderBy("pos").collect()] == [("USA", 28.5), ("GBR", 27.1)]
    page = '[{"page":1},[{"indicator":{"id":"i","value":"Pop"},"country":{"id":"US","value":"United States"},"date":"2023","value":334914895}]]'
    assert [(x.country, x.year, x.value) for x in readers.paged(spark.createDataFrame([(1, page), (2, "[{},[]]")], "id long, body string")).collect()] == [("United States", "2023", 334914895.0)]
    atom = "<feed><entry><id>http://a/1</id><title>A  b</title><summary>x\ny</summary></entry><entry><id>2</id><title></title></entry></feed>"
    assert [(x.title, x.summary, x.url) for x in readers.atom_entries(spark.createDataFrame([(1, atom)], "id long, body string")).collect()] == [("A b", "x y", "http://a/1")]
    empty = spark.createDataFrame([], "a int")
    assert readers.or_fallback(empty, spark.createDataFrame([(7,)], "a int")).collect()[0].a == 7
    assert readers.or_fallback(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(7,)], "a int")).count() == 1


def test_corpus_round_trip_and_source(spark, tmp_path):
    c = spark.createDataFrame([(0, "arxiv", "t", 0.82, 0.75, 0.78, 1, 0, 5)], "id long, source string, title string, confidence double, pheromone double, quality double, tier int, samples int, ingested_at long")
    readers.write_corpus(c, f"file://{tmp_path}/c")
    assert spark.read.json(f"file://{tmp_path}/c").select(*c.columns).first() == c.first()
    (tmp_path / "s.json").write_text('{"version":1,"entries":[{"title":"a","tier":9}]}')
    row = readers.read_corpus(spark, f"file://{tmp_path}/s.json").first()
    assert (row.source, row.confidence, row.tier) == ("unknown", 0.5, 2)
    (tmp_path / "obs").mkdir()
    (tmp_path / "obs/x.txt").write_text("one\ntwo\n")
    spark.dataSource.register(readers.ObservationSource)
    assert spark.read.format("observations").option("path", f"file://{tmp_path}/obs").option("source", "s").load().count() == 2


def test_windows_are_counted_where_the_text_is(spark):
    """Counts are those of the exploded bins, and no window is a row on the way."""
    from collections import Counter

    from loam.functions import vector as V

    texts = [None, "", "a", "ab", "ABC abc", "é✓ÀÀ" * 9, "İΣ ΑΣ", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    each = df.select("doc_id", F.explode(V.hashed_ngram_bins(F.col("text"))).alias("bin"))
    out = V.hashed_ngram_counts(df, "doc_id", F.col("text"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {(x.id, x.bin): x.n for x in out.collect()} == Counter((x.doc_id, x.bin) for x in each.collect())


def test_words_are_split_once_for_all_their_grams(spark):
    from loam.functions import text as T

    df = spark.createDataFrame([(0, "A b  c"), (1, ""), (2, None), (3, "x")], "id long, t string")
    out = df.select("id", T.uni_bigrams(F.col("t")).alias("g"), T.bigrams(T.words(F.col("t"))).alias("b"))
    assert {x.id: x.g for x in out.collect()} == {0: ["a", "b", "c", "a b", "b c"], 1: [], 2: None, 3: ["x"]}
    assert {x.id: x.b for x in out.collect()} == {0: ["A b", "b c"], 1: [], 2: None, 3: []}
    one = df.select(F.explode(T.uni_bigrams(F.col("t"))))
    assert one._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
