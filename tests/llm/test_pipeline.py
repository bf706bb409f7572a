"""The pipeline against a plain version of its stages."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from test_native import fill, split_by_hand
from test_text_ops import WORD, classes_by_hand

import corpus_pipeline
from loam.llm import decontam, toxicity
from loam.llm import vectext as V

SF = "/root/testdata/sf0.001"


def plain(spark, limit):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {}
    for d, r in rows.items():
        t = toxicity.tokens(pa.record_batch({"text": [r.text]}), "text")
        e = model.evidence(model.segments(t)[0][0], int(t.words.counts[0]))
        if model.score(np.array([e]))[0] < 0.7:
            kept[d] = r
    cls = classes_by_hand([(d, r.text) for d, r in kept.items()], 5, 80, 100)
    kept = {d: r for d, r in kept.items() if cls[d][1] == d}
    ix = decontam.build([decontam.Item.of(r.item_id, r.text, None) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()])
    for d in list(kept):
        buf, offs = V.buffer(pa.array([kept[d].text]))
        w = V.words(decontam._PUNCT[buf], offs)
        for _, a, z in zip(*decontam.passages(w.first), strict=True):
            here, score = decontam.word_pairs(w.hash[a:z]), np.zeros(ix.pieces)
            for t in np.flatnonzero(np.isin(ix.terms, w.hash[a:z])):
                score[ix.piece[ix.first[t] : ix.first[t + 1]]] += ix.impact[ix.first[t] : ix.first[t + 1]]
            if any(all(np.isin(x, here).mean() >= decontam.OVERLAP - 1e-9 for x in ix.pairs[ix.item[p]]) for p in np.flatnonzero(score >= decontam.THRESHOLD - 1e-9)):
                kept.pop(d, None)
    size = {d: len(WORD.findall(r.text or "")) for d, r in kept.items()}
    h = {d: int(hashlib.md5(f"{d}\x01{r.text or ''}".encode()).hexdigest()[:15], 16) for d, r in kept.items()}
    per = defaultdict(list)
    for d, r in kept.items():
        per[r.source].append(d)
    want = fill({s: sum(size[d] for d in ds) for s, ds in per.items()})
    times = {}
    for s, ds in per.items():
        total = sum(size[d] for d in ds)
        whole = int(want[s] // total)
        left = want[s] - whole * total
        for d in sorted(ds, key=h.get):
            times[d] = whole + (left > 0 and left * 2 >= size[d])
            left -= size[d]
    rows = [(h[d], len((kept[d].text or "").encode())) for d in kept for _ in range(times[d])]
    depth = split_by_hand(rows, limit)
    return Counter({(d, format(h[d], "060b")[: depth[h[d]]]): times[d] for d in kept if times[d]})


def test_pipeline_equals_plain_stages(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "SHARD_BYTES", 60_000)
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard"} <= set(out.columns)
    got = Counter((r.doc_id, r.shard) for r in out.where("not oversized and instr(shard, '+') = 0").collect())
    assert got == {k: n for k, n in plain(spark, 60_000).items() if k in got} and sum(got.values()) > 100
    assert got == Counter({k: n for k, n in plain(spark, 60_000).items() if len(k[1]) < 60})


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mix", "sharding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema == docs.schema
        assert stage(spark, docs.limit(0), SF).count() == 0
