"""Columns of any name and ids of any type through all public functions and the stages of the pipeline."""

import json

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loam.llm import decontam, jaccard, licenses, mixing, periodic, ppm, qda, quality_rules, sharding, spelling, toolcalls, toxicity, warc

SF = "/root/testdata/sf0.001"
CLASH = ["__id", "__odd", "__row", "__key", "__text", "size", "source_size", "target", "times", "taken", "row", "score", "n", "word", "cls", "key", "id", "component", "runs", "h1", "region", "rid"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    twice = d.limit(3).union(d.limit(2)).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    odd = spark.createDataFrame([(None, None, "en", None, None), (5_000_000, "", "en", "web", 0), (5_000_001, None, None, "web", 0)], d.schema)
    return d.union(twice).union(odd).select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in CLASH]).cache()


def same_columns(out, docs):
    for c in CLASH:
        assert out.where(~F.col(f"`{c}`").startswith(f"{c}-")).isEmpty(), c
    return out.select(docs.columns)


def test_rows_keep_their_columns(spark, docs):
    for out in (jaccard.one_of_each(docs, k=5, num=80), mixing.mixed_rows(docs), sharding.shard(docs), decontam.clean_rows(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))):
        assert 0 < same_columns(out, docs).count() <= 3 * docs.count()
    out = mixing.mix(docs)
    assert out.where("size is null or taken > 3 * size").isEmpty() and out.select("__row", "word").where("not startswith(word, 'word-')").isEmpty()


def test_stages_of_the_pipeline(spark, docs):
    """Nulls, repeated rows, empty texts and clashing names in every stage."""
    clash = docs.drop("text_").withColumn("shard_", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, SF)
        assert out.columns == clash.columns and out.count() > 0, name
        same_columns(out, clash)
    assert corpus_pipeline.shard(spark, clash, SF).count() == clash.count()


def test_scores_take_any_columns(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    n = docs.count()
    assert quality_rules.judge(docs, labels).count() == n
    assert toxicity.score(docs, labels).count() == n
    assert qda.score(docs, labels).count() == n
    assert ppm.score(docs, docs).count() == n
    assert jaccard.classes(docs).count() == n
    for f in (licenses.scan, periodic.runs):
        assert f(docs).count() == n
    spelling.variants(docs, min_count=1).count()


def test_text_ids_in_archives(spark, tmp_path):
    ids = ["b", "a", 'x:"\r\n%41', "None", "", None]
    pages = spark.createDataFrame([(i, f"http://{k}", "same" if k < 2 else f"page {k}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    got = warc.archive(pages, f"file://{tmp_path}/t").collect()
    assert sorted(x.page_id or "~" for x in got) == sorted(i or "~" for i in ids)
    assert {x.page_id: x.refers_to for x in got if x.record_type == "revisit"} == {"b": "a"}


def test_conversation_ids_and_parts(spark):
    rows = [('c"1', k, "user", f"t{k}") for k in range(5)] + [(None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    tools = toolcalls.schema_table(spark, toolcalls.REPLY)
    whole = [json.loads(x.json) for x in toolcalls.format_chat(df, tools, part_turns=None).collect()]
    assert {x["conv_id"]: len(x["messages"]) for x in whole} == {'c"1': 5, None: 1}
    parts = [json.loads(x.json) for x in toolcalls.format_chat(df, tools, part_turns=2).collect()]
    assert sorted(len(x["messages"]) for x in parts if x["conv_id"]) == [1, 2, 2]
    number = toolcalls.format_chat(df.withColumn("conv_id", F.lit(7)), tools).first().json
    assert json.loads(number)["conv_id"] == 7
