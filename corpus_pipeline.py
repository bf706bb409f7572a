"""A corpus pipeline of five operators; each stage reads what the one before it wrote.

Defined results, of all stages.  Null and empty texts: no words, so never toxic, no copy of anything, no benchmark item, taken
once by the mix, and a shard's row of no bytes.  Very long texts are read whole.  Repeated rows: near copies of each other, so one
stays, unless their texts are empty.  Null ids: judged by their texts; they share a shard's hash only with equal texts.  Ties: of a
group of copies the least id stays (null last).  An empty table gives an empty one at every stage.  Other columns pass through,
whatever their names, but for the last stage's own (shard, depth and its sizes), which replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loam.llm import decontam, jaccard, mixing, sharding, toxicity
from loam.llm.common import cut, table

#: Byte limit of a shard.
SHARD_BYTES = 1 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the model learns from all labelled documents that are not held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean_rows(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, k=5, num=80, den=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified benchmark item."""
    return decontam.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents with their shard."""
    return sharding.shard(docs, limit=SHARD_BYTES)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("source_mix", mix_sources),
    ("sharding", shard),
]

#: SQL can state neither the toxicity model nor the index; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in turn over documents; each result is written and reread as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
