"""Admission gates, safety filter and quality labels: predicates over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions.dynamics import clamp

# Reliability of known sources; any other counts as DEFAULT_RELIABILITY.
RELIABILITY = {"arxiv": 0.85, "nasa_power": 0.90, "who_gho": 0.90, "world_bank": 0.85, "text_pattern": 0.60, "unknown": 0.50}
DEFAULT_RELIABILITY = 0.6
# What the gates ask for.
MIN_CONFIDENCE, MIN_RELIABILITY, MIN_WORDS, MIN_NOVELTY, MAX_SOURCE_SHARE = 0.40, 0.4, 3, 0.25, 0.5
# Phrases that the safety filter blocks.
BLOCKED = ["flat earth", "perpetual motion", "5g causes"]
# Least confidence and most rows of a cycle that are safe.
SAFE_CONFIDENCE, MAX_PER_CYCLE = 0.50, 50


def reliability(source: Column, table: dict[str, float] = RELIABILITY) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, source), F.lit(DEFAULT_RELIABILITY))


def reliability_upsert(spark, table: DataFrame, changes: DataFrame) -> DataFrame:
    """(source, reliability): changes win, clamped to [0, 1]."""
    new = changes.groupBy("source").agg(F.last("reliability").alias("reliability")).withColumn("reliability", clamp(F.col("reliability"), 0.0, 1.0))
    return table.join(new, "source", "left_anti").unionByName(new)


def static_gates(df: DataFrame, title: str = "title", confidence: str = "confidence", source: str = "source") -> DataFrame:
    """Adds words, confidence_ok, source_ok, causal_ok and pass: the gates that no other row has a part in."""
    n = T.word_count(F.col(title))
    out = df.withColumns({"words": n, "confidence_ok": F.col(confidence) >= MIN_CONFIDENCE, "source_ok": reliability(F.col(source)) >= MIN_RELIABILITY})
    out = out.withColumn("causal_ok", F.col("words") >= MIN_WORDS)
    return out.withColumn("pass", F.col("confidence_ok") & F.col("source_ok") & F.col("causal_ok"))


def tier(quality: Column) -> Column:
    return F.when(quality >= 0.75, 2).when(quality >= 0.55, 1).otherwise(0)


def admission_quality(confidence: Column, rel: Column, novelty: Column) -> Column:
    return (confidence + rel + novelty) / 3


def safety_filter(df: DataFrame, title: str = "title", confidence: str = "confidence", observations: str = "observations", cycle: str = "cycle", seq: str = "seq", most: int = MAX_PER_CYCLE, blocked: list[str] = BLOCKED) -> DataFrame:
    """Adds reasons and safe.  The rate limit counts, in order, the rows that pass the other checks: those are stateless,
    so the count can be taken after them, per cycle."""
    low = F.lower(F.col(title))
    hit = F.lit(None).cast("string")
    for phrase in reversed(blocked):
        hit = F.when(F.contains(low, F.lit(phrase)), F.lit(phrase)).otherwise(hit)
    checks = F.array_compact(
        F.array(
            F.when(F.col(confidence) < SAFE_CONFIDENCE, F.lit("low confidence")),
            F.when(hit.isNotNull(), F.concat(F.lit("blocked: "), hit)),
            F.when(F.col(observations) <= 0, F.lit("no observations")),
        )
    )
    out = df.withColumn("reasons", checks).withColumn("__ok", F.size("reasons") == 0)
    before = F.count_if("__ok").over(W.partitionBy(cycle).orderBy(seq).rowsBetween(W.unboundedPreceding, -1))
    late = F.coalesce(before, F.lit(0)) >= most
    out = out.withColumn("reasons", F.when(late, F.array_append("reasons", F.lit("rate limit"))).otherwise(F.col("reasons")))
    return out.withColumn("safe", F.size("reasons") == 0).drop("__ok")


def quality_gate(confidence: Column, novelty: Column, evidence: Column, contradiction: Column, strict: bool = False) -> tuple[Column, Column]:
    """Score in [0, 1] and the joined reasons of failure, null if it passes."""
    c, n, e, x = (0.80, 0.55, 3, 0.20) if strict else (0.65, 0.40, 2, 0.30)
    score = clamp(0.4 * confidence + 0.3 * novelty + 0.2 * F.least(evidence, F.lit(5)) / 5 + 0.1 * (1 - contradiction), 0.0, 1.0)
    reasons = F.concat_ws("; ", F.when(confidence < c, "confidence"), F.when(novelty < n, "novelty"), F.when(evidence < e, "evidence"), F.when(contradiction > x, "contradiction"))
    return score, F.nullif(reasons, F.lit(""))


def quality_label(score: Column) -> Column:
    return F.when(score >= 0.90, "excellent").when(score >= 0.75, "good").when(score >= 0.60, "acceptable").otherwise("poor")


def stability(explore: Column, batch: Column, temperature: Column, warn_only: bool = False) -> dict[str, Column]:
    exploration_ok = explore * batch > 10
    temperature_ok = temperature >= 1 / F.sqrt(batch)
    return {"exploration_ok": exploration_ok, "temperature_ok": temperature_ok, "all_ok": F.lit(True) if warn_only else exploration_ok & temperature_ok}


def constitution_tractable(rules: DataFrame, most: int = 12, domains: int = 4) -> DataFrame:
    """rules (id, domain) -> one row: few enough, all domains there, ids unique."""
    return rules.agg(F.count("*").alias("n_rules"), F.countDistinct("domain").alias("n_domains"), (F.countDistinct("id") == F.count("*")).alias("unique_ids")).withColumn("tractable", (F.col("n_rules") <= most) & (F.col("n_domains") >= domains) & F.col("unique_ids"))
