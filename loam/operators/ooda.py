"""The discovery cycle: orient, decide, render, and what a run of cycles leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions.dynamics import clamp
from loam.lineage import cut
from loam.operators import novelty, ordered
from loam.sources import readers

# What a cycle's decisions ask for, and the most of them.
MIN_CONFIDENCE, MIN_NOVELTY, MAX_PER_CYCLE = 0.3, 0.30, 100


def orient(observations: DataFrame, numeric_body: str = "content", text: str = "content") -> DataFrame:
    """observations (seq, source, content) -> hypotheses (seq, part, source, cause, effect, confidence): those of numeric
    fields before those of phrases, each in order."""
    src = observations.select("seq", "source")
    a = readers.json_numeric_pairs(observations, "seq", numeric_body).withColumn("part", F.lit(0))
    b = readers.phrase_hypotheses(observations, "seq", text).drop("phrase").withColumn("part", F.lit(1))
    return a.unionByName(b).join(src, "seq").select("seq", "part", "source", "cause", "effect", "confidence")


def decide(hypotheses: DataFrame, known: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_novelty: float = MIN_NOVELTY) -> DataFrame:
    """hypotheses (seq, cause, effect, confidence), known (title) -> accepted (seq, title, confidence, novelty, quality).

    Confidence, emptiness and exact repeats are decided by expressions.  Titles that resemble a known one are out; those that
    resemble each other meet in a join (novelty.dice_links), and of them the earlier one stays, in rounds (ordered.blocked).
    An accepted title's novelty is against all that is known or was accepted before.
    """
    title = F.concat_ws(" → ", "cause", "effect")
    ok = hypotheses.where((F.col("confidence") >= min_confidence) & (F.col("cause") != "") & (F.col("effect") != "")).withColumn("title", title)
    first = ok.groupBy("title").agg(F.min(F.struct("seq", "confidence")).alias("m")).select("m.*", "title").join(known.select("title").distinct(), "title", "left_anti")
    first = cut(first)
    words = F.transform(T.words(F.col("title")), lambda w: F.xxhash64(w)).alias("g")
    old = known.select("title").distinct().select((-1 - F.monotonically_increasing_id()).alias("id"), words)  # before all others
    lists = cut(first.select(F.col("seq").cast("long").alias("id"), words).unionByName(cut(old)))
    links = cut(novelty.dice_links(lists, 1 - min_novelty - 1e-9).where("b >= 0"))
    out = cut(links.where("a < 0").select(F.col("b").alias("node")).distinct())
    left = links.where("a >= 0").join(out.toDF("a"), "a", "left_anti").join(out.toDF("b"), "b", "left_anti")
    out = out.union(ordered.blocked(left))
    kept = lists.join(out.toDF("id"), "id", "left_anti")
    kept = cut(kept)
    best = novelty.best_dice(kept)
    took = kept.where("id >= 0").select(F.col("id").alias("seq")).join(best.toDF("seq", "best"), "seq", "left").select("seq", (1 - F.coalesce("best", F.lit(0.0))).alias("novelty"))
    got = first.select(F.col("seq").cast("long").alias("seq"), "title", F.col("confidence").cast("double").alias("confidence")).join(took, "seq")
    return got.withColumn("quality", clamp(0.6 * F.col("confidence") + 0.4 * F.col("novelty"), 0.0, 1.0))


def render(discoveries: DataFrame) -> DataFrame:
    """discoveries (title, description, claims array<struct<cause, effect, confidence>>, quality) with a markdown entry."""
    claim = lambda c: F.format_string("- %s → %s (%.2f)", c["cause"], c["effect"], c["confidence"])
    return discoveries.withColumn("entry", F.concat_ws("\n", F.concat(F.lit("# "), F.col("title")), F.col("description"), F.lit("## Claims"), F.array_join(F.transform("claims", claim), "\n"), F.format_string("quality: %.2f", F.col("quality"))))


def cap(discoveries: DataFrame, most: int = MAX_PER_CYCLE) -> DataFrame:
    return discoveries.orderBy("seq").limit(most)


def engine_stats(discoveries: DataFrame) -> DataFrame:
    return discoveries.agg(F.coalesce(F.max("cycle"), F.lit(0)).alias("cycles"), F.count("*").alias("total"), F.coalesce(F.avg("quality"), F.lit(0.0)).alias("mean_quality"))


def branching(cycles: DataFrame, key: str = "key", step: str = "step", ratio: str = "ratio", losses: str = "losses", window: int = 5, eps: float = 0.01, spread: float = 0.05, delta: float = 0.1, reset: bool = False) -> DataFrame:
    """cycles (key, step, ratio, losses array) -> (key, step, plateaued, variance, branch, ratio_a, ratio_b).

    A cycle branches if the last ``window`` changes of the exploration ratio are below eps while its own losses vary by
    spread or more; the branches explore delta less and more, within .05 and .95.  With ``reset`` a branch clears the
    history before the next cycle: then a key's cycles are folded in order.
    """
    n = F.greatest(F.size(losses), F.lit(1))
    mean = F.aggregate(losses, F.lit(0.0), lambda s, x: s + x) / n
    var = F.when(F.size(losses) < 2, 0.0).otherwise(F.aggregate(losses, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    r = cycles.select(key, step, F.col(ratio).cast("double").alias("ratio"), F.coalesce(var, F.lit(0.0)).alias("variance"))
    if reset:
        e = r.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(step, "ratio", "variance"))).alias("e"))
        start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("flat"), F.array().cast("array<boolean>").alias("out"))

        def fold(s: Column, x: Column) -> Column:
            flat = F.when(s["last"].isNull() | (F.abs(x["ratio"] - s["last"]) >= eps), 0).otherwise(s["flat"] + 1)
            go = (flat >= window) & (x["variance"] >= spread)
            return F.struct(F.when(~go, x["ratio"]).alias("last"), F.when(go, 0).otherwise(flat).cast("int").alias("flat"), F.array_append(s["out"], flat >= window).alias("out"))

        z = e.withColumn("p", F.aggregate("e", start, fold)["out"])
        r = z.select(key, F.explode(F.arrays_zip("e", "p")).alias("z")).select(key, f"z.e.{step}", "z.e.ratio", "z.e.variance", F.col("z.p").alias("plateaued"))
    else:
        w = W.partitionBy(key).orderBy(step)
        last = w.rowsBetween(-(window - 1), 0)
        r = r.withColumn("__d", F.abs(F.col("ratio") - F.lag("ratio").over(w)))
        r = r.withColumn("plateaued", F.coalesce((F.count("__d").over(last) == window) & (F.max("__d").over(last) < eps), F.lit(False)))
    side = lambda x: clamp(F.col("ratio") + x, 0.05, 0.95)
    return r.select(key, step, "plateaued", "variance", (F.col("plateaued") & (F.col("variance") >= spread)).alias("branch"), side(-delta).alias("ratio_a"), side(delta).alias("ratio_b"))


def agent_beliefs(observations: DataFrame, mean0: float = 0.5, precision0: float = 1.0) -> DataFrame:
    """observations (agent, place, seq, value, precision) -> (agent, place, mean, precision, visits): Gaussian beliefs of
    agents about places; the update does not depend on order."""
    p = F.col("precision")
    g = observations.groupBy("agent", "place").agg(F.sum(p).alias("s"), F.sum(p * F.col("value")).alias("m"), F.count("*").alias("visits"))
    total: Column = F.col("s") + precision0
    return g.select("agent", "place", ((F.col("m") + mean0 * precision0) / total).alias("mean"), total.alias("precision"), "visits")
