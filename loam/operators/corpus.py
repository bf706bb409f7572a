"""The gated corpus: ordered admission, statistics, batches, feedback, training-run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions.dynamics import clamp
from loam.lineage import cut
from loam.operators import gates, novelty, ordered, provenance


def admit(rows: DataFrame, min_novelty: float = gates.MIN_NOVELTY, max_share: float = gates.MAX_SOURCE_SHARE) -> DataFrame:
    """Ordered admission of rows (seq, source, title, confidence): adds accepted, reason-free novelty, quality, tier, pheromone.

    A row's fate depends on the stateless gates, on similar accepted rows before it, without which novelty cannot fail, and on
    its source's share of all rows accepted before.  The gates are expressions, similar rows come from a prefix-filtered join of
    distinct word-pair sets, and ordered.admitted() decides in rounds on (place, source, class) and the links between classes.
    """
    ok = gates.static_gates(rows).where("pass")
    members, points = novelty.classes(novelty.hashed(ok, "seq", T.bigrams(T.words(F.col("title")))))
    # candidates with some slack; the decision is on the same number as the novelty itself
    near = cut(novelty.class_pairs(points, max(1 - min_novelty - 1e-9, 0.0)).where(1 - F.col("jaccard") < min_novelty).select("a", "b"))
    links = near.toDF("x", "y").union(near.select("b", "a"))
    slim = ordered.numbered(members.join(ok.select(F.col("seq").alias("id"), "source", (T.word_count(F.col("title")) < 2).alias("short")), "id"), "id")
    if min_novelty > 0.5:  # the novelty of titles without a word pair
        slim = slim.where("not short or place = 0")
    slim = cut(slim)
    chosen = ordered.admitted(slim.select("place", "source", "cls"), links, max_share)
    done = slim.join(chosen, "place", "left_semi").select(F.col("id").alias("seq"), F.lit(True).alias("accepted"))
    state = rows.join(cut(done), "seq", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    nov = novelty.max_jaccard(state.where("accepted"), "seq", "title").withColumnRenamed("id", "seq")
    out = state.join(nov, "seq", "left")
    quality = F.when(F.col("accepted"), gates.admission_quality(F.col("confidence"), gates.reliability(F.col("source")), F.col("novelty")))
    out = out.withColumn("quality", quality)
    return out.withColumn("tier", F.when(F.col("accepted"), gates.tier(F.col("quality")))).withColumn("pheromone", F.col("quality"))


def ingest(rows: DataFrame, **options) -> DataFrame:
    """One row (accepted, rejected) of admit()."""
    return admit(rows, **options).agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


#: Observations of a discovery that its chain names, and bytes of each.
CHAIN_OBSERVATIONS, CHAIN_BYTES = 3, 100


def safe_admit(rows: DataFrame, observations: DataFrame, secret: int, blocked: list[str] = gates.BLOCKED, **options) -> tuple[DataFrame, DataFrame]:
    """Safety filter, then ordered admission of what it passes, then a provenance chain for each accepted row.

    rows (seq, cycle, source, title, confidence, quality_score), observations (seq, pos, source, content) -> rows with
    reasons, safe and admit()'s columns, and the chains' links.  A row that the filter stops is not accepted and takes no
    part in later rows' novelty or share.  Links: the first observations in order, at most 100 bytes of each and no cut
    character, then the discovery itself.
    """
    n = observations.groupBy("seq").agg(F.count("*").alias("observations"))
    counted = rows.join(n, "seq", "left").withColumn("observations", F.coalesce("observations", F.lit(0)))
    told = gates.safety_filter(counted, blocked=blocked)
    got = admit(told.where("safe").drop("reasons", "safe"), **options)
    state = told.join(got.select("seq", "accepted", "novelty", "quality", "tier", "pheromone"), "seq", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    state = cut(state)
    first = W.partitionBy("seq").orderBy("pos")
    o = observations.join(state.where("accepted").select("seq"), "seq", "left_semi").withColumn("pos", F.row_number().over(first) - 1).where(F.col("pos") < CHAIN_OBSERVATIONS)
    head = F.coalesce(F.get(T.chunks(F.substring("content", 1, CHAIN_BYTES), CHAIN_BYTES), F.lit(0)), F.lit(""))
    seen = o.select(F.col("seq").alias("discovery_id"), "pos", F.concat(F.lit("Observation from "), "source", F.lit(": "), head).alias("claim"), F.lit("observation").alias("type"))
    own = state.where("accepted").select(F.col("seq").alias("discovery_id"), F.least("observations", F.lit(CHAIN_OBSERVATIONS)).cast("int").alias("pos"), F.concat(F.lit("Discovery: "), "title", F.lit(" | quality="), F.format_string("%.2f", "quality_score")).alias("claim"), F.lit("discovery").alias("type"))
    return state, provenance.build_chain(seen.unionByName(own), secret)


def stats(corpus: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return corpus.agg(
        F.count("*").alias("n"), zero(F.avg("confidence")).alias("mean_confidence"), zero(F.avg("pheromone")).alias("mean_pheromone"), F.countDistinct("source").alias("n_sources"),
        *[F.count_if(F.col("tier") == k).alias(f"tier{k}") for k in (0, 1, 2)],
    )


def source_quality(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("source").agg(F.count("*").alias("n"), F.avg("quality").alias("mean_quality"), F.min("quality").alias("min_quality"), F.max("quality").alias("max_quality"))


def tier_distribution(corpus: DataFrame) -> DataFrame:
    per = corpus.groupBy("tier").agg(F.count("*").alias("n"))
    return per.join(F.broadcast(per.agg(F.sum("n").alias("total")))).select("tier", "n", (100.0 * F.col("n") / F.greatest("total", F.lit(1))).alias("percent"))


def health(corpus: DataFrame) -> DataFrame:
    s = stats(corpus)
    h = F.least(F.lit(1.0), 0.4 * F.col("mean_confidence") + 0.3 * F.col("mean_pheromone") + 0.3 * F.least(F.col("n_sources") / 4.0, F.lit(1.0)))
    return s.select(h.alias("health"), F.when(h >= 0.7, "healthy").when(h >= 0.5, "growing").otherwise("weak").alias("label"))


# ---------------------------------------------------------------- batches


def draw(id_col: str | Column, seed: int) -> Column:
    """A number in (0, 1) for each id: 52 bits of MD5 over seed and id.  It depends on nothing else, neither on the order of rows
    nor on partitions, and SQL can state it."""
    key = F.concat(F.lit(f"{seed}:"), (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def sample(corpus: DataFrame, strategy: str, k: int, seed: int = 42, temperature: float = 0.5) -> DataFrame:
    """k rows (fewer if the corpus has fewer, or after removal of repeats in "mixed"), the same for the same seed.

    Weighted draws without replacement are the k least of waiting times -ln(u) / weight (Efraimidis & Spirakis, 2006), u by id:
    a top-k of each task and of those, no sort.  Weights of 0 come last, by u; if all are 0, or their sum is, u alone decides.
    "stigmergic" weighs by exp(pheromone / temperature), taken as logarithms so that nothing overflows.
    """
    wait = -F.log(draw("id", seed))
    if strategy == "curriculum":
        return corpus.orderBy("tier", "id").limit(k)
    if strategy == "uniform":
        return corpus.orderBy(draw("id", seed), "id").limit(k)
    if strategy == "pheromone":
        return corpus.orderBy(F.when(F.col("pheromone") > 0, wait / F.col("pheromone")).otherwise(float("inf")), wait.desc(), "id").limit(k)
    if strategy == "stigmergic":
        return corpus.orderBy(F.log(wait) - F.col("pheromone") / max(temperature, 0.01), "id").limit(k)
    if strategy == "mixed":
        m = round(0.6 * k)
        return sample(corpus, "pheromone", m, seed).unionByName(sample(corpus, "uniform", k - m, seed + 1)).dropDuplicates(["id"])
    raise ValueError(strategy)


def after_batch(corpus: DataFrame, picked: DataFrame) -> DataFrame:
    """Snapshot after a batch: picked rows are sampled once more and evaporate a little."""
    p = picked.select("id", F.lit(True).alias("__p"))
    out = corpus.join(p, "id", "left")
    hit = F.col("__p").isNotNull()
    return out.withColumns({"samples": F.col("samples") + hit.cast("int"), "pheromone": F.when(hit, F.greatest(F.lit(0.01), F.col("pheromone") * 0.98)).otherwise(F.col("pheromone"))}).drop("__p")


def dispatch(corpus: DataFrame, strategy: str, size: int, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Batch, its mean pheromone after evaporation (0 if empty), and the corpus after it."""
    batch = sample(corpus, strategy, size, **options)
    left = after_batch(corpus, batch)
    mean = left.join(batch.select("id"), "id", "left_semi").agg(F.coalesce(F.avg("pheromone"), F.lit(0.0)).alias("mean_pheromone"))
    return batch, mean, left


def listing(corpus: DataFrame, n: int) -> DataFrame:
    return corpus.orderBy(F.desc("pheromone"), "id").limit(n)


# ---------------------------------------------------------------- exact generators


class Lcg:
    """64-bit linear congruential generator; yields integers below 2**64."""

    # Seed, multiplier, increment.
    SEED, MUL, ADD = 0xDEADBEEF12345678, 6364136223846793005, 1442695040888963407

    def __init__(self, seed: int = SEED):
        self.x = seed & (2**64 - 1)

    def next(self) -> int:
        self.x = (self.x * self.MUL + self.ADD) & (2**64 - 1)
        return self.x

    def unit(self) -> float:
        return self.next() / (2**64 - 1)


class Xorshift:
    """64-bit xorshift generator; a zero seed is replaced."""

    # The seed in place of zero, and the three shifts.
    SEED, SHIFTS = 0xDEADBEEFCAFEBABE, (13, 7, 17)

    def __init__(self, seed: int = 0):
        self.x = seed & (2**64 - 1) or self.SEED

    def next(self) -> int:
        a, b, c = self.SHIFTS
        self.x ^= self.x << a & (2**64 - 1)
        self.x ^= self.x >> b
        self.x ^= self.x << c & (2**64 - 1)
        return self.x

    def unit(self) -> float:
        return (self.next() >> 11) / 2**53


def weighted_pick(weights: list[float], k: int, rng: Lcg | None = None) -> list[int]:
    """Sequential weighted sampling without replacement by a running sum; for small lists on the driver."""
    rng = rng or Lcg()
    left, out = list(enumerate(weights)), []
    while left and len(out) < k:
        r, acc, at = rng.unit() * sum(w for _, w in left), 0.0, 0
        for j, (_, w) in enumerate(left):
            acc += w
            if r <= acc:
                at = j
                break
        out.append(left.pop(at)[0])
    return out


# ---------------------------------------------------------------- feedback and decay


def feedback(corpus: DataFrame, events: DataFrame) -> DataFrame:
    """events (id, seq, positive) folded in order: + raises pheromone by a fifth (at most 1) and above .8 the tier; - lowers it.

    The fold is one aggregate over a row's own ordered events.
    """
    ordered = events.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "positive"))).alias("__e"))
    j = corpus.join(ordered, "id", "left")

    def step(acc: Column, e: Column) -> Column:
        up = F.least(acc["pheromone"] * 1.2, F.lit(1.0))
        p = F.when(e["positive"], up).otherwise(F.greatest(acc["pheromone"] * 0.7, F.lit(0.01)))
        t = F.when(e["positive"] & (up > 0.8) & (acc["tier"] < 2), acc["tier"] + 1).otherwise(acc["tier"])
        return F.struct(p.alias("pheromone"), t.alias("tier"))

    start = F.struct(F.col("pheromone").cast("double").alias("pheromone"), F.col("tier").cast("int").alias("tier"))
    out = F.aggregate(F.coalesce("__e", F.array().cast("array<struct<seq:bigint,positive:boolean>>")), start, step)
    return j.withColumn("__s", out).withColumns({"pheromone": F.col("__s.pheromone"), "tier": F.col("__s.tier")}).drop("__s", "__e")


def decay(corpus: DataFrame, factor: float) -> DataFrame:
    return corpus.withColumn("pheromone", F.greatest(F.col("pheromone") * clamp(F.lit(factor), 0.0, 1.0), F.lit(0.01)))


# ---------------------------------------------------------------- runs of losses


def plateau(losses: DataFrame, key: str, step: str, loss: str, window: int = 5, eps: float = 0.01) -> DataFrame:
    """Adds plateau: the last ``window`` changes are all below eps."""
    w = W.partitionBy(key).orderBy(step)
    d = losses.withColumn("__d", F.abs(F.col(loss) - F.lag(loss).over(w)))
    last = w.rowsBetween(-(window - 1), 0)
    return d.withColumn("plateau", (F.count("__d").over(last) == window) & (F.max("__d").over(last) < eps)).drop("__d")


def trend(yields: DataFrame, key: str, seq: str, value: str, start: float = 0.5) -> DataFrame:
    """(key, explore): the exploration ratio after all cycles; three falling yields raise it by .1 (to .9 at most), a rise
    lowers it by .05 (to .1 at least)."""
    w = W.partitionBy(key).orderBy(seq)
    r = yields.withColumns({"__a": F.lag(value, 2).over(w), "__b": F.lag(value, 1).over(w)})
    a, b, c = F.col("__a"), F.col("__b"), F.col(value)
    delta = F.when(a.isNull(), 0.0).when((c <= b) & (b <= a) & (a > 0), 0.1).when(c > b, -0.05).otherwise(0.0)
    e = r.select(key, F.struct(F.col(seq).alias("s"), delta.alias("d")).alias("e")).groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("e"))
    fold = F.aggregate("e", F.lit(start), lambda x, s: F.when(s["d"] > 0, F.least(x + s["d"], F.lit(0.9))).when(s["d"] < 0, F.greatest(x + s["d"], F.lit(0.1))).otherwise(x))
    return e.select(key, fold.alias("explore"))


def invasion_fitness(items: DataFrame, id_col: str = "id", most_broadcast: int = 20_000, competition: float = 0.2) -> DataFrame:
    """(id, score): success - cost - sum over other residents of relu(cosine - .2) times their weight.

    items (id, success_rate, cost, embedding, pheromone_weight).  Vectors meet as numpy blocks; see vectors.pairs().
    """
    from loam.operators import vectors

    pairs = vectors.pairs(items.select(F.col(id_col).alias("id"), "embedding"), competition, both=True)
    weights = items.select(F.col(id_col).alias("b"), F.col("pheromone_weight").alias("w"))
    crowd = pairs.join(weights, "b").groupBy("a").agg(F.sum((F.col("cosine") - competition) * F.col("w")).alias("crowd"))
    out = items.join(crowd, items[id_col] == crowd["a"], "left")
    return out.select(F.col(id_col).alias("id"), (F.col("success_rate") - F.col("cost") - F.coalesce("crowd", F.lit(0.0))).alias("score"))
