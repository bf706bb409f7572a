"""Token and action sampling over (step, token, logit) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Presets of the sampling pipeline.
PRESETS = {"greedy": {"temperature": 0.0}, "balanced": {"temperature": 0.7, "top_p": 0.9, "repetition": 1.1}, "creative": {"temperature": 1.0, "top_p": 0.95, "top_k": 50}}


def _step():
    return W.partitionBy("step")


def _rank():
    return W.partitionBy("step").orderBy(F.desc("logit"), "token")


def softmax(rows: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Adds p within each step."""
    e = F.exp((F.col("logit") - F.max("logit").over(_step())) / temperature)
    return rows.withColumn("__e", e).withColumn("p", F.col("__e") / F.sum("__e").over(_step())).drop("__e")


def top_k(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(_rank())).where(F.col("__r") <= k).drop("__r")


def top_p(rows: DataFrame, p: float) -> DataFrame:
    """The likeliest tokens until their probabilities reach p, the one that reaches it included."""
    r = softmax(rows)
    before = F.sum("p").over(_rank().rowsBetween(W.unboundedPreceding, 0)) - F.col("p")
    return r.withColumn("__b", before).where(F.col("__b") < p).drop("__b")


def min_p(rows: DataFrame, p: float) -> DataFrame:
    return rows.withColumn("__m", F.max("logit").over(_step())).where(F.col("logit") >= F.col("__m") + F.log(F.lit(p))).drop("__m")


def argmax(rows: DataFrame) -> DataFrame:
    """The greatest logit of each step; of equals the last token."""
    return rows.groupBy("step").agg(F.max_by("token", F.struct("logit", "token")).alias("token"))


def cdf_pick(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """rows with p, draws (step, r): the first token in token order whose running sum exceeds r, else the last."""
    c = F.sum("p").over(W.partitionBy("step").orderBy("token").rowsBetween(W.unboundedPreceding, 0))
    j = rows.withColumn("__c", c).join(draws, "step")
    return j.groupBy("step").agg(F.coalesce(F.min(F.when(F.col("__c") > F.col("r"), F.col("token"))), F.max("token")).alias("token"))


def penalties(rows: DataFrame, history: DataFrame, repetition: float = 1.0, frequency: float = 0.0, presence: float = 0.0, suppress: list[int] | None = None, window: int | None = None) -> DataFrame:
    """history (step, pos, token).  The repetition penalty applies once for each occurrence in the last ``window`` tokens."""
    h = history
    if window:
        h = h.withColumn("__r", F.row_number().over(W.partitionBy("step").orderBy(F.desc("pos")))).where(F.col("__r") <= window)
    n = h.groupBy("step", "token").agg(F.count("*").alias("__n"))
    l = F.col("logit")  # noqa: E741
    k = F.coalesce("__n", F.lit(0))
    scaled = F.when(l > 0, l / F.pow(F.lit(repetition), k)).otherwise(l * F.pow(F.lit(repetition), k))
    out = rows.join(n, ["step", "token"], "left").withColumn("logit", scaled - frequency * k - presence * (k > 0).cast("int")).drop("__n")
    return out.where(~F.col("token").isin(suppress)) if suppress else out


def pipeline(rows: DataFrame, history: DataFrame, temperature: float = 1.0, k: int | None = None, p: float | None = None, least_p: float | None = None, **penalty) -> DataFrame:
    """Penalties, temperature, top-k, top-p, min-p, softmax; temperature 0 is greedy and takes the penalties alone."""
    r = penalties(rows, history, **penalty)
    if temperature <= 0:
        return argmax(r)
    r = r.withColumn("logit", F.col("logit") / temperature)
    r = top_k(r, k) if k else r
    r = top_p(r, p).drop("p") if p else r
    r = min_p(r, least_p) if least_p else r
    return softmax(r)


def cross_entropy(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: the mean of logsumexp - target's logit."""
    m = rows.groupBy("step").agg(F.max("logit").alias("m"))
    s = rows.join(m, "step").groupBy("step").agg((F.log(F.sum(F.exp(F.col("logit") - F.col("m")))) + F.first("m")).alias("lse"))
    t = rows.join(targets.withColumnRenamed("target", "token"), ["step", "token"]).select("step", "logit")
    return s.join(t, "step").agg(F.avg(F.col("lse") - F.col("logit")).alias("loss"))


# ---------------------------------------------------------------- actions


def softmax_policy(actions: DataFrame, temperature: float) -> DataFrame:
    """actions (agent, action, efe): probabilities of softmax(-efe / T)."""
    w = W.partitionBy("agent")
    e = F.exp((F.min("efe").over(w) - F.col("efe")) / temperature)
    return actions.withColumn("__e", e).withColumn("p", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def greedy(actions: DataFrame) -> DataFrame:
    return actions.groupBy("agent").agg(F.min_by("action", F.struct("efe", "action")).alias("action"))


def ucb(actions: DataFrame, c: float) -> DataFrame:
    """actions (agent, action, efe, visits): argmin of efe - c sqrt(ln N / (n + 1)); ln N counts as 1 where N is 0."""
    total = F.sum("visits").over(W.partitionBy("agent"))
    ln = F.when(total == 0, 1.0).otherwise(F.log(total.cast("double")))
    s = F.col("efe") - c * F.sqrt(ln / (F.col("visits") + 1))
    return actions.withColumn("score", s).groupBy("agent").agg(F.min_by("action", F.struct("score", "action")).alias("action"), F.min("score").alias("score"))


def epsilon_greedy(actions: DataFrame, epsilon: float, seed: int = 42) -> DataFrame:
    best = greedy(actions)
    any_ = actions.withColumn("__r", F.rand(seed)).groupBy("agent").agg(F.min_by("action", "__r").alias("other"))
    return best.join(any_, "agent").select("agent", F.when(F.rand(seed + 1) < epsilon, F.col("other")).otherwise(F.col("action")).alias("action"))


def sharpen(scores: DataFrame, start: float, gamma: float, steps: int) -> DataFrame:
    """scores (key, item, x): softmax of x / (T0 / (1 + gamma s)) for every step s."""
    t = F.lit(start) / (1 + gamma * F.col("s"))
    r = scores.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    w = W.partitionBy("key", "s")
    e = F.exp((F.col("x") - F.max("x").over(w)) / t)
    return r.withColumn("__e", e).withColumn("p", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def token_deposits(rows: DataFrame) -> DataFrame:
    """rows (token_pos, layer, delta): sum of positive deltas and layers that gave one."""
    d = F.greatest("delta", F.lit(0.0))
    return rows.groupBy("token_pos").agg(F.sum(d).alias("deposit"), F.count_if(F.col("delta") > 0).alias("layers"))

