"""Correlation, independence tests and the causal skeleton; Beta and Gaussian beliefs."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.dynamics import _NORMAL, clamp, normal_cdf
from loam.lineage import cut


def moments(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums and sums of products in one pass; rows with nulls are left out."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = x.agg(F.count("*"), *[F.sum(c) for c in cols], *[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in pairs]).first()
    p = len(cols)
    s = np.array(row[1 : 1 + p], float)
    ss = np.zeros((p, p))
    for (i, j), v in zip(pairs, row[1 + p :], strict=True):
        ss[i, j] = ss[j, i] = v or 0.0
    return int(row[0]), s, ss


def correlation_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, r) with i < j: one aggregation; 0 where a column is constant."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = df.agg(*[F.coalesce(F.nanvl(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)), F.lit(0.0)).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs])
    return one.select(F.explode(rows).alias("p")).select("p.*")


def correlation_matrix(n: int, s: np.ndarray, ss: np.ndarray) -> np.ndarray:
    m = s / max(n, 1)
    cov = ss / max(n, 1) - np.outer(m, m)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-24))
    r = cov / np.outer(sd, sd)
    np.fill_diagonal(r, 1.0)
    return r


def fisher_z(r: Column, n: Column | int, conditioned: int = 0) -> tuple[Column, Column]:
    """z and two-sided p of a (partial) correlation."""
    x = clamp(r, -0.9999, 0.9999)
    z = 0.5 * F.log((1 + x) / (1 - x))
    se = 1 / F.sqrt(F.greatest((n if isinstance(n, Column) else F.lit(n)) - conditioned - 3, F.lit(1)).cast("double"))
    return z, 2 * normal_cdf(-F.abs(z) / se)


def partial(rij: Column, rik: Column, rjk: Column) -> Column:
    return (rij - rik * rjk) / F.sqrt(F.greatest((1 - rik * rik) * (1 - rjk * rjk), F.lit(1e-12)))


def _cdf(x: float) -> float:
    p, *b = _NORMAL
    a = abs(x)
    if a > 7:
        return 0.0 if x < 0 else 1.0
    t = 1 / (1 + p * a)
    poly = 0.0
    for c in reversed(b):
        poly = (poly + c) * t
    u = poly * math.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    return 1 - u if x >= 0 else u


def _partial(r: np.ndarray, i: int, j: int, z: tuple[int, ...], first_only: bool) -> float:
    if not z:
        return float(r[i, j])
    if first_only:
        z = z[:1]
    k, rest = z[0], z[1:]
    a, b, c = _partial(r, i, j, rest, False), _partial(r, i, k, rest, False), _partial(r, j, k, rest, False)
    return (a - b * c) / math.sqrt(max((1 - b * b) * (1 - c * c), 1e-12))


def skeleton(n: int, r: np.ndarray, alpha: float = 0.05, most: int = 3, first_only: bool = False) -> tuple[set[tuple[int, int]], dict[tuple[int, int], tuple[int, ...]]]:
    """Undirected edges i < j and separating sets.  Levels 0..most; at a level, i's neighbours as they were at its start.

    first_only: partial correlations condition on the first variable alone.
    """
    p = len(r)
    adj = {i: set(range(p)) - {i} for i in range(p)}
    seps: dict = {}
    for level in range(most + 1):
        gone = []
        for i in range(p):
            for j in range(i + 1, p):
                if j not in adj[i]:
                    continue
                for z in combinations(sorted(adj[i] - {j}), level):
                    x = min(max(_partial(r, i, j, z, first_only), -0.9999), 0.9999)
                    stat = 0.5 * math.log((1 + x) / (1 - x)) * math.sqrt(max(n - level - 3, 1))
                    if 2 * _cdf(-abs(stat)) > alpha:
                        gone.append((i, j))
                        seps[i, j] = z
                        break
        for i, j in gone:
            adj[i].discard(j)
            adj[j].discard(i)
    return {(i, j) for i in adj for j in adj[i] if i < j}, seps


def orient(edges: set[tuple[int, int]], seps: dict) -> dict[tuple[int, int], str]:
    """Colliders, then the first propagation rule until nothing changes: (i, j) -> '->', '<-' or '--'."""
    near = lambda a, b: (min(a, b), max(a, b)) in edges
    arrow: dict = {}
    nodes = sorted({x for e in edges for x in e})
    for b in nodes:
        ns = [x for x in nodes if x != b and near(x, b)]
        for a, c in combinations(ns, 2):
            if not near(a, c) and b not in seps.get((min(a, c), max(a, c)), ()):
                arrow[min(a, b), max(a, b)] = (a, b)
                arrow[min(c, b), max(c, b)] = (c, b)
    more = True
    while more:
        more = False
        for a, b in list(arrow.values()):
            for c in nodes:
                if c not in (a, b) and near(b, c) and not near(a, c) and (min(b, c), max(b, c)) not in arrow:
                    arrow[min(b, c), max(b, c)] = (b, c)
                    more = True
    return {e: "--" if e not in arrow else ("->" if arrow[e] == e else "<-") for e in edges}


def causal_graph(spark: SparkSession, df: DataFrame, cols: list[str], alpha: float = 0.05, first_only: bool = False) -> DataFrame:
    """(from, to, type, strength): sufficient statistics are distributed, the p x p part runs on the driver."""
    n, s, ss = moments(df, cols)
    r = correlation_matrix(n, s, ss)
    kinds = orient(*skeleton(n, r, alpha, first_only=first_only))
    rows = [(cols[j], cols[i], "directed", float(abs(r[i, j]))) if k == "<-" else (cols[i], cols[j], "directed" if k == "->" else "undirected", float(abs(r[i, j]))) for (i, j), k in sorted(kinds.items())]
    return spark.createDataFrame(rows, "from string, to string, type string, strength double")


#: Neighbours of a node in one row, on average at most.
NEAR = 1024


def colliders(edges: DataFrame, sepsets: DataFrame) -> DataFrame:
    """edges (i, j) undirected, i < j; sepsets (i, j, z array) -> (a, b, c): a -> b <- c.

    The c of an edge (a, b) are b's neighbours that are not a's: arrays, split by a hash of c where a node has many, that meet by
    (a, part).  So what moves is arrays, a row an edge and part, and only open triples become rows.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few edges are many triples: no task takes all
    both = cut(edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).repartition(n, "i"))
    widest = both.groupBy("i").count().agg(F.max("count")).first()[0] or 0
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(-(-widest // NEAR) or 1)).cast("int").alias("p")
    near = cut(both.groupBy("i", part("j")).agg(F.sort_array(F.collect_list("j")).alias("near")))
    own = near.toDF("a", "p", "own")
    at = F.array_position("c", F.col("a")).cast("int")  # in a's own part the lists are in order
    above = F.when(at > 0, F.slice("c", at + 1, F.size("c"))).otherwise(F.filter("c", lambda x: x > F.col("a")))
    w = both.toDF("a", "b").join(near.toDF("b", "p", "c"), "b").select("a", "b", "p", above.alias("c")).where(F.size("c") > 0)
    w = w.repartition(n, "a", "p").join(own, ["a", "p"], "left").select("a", "b", "p", F.when(F.col("own").isNull(), F.col("c")).otherwise(F.array_except("c", "own")).alias("c"))
    if not sepsets.isEmpty():
        z = sepsets.select(F.col("i").alias("a"), F.explode("z").alias("b"), F.col("j").alias("c")).groupBy("a", "b", part("c")).agg(F.collect_set("c").alias("z"))
        w = w.where(F.size("c") > 0).join(z, ["a", "b", "p"], "left").select("a", "b", "p", F.when(F.col("z").isNull(), F.col("c")).otherwise(F.array_except("c", "z")).alias("c"))
    return w.select("a", "b", F.explode("c").alias("c"))


def bic(edges: DataFrame, n: int) -> DataFrame:
    """One row: n/2 sum ln max(r^2, 1e-10) - E ln(n) / 2 over directed edges (strength)."""
    r2 = F.greatest(F.col("strength") * F.col("strength"), F.lit(1e-10))
    return edges.where("type = 'directed'").agg((n / 2 * F.coalesce(F.sum(F.log(r2)), F.lit(0.0)) - F.count("*") * math.log(max(n, 1)) / 2).alias("bic"))


# ---------------------------------------------------------------- beliefs


def beta_posterior(counts: DataFrame, key: str, success: str, failure: str, a0: float = 1.0, b0: float = 1.0) -> DataFrame:
    a, b = F.col(success) + a0, F.col(failure) + b0
    mean = a / (a + b)
    var = a * b / ((a + b) * (a + b) * (a + b + 1))
    return counts.select(key, a.alias("alpha"), b.alias("beta"), mean.alias("mean"), var.alias("variance"), F.greatest(mean - 1.96 * F.sqrt(var), F.lit(0.0)).alias("lower"), F.least(mean + 1.96 * F.sqrt(var), F.lit(1.0)).alias("upper"), F.log(mean / (1 - mean)).alias("log_odds"))


def gaussian_update(rows: DataFrame, key: str, value: str, precision: float = 1.0, mean0: float = 20.0, precision0: float = 0.1) -> DataFrame:
    """Conjugate update; the order of rows does not matter, so it is one aggregation."""
    n, s = F.count(value) * precision, F.coalesce(F.sum(value), F.lit(0.0)) * precision
    return rows.groupBy(key).agg(((s + mean0 * precision0) / (n + precision0)).alias("mean"), (n + precision0).alias("precision"))


def merge_beliefs(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg((F.sum(F.col("precision") * F.col("mean")) / F.sum("precision")).alias("mean"), F.sum("precision").alias("precision"))


def welford(rows: DataFrame, key: str, value: str) -> DataFrame:
    var = F.when(F.count(value) < 2, 0.0).otherwise(F.var_pop(value))
    return rows.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), var.alias("variance"), F.sqrt(var).alias("std"))


def log_marginal(rows: DataFrame, key: str, value: str) -> DataFrame:
    v, n = F.var_pop(value), F.count(value)
    return rows.groupBy(key).agg(F.when(F.coalesce(v, F.lit(0.0)) < 1e-10, 0.0).otherwise(-n / 2 * F.log(2 * math.pi * v) - n / 2).alias("log_marginal"))


def belief_fold(observations: DataFrame, key: str) -> DataFrame:
    """observations (key, seq, lr, strength) from a uniform prior, in order: (key, alpha, beta, confidence, n_updates)."""
    e = observations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "lr", "strength"))).alias("e"))
    start = F.struct(F.lit(1.0).alias("a"), F.lit(1.0).alias("b"), F.lit(0).alias("n"))

    r = e.withColumn("s", F.aggregate("e", start, _belief_step))
    mean = F.col("s.a") / (F.col("s.a") + F.col("s.b"))
    return r.select(key, F.col("s.a").alias("alpha"), F.col("s.b").alias("beta"), (2 * F.abs(mean - 0.5)).alias("confidence"), F.col("s.n").alias("n_updates"))


def propagate(nodes: DataFrame, deps: DataFrame, observed: DataFrame) -> DataFrame:
    """One hop: observations to the children of observed nodes (node, mean, strength): likelihood ratio 1 + (mean - .5) w."""
    j = deps.join(observed, deps["parent"] == observed["node"]).select("child", (1 + (F.col("mean") - 0.5) * F.col("weight")).alias("lr"), (F.col("strength") / 2).alias("strength"))
    return j.join(nodes.select(F.col("node").alias("child")), "child", "left_semi")


def belief_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes (node, alpha, beta, confidence, n_updates) with new (node, mean, weight) ones, which replace those of their name:
    Beta(1, 1) where mean is null, else ten times the weight as pseudo-counts around the mean."""
    m, w = F.col("mean"), F.col("weight") * 10
    made = new.select("node", F.when(m.isNull(), 1.0).otherwise(m * w).alias("alpha"), F.when(m.isNull(), 1.0).otherwise((1 - m) * w).alias("beta"), F.when(m.isNull(), 0.0).otherwise(2 * F.abs(m - 0.5)).alias("confidence"), F.lit(0).alias("n_updates"))
    return nodes.join(made.select("node"), "node", "left_anti").select(made.columns).unionByName(made)


def dependencies(deps: DataFrame, new: DataFrame) -> DataFrame:
    """(child, parent, weight): new edges are appended, repeats kept."""
    return deps.unionByName(new.select(deps.columns))


def _belief_step(s: Column, x: Column) -> Column:
    w = x["strength"] * F.greatest(F.log(1.0 + s["n"]), F.lit(1.0))
    up = x["lr"] > 1
    a, b = s["a"] + F.when(up, x["lr"] * w).otherwise(w), s["b"] + F.when(up, w).otherwise(w / x["lr"])
    return F.struct(a.alias("a"), b.alias("b"), (s["n"] + 1).alias("n"))


def observe(nodes: DataFrame, deps: DataFrame, observations: DataFrame) -> DataFrame:
    """nodes after observations (node, seq, lr, strength), folded in order; each also moves the node's children, by
    1 + (mean - .5) weight and half the strength, with the mean right after it.

    One batch: an observed parent must not itself be the child of an observed node, or its mean would hang on the batch's
    own order; such a batch raises, and is to be given in parts.  Observations of unknown nodes move their children from a
    mean of a half.
    """
    seen = observations.select("node").distinct()
    inner = deps.join(seen.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node")).join(seen, "node", "left_semi")
    if not inner.join(deps.select(F.col("parent").alias("node")), "node", "left_semi").isEmpty():
        raise ValueError("an observed parent is the child of an observed node: give the observations in parts")
    start = lambda: F.struct(F.col("alpha").cast("double").alias("a"), F.col("beta").cast("double").alias("b"), F.col("n_updates").cast("int").alias("n"))
    e = observations.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("seq", "lr", "strength"))).alias("e"))
    trail = F.struct(start().alias("s"), F.array().cast("array<struct<seq:bigint,mean:double,strength:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = _belief_step(acc["s"], x)
        return F.struct(s.alias("s"), F.array_append(acc["out"], F.struct(x["seq"].cast("long").alias("seq"), (s["a"] / (s["a"] + s["b"])).alias("mean"), x["strength"].cast("double").alias("strength"))).alias("out"))

    means = e.join(nodes, "node").select("node", F.explode(F.aggregate("e", trail, step)["out"]).alias("m")).select("node", "m.*")
    lost = observations.join(nodes.select("node"), "node", "left_anti").select("node", F.col("seq").cast("long").alias("seq"), F.lit(0.5).alias("mean"), F.col("strength").cast("double").alias("strength"))
    moved = deps.join(means.unionByName(lost), deps["parent"] == F.col("node")).select(F.col("child").alias("node"), "seq", F.lit(1).alias("turn"), (1 + (F.col("mean") - 0.5) * F.col("weight")).alias("lr"), (F.col("strength") / 2).alias("strength"))
    every = observations.select("node", F.col("seq").cast("long").alias("seq"), F.lit(0).alias("turn"), F.col("lr").cast("double").alias("lr"), F.col("strength").cast("double").alias("strength")).unionByName(moved)
    folded = every.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("seq", "turn", "lr", "strength"))).alias("e"))
    r = nodes.join(folded, "node", "left").withColumn("s", F.aggregate(F.coalesce("e", F.array().cast("array<struct<seq:bigint,turn:int,lr:double,strength:double>>")), start(), _belief_step))
    mean = F.col("s.a") / (F.col("s.a") + F.col("s.b"))
    return r.select("node", F.col("s.a").alias("alpha"), F.col("s.b").alias("beta"), F.when(F.col("s.n") > F.col("n_updates"), 2 * F.abs(mean - 0.5)).otherwise(F.col("confidence")).alias("confidence"), F.col("s.n").alias("n_updates"))


# ---------------------------------------------------------------- reading a causal graph


def neighbours(edges: DataFrame) -> DataFrame:
    """edges (from, to, type) -> (node, neighbour), once each, of either direction."""
    a = edges.select(F.col("from").alias("node"), F.col("to").alias("neighbour"))
    return a.unionByName(edges.select(F.col("to").alias("node"), F.col("from").alias("neighbour"))).where("node <> neighbour").distinct()


def parents(edges: DataFrame) -> DataFrame:
    """(node, parent) of directed edges."""
    return edges.where("type = 'directed'").select(F.col("to").alias("node"), F.col("from").alias("parent"))


def n_directed(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count_if(F.col("type") == "directed").alias("n_directed"))
