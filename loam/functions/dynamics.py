"""Decay, cost, annealing and free-energy arithmetic as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decay rate of each kind of deposit.
DECAY_RATES = {"exploitation": 0.02, "exploration": 0.05, "success": 0.01, "traversal": 0.03, "recency": 0.10}
CALIBRATION = 3.3
# Structural cost of a relation; any other costs 1.
STRUCTURAL_COST = {"CONTAINS": 0.2, "contains": 0.2, "HAS_ROOM": 0.3, "has_room": 0.3, "similar": 0.4, "HALL": 0.5, "hall": 0.5, "causes": 0.6, "TUNNEL": 0.7, "tunnel": 0.7, "supports": 0.5, "contradicts": 0.5, "refutes": 0.5, "confirms": 0.5, "leads_to": 0.4}
# Temperature and policy of each agent archetype.
ARCHETYPES = {"explorer": (1.0, "softmax", 1.0), "exploiter": (0.1, "greedy", 0.0), "specialist": (0.3, "softmax", 0.3), "generalist": (0.5, "epsilon", 0.15), "critic": (0.2, "softmax", 0.2)}
FLOOR = 1e-4
CEILING = 5.0


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def lookup(table: dict[str, float], key: Column, default: float) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def decay_exponential(v: Column, rate: Column | float, ticks: Column | int = 1) -> Column:
    """v (1 - rate)**ticks; 0 once below the floor."""
    r = F.pow(1 - (rate if isinstance(rate, Column) else F.lit(rate)), ticks if isinstance(ticks, Column) else F.lit(ticks))
    out = v * r
    return F.when(out < FLOOR, 0.0).otherwise(out)


def decay_linear(v: Column, rate: Column | float, ticks: Column | int = 1) -> Column:
    out = F.greatest(v - rate * (ticks if isinstance(ticks, Column) else F.lit(ticks)), F.lit(0.0))
    return F.when(out < FLOOR, 0.0).otherwise(out)


def decay_sigmoid(v: Column, rate: Column | float, steepness: float = 10.0) -> Column:
    """One tick: a strong value loses up to rate, a weak one almost nothing less."""
    k = F.lit(steepness) * rate
    out = v * (1 - rate / (1 + F.exp(k * (v - 0.5))))
    return F.when(out < FLOOR, 0.0).otherwise(out)


def edge_decay(success: Column, traversal: Column, recency: Column) -> tuple[Column, Column, Column]:
    return success * (1 - DECAY_RATES["success"]), traversal * (1 - DECAY_RATES["traversal"]), recency * (1 - DECAY_RATES["recency"])


def pheromone_factor(success: Column, recency: Column, traversal: Column) -> Column:
    one = F.lit(1.0)
    return 0.5 * F.least(success, one) + 0.3 * F.least(recency, one) + 0.2 * F.least(traversal, one)


def structural_cost(relation: Column) -> Column:
    return lookup(STRUCTURAL_COST, relation, 1.0)


def edge_cost(cosine_to_goal: Column, factor: Column, relation: Column, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> Column:
    a, b, c = weights
    return a * (1 - cosine_to_goal) + b * (1 - factor) + c * structural_cost(relation)


def heuristic(cosine: Column, degree: Column, threshold: float = 0.3) -> Column:
    h = 1 - cosine
    conn = clamp(degree / 20.0, 0.1, 1.0)
    hg = 0.5 * h / conn
    return F.when(cosine < threshold, 0.5 * h + 0.5 * hg).otherwise(0.9 * h + 0.1 * hg)


def calibrated_decay(rate: Column | float, average: Column, diversity: Column) -> Column:
    r = F.lit(rate) if not isinstance(rate, Column) else rate
    return F.when(diversity < 0.3, F.least(r * 2, F.lit(1.0))).when(average > 0.7, F.least(r * 1.5, F.lit(1.0))).when(average < 0.1, r * 0.5).otherwise(r)


def canonical_decay(base: Column | float, mean: Column, variance: Column, crowd: Column, delta: Column) -> Column:
    return clamp(base * F.exp(-0.5 * mean * variance * crowd * F.abs(delta)), 0.005, 0.30)


def annealed(start: float, end: float, p: Column, kind: str = "linear") -> Column:
    t = clamp(p, 0.0, 1.0)
    if kind == "linear":
        return start + (end - start) * t
    if kind == "exponential":
        return start * F.pow(F.lit(end / start), t)
    if kind == "cosine":
        return end + (start - end) * 0.5 * (1 + F.cos(t * math.pi))
    raise ValueError(kind)


def variational_free_energy(observed: Column, mean: Column, precision: Column) -> Column:
    d = observed - mean
    return 0.5 * precision * d * d + 0.5 * F.log(2 * math.pi / precision)


def expected_free_energy(precision: Column, similarity: Column, exploitation: Column, exploration: Column) -> Column:
    return -(1 / precision + F.greatest(similarity, F.lit(0.0)) + 0.5 * exploitation - 0.3 * exploration)


def lr_schedule(step: Column, base: float, warmup: int, total: int, least: float = 0.0) -> Column:
    """Linear warm-up, then half a cosine down to ``least``."""
    p = clamp((step - warmup) / float(max(total - warmup, 1)), 0.0, 1.0)
    return F.when(step < warmup, base * step / float(max(warmup, 1))).otherwise(least + (base - least) * 0.5 * (1 + F.cos(p * math.pi)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def bayes_combine(prior: Column, likelihood: Column) -> Column:
    p, q = clamp(prior, 0.001, 0.999), clamp(likelihood, 0.001, 0.999)
    return p * q / (p * q + (1 - p) * (1 - q))


def evidence_quality(n: Column) -> Column:
    return F.when(n <= 0, 0.5).otherwise(F.least(F.lit(1.0), 0.5 + 0.5 * F.least(F.log(n), F.lit(2.0)) / 2.0))


# Coefficients of the rational approximation 26.2.17 of the normal distribution function.
_NORMAL = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(x: Column) -> Column:
    p, *b = _NORMAL
    a = F.abs(x)
    t = 1 / (1 + p * a)
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = (poly + c) * t
    upper = poly * F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    return F.when(x < -7, 0.0).when(x > 7, 1.0).when(x >= 0, 1 - upper).otherwise(upper)


def recency_weight(age: Column, lam: float = 0.1) -> Column:
    return F.exp(-lam * F.greatest(age, F.lit(0)))
