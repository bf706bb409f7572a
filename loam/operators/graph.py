"""Path search over relation edges: best-first searches of many queries side by side, greedy walks, least-cost relaxation."""

from __future__ import annotations

import heapq
import math
import pickle
import re
from collections.abc import Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loam.functions import dynamics as D
from loam.functions import vector as V
from loam.lineage import cut, drop


def _cos(a, b) -> float:
    if a is None or b is None or len(a) != len(b) or not len(a):
        return 0.0
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return 0.0 if na < 1e-8 or nb < 1e-8 else max(-1.0, min(1.0, sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb)))


def _factor(e: Mapping) -> float:
    return 0.5 * min(e["success"], 1) + 0.3 * min(e["recency"], 1) + 0.2 * min(e["traversal"], 1)


def best_first(start, goal, edges: dict, vectors: dict, degree: dict, most: int = 1000, weights=(0.4, 0.3, 0.3)) -> dict | None:
    """Path, relations, cost, steps and counts of one search in plain Python, for small graphs and as astar()'s measure; None if
    there is no path, an end is unknown, or more than ``most`` labels are taken.

    A node is opened again only if it is reached for less by over 1e-6.  The heuristic may overestimate, so the path need
    not be the cheapest.
    """
    a, b, c = weights
    if start not in vectors or goal not in vectors:
        return None
    if start == goal:
        return {"path": [start], "relations": [], "cost": 0.0, "steps": [], "iterations": 0, "expanded": 0}

    def h(x) -> float:
        s = _cos(vectors.get(x), vectors.get(goal))
        d = 1 - s
        hg = 0.5 * d / min(max(degree.get(x, 0) / 20, 0.1), 1.0)
        return 0.5 * d + 0.5 * hg if s < 0.3 else 0.9 * d + 0.1 * hg

    best, came = {start: 0.0}, {}
    queue = [(h(start), start, 0.0)]
    rounds = expanded = 0
    while queue:
        f, node, g = heapq.heappop(queue)
        rounds += 1
        if rounds > most:
            return None
        if g > best.get(node, math.inf) + 1e-6:
            continue
        expanded += 1
        if node == goal:
            steps, at = [], goal
            while at in came:
                prev, e, gg = came[at]
                steps.append((at, e["relation"], gg, h(at)))
                at = prev
            steps.reverse()
            return {"path": [start] + [s[0] for s in steps], "relations": [s[1] for s in steps], "cost": g, "steps": [{"node": n, "g": x, "h": y, "f": x + y} for n, _, x, y in steps], "iterations": rounds, "expanded": expanded}
        for e in edges.get(node, ()):
            to = e["to_id"]
            if to not in vectors:
                continue
            cost = g + a * (1 - _cos(vectors[to], vectors.get(goal))) + b * (1 - _factor(e)) + c * D.STRUCTURAL_COST.get(e["relation"], 1.0)
            if cost < best.get(to, math.inf) - 1e-6:
                best[to] = cost
                came[to] = (node, e, cost)
                heapq.heappush(queue, (cost + h(to), to, cost))
    return None


def greedy_walk(start, goal, edges: dict, vectors: dict, pheromone: dict, most: int = 20) -> list:
    """Goes to the unvisited neighbour nearest to the goal, deposits counting as nearness; may end before the goal."""
    path, seen = [start], {start}
    while path[-1] != goal and len(path) <= most:
        near = [(1 - _cos(vectors.get(e["to_id"]), vectors.get(goal)) - 0.2 * pheromone.get(e["to_id"], 0.0), e["to_id"]) for e in edges.get(path[-1], ()) if e["to_id"] not in seen]
        if not near:
            break
        path.append(min(near)[1])
        seen.add(path[-1])
    return path


def navigate(start, goal, edges: dict, vectors: dict, degree: dict, pheromone: dict, max_steps: int = 20) -> list:
    if start == goal:
        return [start]
    found = best_first(start, goal, edges, vectors, degree, max_steps * 10)
    return found["path"] if found else greedy_walk(start, goal, edges, vectors, pheromone, max_steps)


#: Open labels of a search whose edges a round fetches.
WINDOW = 32
#: Weights of nearness to the goal, deposits and kind of relation in an edge's cost.
WEIGHTS = (0.4, 0.3, 0.3)


def _tables(queries: DataFrame, kg: DataFrame, vectors: DataFrame, weights: tuple[float, float, float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (node, to, base, relation), of parallel ones the cheapest; places (to, v, degree); and the searches whose ends are
    places (qid, start, goal, gv, v, degree)."""
    _, b, c = weights
    base = b * (1 - D.pheromone_factor(F.col("success"), F.col("recency"), F.col("traversal"))) + c * D.structural_cost(F.col("relation"))
    edges = kg.select("from_id", "to_id", base.alias("base"), "relation").groupBy("from_id", "to_id").agg(F.min(F.struct("base", "relation")).alias("e"))
    deg = kg.select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("to")).groupBy("to").agg(F.count("*").alias("degree"))
    places = cut(vectors.select(F.col("id").alias("to"), F.col("embedding").alias("v")).join(deg, "to", "left").withColumn("degree", F.coalesce("degree", F.lit(0))))
    ends = queries.join(places.select(F.col("to").alias("goal"), F.col("v").alias("gv")), "goal").join(places.withColumnRenamed("to", "start"), "start")
    return cut(edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("to"), "e.base", "e.relation")), places, ends


def astar(queries: DataFrame, kg: DataFrame, vectors: DataFrame, most: int = 1000, weights: tuple[float, float, float] = WEIGHTS, window: int = WINDOW) -> DataFrame:
    """queries (qid, start, goal) -> (qid, found, path, cost, iterations, expanded, steps), all searches side by side.

    Each search takes its labels (a node, its cost g and distance estimate h) in order of g + h, as best_first() does, so the
    heuristic may overestimate and the result is the same.  A search is a row that holds its open and its taken labels; no more
    than ``most`` labels are ever taken, so of the open ones only as many as may still be taken are kept, and a row is bounded
    whatever the graph.  A round fetches the edges of each search's ``window`` first open labels in one join, of a hub only those
    that may matter, and goes on until a label's edges are not among them.  The graph is never gathered for a search.

    found is false for unknown starts and goals (those without a vector), without a path, and after ``most`` labels.  steps
    (node, relation, g, h, f) follow the path, the start excluded.  Of parallel edges only the cheapest takes part.  Edges to
    nodes without a vector are dropped.
    """
    edges, places, ends = _tables(queries, kg, vectors, weights)
    near = V.cosine(F.col("v"), F.col("gv"))
    h = D.heuristic(near, F.col("degree"))
    kind = queries.schema["start"].dataType.simpleString()
    qkind = queries.schema["qid"].dataType.simpleString()
    goals = cut(ends.select("qid", "start", "goal", "gv", h.alias("h0")))
    targets = cut(goals.select("goal", "gv").dropDuplicates(["goal"]))
    shape = f"array<struct<node:{kind},relation:string,g:double,h:double,f:double>>"
    told = f"found boolean, path array<{kind}>, cost double, iterations long, expanded long, steps {shape}"
    shaped = queries.sparkSession.createDataFrame([], f"qid {qkind}, start {kind}, goal {kind}, h0 double, held binary, asked array<{kind}>, {told}").schema
    state = cut(goals.select("qid", "start", "goal", "h0", F.lit(None).cast("binary").alias("held"), F.array("start").alias("asked")))
    ended = []
    while True:
        asked = cut(state.select("qid", F.explode("asked").alias("parent")).join(goals.select("qid", "goal"), "qid"))
        # steps and estimates depend on goal and edge alone, so searches with one goal share them
        out = asked.select("goal", "parent").distinct().join(edges.withColumnRenamed("node", "parent"), "parent").join(places, "to").join(targets, "goal")
        out = out.select("goal", "parent", F.col("to").alias("node"), (weights[0] * (1 - near) + F.col("base")).alias("step"), h.alias("h"), "relation")
        best = W.partitionBy("goal", "parent").orderBy(F.col("step") + F.col("h"), "node")
        out = cut(out.withColumn("k", F.row_number().over(best)).where(F.col("k") <= most + 1).drop("k"))
        out = asked.join(out, ["goal", "parent"]).drop("goal")
        both = state.unionByName(out, allowMissingColumns=True)
        state = cut(both.groupBy("qid").applyInArrow(_search(most, window, to_arrow_schema(shaped)), shaped))
        done, left = state.agg(F.count_if(F.col("held").isNull()), F.count_if(F.col("held").isNotNull())).first()
        if done:
            ended.append(state.where("held is null").select("qid", "found", "path", "cost", "iterations", "expanded", "steps"))
        if not left:
            break
        state = state.where("held is not null").select("qid", "start", "goal", "h0", "held", "asked")
    if not ended:
        ended = [queries.limit(0).select("qid", *[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in re.split(r", (?=\w+ )", told))])]
    out = queries.select("qid").join(reduce(DataFrame.unionByName, ended), "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return out.select("qid", F.coalesce("found", F.lit(False)).alias("found"), none("path", f"array<{kind}>"), "cost", zero("iterations"), zero("expanded"), none("steps", shape))


def _search(most: int, window: int, shape: pa.Schema):
    """Goes on with one search as far as its edges are here."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        row = next(r for r in rows if r["goal"] is not None)
        kids: dict = {}
        for r in rows:
            if r["goal"] is None:
                kids.setdefault(r["parent"], []).append((r["node"], r["step"], r["h"], r["relation"]))
        start, goal, known, held = row["start"], row["goal"], set(row["asked"]), row["held"]
        queue, best, came, taken, rounds, expanded = pickle.loads(held) if held is not None else ([(row["h0"], start, 0.0)], {start: 0.0}, {}, set(), 0, 0)
        told = {"held": None, "asked": [], "found": False, "path": [], "cost": None, "steps": []}
        if start == goal:
            queue, told = [], told | {"found": True, "path": [start], "cost": 0.0}
        while queue:
            f, node, g = queue[0]
            stale = g > best.get(node, math.inf) + 1e-6
            if not stale and node != goal and node not in known:
                queue = heapq.nsmallest(most - rounds + 1, queue)
                taken_or_open = taken | {x[1] for x in queue}
                keep = lambda d: {k: v for k, v in d.items() if k in taken_or_open}  # noqa: B023, E731
                told["held"] = pickle.dumps((queue, keep(best), keep(came), taken, rounds, expanded))
                told["asked"] = list(dict.fromkeys(n for _, n, x in queue if n != goal and x <= best[n] + 1e-6))[:window]
                break
            heapq.heappop(queue)
            rounds += 1
            if rounds > most:
                break
            if stale:
                continue
            expanded += 1
            if node == goal:
                steps, at = [], goal
                while at != start:
                    at0, relation, gg, hh = came[at]
                    steps.append({"node": at, "relation": relation, "g": gg, "h": hh, "f": gg + hh})
                    at = at0
                steps.reverse()
                told |= {"found": True, "path": [start] + [x["node"] for x in steps], "cost": g, "steps": steps}
                break
            taken.add(node)
            for to, step, h, relation in kids.get(node, ()):
                if g + step < best.get(to, math.inf) - 1e-6:
                    best[to] = g + step
                    came[to] = (node, relation, g + step, h)
                    heapq.heappush(queue, (g + step + h, to, g + step))
        return pa.Table.from_pylist([{"qid": row["qid"], "start": start, "goal": goal, "h0": row["h0"], **told, "iterations": rounds, "expanded": expanded}], schema=shape)

    return run


def least_costs(queries: DataFrame, kg: DataFrame, vectors: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """queries (qid, start, goal) -> (qid, found, cost): the least cost of any path, with astar()'s costs and no heuristic.

    Order does not matter here, so a round goes on from all labels that became cheaper and are cheaper than their goal's, and
    ends when there are none.  A label is a row; edges, labels and vectors meet in joins, whatever a search reaches.
    """
    edges, places, ends = _tables(queries, kg, vectors, weights)
    goals = cut(ends.select("qid", "start", "goal", "gv"))
    best = cut(goals.select("qid", F.col("start").alias("node"), F.lit(0.0).alias("g"), F.lit(True).alias("open")))
    while True:
        top = goals.select("qid", F.col("goal").alias("node")).join(best, ["qid", "node"]).select("qid", F.col("g").alias("top"))
        front = best.where("open").join(top, "qid", "left").where("top is null or g < top").select("qid", "node", "g")
        out = front.join(edges, "node").join(places, "to").join(goals.select("qid", "gv"), "qid")
        step = weights[0] * (1 - V.cosine(F.col("v"), F.col("gv"))) + F.col("base")
        new = out.groupBy("qid", F.col("to").alias("node")).agg(F.min(F.col("g") + step).alias("new"))
        j = best.drop("open").join(new, ["qid", "node"], "full")
        less = F.col("new").isNotNull() & (F.col("g").isNull() | (F.col("new") < F.col("g") - 1e-12))
        nxt = cut(j.select("qid", "node", F.least("g", "new").alias("g"), less.alias("open")))
        drop(best)
        best = nxt
        if best.where("open").isEmpty():
            break
    hit = goals.select("qid", F.col("goal").alias("node")).join(best, ["qid", "node"]).select("qid", F.col("g").alias("cost"))
    return queries.select("qid").join(hit, "qid", "left").select("qid", F.col("cost").isNotNull().alias("found"), "cost")


def walks(queries: DataFrame, kg: DataFrame, vectors: DataFrame, pheromone: DataFrame, most: int = 20) -> DataFrame:
    """queries (qid, start, goal), pheromone (id, value) -> (qid, path): greedy walks, a step of all of them a round.

    Each goes to the unvisited neighbour nearest to its goal, deposits counting as nearness (of equal ones to the least id), and
    ends at the goal, without such a neighbour, or after ``most`` steps.  A path holds at most that many nodes.
    """
    edges = cut(kg.select(F.col("from_id").alias("node"), F.col("to_id").alias("to")).distinct())
    places = cut(vectors.select(F.col("id").alias("to"), F.col("embedding").alias("v")).join(pheromone.select(F.col("id").alias("to"), "value"), "to", "full"))
    at = queries.join(places.select(F.col("to").alias("goal"), F.col("v").alias("gv")), "goal", "left").select("qid", "goal", "gv", F.col("start").alias("node"), F.array("start").alias("path"))
    at, ends = cut(at), []
    targets = cut(at.select("goal", "gv").dropDuplicates(["goal"]))
    for _ in range(most):
        on = at.where(~F.coalesce(F.col("node") == F.col("goal"), F.lit(False)))
        far = 1 - F.coalesce(V.cosine(F.col("v"), F.col("gv")), F.lit(0.0)) - 0.2 * F.coalesce("value", F.lit(0.0))
        reached = cut(on.join(edges, "node").where(~F.array_contains("path", F.col("to"))).select("qid", "goal", "to"))
        # distances depend on goal and place alone
        told = reached.select("goal", "to").distinct().join(places, "to", "left").join(targets.withColumnRenamed("goal", "g"), F.col("goal").eqNullSafe(F.col("g"))).select("g", F.col("to").alias("t"), far.alias("far"))
        near = reached.join(told, F.col("goal").eqNullSafe(F.col("g")) & (F.col("to") == F.col("t"))).groupBy("qid").agg(F.min(F.struct("far", "to")).alias("best"))
        step = cut(at.join(near, "qid", "left"))
        ends.append(step.where("best is null").select("qid", "path"))
        at = step.where("best is not null").select("qid", "goal", "gv", F.col("best.to").alias("node"), F.concat("path", F.array("best.to")).alias("path"))
        if at.isEmpty():
            break
    return reduce(DataFrame.unionByName, ends).unionByName(at.select("qid", "path")) if ends else at.select("qid", "path")


def navigate_all(queries: DataFrame, kg: DataFrame, vectors: DataFrame, pheromone: DataFrame, max_steps: int = 20) -> DataFrame:
    """(qid, path): astar() of ten labels a step, and for what it does not find a greedy walk."""
    got = cut(astar(queries, kg, vectors, max_steps * 10).select("qid", "found", "path"))
    lost = queries.join(got.where("not found").select("qid"), "qid", "left_semi")
    return got.where("found").select("qid", "path").unionByName(walks(lost, kg, vectors, pheromone, max_steps))


def cheapest(spark: SparkSession, costs: DataFrame, start, most: int | None = None) -> DataFrame:
    """(node, cost): least sum of cost over (from_id, to_id, cost) from start, by label-correcting joins.

    Each round relaxes only edges of nodes that became cheaper, and ends when none did.  A search that isn't finished after
    ``most`` rounds is an error; without it rounds go on as long as costs fall, which ends unless a circle has a negative sum.
    """
    edges = cut(costs.select(F.col("from_id").alias("f"), F.col("to_id").alias("t"), F.col("cost").alias("w")))
    best = spark.createDataFrame([(start, 0.0)], "node long, cost double")
    front = best
    rounds = 0
    while True:
        step = front.join(edges, F.col("node") == F.col("f")).groupBy(F.col("t").alias("n")).agg(F.min(F.col("cost") + F.col("w")).alias("new"))
        j = step.join(best, F.col("n") == F.col("node"), "left")
        front = cut(j.where(F.col("cost").isNull() | (F.col("new") < F.col("cost") - 1e-12)).select(F.col("n").alias("node"), F.col("new").alias("cost")))
        if front.isEmpty():
            return best
        rounds += 1
        if most is not None and rounds > most:
            raise RuntimeError(f"costs still fall after {most} rounds")
        gone = front.select(F.col("node").alias("g"))
        best = cut(best.join(gone, F.col("node") == F.col("g"), "left_anti").unionByName(front))
