"""Queries: vectors, the knowledge store, graph, statistics, chat, sampling, provenance, safety, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import dynamics as D
from loam.functions import text as T
from loam.functions import vector as V
from loam.operators import chat, corpus, graph, ooda, provenance, safety, sampling, stats, vectors
from loam.operators import store as S
from loam.plans.base import CORPUS_SQL, DEP_SQL, KG_SQL, KG_WIDE_SQL, deposits, kg, query, r6, t

_VEC = "v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT id, label, CASE WHEN sqrt(list_sum(list_transform(e, lambda x: x * x))) >= 1e-8 THEN list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) ELSE list_transform(e, lambda x: 0.0) END AS e FROM v)"


def _vec(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")


def _first(spark: SparkSession, d: str) -> list[float]:
    return list(t(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


@query(f"WITH {_VEC} SELECT a.id, round(list_dot_product(a.e, b.e), 6) AS score FROM u a, u b WHERE b.id = 0 ORDER BY list_dot_product(a.e, b.e) DESC, a.id LIMIT 10")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_k(_vec(spark, d), _first(spark, d), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_VEC} SELECT a.id, round(list_dot_product(a.e, b.e), 6) AS score FROM u a, u b WHERE b.id = 7 AND a.id <> 7 ORDER BY list_dot_product(a.e, b.e) DESC, a.id LIMIT 10")
def find_similar(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_to(_vec(spark, d), 7, 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_VEC}, s AS (SELECT a.id, d.text, least(1, list_dot_product(a.e, b.e) + CASE WHEN contains(lower(d.text), 'the') THEN 0.2 ELSE 0 END + 0.1 * ((d.n_chars % 10) / 10.0)) AS score FROM u a JOIN documents d ON d.doc_id = a.id, u b WHERE b.id = 0) SELECT id, round(score::DOUBLE, 6) AS score, left(text, 120) AS preview FROM s ORDER BY s.score DESC, id LIMIT 10")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    rows = _vec(spark, d).join(t(spark, d, "documents").withColumnRenamed("doc_id", "id"), "id")
    q = F.array(*[F.lit(float(x)) for x in _first(spark, d)])
    out = vectors.hybrid_search(rows, "the", q, 10, "id", "text", "text", F.col("embedding"), (F.col("n_chars") % 10) / 10.0)
    return out.withColumn("score", F.round("score", 6))


@query(f"WITH {_VEC} SELECT a.id AS from_id, b.id AS to_id, 'similar' AS relation, round(list_dot_product(a.e, b.e), 6) AS confidence FROM u a JOIN u b ON a.id < b.id WHERE list_dot_product(a.e, b.e) > 0.3")
def similarity_graph(spark: SparkSession, d: str) -> DataFrame:
    return S.similarity_edges(_vec(spark, d).select("id", "embedding"), 0.3).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {_VEC} SELECT a.id AS from_id, b.id AS to_id, 'tunnel' AS relation, round(list_dot_product(a.e, b.e), 6) AS confidence FROM u a JOIN u b ON a.id < b.id AND a.label <> b.label WHERE list_dot_product(a.e, b.e) > 0.3")
def tunnels(spark: SparkSession, d: str) -> DataFrame:
    return S.tunnels(_vec(spark, d), "label", 0.3).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {_VEC}, p AS (SELECT a.id, b.id AS o, list_dot_product(a.e, b.e) AS s FROM u a JOIN u b ON a.label = b.label AND a.id <> b.id WHERE list_dot_product(a.e, b.e) > 0.3), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, o) AS k FROM p) SELECT id, o AS match, round(s, 6) AS score FROM r WHERE k = 1")
def near_duplicate(spark: SparkSession, d: str) -> DataFrame:
    v = _vec(spark, d).withColumnRenamed("label", "room")
    return vectors.duplicate_of(v, v, 0.3).withColumn("score", F.round("score", 6))


@query(f"WITH {_VEC}, p AS (SELECT a.id, sum((list_dot_product(a.e, b.e) - 0.2) * ((b.id % 10) / 10.0)) AS k FROM u a JOIN u b ON a.id <> b.id WHERE list_dot_product(a.e, b.e) > 0.2 GROUP BY a.id) SELECT u.id, round(((u.id % 100) / 100.0 - (u.id % 7) / 10.0 - coalesce(k, 0))::DOUBLE, 5) AS score FROM u LEFT JOIN p USING (id)")
def invasion_fitness(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    x = _vec(spark, d).select("id", "embedding", ((i % 100) / 100.0).alias("success_rate"), ((i % 7) / 10.0).alias("cost"), ((i % 10) / 10.0).alias("pheromone_weight"))
    return corpus.invasion_fitness(x).withColumn("score", F.round("score", 5))


@query("WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL) SELECT label, i::INT AS i, round(x, 6) AS x FROM m")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    x = vectors.mean_pool(t(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "label", "embedding")
    return x.select("label", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) / 127.0::DOUBLE AS s FROM v) SELECT vec_id, round(s, 9) AS scale, list_sum(list_transform(e, lambda x: round(x / s)))::BIGINT AS total FROM s")
def quantize(spark: SparkSession, d: str) -> DataFrame:
    q = t(spark, d, "embeddings").select("vec_id", V.quantize_int8(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.round("q.scale", 9).alias("scale"), F.aggregate("q.q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# ---------------------------------------------------------------- store


def _entities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = t(spark, d, "documents")
    wings = S.insert_wings(spark.createDataFrame([], "id string, name string, description string"), x.select(F.lit(0).alias("seq"), F.col("lang").alias("name"), F.lit("").alias("description")).distinct())
    rooms, _ = S.insert_rooms(spark.createDataFrame([], "id string, wing_id string, name string, description string"), wings, x.select(F.lit(0).alias("seq"), S.wing_id(F.col("lang")).alias("wing_id"), F.col("source").alias("name"), F.lit("").alias("description")).distinct())
    drawers = x.select(F.col("doc_id").alias("id"), S.room_id(S.wing_id(F.col("lang")), F.col("source")).alias("room_id"))
    return wings, rooms, drawers


@query("SELECT 'wing:' || lang AS wing, 'wing:' || lang || ':' || source AS room, count(*) AS n_drawers FROM documents GROUP BY ALL")
def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return S.taxonomy(*_entities(spark, d))


@query(f"WITH {DEP_SQL}, {KG_SQL} SELECT (SELECT count(DISTINCT lang) FROM documents) AS n_wings, (SELECT count(*) FROM (SELECT DISTINCT lang, source FROM documents)) AS n_rooms, (SELECT count(*) FROM documents) AS n_drawers, (SELECT count(*) FROM g) AS n_kg, (SELECT count(*) FROM g WHERE relation = 'similar') AS n_similar")
def palace_status(spark: SparkSession, d: str) -> DataFrame:
    w, r, x = _entities(spark, d)
    g = kg(spark, d)
    return S.status(wings=w, rooms=r, drawers=x, kg=g, similar=g.where("relation = 'similar'"))


@query("""WITH b AS (SELECT *, list_transform(regexp_extract_all(hex(encode(lower(text))), '..'), lambda x: ('0x' || x)::INT) AS b FROM documents)
SELECT 'wing:' || lang || ':' || source || ':drawer:' || (row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1) AS id, doc_id AS title,
len(list_distinct(list_concat(list_transform(range(1, len(b)), lambda i: (b[i] * 31 + b[i + 1]) % 256), list_transform(range(1, len(b) - 1), lambda i: (b[i] * 961 + b[i + 1] * 31 + b[i + 2]) % 256))))::INT AS n_bins FROM b""")
def drawer_insert(spark: SparkSession, d: str) -> DataFrame:
    _, rooms, x = _entities(spark, d)
    new = t(spark, d, "documents").select(F.col("doc_id").alias("seq"), S.room_id(S.wing_id(F.col("lang")), F.col("source")).alias("room_id"), F.col("doc_id").alias("title"), F.col("text").alias("content"))
    empty = spark.createDataFrame([], "id string, room_id string, title long, content string, embedding array<float>")
    return S.insert_drawers(empty, rooms, new)[0].select("id", "title", F.size(F.filter("embedding", lambda x: x != 0)).alias("n_bins"))


@query(f"WITH {KG_SQL}, e AS (SELECT unnest(list_distinct([from_id, to_id])) AS node FROM g) SELECT node, count(*) AS degree FROM e GROUP BY node")
def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return S.degree(kg(spark, d))


@query(f"WITH {DEP_SQL} SELECT drawer_id, round(max(value), 6) AS pheromone FROM d GROUP BY drawer_id HAVING max(value) > 0 ORDER BY max(value) DESC, drawer_id LIMIT 10")
def hot_paths(spark: SparkSession, d: str) -> DataFrame:
    return S.hot_paths(deposits(spark, d)).withColumn("pheromone", F.round("pheromone", 6))


@query(f"WITH {DEP_SQL}, m AS (SELECT drawer_id, max(value) AS p FROM d GROUP BY drawer_id) SELECT doc_id AS drawer_id, round(coalesce(p, 0), 6) AS pheromone FROM documents LEFT JOIN m ON m.drawer_id = doc_id WHERE coalesce(p, 0) < 0.1 ORDER BY doc_id LIMIT 10")
def cold_spots(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return S.cold_spots(x, deposits(spark, d)).withColumn("pheromone", F.round("pheromone", 6))


@query(f"WITH {KG_SQL}, f AS (SELECT edge_seq, 0.5 * least(success, 1) + 0.3 * least(recency, 1) + 0.2 * least(traversal, 1) AS factor FROM g) SELECT edge_seq, round(factor::DOUBLE, 6) AS factor FROM f WHERE factor > 0 ORDER BY round(f.factor::DOUBLE, 9) DESC, edge_seq LIMIT 10")
def hot_edges(spark: SparkSession, d: str) -> DataFrame:
    return S.hot_edges(kg(spark, d)).select("edge_seq", r6(F.col("factor"), "factor"))


@query(f"WITH {KG_WIDE_SQL}, o AS (SELECT unnest(['supports','contradicts','confirms','refutes','causes','prevents']) AS a, unnest(['contradicts','supports','refutes','confirms','prevents','causes']) AS b) SELECT x.edge_seq AS seq1, y.edge_seq AS seq2, x.from_id, x.to_id, x.relation || ' vs ' || y.relation AS conflict, round(x.confidence + y.confidence, 6) AS weight FROM g x JOIN o ON o.a = x.relation JOIN g y ON y.from_id = x.from_id AND y.to_id = x.to_id AND y.relation = o.b AND y.edge_seq > x.edge_seq WHERE x.confidence + y.confidence > 0.25")
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    return S.contradictions(kg(spark, d, wide=True), 0.25).withColumn("weight", F.round("weight", 6))


@query(f"WITH {KG_SQL} SELECT edge_seq, to_id, relation FROM g WHERE from_id = 3")
def kg_query(spark: SparkSession, d: str) -> DataFrame:
    return S.kg_query(kg(spark, d), 3).select("edge_seq", "to_id", "relation")


@query(f"WITH {KG_SQL} SELECT edge_seq FROM g WHERE from_id <> 3 AND to_id <> 3")
def kg_invalidate(spark: SparkSession, d: str) -> DataFrame:
    return S.kg_invalidate(kg(spark, d), 3).select("edge_seq")


@query(f"WITH {DEP_SQL}, m AS (SELECT drawer_id, max(value) AS p FROM d GROUP BY drawer_id) SELECT round(avg(coalesce(p, 0)), 6) AS average FROM documents LEFT JOIN m ON m.drawer_id = doc_id")
def avg_pheromone(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return S.average_pheromone(x, deposits(spark, d)).withColumn("average", F.round("average", 6))


@query(f"WITH {KG_SQL} SELECT edge_seq, round((0.4 * (1 - (edge_seq % 10) / 10.0) + 0.3 * (1 - (0.5 * least(success, 1) + 0.3 * least(recency, 1) + 0.2 * least(traversal, 1))) + 0.3 * CASE relation WHEN 'similar' THEN 0.4 WHEN 'leads_to' THEN 0.4 WHEN 'causes' THEN 0.6 WHEN 'prevents' THEN 1.0 ELSE 0.5 END)::DOUBLE, 6) AS cost FROM g")
def edge_cost(spark: SparkSession, d: str) -> DataFrame:
    f = D.pheromone_factor(F.col("success"), F.col("recency"), F.col("traversal"))
    return kg(spark, d).select("edge_seq", r6(D.edge_cost((F.col("edge_seq") % 10) / 10.0, f, F.col("relation")), "cost"))


@query(f"WITH {KG_SQL} SELECT edge_seq, round(success * 0.99, 6) AS success, round(traversal * 0.97, 6) AS traversal, round(recency * 0.90, 6) AS recency FROM g")
def edge_decay(spark: SparkSession, d: str) -> DataFrame:
    _, g = S.tick(spark.createDataFrame([], "drawer_id long, tag string, value double, decay double, strategy string"), kg(spark, d))
    return g.select("edge_seq", *[r6(F.col(c), c) for c in ("success", "traversal", "recency")])


@query("SELECT user_id AS agent_id, event_id AS seq FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def diary_recent(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "events").select(F.col("user_id").alias("agent_id"), F.col("event_id").alias("seq"))
    return S.diary_recent(x, 3).select("agent_id", "seq")


@query(f"""WITH {KG_SQL}, p AS (SELECT o_custkey AS path_id, o_orderkey AS pos, o_orderkey * 7 % 99 AS node FROM orders), s AS (SELECT *, lead(node) OVER (PARTITION BY path_id ORDER BY pos) AS nx FROM p), f AS (SELECT from_id, to_id, min(edge_seq) AS edge_seq FROM g GROUP BY ALL),
h AS (SELECT path_id, pos, edge_seq FROM s JOIN f ON f.from_id = s.node AND f.to_id = s.nx), w AS (SELECT edge_seq, 1 - (row_number() OVER (PARTITION BY path_id ORDER BY pos) - 1)::DOUBLE / count(*) OVER (PARTITION BY path_id) AS w FROM h)
SELECT edge_seq, round(sum(w), 6) AS success, round(count(*) * 0.1::DOUBLE, 6) AS traversal FROM w GROUP BY edge_seq""")
def path_reward(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "orders").select(F.col("o_custkey").alias("path_id"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") * 7 % 99).alias("node"))
    e, _ = S.path_reward(p, kg(spark, d))
    return e.select("edge_seq", r6(F.col("success"), "success"), r6(F.col("traversal"), "traversal"))


@query(f"""WITH RECURSIVE {DEP_SQL}, n AS (SELECT drawer_id, tag, value - 1 AS a, row_number() OVER (PARTITION BY drawer_id, tag ORDER BY seq) AS k FROM d WHERE drawer_id IN (SELECT doc_id FROM documents)),
f AS (SELECT drawer_id, tag, k, greatest(0, least(1, a)) AS v FROM n WHERE k = 1 UNION ALL SELECT f.drawer_id, f.tag, n.k, least(f.v + n.a, 5) FROM f JOIN n ON n.drawer_id = f.drawer_id AND n.tag = f.tag AND n.k = f.k + 1)
SELECT drawer_id, tag, round(arg_max(v, k), 6) AS value FROM f GROUP BY ALL""")
def pheromone_deposits(spark: SparkSession, d: str) -> DataFrame:
    x = deposits(spark, d).select("seq", "drawer_id", "tag", (F.col("value") - 1).alias("amount"))
    drawers = t(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return S.deposit(spark.createDataFrame([], "drawer_id long, tag string, value double"), x, drawers).withColumn("value", F.round("value", 6))


def _searches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A search for each supplier, from the node of its number, in the graph of all customers' orders; and the nodes' vectors."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), F.col("s_suppkey").alias("start"), (F.col("s_suppkey") * 91 % 99).alias("goal"))
    return s, kg(spark, d, wide=True), t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query()
def astar_paths(spark: SparkSession, d: str) -> DataFrame:
    """Best-first paths; the order of labels is no SQL, so the tests hold it against a search of one query after the other."""
    out = graph.astar(*_searches(spark, d))
    return out.select("qid", "found", "path", r6(F.col("cost"), "cost"), "iterations", "expanded", F.transform("steps", lambda s: s["relation"]).alias("relations"))


# The least costs by relaxing all edges of all searches again and again; 24 edges are more than any least path here has.
@query(f"""WITH RECURSIVE {KG_WIDE_SQL}, v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT id, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-8)) AS e FROM v),
e AS (SELECT from_id, to_id, min(0.3 * (1 - (0.5 * least(success, 1) + 0.3 * least(recency, 1) + 0.2 * least(traversal, 1))) + 0.3 * CASE WHEN relation IN ('similar', 'leads_to') THEN 0.4 WHEN relation = 'causes' THEN 0.6 WHEN relation = 'prevents' THEN 1.0 ELSE 0.5 END)::DOUBLE AS c FROM g GROUP BY ALL),
q AS (SELECT s_suppkey AS qid, s_suppkey AS start, s_suppkey * 91 % 99 AS goal FROM supplier),
k AS (SELECT b.id AS goal, a.id AS to_id, 0.4 * (1 - greatest(-1, least(1, list_dot_product(a.e, b.e)))) AS near FROM u a, u b WHERE b.id IN (SELECT goal FROM q) AND a.id IN (SELECT to_id FROM e)),
r AS (SELECT q.qid, q.goal, q.start AS node, 0::DOUBLE AS cost, 0 AS hop FROM q WHERE q.start IN (SELECT id FROM u) AND q.goal IN (SELECT id FROM u)
      UNION ALL SELECT r.qid, r.goal, e.to_id, min(r.cost + e.c + k.near), any_value(r.hop) + 1 FROM r JOIN e ON e.from_id = r.node JOIN k ON k.goal = r.goal AND k.to_id = e.to_id WHERE r.hop < 24 GROUP BY r.qid, r.goal, e.to_id)
SELECT q.qid, min(r.cost) IS NOT NULL AS found, round(min(r.cost), 6) AS cost FROM q LEFT JOIN r ON r.qid = q.qid AND r.node = q.goal GROUP BY q.qid""")
def astar_least_costs(spark: SparkSession, d: str) -> DataFrame:
    return graph.least_costs(*_searches(spark, d)).select("qid", "found", r6(F.col("cost"), "cost"))


@query()
def navigate_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of few labels, else greedy walks, with the store's deposits; held against the plain version in the tests."""
    q, g, v = _searches(spark, d)
    top = deposits(spark, d).groupBy(F.col("drawer_id").alias("id")).agg(F.max("value").alias("value"))
    return graph.navigate_all(q, g, v, top, 2)


@query(f"""WITH RECURSIVE {KG_SQL}, e AS (SELECT from_id, to_id, min(0.1 + confidence) AS c FROM g GROUP BY ALL),
r AS (SELECT 0::BIGINT AS node, 0::DOUBLE AS cost, 0 AS hop UNION ALL SELECT e.to_id, min(r.cost + e.c), any_value(hop) + 1 FROM r JOIN e ON e.from_id = r.node WHERE hop < 12 GROUP BY e.to_id) SELECT node, round(min(cost), 6) AS cost FROM r GROUP BY node""", name="cheapest_paths")
def cheapest_paths(spark: SparkSession, d: str) -> DataFrame:
    c = kg(spark, d).groupBy("from_id", "to_id").agg(F.min(0.1 + F.col("confidence")).alias("cost"))
    return graph.cheapest(spark, c, 0).withColumn("cost", F.round("cost", 6))


# ---------------------------------------------------------------- statistics


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlation_long(t(spark, d, "lineitem"), _NUM).withColumn("r", F.round("r", 6))


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, greatest(-0.9999, least(0.9999, corr({a}, {b}))) AS r, count(*) AS n FROM lineitem" for a, b in _PAIRS) + ") SELECT i, j, round(0.5 * ln((1 + r) / (1 - r)), 6) AS z FROM c")
def fisher_z(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "lineitem")
    z, _ = stats.fisher_z(F.col("r"), 1)
    return stats.correlation_long(x, _NUM).select("i", "j", r6(z, "z"))


@query()
def pc_skeleton(spark: SparkSession, d: str) -> DataFrame:
    """Causal graph over order lines and their revenue; the tests check known structures."""
    x = t(spark, d, "lineitem").withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return stats.causal_graph(spark, x, [*_NUM, "revenue"]).withColumn("strength", F.round("strength", 6))


@query("""WITH e AS (SELECT DISTINCT least(o_custkey % 997, o_orderkey * 7 % 997) AS i, greatest(o_custkey % 997, o_orderkey * 7 % 997) AS j FROM orders WHERE o_custkey % 997 <> o_orderkey * 7 % 997), b AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e)
SELECT x.i AS a, x.j AS b, y.j AS c FROM b x JOIN b y ON x.j = y.i AND x.i < y.j WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.i = x.i AND e.j = y.j)""")
def v_structures(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    a, b = F.col("o_custkey") % 997, F.col("o_orderkey") * 7 % 997
    e = o.where(a != b).select(F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).distinct()
    return stats.colliders(e, spark.createDataFrame([], "i long, j long, z array<long>"))


@query("WITH c AS (SELECT event_type, count(*) FILTER (WHERE value > 50) + 1.0::DOUBLE AS a, count(*) FILTER (WHERE value <= 50) + 1.0::DOUBLE AS b FROM events GROUP BY event_type), m AS (SELECT *, a / (a + b) AS m, a * b / ((a + b) * (a + b) * (a + b + 1)) AS v FROM c) SELECT event_type, a AS alpha, b AS beta, round(m, 6) AS mean, round(v, 9) AS variance, round(greatest(m - 1.96 * sqrt(v), 0), 6) AS lower, round(least(m + 1.96 * sqrt(v), 1), 6) AS upper, round(ln(m / (1 - m)), 6) AS log_odds FROM m")
def beta_posterior(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("s"), F.count_if(F.col("value") <= 50).alias("f"))
    x = stats.beta_posterior(c, "event_type", "s", "f")
    return x.select("event_type", "alpha", "beta", r6(F.col("mean"), "mean"), F.round("variance", 9).alias("variance"), *[r6(F.col(k), k) for k in ("lower", "upper", "log_odds")])


@query("SELECT event_type, round((sum(value) + 20 * 0.1) / (count(value) + 0.1), 6) AS mean, round(count(value) + 0.1::DOUBLE, 6) AS precision FROM events GROUP BY event_type")
def belief_gaussian(spark: SparkSession, d: str) -> DataFrame:
    return stats.gaussian_update(t(spark, d, "events"), "event_type", "value").select("event_type", r6(F.col("mean"), "mean"), r6(F.col("precision"), "precision"))


@query("WITH b AS (SELECT user_id, event_type, avg(value) AS m, count(*)::DOUBLE AS p FROM events GROUP BY ALL) SELECT event_type, round(sum(p * m) / sum(p), 6) AS mean, sum(p) AS precision FROM b GROUP BY event_type")
def belief_merge(spark: SparkSession, d: str) -> DataFrame:
    b = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("mean"), F.count("*").cast("double").alias("precision"))
    return stats.merge_beliefs(b, "event_type").withColumn("mean", F.round("mean", 6))


@query("SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, round(CASE WHEN count(value) < 2 THEN 0 ELSE var_pop(value) END, 5) AS variance, round(sqrt(CASE WHEN count(value) < 2 THEN 0 ELSE var_pop(value) END), 6) AS std FROM events GROUP BY user_id")
def welford(spark: SparkSession, d: str) -> DataFrame:
    x = stats.welford(t(spark, d, "events"), "user_id", "value")
    return x.select("user_id", "n", r6(F.col("mean"), "mean"), F.round("variance", 5).alias("variance"), r6(F.col("std"), "std"))


@query("SELECT event_type, round(CASE WHEN var_pop(value) < 1e-10 THEN 0 ELSE -count(value) / 2.0 * ln(2 * pi() * var_pop(value)) - count(value) / 2.0 END, 4) AS log_marginal FROM events GROUP BY event_type")
def bge_marginal(spark: SparkSession, d: str) -> DataFrame:
    return stats.log_marginal(t(spark, d, "events"), "event_type", "value").withColumn("log_marginal", F.round("log_marginal", 4))


@query("""WITH RECURSIVE n AS (SELECT user_id AS node, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, 0.5 + (event_id % 20) / 10.0::DOUBLE AS lr, (event_id % 5 + 1) / 5.0::DOUBLE AS s FROM events),
f AS (SELECT node, 0::BIGINT AS k, 1.0::DOUBLE AS a, 1.0::DOUBLE AS b FROM (SELECT DISTINCT node FROM n) UNION ALL
SELECT f.node, n.k, f.a + CASE WHEN lr > 1 THEN lr ELSE 1 END * s * greatest(ln(1 + f.k), 1), f.b + CASE WHEN lr > 1 THEN 1 ELSE 1 / lr END * s * greatest(ln(1 + f.k), 1) FROM f JOIN n ON n.node = f.node AND n.k = f.k + 1)
SELECT node, round(arg_max(a, k), 4) AS alpha, round(arg_max(b, k), 4) AS beta, max(k)::INT AS n_updates FROM f GROUP BY node""")
def belief_updates(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), (0.5 + (F.col("event_id") % 20) / 10.0).alias("lr"), ((F.col("event_id") % 5 + 1) / 5.0).alias("strength"))
    return stats.belief_fold(e, "node").select("node", F.round("alpha", 4).alias("alpha"), F.round("beta", 4).alias("beta"), "n_updates")


@query("""WITH o AS (SELECT user_id AS node, avg(value) / 100 AS mean, 1.0::DOUBLE AS strength FROM events GROUP BY user_id), p AS (SELECT o_custkey AS parent, o_orderkey % 1000 AS child, (o_orderkey % 10) / 10.0::DOUBLE AS weight FROM orders)
SELECT child, round(1 + (mean - 0.5) * weight, 6) AS lr, strength / 2 AS strength FROM p JOIN o ON o.node = p.parent""")
def belief_propagate(spark: SparkSession, d: str) -> DataFrame:
    obs = t(spark, d, "events").groupBy(F.col("user_id").alias("node")).agg((F.avg("value") / 100).alias("mean"), F.lit(1.0).alias("strength"))
    deps = t(spark, d, "orders").select(F.col("o_custkey").alias("parent"), (F.col("o_orderkey") % 1000).alias("child"), ((F.col("o_orderkey") % 10) / 10.0).alias("weight"))
    return stats.propagate(spark.range(1000).withColumnRenamed("id", "node"), deps, obs).withColumn("lr", F.round("lr", 6))


# ---------------------------------------------------------------- chat


_SYS = chat.DEFAULT_SYSTEM


@query("SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations GROUP BY conv_id")
def chatml_render(spark: SparkSession, d: str) -> DataFrame:
    return chat.render(t(spark, d, "conversations"), "chatml")


@query("SELECT conv_id, string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|>', '' ORDER BY turn) || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS prompt FROM conversations GROUP BY conv_id")
def llama3_render(spark: SparkSession, d: str) -> DataFrame:
    return chat.render(t(spark, d, "conversations"), "llama3")


@query("SELECT conv_id, string_agg(CASE role WHEN 'system' THEN '<|system|>' || chr(10) || text || chr(10) WHEN 'user' THEN '<|user|>' || chr(10) || text || chr(10) || '<|assistant|>' || chr(10) ELSE text || chr(10) END, '' ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def generic_render(spark: SparkSession, d: str) -> DataFrame:
    return chat.render(t(spark, d, "conversations"), "generic")


@query(f"SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, -1, 'system', '{_SYS}' FROM conversations GROUP BY conv_id HAVING NOT bool_or(role = 'system')")
def system_injection(spark: SparkSession, d: str) -> DataFrame:
    return chat.inject_system(t(spark, d, "conversations"))


def _wrapped(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "conversations").where("role = 'assistant'")
    return x.select("conv_id", "turn", F.concat(F.lit("Hmm, "), F.lit("<think>"), F.substring("text", 1, 60), F.lit("</think> "), F.substring("text", F.lit(61), F.length("text"))).alias("text"))


def _texts(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_META = "^(" + "|".join(x.replace(".", r"\.").replace("'", "''") for x in T.META_STARTS) + ")"
#: x3: the best line of b, for rows of src.
_EXTRACT = rf"""x1 AS (SELECT *, list_transform(regexp_split_to_array(b, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM src),
x2 AS (SELECT *, list_filter(list_transform(l, lambda x, i: {{'s': least(strlen(x), 200) + CASE WHEN x LIKE '%.' OR x LIKE '%!' THEN 100 WHEN contains(x, ' is ') OR contains(x, ' are ') OR contains(x, ' was ') THEN 80 ELSE 0 END, 'i': i, 'x': x}}), lambda r: strlen(r.x) >= 8 AND NOT regexp_matches(r.x, '{_META}')) AS g FROM x1),
x3 AS (SELECT *, coalesce(list_sort(g, 'DESC')[1].x, list_filter(l, lambda x: strlen(x) > 15)[1], '{T.NO_ANSWER}') AS best FROM x2)"""


@query(rf"""WITH t AS (SELECT conv_id, turn, left(text, 60) AS k, regexp_replace('Hmm,  ' || substr(text, 61), '^\s+|\s+$', '', 'g') AS a FROM conversations WHERE role = 'assistant'),
p AS (SELECT *, list_reduce(list_prepend(a, {_texts(T.FILLER_PREFIXES)}), lambda s, p: CASE WHEN starts_with(s, p) THEN regexp_replace(substr(s, length(p) + 1), '^\s+', '') ELSE s END) AS s FROM t),
c AS (SELECT *, length(s) - instr(reverse(s), chr(10) || chr(10)) - 1 AS cut FROM p), f AS (SELECT *, regexp_replace(substr(s, cut + 3), '^\s+|\s+$', '', 'g') AS tail FROM c),
z AS (SELECT *, CASE WHEN contains(s, chr(10) || chr(10)) AND (strlen(tail) < 10 AND NOT contains(tail, '.') OR regexp_matches(lower(tail), '^({"|".join(T.FILLER_TAILS)})')) THEN regexp_replace(left(s, cut), '\s+$', '') ELSE s END AS y FROM f),
src AS (SELECT conv_id, turn, regexp_replace(k, '^\s+|\s+$', '', 'g') AS b, list_reduce(list_prepend(y, {_texts(T.FILLER_SUFFIXES)}), lambda s, x: CASE WHEN ends_with(s, x) THEN regexp_replace(left(s, length(s) - length(x)), '\s+$', '') ELSE s END) AS w FROM z),
{_EXTRACT} SELECT conv_id, turn, CASE WHEN w <> '' THEN w WHEN b <> '' THEN best ELSE '{T.NO_ANSWER}' END AS answer FROM x3""")
def think_strip(spark: SparkSession, d: str) -> DataFrame:
    return _wrapped(spark, d).select("conv_id", "turn", T.strip_think(F.col("text")).alias("answer"))


@query(f"WITH src AS (SELECT conv_id, turn, text AS b FROM conversations), {_EXTRACT} SELECT conv_id, turn, best AS answer FROM x3")
def answer_extract(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").select("conv_id", "turn", T.extract_answer(F.col("text")).alias("answer"))


# ---------------------------------------------------------------- sampling


def _logits(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as logits: a row is a step, a dimension a token."""
    e = t(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("step"), F.posexplode(F.col("embedding").cast("array<double>")).alias("token", "logit")).withColumn("logit", F.round(F.col("logit") * 5, 4))


_LOG = "l AS (SELECT vec_id AS step, unnest(range(0, len(embedding)))::INT AS token, round(unnest(embedding)::DOUBLE * 5, 4) AS logit FROM embeddings)"


@query(f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY logit DESC, token) AS k FROM l) SELECT step, token, logit FROM r WHERE k <= 5")
def logit_topk(spark: SparkSession, d: str) -> DataFrame:
    return sampling.top_k(_logits(spark, d), 5).select("step", "token", "logit")


@query(f"WITH {_LOG} SELECT step, token FROM (SELECT *, max(logit) OVER (PARTITION BY step) AS m FROM l) WHERE logit >= m + ln(0.3)")
def logit_minp(spark: SparkSession, d: str) -> DataFrame:
    return sampling.min_p(_logits(spark, d), 0.3).select("step", "token")


@query(f"WITH {_LOG}, e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY step)) AS e FROM l), p AS (SELECT *, e / sum(e) OVER (PARTITION BY step) AS p FROM e), c AS (SELECT *, sum(p) OVER (PARTITION BY step ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - p AS b FROM p) SELECT step, token, round(p, 6) AS p FROM c WHERE b < 0.5")
def logit_topp(spark: SparkSession, d: str) -> DataFrame:
    return sampling.top_p(_logits(spark, d), 0.5).select("step", "token", r6(F.col("p"), "p"))


@query(f"WITH {_LOG}, h AS (SELECT user_id AS step, event_id % 64 AS token, count(*) AS n FROM events GROUP BY ALL) SELECT l.step, l.token, round(CASE WHEN logit > 0 THEN logit / power(1.2, coalesce(n, 0)) ELSE logit * power(1.2, coalesce(n, 0)) END - 0.1 * coalesce(n, 0) - 0.2 * (coalesce(n, 0) > 0)::INT, 6) AS logit FROM l LEFT JOIN h ON h.step = l.step AND h.token = l.token")
def logit_penalties(spark: SparkSession, d: str) -> DataFrame:
    h = t(spark, d, "events").select(F.col("user_id").alias("step"), F.col("event_id").alias("pos"), (F.col("event_id") % 64).cast("int").alias("token"))
    return sampling.penalties(_logits(spark, d), h, 1.2, 0.1, 0.2).select("step", "token", r6(F.col("logit"), "logit"))


@query(f"WITH {_LOG} SELECT step, arg_max(token, struct_pack(a := logit, b := token)) AS token FROM l GROUP BY step")
def logit_argmax(spark: SparkSession, d: str) -> DataFrame:
    return sampling.argmax(_logits(spark, d))


@query(f"WITH {_LOG}, s AS (SELECT step, max(logit) AS m FROM l GROUP BY step), z AS (SELECT l.step, ln(sum(exp(logit - m))) + any_value(m) AS lse FROM l JOIN s USING (step) GROUP BY l.step) SELECT round(avg(lse - logit), 6) AS loss FROM z JOIN l USING (step) WHERE l.token = l.step % 64")
def cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    x = _logits(spark, d)
    g = x.select("step").distinct().withColumn("target", (F.col("step") % 64).cast("int"))
    return sampling.cross_entropy(x, g).withColumn("loss", F.round("loss", 6))


def _actions(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy(F.col("user_id").alias("agent"), F.col("event_type").alias("action")).agg((F.avg("value") / 10).alias("efe"), F.count("*").alias("visits"))


_ACT = "a AS (SELECT user_id AS agent, event_type AS action, avg(value) / 10 AS efe, count(*) AS visits FROM events GROUP BY ALL)"


@query(f"WITH {_ACT}, e AS (SELECT *, exp((min(efe) OVER (PARTITION BY agent) - efe) / 0.5) AS e FROM a) SELECT agent, action, round(e / sum(e) OVER (PARTITION BY agent), 6) AS p FROM e")
def softmax_policy(spark: SparkSession, d: str) -> DataFrame:
    return sampling.softmax_policy(_actions(spark, d), 0.5).select("agent", "action", r6(F.col("p"), "p"))


@query(f"WITH {_ACT}, s AS (SELECT *, efe - 0.5 * sqrt(ln(sum(visits) OVER (PARTITION BY agent)) / (visits + 1)) AS s FROM a) SELECT agent, arg_min(action, struct_pack(a := s, b := action)) AS action, round(min(s), 6) AS score FROM s GROUP BY agent")
def ucb_action(spark: SparkSession, d: str) -> DataFrame:
    return sampling.ucb(_actions(spark, d), 0.5).withColumn("score", F.round("score", 6))


@query("WITH p AS (SELECT o_orderkey AS id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 21 AS i FROM orders), q AS (SELECT id, i, i / 20.0::DOUBLE AS p FROM p) SELECT id, i::INT AS i, round(1 + (0.1 - 1) * p, 6) AS linear, round(power(0.1, p), 6) AS exponential, round(0.1 + 0.9 * 0.5 * (1 + cos(pi() * p)), 6) AS cosine, round(CASE WHEN i < 5 THEN 0.01 * i / 5 ELSE 0.005 * (1 + cos(pi() * (i - 5) / 15.0)) END, 6) AS lr FROM q")
def annealing(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as the steps of a run of 21."""
    p = F.col("i") / 20.0
    step = (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) % 21
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), step.cast("int").alias("i")).select("id", "i", *[r6(D.annealed(1.0, 0.1, p, k), k) for k in ("linear", "exponential", "cosine")], r6(D.lr_schedule(F.col("i"), 0.01, 5, 20), "lr"))


@query("SELECT event_id, round(0.5 * 2 * pow(value / 100 - 0.5, 2) + 0.5 * ln(2 * pi() / 2), 6) AS vfe, round(-(0.5 + greatest(value / 100 - 0.5, 0) + 0.5 * 0.3 - 0.3 * 0.6), 6) AS efe FROM events")
def free_energy(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value") / 100
    return t(spark, d, "events").select("event_id", r6(D.variational_free_energy(v, F.lit(0.5), F.lit(2.0)), "vfe"), r6(D.expected_free_energy(F.lit(2.0), v - 0.5, F.lit(0.3), F.lit(0.6)), "efe"))


@query("SELECT event_id % 50 AS token_pos, round(sum(greatest(value - 50, 0)), 4) AS deposit, count(*) FILTER (WHERE value > 50) AS layers FROM events GROUP BY 1")
def token_deposits(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "events").select((F.col("event_id") % 50).alias("token_pos"), (F.col("value") - 50).alias("delta"))
    return sampling.token_deposits(x).withColumn("deposit", F.round("deposit", 4))


# ---------------------------------------------------------------- provenance and safety


@query("SELECT o_orderkey, sha256(unhex(lpad(hex(7::BIGINT), 16, '0') || lpad(hex(o_orderkey), 16, '0')) || encode(o_orderpriority)) AS hash FROM orders")
def tx_hash(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", provenance.tx_hash(F.lit(7).cast("long"), F.col("o_orderkey"), F.col("o_orderpriority")).alias("hash"))


def _ops(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 90, "anomaly").otherwise("ok")
    return t(spark, d, "events").select("user_id", "ts", "event_id", kind.alias("kind"))


_OPS = "o AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN value > 90 THEN 'anomaly' ELSE 'ok' END AS kind FROM events)"


@query(f"WITH {_OPS} SELECT user_id, count(*) AS total, round(avg((kind = 'error')::INT), 6) AS error_rate, round(avg((kind = 'anomaly')::INT), 6) AS anomaly_rate FROM o GROUP BY user_id")
def breaker_rates(spark: SparkSession, d: str) -> DataFrame:
    x = safety.breaker_rates(_ops(spark, d), "user_id")
    return x.select("user_id", "total", r6(F.col("error_rate"), "error_rate"), r6(F.col("anomaly_rate"), "anomaly_rate"))


_FSM = f"""WITH RECURSIVE {_OPS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o),
c AS (SELECT user_id, k, kind, k >= 5 AND sum((kind = 'error')::INT) OVER w / k::DOUBLE > 0.1 AS bad, k >= 5 AND sum((kind = 'anomaly')::INT) OVER w / k::DOUBLE > 0.25 AS odd FROM n WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 'BOOT' AS st, 0 AS dg, NULL::VARCHAR AS ev, NULL::VARCHAR AS was FROM c UNION ALL
SELECT c.user_id, c.k, CASE WHEN f.st = 'EMERGENCY_STOP' THEN f.st WHEN c.odd THEN 'EMERGENCY_STOP' WHEN f.st = 'BOOT' THEN 'NOMINAL' WHEN f.st = 'NOMINAL' AND c.bad THEN 'DEGRADED' WHEN f.st = 'DEGRADED' AND c.bad AND f.dg + 1 > 10 THEN 'SAFE_MODE' WHEN f.st = 'DEGRADED' AND NOT c.bad AND c.k >= 5 THEN 'NOMINAL' ELSE f.st END,
CASE WHEN f.st = 'EMERGENCY_STOP' OR c.odd THEN f.dg WHEN f.st = 'NOMINAL' AND c.bad THEN 1 WHEN f.st = 'DEGRADED' AND NOT c.bad AND c.k >= 5 THEN 0 WHEN f.st = 'DEGRADED' THEN f.dg + 1 ELSE f.dg END, c.kind, f.st FROM f JOIN c ON c.user_id = f.user_id AND c.k = f.k + 1)"""


@query(_FSM + " SELECT user_id, arg_max(st, k) AS state, max(k)::INT AS total FROM f GROUP BY user_id")
def safety_fsm(spark: SparkSession, d: str) -> DataFrame:
    return safety.final_state(_ops(spark, d), "user_id", ["ts", "event_id"]).select("user_id", "state", "total")


@query(_FSM + " SELECT user_id, k::INT AS n, ev AS event, was AS from_state, st AS to_state FROM f WHERE k > 0 AND was <> st")
def safety_audit(spark: SparkSession, d: str) -> DataFrame:
    return safety.audit_log(_ops(spark, d), "user_id", ["ts", "event_id"]).where("from_state <> to_state")


# ---------------------------------------------------------------- cycles and streams


@query("""WITH RECURSIVE y AS (SELECT user_id AS key, date_trunc('day', ts) AS s, count(*) AS v FROM events GROUP BY ALL), n AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY s) AS k, lag(v, 2) OVER (PARTITION BY key ORDER BY s) AS a, lag(v, 1) OVER (PARTITION BY key ORDER BY s) AS b, v AS c FROM y),
f AS (SELECT DISTINCT key, 0::BIGINT AS k, 0.5::DOUBLE AS e FROM n UNION ALL SELECT n.key, n.k, CASE WHEN a IS NULL THEN e WHEN c <= b AND b <= a AND a > 0 THEN least(e + 0.1, 0.9) WHEN c > b THEN greatest(e - 0.05, 0.1) ELSE e END FROM f JOIN n ON n.key = f.key AND n.k = f.k + 1) SELECT key, round(arg_max(e, k), 6) AS explore FROM f GROUP BY key""")
def ooda_feedback(spark: SparkSession, d: str) -> DataFrame:
    y = t(spark, d, "events").groupBy(F.col("user_id").alias("key"), F.date_trunc("day", "ts").alias("s")).agg(F.count("*").alias("v"))
    return corpus.trend(y, "key", "s", "v").withColumn("explore", F.round("explore", 6))


@query("""WITH l AS (SELECT user_id, event_id, abs(value / 5000 - lag(value / 5000) OVER (PARTITION BY user_id ORDER BY event_id)) AS d FROM events), p AS (SELECT user_id, event_id, count(d) OVER w = 5 AND max(d) OVER w < 0.01 AS plateau FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id FROM p WHERE plateau""")
def plateau(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "events").select("user_id", "event_id", (F.col("value") / 5000).alias("loss"))
    return corpus.plateau(x, "user_id", "event_id", "loss").where("plateau").select("user_id", "event_id")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    w = t(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("SELECT user_id AS agent, event_type AS place, round((sum(value * 2) + 0.5) / (sum(2.0) + 1), 6) AS mean, round(sum(2.0) + 1, 6)::DOUBLE AS precision, count(*) AS visits FROM events GROUP BY ALL")
def agent_beliefs(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "events").select(F.col("user_id").alias("agent"), F.col("event_type").alias("place"), F.col("event_id").alias("seq"), "value", F.lit(2.0).alias("precision"))
    return ooda.agent_beliefs(x).withColumn("mean", F.round("mean", 6))


# ---------------------------------------------------------------- relational extras


@query("SELECT r_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, o_orderpriority)")
def star_rollup(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    x = li.join(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), li.l_orderkey == F.col("o_orderkey")).join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.rollup("r_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM customer JOIN orders ON o_custkey = c_custkey) WHERE r <= 2")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice").join(t(spark, d, "customer").select("c_custkey"), "c_custkey", "left_semi")
    w = W.partitionBy("c_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("r", F.row_number().over(w)).where("r <= 2").drop("r")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def idle_customers(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select("c_custkey")
    return c.join(t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
