"""How the driver's tables stand for the store's entities, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.text import SPACE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL that states the same; <space> stands for runs of white space."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql.replace("<space>", SPACE)
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


#: Confidence of a document: from its size, so that every document has one.
CONF = "((n_chars % 1000) / 1000.0)::DOUBLE"


def docs(spark: SparkSession, d: str) -> DataFrame:
    """(id, source, wing, title, confidence): documents as discoveries."""
    conf = (F.col("n_chars") % 1000) / 1000.0
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("wing"), F.col("text").alias("title"), conf.alias("confidence"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """(id, source, confidence, pheromone, quality, tier)."""
    from loam.operators.gates import tier

    x = docs(spark, d).withColumn("quality", (F.col("confidence") + 0.6 + 0.5) / 3).withColumn("pheromone", F.col("quality"))
    return x.select("id", "source", "confidence", "pheromone", "quality", tier(F.col("quality")).alias("tier"), F.lit(0).alias("samples"))


CORPUS_SQL = """c AS (SELECT doc_id AS id, source, (n_chars % 1000) / 1000.0::DOUBLE AS confidence, ((n_chars % 1000) / 1000.0::DOUBLE + 0.6::DOUBLE + 0.5::DOUBLE) / 3 AS quality FROM documents),
k AS (SELECT *, quality AS pheromone, CASE WHEN quality >= 0.75 THEN 2 WHEN quality >= 0.55 THEN 1 ELSE 0 END AS tier FROM c)"""


def kg(spark: SparkSession, d: str, wide: bool = False) -> DataFrame:
    """Orders as relation edges between a hundred nodes; with wide, from as many nodes as there are customers."""
    o = t(spark, d, "orders")
    rel = F.element_at(F.array(*[F.lit(x) for x in RELATIONS]), (F.col("o_orderkey") % len(RELATIONS) + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("edge_seq"), (F.col("o_custkey") if wide else F.col("o_custkey") % 100).alias("from_id"), (F.col("o_orderkey") * 7 % 99).alias("to_id"), rel.alias("relation"), ((F.col("o_orderkey") % 100) / 100.0).alias("confidence"), ((F.col("o_orderkey") % 13) / 10.0).alias("success"), ((F.col("o_orderkey") % 7) / 10.0).alias("traversal"), ((F.col("o_orderkey") % 11) / 10.0).alias("recency"))


RELATIONS = ["supports", "contradicts", "confirms", "refutes", "causes", "prevents", "leads_to", "similar"]
KG_SQL = "g AS (SELECT o_orderkey AS edge_seq, o_custkey % 100 AS from_id, o_orderkey * 7 % 99 AS to_id, ['supports','contradicts','confirms','refutes','causes','prevents','leads_to','similar'][(o_orderkey % 8 + 1)::INT] AS relation, (o_orderkey % 100) / 100.0::DOUBLE AS confidence, (o_orderkey % 13) / 10.0::DOUBLE AS success, (o_orderkey % 7) / 10.0::DOUBLE AS traversal, (o_orderkey % 11) / 10.0::DOUBLE AS recency FROM orders)"
KG_WIDE_SQL = KG_SQL.replace("o_custkey % 100", "o_custkey")


def deposits(spark: SparkSession, d: str) -> DataFrame:
    """Events as deposits on drawers (users), tagged by their type."""
    e = t(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("drawer_id"), F.col("event_type").alias("tag"), (F.abs(F.col("value")) % 3).alias("value"))


DEP_SQL = "d AS (SELECT event_id AS seq, user_id AS drawer_id, event_type AS tag, abs(value) % 3 AS value FROM events)"
WORDS_SQL = r"list_filter(regexp_split_to_array({0}, '<space>'), lambda w: w <> '')"
COS_SQL = "CASE WHEN {n1} >= 1e-8 AND {n2} >= 1e-8 THEN greatest(-1, least(1, {dot} / ({n1} * {n2}))) ELSE 0 END"

# Ordered admission as a recursive query: one step a candidate, with the accepted ones so far.
_ADMIT = r"""RECURSIVE r AS (SELECT doc_id AS seq, doc_id % 7 AS cycle, source, text, lower(text) AS l, (n_chars % 1000) / 1000.0::DOUBLE AS c, list_filter(regexp_split_to_array(text, '<space>'), lambda w: w <> '') AS w FROM documents),
{filter}
ok AS (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM m WHERE c >= 0.40 AND len(w) >= 3),
g AS (SELECT k, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM ok), n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
p AS (SELECT a.k AS k, b.k AS o, count(*)::DOUBLE AS m FROM g a JOIN g b ON a.g = b.g AND a.k > b.k GROUP BY ALL),
j AS (SELECT p.k, p.o, m / (x.n + y.n - m) AS j FROM p JOIN n x ON x.k = p.k JOIN n y ON y.k = p.o), s AS (SELECT k, list(o) AS sim FROM j WHERE 1 - j < 0.25 GROUP BY k),
os AS (SELECT ok.k, ok.source, coalesce(s.sim, []::BIGINT[]) AS sim FROM ok LEFT JOIN s ON s.k = ok.k),
f AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS acc, []::VARCHAR[] AS src UNION ALL
SELECT k, CASE WHEN fine THEN list_append(acc, k) ELSE acc END, CASE WHEN fine THEN list_append(src, source) ELSE src END FROM (SELECT os.k, os.source, acc, src, (len(acc) = 0 OR len(list_filter(src, lambda z: z = os.source))::DOUBLE / len(acc) < 0.5) AND NOT list_has_any(acc, os.sim) AS fine FROM f JOIN os ON os.k = f.k + 1)),
a AS (SELECT unnest(acc) AS k FROM (SELECT acc FROM f ORDER BY k DESC LIMIT 1)), h AS (SELECT min(k) AS k FROM a),
v AS (SELECT a.k, CASE WHEN a.k = (SELECT k FROM h) THEN 1 ELSE 1 - coalesce(max(j.j), 0) END AS novelty FROM a LEFT JOIN (SELECT j.* FROM j JOIN a b ON b.k = j.o) j ON j.k = a.k GROUP BY a.k),
z AS (SELECT ok.seq, (ok.c + 0.6 + novelty) / 3 AS quality FROM v JOIN ok ON ok.k = v.k)"""
ADMIT_SQL = _ADMIT.replace("{filter}", "m AS (SELECT * FROM r),")
SAFE_ADMIT_SQL = _ADMIT.replace("{filter}", """t0 AS (SELECT *, c >= 0.5 AND l NOT LIKE '%idiot%' AND l NOT LIKE '%license%' AS pre FROM r), t1 AS (SELECT *, coalesce(sum(pre::INT) OVER (PARTITION BY cycle ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t0),
m AS (SELECT * FROM t1 WHERE pre AND before < 50),""")
