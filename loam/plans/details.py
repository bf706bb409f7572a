"""Queries: readers, single functions, writes, beliefs, claims; each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import dynamics as D
from loam.functions import text as T
from loam.functions import vector as V
from loam.operators import chat, corpus, gates, ooda, provenance, safety, sampling, stats, store, training
from loam.plans.base import ADMIT_SQL, CORPUS_SQL, SAFE_ADMIT_SQL, docs, query, r6, t
from loam.plans.base import corpus as table
from loam.plans.store import _ACT, _LOG, _actions, _logits
from loam.sources import readers

# ---------------------------------------------------------------- readers: payloads are made from tables


@query("""SELECT p_partkey AS id, 'd' || lpad(i::VARCHAR, 2, '0') AS date, CASE WHEN i % 5 <> 0 THEN i::DOUBLE END AS a, CASE WHEN i % 7 <> 0 THEN (p_size * 10 + i)::DOUBLE END AS b
FROM (SELECT p_partkey, p_size, unnest(range(1, least(p_size, 31) + 1)) AS i FROM part)""")
def daily_points(spark: SparkSession, d: str) -> DataFrame:
    days = F.sequence(F.lit(1), F.col("p_size"))
    at = lambda f: F.map_from_arrays(F.transform(days, lambda i: F.concat(F.lit("d"), F.lpad(i.cast("string"), 2, "0"))), F.transform(days, f))
    a = at(lambda i: F.when(i % 5 == 0, -999.0).otherwise(i.cast("double")))
    b = at(lambda i: F.when(i % 7 == 0, -999.0).otherwise((F.col("p_size") * 10 + i).cast("double")))
    body = F.to_json(F.struct(F.struct(F.struct(a.alias("a"), b.alias("b")).alias("parameter")).alias("properties")))
    x = readers.daily_points(t(spark, d, "part").select(F.col("p_partkey").alias("id"), body.alias("body")))
    return x.select("id", "date", *[F.try_element_at("values", F.lit(k)).alias(k) for k in ("a", "b")])


@query("""SELECT c_nationkey::BIGINT AS id, (r - 1)::INT AS pos, 'balance' AS indicator, c_mktsegment AS place, c_custkey AS year, c_acctbal AS value
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r <= 10""")
def indicator_rows(spark: SparkSession, d: str) -> DataFrame:
    row = F.struct(F.col("c_custkey").alias("TimeDim"), F.lit("balance").alias("IndicatorCode"), F.col("c_mktsegment").alias("SpatialDim"), F.col("c_acctbal").alias("NumericValue"))
    g = t(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("value"))
    return readers.indicators(g.select("id", F.to_json(F.struct("value")).alias("body")))


@query("""SELECT o_custkey AS id, (r - 1)::INT AS pos, o_orderpriority AS country, o_orderkey::VARCHAR AS year, o_totalprice AS value, o_orderstatus AS indicator
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 10""")
def paged_rows(spark: SparkSession, d: str) -> DataFrame:
    named = lambda c: F.struct(F.lit("x").alias("id"), F.col(c).alias("value"))
    row = F.struct(F.col("o_orderkey").alias("k"), F.struct(named("o_orderstatus").alias("indicator"), named("o_orderpriority").alias("country"), F.col("o_orderkey").cast("string").alias("date"), F.col("o_totalprice").alias("value")).alias("v"))
    g = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"]).alias("rows"))
    return readers.paged(g.select("id", F.concat(F.lit('[{"page":1},'), F.to_json("rows"), F.lit("]")).alias("body")))


@query("""SELECT page_id AS id, pos::INT AS pos, 'Page ' || page_id || ' part ' || pos AS title, 'about ' || url AS summary, url FROM pages, (VALUES (0), (2)) p(pos)""")
def atom_entries(spark: SparkSession, d: str) -> DataFrame:
    """Feeds of three entries, the second without a title: it is left out."""
    one = lambda k, title: F.concat(F.lit("<entry>\n<title>"), title, F.lit("</title><summary>\n about\n  "), F.col("url"), F.lit(" </summary><id> "), F.col("url"), F.lit(f" </id><k>{k}</k></entry>"))
    title = lambda k: F.concat(F.lit("Page  "), F.col("page_id").cast("string"), F.lit(f"\n part {k} "))
    body = F.concat(F.lit("<feed>"), one(0, title(0)), one(1, F.lit("  ")), one(2, title(2)), F.lit("</feed>"))
    return readers.atom_entries(t(spark, d, "pages").select(F.col("page_id").alias("id"), body.alias("body"), "url"))


@query("SELECT n_name AS name, 1 AS part FROM nation UNION ALL SELECT r_name, 2 FROM region")
def source_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A source with rows stays as it is; one without gives the fallback's."""
    n, r = t(spark, d, "nation").select(F.col("n_name").alias("name")), t(spark, d, "region").select(F.col("r_name").alias("name"))
    return readers.or_fallback(n, r).withColumn("part", F.lit(1)).unionByName(readers.or_fallback(n.where("name = '?'"), r).withColumn("part", F.lit(2)))


@query("""WITH e AS (SELECT event_id, event_id % 50 AS a, (props->>'k')::INT AS k, event_type FROM events)
SELECT event_id AS seq, 0 AS part, event_type AS source, 'a' AS cause, 'b' AS effect, round(least(greatest(0.45 + sqrt(least(a, 100) * least(abs(k), 100)) / 100, 0.1), 0.9)::DOUBLE, 6) AS confidence FROM e
UNION ALL SELECT event_id, 1, event_type, 'a":' || a || ',"b":' || k || ',"c":"rain', 'floods', 0.75::DOUBLE FROM e""")
def orient_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    content = F.to_json(F.struct((F.col("event_id") % 50).alias("a"), k.alias("b"), F.lit("rain causes floods").alias("c")))
    x = ooda.orient(t(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("source"), content.alias("content")))
    return x.withColumn("confidence", F.round("confidence", 6))


# ---------------------------------------------------------------- rendering and requests


@query("""WITH q AS (SELECT doc_id, source, lang, printf('%.2f', (n_chars % 100) / 100.0) AS q FROM documents)
SELECT doc_id, '# ' || source || chr(10) || lang || chr(10) || '## Claims' || chr(10) || '- ' || lang || ' → ' || source || ' (' || q || ')' || chr(10) || 'quality: ' || q AS entry FROM q""")
def discovery_entries(spark: SparkSession, d: str) -> DataFrame:
    q = (F.col("n_chars") % 100) / 100.0
    x = t(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("description"), q.alias("quality"), F.array(F.struct(F.col("lang").alias("cause"), F.col("source").alias("effect"), q.alias("confidence"))).alias("claims"))
    return ooda.render(x).select("doc_id", "entry")


@query("SELECT item_id, text AS joined, true AS within, true AS full FROM benchmark")
def utf8_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks joined are the text, each within 32 bytes, and none but the last with room for four bytes more."""
    x = t(spark, d, "benchmark").select("item_id", T.chunks(F.col("text"), 32).alias("c"))
    most = F.slice("c", F.lit(1), F.greatest(F.size("c") - 1, F.lit(0)))
    return x.select("item_id", F.array_join("c", "").alias("joined"), F.forall("c", lambda s: F.octet_length(s) <= 32).alias("within"), F.forall(most, lambda s: F.octet_length(s) > 28).alias("full"))


@query("""SELECT 'm' || conv_id AS model, text AS prompt, CASE WHEN turn % 2 = 0 THEN turn + 1 ELSE 256 END::INT AS max_tokens, CASE WHEN turn % 3 = 0 THEN 0.25 ELSE 0.7 END::DOUBLE AS temperature, 0.9::DOUBLE AS top_p, 50 AS top_k, turn % 2 = 1 AS stream, conv_id AS seed FROM conversations""")
def request_defaults(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("turn")
    body = F.to_json(F.struct(F.concat(F.lit("m"), F.col("conv_id").cast("string")).alias("model"), F.col("text").alias("prompt"), F.when(c % 2 == 0, c + 1).alias("max_tokens"), F.when(c % 3 == 0, 0.25).alias("temperature"), F.when(c % 2 == 1, True).alias("stream"), F.col("conv_id").alias("seed")))
    return chat.requests(t(spark, d, "conversations").select(body.alias("body"))).drop("messages")


@query("SELECT event_id, 'chat-' || (epoch_us(ts) // 1000000) || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') AS id FROM events")
def response_ids(spark: SparkSession, d: str) -> DataFrame:
    ts = F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC")
    return t(spark, d, "events").select("event_id", chat.response_id("chat", ts).alias("id"))


@query(r"""WITH w AS (SELECT conv_id * 1000 + turn AS id, list_filter(regexp_split_to_array(text, '<space>'), lambda w: w <> '') AS w FROM conversations), p AS (SELECT id, w, unnest(range(4, len(w) + 1)) AS i FROM w)
SELECT id, (i + 2)::INT AS pos, w[i] AS text FROM p""")
def visible_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The first three words of each turn are put into a think block, whose opening tag is cut in two tokens."""
    w = T.words(F.col("text"))
    parts = F.concat(F.array(F.lit("<thi"), F.lit("nk>")), F.slice(w, 1, 3), F.array(F.lit("</think>")), F.slice(w, F.lit(4), F.greatest(F.size(w) - 3, F.lit(0))))
    x = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.posexplode(parts).alias("pos", "text"))
    return chat.visible_tokens(x, "id").where("text <> '<thi'")


@query(r"""WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Well <think>' || text ELSE '<think>' || text || '</think>' END AS t, list_filter(regexp_split_to_array(text, '<space>'), lambda w: w <> '')[1:5] AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Well <think>' || array_to_string(w, ' ') || '</think>' ELSE t END AS text FROM x""")
def think_budget(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Well <think>"), "text")).otherwise(F.concat(F.lit("<think>"), "text", F.lit("</think>")))
    return t(spark, d, "conversations").select("conv_id", "turn", x.alias("t")).select("conv_id", "turn", T.think_budget(F.col("t"), 5).alias("text"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ' '), lambda p, i: CASE WHEN i = 1 THEN p ELSE 'Ġ' || p END), lambda p: p <> ''), '|') AS pieces FROM documents")
def space_pieces(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.array_join(T.space_pieces(F.col("text")), "|").alias("pieces"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'llama3' WHEN 1 THEN 'chatml' WHEN 2 THEN 'llama3' ELSE 'chatml' END AS template, CASE p_partkey % 4 WHEN 0 THEN 'llama_1b' WHEN 1 THEN 'small_1b7' WHEN 2 THEN 'olmo_7b' ELSE 'small_135m' END AS family FROM part""")
def template_detection(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    model = F.when(k == 0, "Llama-3-8B").when(k == 1, "Small-1.7B").when(k == 2, "OLMo-7B").otherwise("Other")
    special = F.when(k == 1, F.array(F.lit("<|im_start|>"))).when(k == 2, F.array(F.lit("<|start_header_id|>"))).otherwise(F.array().cast("array<string>"))
    return t(spark, d, "part").select("p_partkey", T.template_of(model, special).alias("template"), T.model_family(model).alias("family"))


# ---------------------------------------------------------------- scalar functions

_V, _N = "(n_chars % 100) / 100.0", "n_chars % 31"


@query("""WITH x AS (SELECT doc_id, (n_chars % 100) / 100.0::DOUBLE AS v, CASE doc_id % 5 WHEN 0 THEN 0.02 WHEN 1 THEN 0.05 WHEN 2 THEN 0.01 WHEN 3 THEN 0.03 ELSE 0.10 END::DOUBLE AS r FROM documents), y AS (SELECT *, v * (1 - r / (1 + exp(10 * r * (v - 0.5)))) AS s FROM x)
SELECT doc_id, round(r, 6) AS rate, round(CASE WHEN s < 1e-4 THEN 0 ELSE s END::DOUBLE, 6) AS value FROM y""")
def decay_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    """A rate by kind of deposit, then one sigmoid tick."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("exploitation", "exploration", "success", "traversal", "recency")]), (F.col("doc_id") % 5 + 1).cast("int"))
    x = t(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 100) / 100.0).alias("v"), D.lookup(D.DECAY_RATES, kind, 0.02).alias("rate"))
    return x.select("doc_id", r6(F.col("rate"), "rate"), r6(D.decay_sigmoid(F.col("v"), F.col("rate")), "value"))


@query(f"""WITH x AS (SELECT doc_id, {_V}::DOUBLE AS a, ({_N}) / 31.0::DOUBLE AS b FROM documents)
SELECT doc_id, round(CASE WHEN b < 0.3 THEN 0.05 * 2 WHEN a > 0.7 THEN 0.05 * 1.5 WHEN a < 0.1 THEN 0.05 * 0.5 ELSE 0.05 END::DOUBLE, 6) AS calibrated, round(least(greatest(0.1 * exp(-0.5 * a * b * 3 * abs(a - b)), 0.005), 0.30)::DOUBLE, 6) AS canonical FROM x""")
def decay_calibration(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 100) / 100.0).alias("a"), ((F.col("n_chars") % 31) / 31.0).alias("b"))
    a, b = F.col("a"), F.col("b")
    return x.select("doc_id", r6(D.calibrated_decay(0.05, a, b), "calibrated"), r6(D.canonical_decay(0.1, a, b, F.lit(3.0), a - b), "canonical"))


@query(f"""WITH x AS (SELECT doc_id, {_V}::DOUBLE AS c, {_N} AS n FROM documents), y AS (SELECT *, 1 - c AS h, 0.5 * (1 - c) / least(greatest(n / 20.0, 0.1), 1) AS g FROM x)
SELECT doc_id, round((CASE WHEN c < 0.3 THEN 0.5 * h + 0.5 * g ELSE 0.9 * h + 0.1 * g END)::DOUBLE, 6) AS h FROM y""")
def path_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", r6(D.heuristic((F.col("n_chars") % 100) / 100.0, F.col("n_chars") % 31), "h"))


@query("WITH x AS (SELECT event_id, value / 100 - 1 AS x FROM events) SELECT event_id, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(x / (1 + exp(-x)), 6) AS silu, round(greatest(x, 0), 6) AS relu, round(exp(-0.1 * greatest(event_id % 40 - 5, 0)), 6) AS recency FROM x")
def activations(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("value") / 100 - 1
    return t(spark, d, "events").select("event_id", r6(D.sigmoid(x), "sigmoid"), r6(D.silu(x), "silu"), r6(D.relu(x), "relu"), r6(D.recency_weight(F.col("event_id") % 40 - 5), "recency"))


@query(f"""WITH x AS (SELECT doc_id, least(greatest({_V}, 0.001), 0.999)::DOUBLE AS p, least(greatest(({_N}) / 30.0, 0.001), 0.999)::DOUBLE AS l, n_chars % 12 AS n FROM documents)
SELECT doc_id, round(p * l / (p * l + (1 - p) * (1 - l)), 6) AS combined, round(CASE WHEN n = 0 THEN 0.5 ELSE least(1, 0.5 + 0.5 * least(ln(n), 2) / 2) END::DOUBLE, 6) AS quality FROM x""")
def bayes_combine(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return t(spark, d, "documents").select("doc_id", r6(D.bayes_combine((n % 100) / 100.0, (n % 31) / 30.0), "combined"), r6(D.evidence_quality(n % 12), "quality"))


@query("""WITH x AS (SELECT event_id, value / 50 - 3 AS x FROM events), t AS (SELECT *, 1 / (1 + 0.2316419 * abs(x)) AS t FROM x), u AS (SELECT *, t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) * exp(-x * x / 2) / sqrt(2 * pi()) AS u FROM t)
SELECT event_id, round(CASE WHEN x < -7 THEN 0 WHEN x > 7 THEN 1 WHEN x >= 0 THEN 1 - u ELSE u END::DOUBLE, 6) AS p FROM u""")
def normal_cdf(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", r6(D.normal_cdf(F.col("value") / 50 - 3), "p"))


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 5) AS total, round(list_avg(embedding::DOUBLE[]), 6) AS mean, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def tensor_reductions(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    x = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return x.select("vec_id", F.round(total, 5).alias("total"), r6(total / F.size("e"), "mean"), r6(V.norm(F.col("e")), "norm"))


# ---------------------------------------------------------------- gates, corpus, cycles


@query("SELECT 'nations' AS rules, 25::BIGINT AS n_rules, 5::BIGINT AS n_domains, true AS unique_ids, false AS tractable UNION ALL SELECT 'regions', 5, 5, true, true")
def constitution(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation").select(F.col("n_name").alias("id"), F.col("n_regionkey").alias("domain"))
    r = t(spark, d, "region").select(F.col("r_name").alias("id"), F.col("r_regionkey").alias("domain"))
    one = lambda x, k: gates.constitution_tractable(x).withColumn("rules", F.lit(k))
    return one(n, "nations").unionByName(one(r, "regions"))


@query("SELECT doc_id AS seq FROM documents WHERE n_chars % 2 = 0 ORDER BY doc_id LIMIT 100")
def cycle_cap(spark: SparkSession, d: str) -> DataFrame:
    return ooda.cap(t(spark, d, "documents").where("n_chars % 2 = 0").select(F.col("doc_id").alias("seq")))


@query("SELECT max(doc_id % 7) AS cycles, count(*) AS total, round(avg((n_chars % 1000) / 1000.0), 6) AS mean_quality FROM documents")
def engine_stats(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select((F.col("id") % 7).alias("cycle"), F.col("confidence").alias("quality"))
    return ooda.engine_stats(x).withColumn("mean_quality", F.round("mean_quality", 6))


@query(f"WITH {CORPUS_SQL}, b AS (SELECT pheromone FROM k ORDER BY tier, id LIMIT 32) SELECT round(avg(greatest(0.01, pheromone * 0.98)), 6) AS mean_pheromone FROM b")
def batch_mean(spark: SparkSession, d: str) -> DataFrame:
    return corpus.dispatch(table(spark, d), "curriculum", 32)[1].withColumn("mean_pheromone", F.round("mean_pheromone", 6))


@query(f"WITH {ADMIT_SQL} SELECT (SELECT count(*) FROM z) AS accepted, (SELECT count(*) FROM r) - (SELECT count(*) FROM z) AS rejected")
def corpus_ingest(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("seq"), "source", F.col("text").alias("title"), ((F.col("n_chars") % 1000) / 1000.0).alias("confidence"))
    return corpus.ingest(rows)


@query(f"WITH {SAFE_ADMIT_SQL} SELECT r.seq, m.seq IS NOT NULL AS safe, z.seq IS NOT NULL AS accepted, round(quality::DOUBLE, 6) AS quality, CASE WHEN z.seq IS NOT NULL THEN 1 + least(3, len(string_split(r.text, chr(10)))) END AS n_links, CASE WHEN z.seq IS NOT NULL THEN true END AS valid FROM r LEFT JOIN m USING (seq) LEFT JOIN z USING (seq)")
def safe_admission(spark: SparkSession, d: str) -> DataFrame:
    """Filter, admission and chains; the lines of a document are its observations."""
    x = t(spark, d, "documents")
    conf = (F.col("n_chars") % 1000) / 1000.0
    rows = x.select(F.col("doc_id").alias("seq"), (F.col("doc_id") % 7).alias("cycle"), "source", F.col("text").alias("title"), conf.alias("confidence"), conf.alias("quality_score"))
    obs = x.select(F.col("doc_id").alias("seq"), F.posexplode(F.split("text", "\n")).alias("pos", "content"), "source")
    state, links = corpus.safe_admit(rows, obs, 4242, blocked=["idiot", "license"])
    told = provenance.verify_chain(links).withColumnRenamed("discovery_id", "seq")
    return state.join(told, "seq", "left").select("seq", "safe", "accepted", r6(F.col("quality"), "quality"), "n_links", "valid")


@query("""WITH x AS (SELECT user_id AS key, event_id AS step, (event_id % 3) / 1000.0 + CASE WHEN value > 150 THEN 0.4 ELSE 0.5 END::DOUBLE AS ratio, [value / 100, 0.5, 1] AS l FROM events), y AS (SELECT *, abs(ratio - lag(ratio) OVER (PARTITION BY key ORDER BY step)) AS d, list_var_pop(l) AS v FROM x),
z AS (SELECT *, count(d) OVER w = 5 AND max(d) OVER w < 0.01 AS p FROM y WINDOW w AS (PARTITION BY key ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT key, step, p AS plateaued, round(v, 6) AS variance, p AND v >= 0.05 AS branch, round(least(greatest(ratio - 0.1, 0.05), 0.95), 6) AS ratio_a, round(least(greatest(ratio + 0.1, 0.05), 0.95), 6) AS ratio_b FROM z""")
def cycle_branching(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    x = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("step"), ((F.col("event_id") % 3) / 1000.0 + F.when(F.col("value") > 150, 0.4).otherwise(0.5)).alias("ratio"), F.array(F.col("value") / 100, F.lit(0.5), F.lit(1.0)).alias("losses"))
    return ooda.branching(x).withColumns({c: F.round(c, 6) for c in ("variance", "ratio_a", "ratio_b")})


@query("SELECT user_id AS key, round(sum(value * power(0.5, r - 1)), 5) AS total FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) GROUP BY user_id")
def deep_supervision(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("value").alias("loss"))
    return training.deep_supervision(x, "key", "seq", "loss").withColumn("total", F.round("total", 5))


# ---------------------------------------------------------------- sampling and actions


@query(f"WITH {_LOG}, h AS (SELECT step, token, count(*) AS n FROM (SELECT user_id AS step, event_id % 64 AS token, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5 GROUP BY ALL) SELECT l.step, l.token, round(CASE WHEN logit > 0 THEN logit / power(1.2, coalesce(n, 0)) ELSE logit * power(1.2, coalesce(n, 0)) END, 6) AS logit FROM l LEFT JOIN h ON h.step = l.step AND h.token = l.token")
def penalty_window(spark: SparkSession, d: str) -> DataFrame:
    h = t(spark, d, "events").select(F.col("user_id").alias("step"), F.col("event_id").alias("pos"), (F.col("event_id") % 64).cast("int").alias("token"))
    return sampling.penalties(_logits(spark, d), h, 1.2, window=5).select("step", "token", r6(F.col("logit"), "logit"))


@query(f"""WITH {_LOG}, x AS (SELECT step, token, logit / 0.7 AS z FROM l), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY z DESC, token) AS r FROM x) WHERE r <= 20), e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY step)) AS e FROM k), q AS (SELECT *, e / sum(e) OVER (PARTITION BY step) AS p FROM e),
c AS (SELECT *, sum(p) OVER (PARTITION BY step ORDER BY z DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - p AS b FROM q) SELECT step, token, round(e / sum(e) OVER (PARTITION BY step), 6) AS p FROM c WHERE b < 0.9""")
def sampling_pipeline(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "step long, pos long, token int")
    return sampling.pipeline(_logits(spark, d), none, 0.7, 20, 0.9).select("step", "token", r6(F.col("p"), "p"))


@query(f"WITH {_LOG}, e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY step)) AS e FROM l), c AS (SELECT step, token, sum(e) OVER (PARTITION BY step ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(e) OVER (PARTITION BY step) AS c FROM e) SELECT step, coalesce(min(token) FILTER (WHERE c > (step * 37 % 100) / 100.0), max(token)) AS token FROM c GROUP BY step")
def cdf_sample(spark: SparkSession, d: str) -> DataFrame:
    x = sampling.softmax(_logits(spark, d))
    draws = t(spark, d, "embeddings").select(F.col("vec_id").alias("step"), ((F.col("vec_id") * 37 % 100) / 100.0).alias("r"))
    return sampling.cdf_pick(x, draws)


@query(f"WITH {_ACT} SELECT agent, arg_min(action, struct_pack(a := efe, b := action)) AS action FROM a GROUP BY agent")
def greedy_action(spark: SparkSession, d: str) -> DataFrame:
    return sampling.greedy(_actions(spark, d))


@query(f"WITH {_ACT}, s AS (SELECT *, unnest(range(0, 3)) AS s FROM a), e AS (SELECT *, exp((efe - max(efe) OVER (PARTITION BY agent, s)) * (1 + 0.5 * s)) AS e FROM s) SELECT agent AS key, action AS item, s::INT AS s, round(e / sum(e) OVER (PARTITION BY agent, s), 6) AS p FROM e")
def sharpened_scores(spark: SparkSession, d: str) -> DataFrame:
    x = _actions(spark, d).select(F.col("agent").alias("key"), F.col("action").alias("item"), F.col("efe").alias("x"))
    return sampling.sharpen(x, 1.0, 0.5, 3).select("key", "item", "s", r6(F.col("p"), "p"))


@query("WITH v AS (SELECT * FROM (VALUES (0, 'explorer', 1.0::DOUBLE, 'softmax', 1.0::DOUBLE), (1, 'exploiter', 0.1, 'greedy', 0.0), (2, 'specialist', 0.3, 'softmax', 0.3), (3, 'generalist', 0.5, 'epsilon', 0.15), (4, 'critic', 0.2, 'softmax', 0.2)) v(k, archetype, temperature, policy, parameter)) SELECT c_custkey AS agent, archetype, temperature, policy, parameter FROM customer JOIN v ON k = c_custkey % 5")
def archetype_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Each customer as an agent of some archetype, with that archetype's settings."""
    names = F.array(*[F.lit(k) for k in D.ARCHETYPES])
    table = spark.createDataFrame([(k, *v) for k, v in D.ARCHETYPES.items()], "archetype string, temperature double, policy string, parameter double")
    agents = t(spark, d, "customer").select(F.col("c_custkey").alias("agent"), F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int")).alias("archetype"))
    return agents.join(F.broadcast(table), "archetype").select("agent", "archetype", "temperature", "policy", "parameter")  # a row an archetype


# ---------------------------------------------------------------- writes


@query("""WITH a AS (SELECT c_custkey AS id, 'old' AS state FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS id, 'new' AS state FROM customer WHERE c_custkey % 3 = 0)
SELECT id, state, (SELECT count(*) FROM orders WHERE o_custkey = u.id AND u.state = 'old') AS diary FROM (SELECT * FROM a WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n) u""")
def agents_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Agents, and the entries left in their diaries."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    diary = t(spark, d, "orders").select(F.col("o_custkey").alias("agent_id"), F.col("o_orderkey").alias("seq"))
    agents, left = store.upsert_agents(c.where("id % 2 = 0").withColumn("state", F.lit("old")), diary, c.where("id % 3 = 0").withColumn("state", F.lit("new")))
    n = left.groupBy(F.col("agent_id").alias("id")).agg(F.count("*").alias("diary"))
    return agents.join(n, "id", "left").withColumn("diary", F.coalesce("diary", F.lit(0)))


@query("SELECT o_custkey AS agent_id, o_orderkey AS seq, o_custkey % 2 = 0 AS written FROM orders")
def diary_append(spark: SparkSession, d: str) -> DataFrame:
    """Entries of unknown agents are refused."""
    agents = t(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    new = t(spark, d, "orders").select(F.col("o_custkey").alias("agent_id"), F.col("o_orderkey").alias("seq"))
    good, bad = store.append_diary(spark.createDataFrame([], "agent_id long, seq long"), agents, new)
    return good.withColumn("written", F.lit(True)).unionByName(bad.withColumn("written", F.lit(False)))


@query("""SELECT source, CASE WHEN substr(source, 4)::INT % 2 = 0 THEN least(substr(source, 4)::INT / 10.0, 1) ELSE 0.6 END::DOUBLE AS reliability FROM (SELECT DISTINCT source FROM documents)""")
def reliability_changes(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "documents").select("source").distinct()
    k = F.substring("source", 4, 9).cast("int")
    return gates.reliability_upsert(spark, s.withColumn("reliability", F.lit(0.6)), s.where(k % 2 == 0).withColumn("reliability", k / 10.0))


@query("SELECT s_suppkey AS nonce, CASE s_suppkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN s_suppkey % 3 = 1 THEN 'no funds' END AS reason FROM (SELECT row_number() OVER (ORDER BY s_suppkey) AS s_suppkey FROM supplier)")
def ledger_states(spark: SparkSession, d: str) -> DataFrame:
    led = _ledger(spark, d)
    return led.select("nonce", "status", "reason")


@query("SELECT count(*) FILTER (WHERE k % 3 = 2) AS n_pending, count(*) FILTER (WHERE k % 3 = 0) AS n_confirmed FROM (SELECT row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier)")
def ledger_status(spark: SparkSession, d: str) -> DataFrame:
    return safety.ledger_status(_ledger(spark, d))


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    new = t(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.lit("mint").alias("op"), F.col("s_suppkey").cast("double").alias("amount"), F.lit("x").alias("recipient"))
    led = safety.ledger_append(spark.createDataFrame([], "nonce long, op string, amount double, recipient string, hash string, status string, reason string"), new, 7)
    told = led.where("nonce % 3 < 2").select("hash", (F.col("nonce") % 3 == 0).alias("ok"), F.lit("no funds").alias("reason"))
    return safety.ledger_settle(led, told)


# ---------------------------------------------------------------- beliefs and graphs


@query("""WITH o AS (SELECT user_id AS node, 0.5 + avg(value) / 50 AS lr FROM events GROUP BY user_id), n AS (SELECT node, CASE WHEN node % 2 = 0 THEN 7.0 ELSE 1 END::DOUBLE AS a, CASE WHEN node % 2 = 0 THEN 3.0 ELSE 1 END::DOUBLE AS b FROM o),
u AS (SELECT node, a + CASE WHEN lr > 1 THEN lr ELSE 1 END AS a, b + CASE WHEN lr > 1 THEN 1 ELSE 1 / lr END AS b FROM n JOIN o USING (node)), c AS (SELECT node + 1000000 AS node, 1 + (a / (a + b) - 0.5) * 0.8 AS lr FROM u)
SELECT node, round(a, 5) AS alpha, round(b, 5) AS beta, round(2 * abs(a / (a + b) - 0.5), 6) AS confidence, 1 AS n_updates FROM u
UNION ALL SELECT node, round(a, 5), round(b, 5), round(2 * abs(a / (a + b) - 0.5), 6), 1 FROM (SELECT node, 1 + CASE WHEN lr > 1 THEN lr / 2 ELSE 0.5 END AS a, 1 + CASE WHEN lr > 1 THEN 0.5 ELSE 0.5 / lr END AS b FROM c)""")
def belief_observe(spark: SparkSession, d: str) -> DataFrame:
    """Users with a prior of .7 or none, each observed once; each has one child."""
    o = t(spark, d, "events").groupBy(F.col("user_id").alias("node")).agg((0.5 + F.avg("value") / 50).alias("lr")).withColumns({"seq": F.col("node"), "strength": F.lit(1.0)})
    ids = o.select("node")
    new = ids.select("node", F.when(F.col("node") % 2 == 0, 0.7).alias("mean"), F.lit(1.0).alias("weight")).unionByName(ids.select(F.col("node") + 1000000, F.lit(None).cast("double"), F.lit(1.0)).toDF("node", "mean", "weight"))
    nodes = stats.belief_nodes(spark.createDataFrame([], "node long, alpha double, beta double, confidence double, n_updates int"), new)
    deps = stats.dependencies(spark.createDataFrame([], "child long, parent long, weight double"), ids.select((F.col("node") + 1000000).alias("child"), F.col("node").alias("parent"), F.lit(0.8).alias("weight")))
    x = stats.observe(nodes, deps, o)
    return x.select("node", F.round("alpha", 5).alias("alpha"), F.round("beta", 5).alias("beta"), r6(F.col("confidence"), "confidence"), "n_updates")


_GRAPH = "g AS (SELECT o_custkey AS a, o_orderkey % 1009 AS b, CASE WHEN o_orderkey % 2 = 0 THEN 'directed' ELSE 'undirected' END AS type, (o_orderkey % 100) / 100.0::DOUBLE AS strength FROM orders)"


def _graph(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select(F.col("o_custkey").alias("from"), (k % 1009).alias("to"), F.when(k % 2 == 0, "directed").otherwise("undirected").alias("type"), ((k % 100) / 100.0).alias("strength"))


@query(f"WITH {_GRAPH} SELECT DISTINCT a AS node, b AS neighbour FROM (SELECT a, b FROM g UNION ALL SELECT b, a FROM g) WHERE a <> b")
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return stats.neighbours(_graph(spark, d))


@query(f"WITH {_GRAPH} SELECT b AS node, a AS parent FROM g WHERE type = 'directed'")
def graph_parents(spark: SparkSession, d: str) -> DataFrame:
    return stats.parents(_graph(spark, d))


@query(f"WITH {_GRAPH} SELECT count(*) FILTER (WHERE type = 'directed') AS n_directed FROM g")
def graph_directed(spark: SparkSession, d: str) -> DataFrame:
    return stats.n_directed(_graph(spark, d))


@query(f"WITH {_GRAPH} SELECT round(500 * sum(ln(greatest(strength * strength, 1e-10))) - count(*) * ln(1000) / 2, 4) AS bic FROM g WHERE type = 'directed'")
def graph_bic(spark: SparkSession, d: str) -> DataFrame:
    return stats.bic(_graph(spark, d), 1000).withColumn("bic", F.round("bic", 4))


@query()
def validator(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on a claim of each document; the tests hold them against a plain model, graph and chain included."""
    x = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("cause"), F.col("lang").alias("effect"), F.split("text", "\n").alias("evidence"))
    return training.validate(x)


# ---------------------------------------------------------------- hashes and claims


@query("""WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::HUGEINT) AS b FROM documents)
SELECT doc_id, lpad(lower(hex(list_reduce(b, lambda h, x: (h * 16777619 + x) % 18446744073709551616, 2166136261::HUGEINT))), 16, '0') AS hash FROM b""")
def title_hash(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", provenance.title_hash(F.col("text")).alias("hash"))


@query("""WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::HUGEINT) AS b FROM documents)
SELECT doc_id, lpad(lower(hex(list_reduce(b, lambda h, x: (xor(h, x) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT))), 16, '0') AS hash FROM b""")
def fnv_hash(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", provenance.fnv1a(F.col("text")).alias("hash"))


_KEY = bytes(range(32))
_PAD = {n: bytes(b ^ p for b in _KEY.ljust(64, b"\0")).hex() for n, p in (("i", 0x36), ("o", 0x5C))}


@query(f"""WITH w AS (SELECT doc_id, source, sha256(text) AS w FROM documents)
SELECT doc_id, source AS statement, w AS witness_hash, sha256(unhex('{_PAD["o"]}') || unhex(sha256(unhex('{_PAD["i"]}') || encode(source) || unhex(w)))) AS proof, true AS valid, false AS forged FROM w""")
def mac_claims(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "documents").select("doc_id", provenance.mac_claim(F.col("source"), F.col("text"), _KEY).alias("c"))
    return x.select("doc_id", "c.statement", "c.witness_hash", "c.proof", provenance.mac_verify(F.col("c"), _KEY).alias("valid"), provenance.mac_verify(F.col("c").withField("statement", F.lit("other")), _KEY).alias("forged"))


@query("SELECT doc_id AS discovery_id, len(string_split(text, chr(10)))::BIGINT AS n_links, true AS valid, len(string_split(text, chr(10)))::BIGINT AS n_back FROM documents")
def provenance_chain(spark: SparkSession, d: str) -> DataFrame:
    """A link for each line of each document, signed, written as JSON, read back and verified."""
    c = t(spark, d, "documents").select(F.col("doc_id").alias("discovery_id"), F.posexplode(F.split("text", "\n")).alias("pos", "claim"), F.lit("observation").alias("type"))
    links = provenance.build_chain(c, 4242)
    back = provenance.links_from_json(provenance.links_json(links))
    return provenance.verify_chain(back).withColumn("n_back", F.col("n_links"))  # both count the links read back
