"""Queries: gates, corpus aggregates, text functions, novelty, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import dynamics as D
from loam.functions import text as T
from loam.functions import vector as V
from loam.operators import chat, corpus, gates, novelty
from loam.plans.base import ADMIT_SQL, CONF, CORPUS_SQL, WORDS_SQL, docs, query, r6, t
from loam.plans.base import corpus as table
from loam.sources import readers


@query(f"""WITH x AS (SELECT doc_id AS id, source, len({WORDS_SQL.format('text')})::INT AS words, {CONF} >= 0.40 AS confidence_ok, true AS source_ok FROM documents)
SELECT *, words >= 3 AS causal_ok, confidence_ok AND source_ok AND words >= 3 AS pass FROM x""")
def corpus_gate_static(spark: SparkSession, d: str) -> DataFrame:
    return gates.static_gates(docs(spark, d)).select("id", "source", "words", "confidence_ok", "source_ok", "causal_ok", "pass")


@query("""WITH x AS (SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS c, (n_chars % 97) / 97.0::DOUBLE AS n, n_chars % 6 AS e, (n_chars % 89) / 89.0::DOUBLE AS k FROM documents),
y AS (SELECT *, greatest(0, least(1, 0.4 * c + 0.3 * n + 0.2 * least(e, 5) / 5 + 0.1 * (1 - k))) AS s, concat_ws('; ', CASE WHEN c < 0.65 THEN 'confidence' END, CASE WHEN n < 0.40 THEN 'novelty' END, CASE WHEN e < 2 THEN 'evidence' END, CASE WHEN k > 0.30 THEN 'contradiction' END) AS r FROM x)
SELECT doc_id, round(s::DOUBLE, 6) AS score, nullif(r, '') AS reasons, CASE WHEN s >= 0.9 THEN 'excellent' WHEN s >= 0.75 THEN 'good' WHEN s >= 0.6 THEN 'acceptable' ELSE 'poor' END AS label FROM y""")
def bayes_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    s, r = gates.quality_gate((n % 1000) / 1000.0, (n % 97) / 97.0, n % 6, (n % 89) / 89.0)
    return t(spark, d, "documents").select("doc_id", r6(s, "score"), r.alias("reasons"), gates.quality_label(s).alias("label"))


@query("""WITH x AS (SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS c, n_chars % 5 AS o, doc_id % 7 AS cycle, lower(text) AS l FROM documents),
y AS (SELECT *, list_filter([CASE WHEN c < 0.5 THEN 'low confidence' END, CASE WHEN l LIKE '%idiot%' THEN 'blocked: idiot' WHEN l LIKE '%license%' THEN 'blocked: license' END, CASE WHEN o <= 0 THEN 'no observations' END], lambda z: z IS NOT NULL) AS r FROM x),
z AS (SELECT *, coalesce(sum((len(r) = 0)::INT) OVER (PARTITION BY cycle ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM y)
SELECT doc_id, array_to_string(CASE WHEN before >= 50 THEN list_append(r, 'rate limit') ELSE r END, '|') AS reasons, len(r) = 0 AND before < 50 AS safe FROM z""")
def safety_filter(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "documents").select("doc_id", F.col("text").alias("title"), ((F.col("n_chars") % 1000) / 1000.0).alias("confidence"), (F.col("n_chars") % 5).alias("observations"), (F.col("doc_id") % 7).alias("cycle"))
    out = gates.safety_filter(x, seq="doc_id", blocked=["idiot", "license"])
    return out.select("doc_id", F.array_join("reasons", "|").alias("reasons"), "safe")


@query("""SELECT doc_id, (doc_id % 100) / 100.0 * (n_chars % 64) > 10 AS exploration_ok, (n_chars % 10) / 10.0 >= 1 / sqrt(1 + n_chars % 64) AS temperature_ok,
(doc_id % 100) / 100.0 * (n_chars % 64) > 10 AND (n_chars % 10) / 10.0 >= 1 / sqrt(1 + n_chars % 64) AS all_ok FROM documents""")
def stability_check(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    a = gates.stability((F.col("doc_id") % 100) / 100.0, n % 64, (n % 10) / 10.0)
    b = gates.stability((F.col("doc_id") % 100) / 100.0, 1 + n % 64, (n % 10) / 10.0)
    return t(spark, d, "documents").select("doc_id", a["exploration_ok"].alias("exploration_ok"), b["temperature_ok"].alias("temperature_ok"), (a["exploration_ok"] & b["temperature_ok"]).alias("all_ok"))


@query(f"WITH {CORPUS_SQL} SELECT id, round(quality, 6) AS quality, tier FROM k")
def tier_assign(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d).select("id", r6(F.col("quality"), "quality"), "tier")


@query(f"WITH {CORPUS_SQL} SELECT count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(pheromone), 6) AS mean_pheromone, count(DISTINCT source) AS n_sources, count(*) FILTER (WHERE tier = 0) AS tier0, count(*) FILTER (WHERE tier = 1) AS tier1, count(*) FILTER (WHERE tier = 2) AS tier2 FROM k")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.stats(table(spark, d)).withColumns({"mean_confidence": F.round("mean_confidence", 6), "mean_pheromone": F.round("mean_pheromone", 6)})


@query(f"WITH {CORPUS_SQL} SELECT source, count(*) AS n, round(avg(quality), 6) AS mean_quality, round(min(quality), 6) AS min_quality, round(max(quality), 6) AS max_quality FROM k GROUP BY source")
def source_quality(spark: SparkSession, d: str) -> DataFrame:
    x = corpus.source_quality(table(spark, d))
    return x.select("source", "n", *[r6(F.col(c), c) for c in ("mean_quality", "min_quality", "max_quality")])


@query(f"WITH {CORPUS_SQL} SELECT tier, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM k), 6) AS percent FROM k GROUP BY tier")
def tier_distribution(spark: SparkSession, d: str) -> DataFrame:
    return corpus.tier_distribution(table(spark, d)).withColumn("percent", F.round("percent", 6))


@query(f"WITH {CORPUS_SQL}, h AS (SELECT least(1, 0.4 * avg(confidence) + 0.3 * avg(pheromone) + 0.3 * least(count(DISTINCT source) / 4.0, 1)) AS h FROM k) SELECT round(h::DOUBLE, 6) AS health, CASE WHEN h >= 0.7 THEN 'healthy' WHEN h >= 0.5 THEN 'growing' ELSE 'weak' END AS label FROM h")
def corpus_health(spark: SparkSession, d: str) -> DataFrame:
    return corpus.health(table(spark, d)).withColumn("health", F.round("health", 6))


@query(f"WITH {CORPUS_SQL} SELECT id, round(pheromone, 6) AS pheromone FROM k ORDER BY k.pheromone DESC, id LIMIT 20")
def corpus_list(spark: SparkSession, d: str) -> DataFrame:
    return corpus.listing(table(spark, d), 20).select("id", r6(F.col("pheromone"), "pheromone"))


@query(f"WITH {CORPUS_SQL} SELECT id, tier FROM k ORDER BY tier, id LIMIT 32")
def curriculum_batch(spark: SparkSession, d: str) -> DataFrame:
    return corpus.sample(table(spark, d), "curriculum", 32).select("id", "tier")


@query(f"WITH {CORPUS_SQL}, b AS (SELECT id FROM k ORDER BY tier, id LIMIT 32) SELECT k.id, (b.id IS NOT NULL)::INT AS samples, round(CASE WHEN b.id IS NULL THEN pheromone ELSE greatest(0.01, pheromone * 0.98) END, 6) AS pheromone FROM k LEFT JOIN b ON b.id = k.id")
def batch_effects(spark: SparkSession, d: str) -> DataFrame:
    return corpus.dispatch(table(spark, d), "curriculum", 32)[2].select("id", "samples", r6(F.col("pheromone"), "pheromone"))


_DRAW = "(('0x' || substr(md5('{seed}:' || id), 1, 13))::BIGINT + 0.5) / 4503599627370496"


@query(f"""WITH {CORPUS_SQL}, w AS (SELECT id, pheromone, {_DRAW.format(seed=42)} AS u, {_DRAW.format(seed=43)} AS u2 FROM k),
p AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN pheromone > 0 THEN -ln(u) / pheromone ELSE 'inf'::DOUBLE END, u, id) AS p, row_number() OVER (ORDER BY u, id) AS q,
             row_number() OVER (ORDER BY u2, id) AS q2, row_number() OVER (ORDER BY ln(-ln(u)) - pheromone / 0.5, id) AS s FROM w)
SELECT 'pheromone' AS strategy, id FROM p WHERE p <= 32 UNION ALL SELECT 'uniform', id FROM p WHERE q <= 32 UNION ALL SELECT 'stigmergic', id FROM p WHERE s <= 32 UNION ALL SELECT 'mixed', id FROM p WHERE p <= 19 OR q2 <= 13""")
def weighted_batches(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d)
    out = [corpus.sample(x, s, 32).select(F.lit(s).alias("strategy"), "id") for s in ("pheromone", "uniform", "stigmergic", "mixed")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(f"WITH {CORPUS_SQL} SELECT id, round(greatest(0.01, pheromone * 0.9), 6) AS pheromone FROM k")
def corpus_decay(spark: SparkSession, d: str) -> DataFrame:
    return corpus.decay(table(spark, d), 0.9).select("id", r6(F.col("pheromone"), "pheromone"))


@query(f"""WITH RECURSIVE {CORPUS_SQL}, e AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, value > 50 AS up FROM events WHERE user_id IN (SELECT id FROM k)),
f AS (SELECT id, 0::BIGINT AS n, pheromone::DOUBLE AS p, tier FROM k UNION ALL
SELECT f.id, e.n, CASE WHEN e.up THEN least(f.p * 1.2, 1) ELSE greatest(f.p * 0.7, 0.01) END, CASE WHEN e.up AND least(f.p * 1.2, 1) > 0.8 AND f.tier < 2 THEN f.tier + 1 ELSE f.tier END FROM f JOIN e ON e.id = f.id AND e.n = f.n + 1)
SELECT id, round(arg_max(p, n), 6) AS pheromone, arg_max(tier, n) AS tier FROM f GROUP BY id""")
def corpus_feedback(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), (F.col("value") > 50).alias("positive"))
    return corpus.feedback(table(spark, d), e).select("id", r6(F.col("pheromone"), "pheromone"), "tier")


# ---------------------------------------------------------------- text


@query(f"SELECT doc_id, len({WORDS_SQL.format('text')})::INT AS words FROM documents")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query(f"""WITH w AS (SELECT doc_id, {WORDS_SQL.format('lower(text)')} AS w FROM documents), g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w)
SELECT g AS gram, count(*) AS n FROM g GROUP BY g""")
def ngrams(spark: SparkSession, d: str) -> DataFrame:
    g = t(spark, d, "documents").select(F.explode(T.uni_bigrams(F.col("text"))).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents) SELECT doc_id, greatest(len(w) - 1, 0)::INT AS n_pairs, len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))::INT AS n_distinct FROM w""")
def bigram_pairs(spark: SparkSession, d: str) -> DataFrame:
    b = T.bigrams(T.words(F.col("text")))
    return t(spark, d, "documents").select("doc_id", F.size(b).alias("n_pairs"), F.size(F.array_distinct(b)).alias("n_distinct"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM documents")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def title_dedup(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(r"SELECT page_id, CASE WHEN regexp_matches(html, '(?s)<title(?:\s[^>]*)?>.*?</title>') THEN regexp_extract(html, '(?s)<title(?:\s[^>]*)?>(.*?)</title>', 1) END AS title, CASE WHEN regexp_matches(html, '(?s)<h2(?:\s[^>]*)?>.*?</h2>') THEN regexp_extract(html, '(?s)<h2(?:\s[^>]*)?>(.*?)</h2>', 1) END AS h2 FROM pages")
def xml_title(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", T.xml_tag(F.col("html"), "title").alias("title"), T.xml_tag(F.col("html"), "h2").alias("h2"))


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?)://', 1) AS s, regexp_extract(url, '^https?://([^/?#]*)', 1) AS r, regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS q FROM pages)
SELECT page_id, nullif(s, '') AS scheme, CASE WHEN s <> '' THEN regexp_replace(r, ':\d+$', '') END AS host, CASE WHEN s <> '' THEN coalesce(nullif(regexp_extract(r, ':(\d+)$', 1), '')::INT, CASE s WHEN 'https' THEN 443 ELSE 80 END) END AS port,
CASE WHEN s <> '' THEN CASE WHEN q = '' THEN '/' WHEN q LIKE '/%' THEN q ELSE '/' || q END END AS path FROM p""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", *[c.alias(k) for k, c in readers.url_parts(F.col("url")).items()])


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("WITH x AS (SELECT l_orderkey, l_linenumber, " + "unnest([" + ", ".join(f"{{'a': '{a}', 'b': '{b}', 'x': {a}, 'y': {b}}}" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]) + "]) AS p FROM lineitem) SELECT l_orderkey, l_linenumber, p.a AS cause, p.b AS effect, round(least(greatest(0.45 + sqrt(least(abs(p.x), 100) * least(abs(p.y), 100)) / 100, 0.1), 0.9)::DOUBLE, 6) AS confidence FROM x")
def numeric_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = readers.numeric_pairs(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _NUM)
    return x.withColumn("confidence", F.round("confidence", 6))


@query("SELECT event_id, 'a' AS cause, 'b' AS effect, round(least(greatest(0.45 + sqrt(least(abs(event_id % 50), 100) * least(abs((props->>'k')::DOUBLE), 100)) / 100, 0.1), 0.9)::DOUBLE, 6) AS confidence FROM events")
def json_numeric_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    body = F.to_json(F.struct((F.col("event_id") % 50).alias("a"), F.get_json_object("props", "$.k").cast("double").alias("b"), F.lit("text").alias("c")))
    return readers.json_numeric_pairs(e.select("event_id", body.alias("body")), "event_id", "body").withColumn("confidence", F.round("confidence", 6))


_PH = [(" the ", 0.75), (" und ", 0.65), (" de ", 0.6)]


@query(r"""WITH q AS (SELECT doc_id, lower(text) AS t, unnest([{'p': ' the ', 'c': 0.75}, {'p': ' und ', 'c': 0.65}, {'p': ' de ', 'c': 0.6}]) AS p FROM documents), x AS (SELECT *, instr(t, q.p.p) AS i FROM q WHERE instr(t, q.p.p) > 0),
y AS (SELECT doc_id, p AS ph, list_filter(regexp_split_to_array(left(t, (i - 1)::INT), '<space>'), lambda w: w <> '') AS b, list_filter(regexp_split_to_array(substr(t, i + length(x.p.p)), '<space>'), lambda w: w <> '') AS a FROM x),
z AS (SELECT doc_id, ph, coalesce(b[-1], 'X') AS c, coalesce(a[1], 'Y') AS e FROM y)
SELECT doc_id, ph.p AS phrase, regexp_replace(c, '^\P{L}+|\P{L}+$', '', 'g') AS cause, regexp_replace(e, '^\P{L}+|\P{L}+$', '', 'g') AS effect, ph.c::DOUBLE AS confidence FROM z WHERE strlen(c) > 1 AND strlen(e) > 1""")
def causal_phrase(spark: SparkSession, d: str) -> DataFrame:
    return readers.phrase_hypotheses(t(spark, d, "documents"), "doc_id", "text", _PH)


@query(f"WITH {CORPUS_SQL} SELECT id, '[' || upper(source) || '] doc ' || id || ' (quality=' || printf('%.2f', floor(quality * 100) / 100) || ')' AS line FROM k")
def training_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d).select("id", T.training_text(F.col("source"), F.concat(F.lit("doc "), F.col("id").cast("string")), F.floor(F.col("quality") * 100) / 100).alias("line"))


@query("SELECT doc_id, left(text, 120) AS preview FROM documents")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("""WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(lower(text))), '..'), lambda x: ('0x' || x)::INT) AS b FROM documents),
g AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, len(b)), lambda i: (b[i] * 31 + b[i + 1]) % 256), list_transform(range(1, len(b) - 1), lambda i: (b[i] * 961 + b[i + 1] * 31 + b[i + 2]) % 256))) AS bin FROM b)
SELECT doc_id, bin::INT AS bin, count(*) AS n FROM g GROUP BY ALL""")
def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    return V.hashed_ngram_counts(t(spark, d, "documents"), "doc_id", F.col("text")).withColumnRenamed("id", "doc_id")


@query("""WITH h AS (SELECT item_id, hex(encode(text)) AS h, strlen(text) AS n FROM benchmark), p AS (SELECT item_id, h, unnest(range(0, n - 1)) AS pos FROM h)
SELECT item_id AS id, pos::INT AS pos, ('0x' || substr(h, pos * 2 + 1, 2))::INT AS input, ('0x' || substr(h, pos * 2 + 3, 2))::INT AS target FROM p""")
def next_token_pairs(spark: SparkSession, d: str) -> DataFrame:
    return chat.next_token_pairs(t(spark, d, "benchmark"), "item_id", "text")


@query()
def gpt4_pretokenize(spark: SparkSession, d: str) -> DataFrame:
    """Pieces by text; the tests hold it against the same pattern in another engine."""
    p = T.pretokenize(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.size(p).alias("pieces"), F.size(F.array_distinct(p)).alias("distinct_pieces"))


def _tokenizer():
    """A byte vocabulary, id = byte, with a few merges."""
    from loam.functions import bpe

    vocab = {c: i for i, c in enumerate(bpe.byte_chars())}
    pairs = [("e", "r"), ("t", "h"), ("e", "n"), ("th", "e")]
    vocab |= {a + b: 256 + i for i, (a, b) in enumerate(pairs)}
    return bpe.Tokenizer(vocab, {p: i for i, p in enumerate(pairs)})


# Bytes as hex marks; each merge in order of rank replaces two marks by one.  Letters of a pair never lie in two pieces here.
_BPE_SQL = """b AS (SELECT doc_id AS id, regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g') AS h FROM documents),
m AS (SELECT id, replace(replace(replace(replace(h, '65 72 ', 'X0 '), '74 68 ', 'X1 '), '65 6E ', 'X2 '), 'X1 65 ', 'X3 ') AS h FROM b),
k AS (SELECT id, list_transform(list_filter(string_split(h, ' '), lambda x: x <> ''), lambda x: CASE WHEN x[1] = 'X' THEN 256 + x[2]::INT ELSE ('0x' || x)::INT END) AS tokens FROM m)"""


@query(f"WITH {_BPE_SQL} SELECT id, len(tokens)::INT AS n_tokens, sha256(array_to_string(tokens, ',')) AS ids FROM k")
def bpe_encode(spark: SparkSession, d: str) -> DataFrame:
    from loam.functions import bpe

    out = bpe.encode(t(spark, d, "documents"), _tokenizer(), "doc_id", "text")
    return out.select("id", F.size("tokens").alias("n_tokens"), F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ","), 256).alias("ids"))


@query(f"WITH {_BPE_SQL}, e AS (SELECT unnest(tokens) AS token_id FROM k) SELECT token_id, count(*) AS n, CASE WHEN token_id > 258 THEN 'the' WHEN token_id > 255 THEN ['er', 'th', 'en'][token_id - 255] WHEN token_id BETWEEN 33 AND 126 THEN chr(token_id) END AS token FROM e WHERE token_id BETWEEN 33 AND 126 OR token_id > 255 GROUP BY token_id")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Printable tokens of all documents, counted by id and named by a join."""
    from loam.functions import bpe

    tok = _tokenizer()
    ids = bpe.encode(t(spark, d, "documents"), tok, "doc_id", "text").select(F.explode("tokens").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(i, x) for x, i in tok.vocab.items()], "token_id int, token string")
    return bpe.token_names(ids, names).where("token_id between 33 and 126 or token_id > 255").select("token_id", "n", "token")


@query("SELECT doc_id, sha256(lower(text)) AS digest FROM documents")
def sha256_text(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.sha2(F.lower("text"), 256).alias("digest"))


# ---------------------------------------------------------------- novelty


_BG = f"""w AS (SELECT item_id AS id, {WORDS_SQL.format('text')} AS w FROM benchmark), g AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w), n AS (SELECT id, count(*) AS n FROM g GROUP BY id)"""


@query(f"""WITH {_BG}, p AS (SELECT a.id, b.id AS o, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.id > b.id GROUP BY ALL),
m AS (SELECT p.id, max(k::DOUBLE / (x.n + y.n - k)) AS best FROM p JOIN n x ON x.id = p.id JOIN n y ON y.id = p.o GROUP BY p.id)
SELECT w.id, round(CASE WHEN w.id = (SELECT min(id) FROM w) THEN 1 WHEN len(w) < 2 THEN 0.5 ELSE 1 - coalesce(best, 0) END::DOUBLE, 6) AS novelty FROM w LEFT JOIN m USING (id)""")
def novelty_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return novelty.max_jaccard(t(spark, d, "benchmark").withColumnRenamed("item_id", "id"), "id", "text").withColumn("novelty", F.round("novelty", 6))


@query(f"""WITH a AS (SELECT doc_id AS id, {WORDS_SQL.format('text')} AS w FROM documents), x AS (SELECT id, len(w) AS na, unnest(w) AS g FROM a), b AS (SELECT item_id AS o, {WORDS_SQL.format('text')} AS w FROM benchmark), y AS (SELECT o, len(w) AS nb, unnest(list_distinct(w)) AS g FROM b),
c AS (SELECT id, na, o, nb, count(*) AS c FROM x JOIN y USING (g) GROUP BY ALL), m AS (SELECT id, max(2 * c::DOUBLE / (na + nb)) AS best FROM c GROUP BY id) SELECT a.id, round(1 - coalesce(best, 0), 6) AS novelty FROM a LEFT JOIN m USING (id)""")
def novelty_dice(spark: SparkSession, d: str) -> DataFrame:
    x = novelty.dice_novelty(t(spark, d, "documents"), t(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
    return x.withColumn("novelty", F.round("novelty", 6))


_UB = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"


@query(f"""WITH a0 AS (SELECT doc_id AS id, {WORDS_SQL.format('lower(text)')} AS w FROM documents), a AS (SELECT id, {_UB} AS w FROM a0), x AS (SELECT id, len(w) AS na, unnest(w) AS g FROM a), b0 AS (SELECT item_id AS o, {WORDS_SQL.format('lower(text)')} AS w FROM benchmark), b AS (SELECT o, {_UB} AS w FROM b0),
y AS (SELECT o, len(w) AS nb, unnest(list_distinct(w)) AS g FROM b), c AS (SELECT id, na, o, nb, count(*) AS c FROM x JOIN y USING (g) GROUP BY ALL), m AS (SELECT id, max(c::DOUBLE / (na + nb - c)) AS best FROM c GROUP BY id)
SELECT a.id, round(CASE WHEN len(a.w) = 0 THEN 0 ELSE greatest(1 - coalesce(best, 0), 0) END::DOUBLE, 6) AS novelty FROM a LEFT JOIN m USING (id)""")
def novelty_ngram(spark: SparkSession, d: str) -> DataFrame:
    x = novelty.ngram_novelty(t(spark, d, "documents"), t(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
    return x.withColumn("novelty", F.round("novelty", 6))


@query(f"""WITH w AS (SELECT doc_id AS id, {WORDS_SQL.format('text')} AS w FROM documents), g AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w), n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL) SELECT a, b, round(k::DOUBLE / (x.n + y.n - k), 6) AS jaccard FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k::DOUBLE / (x.n + y.n - k) > 0.5""")
def bigram_near_dups(spark: SparkSession, d: str) -> DataFrame:
    x = novelty.jaccard_pairs(t(spark, d, "documents"), "doc_id", T.bigrams(T.words(F.col("text"))), 0.5)
    return x.withColumn("jaccard", F.round("jaccard", 6))


@query(f"WITH {ADMIT_SQL} SELECT r.seq, z.seq IS NOT NULL AS accepted, round(quality::DOUBLE, 6) AS quality, CASE WHEN quality >= 0.75 THEN 2 WHEN quality >= 0.55 THEN 1 WHEN quality IS NOT NULL THEN 0 END AS tier FROM r LEFT JOIN z USING (seq)")
def corpus_admission(spark: SparkSession, d: str) -> DataFrame:
    """Ordered admission of whole texts."""
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("seq"), "source", F.col("text").alias("title"), ((F.col("n_chars") % 1000) / 1000.0).alias("confidence"))
    return corpus.admit(rows).select("seq", "accepted", r6(F.col("quality"), "quality"), "tier")


@query("SELECT doc_id, round(CASE WHEN (n_chars % 100) / 100.0 * (1 - 0.02) < 1e-4 THEN 0 ELSE (n_chars % 100) / 100.0 * (1 - 0.02) END::DOUBLE, 6) AS exp1, round(CASE WHEN (n_chars % 100) / 100.0 * power(0.95, n_chars % 20) < 1e-4 THEN 0 ELSE (n_chars % 100) / 100.0 * power(0.95, n_chars % 20) END::DOUBLE, 6) AS exp_n, round(greatest((n_chars % 100) / 100.0 - 0.1, 0)::DOUBLE, 6) AS lin FROM documents")
def decay_n_ticks(spark: SparkSession, d: str) -> DataFrame:
    v = (F.col("n_chars") % 100) / 100.0
    return t(spark, d, "documents").select("doc_id", r6(D.decay_exponential(v, 0.02), "exp1"), r6(D.decay_exponential(v, 0.05, F.col("n_chars") % 20), "exp_n"), r6(D.decay_linear(v, 0.1), "lin"))
