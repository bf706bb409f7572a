"""The registered queries of the training-data operators, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import decontam, jaccard, licenses, mixing, periodic, ppm, qda, quality_rules, sharding, spelling, toolcalls, toxicity, warc
from loam.llm.common import crc_bucket, table

#: Byte limit of a shard in op8.
SHARD_BYTES = 1 << 20


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), keep=False)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = toolcalls.turns_as_calls(table(spark, sf_dir, "conversations"))
    return toolcalls.format_chat(events, toolcalls.schema_table(spark, toolcalls.REPLY))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "n_passages")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), limit=SHARD_BYTES, keep=False)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_bucket("doc_id", 5) == 1
    out = ppm.score(docs, docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = {f"phrase:{k}": v for k, v in licenses.PHRASES.items()}
    out = licenses.scan(table(spark, sf_dir, "documents"), phrases | licenses.TEMPLATES)
    label = lambda m: F.replace(m.template, F.lit("phrase:"), F.lit(""))
    base = F.filter("matches", lambda m: m.template.startswith("phrase:"))
    places = F.transform(base, lambda m: m.start)
    joined = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, label))), ",")
    return out.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("matches")).alias("labels"), "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.runs(table(spark, sf_dir, "documents"), plant=True)
    out = out.withColumn("top", F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("s"), (-r.period).alias("p")))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.expr("(1000 * top.length) div -top.p").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), noise=199)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1,
    "op2_quality_rules": op2,
    "op3_decontamination": op3,
    "op4_tool_linking": op4,
    "op5_warc": op5,
    "op6_toxicity": op6,
    "op7_quality_qda": op7,
    "op8_sharding": op8,
    "op9_jaccard_join": op9,
    "op10_ppm": op10,
    "op11_license_scan": op11,
    "op12_periodic_runs": op12,
    "op13_spelling_variants": op13,
}

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_HASH = "('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || chr(1) || coalesce(text, '')), 1, 15))::BIGINT"

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32(text: str) -> str:
    """crc32 of a string's UTF-8 bytes: a fold over its bytes (0 to 255) with eight shifts (-1) after each."""
    steps = f"flatten(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: [('0x' || x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


SQL: dict[str, str] = {
    # The boundary row is found on the sorted hashes here: a plain statement of what the histograms find.
    "op1_source_mix": f"""
WITH d AS (SELECT doc_id, source, coalesce(len({_WORDS.format("text")}), 0)::BIGINT AS size, {_HASH} AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
   row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM w),
f AS (SELECT *, (SELECT arg_min(level, place) FROM l WHERE level * weight <= cap) AS free FROM l),
t AS (SELECT source, source_size, CASE WHEN free IS NULL THEN cap ELSE least(cap, free * weight) END AS target FROM f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS times FROM t),
k AS (SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h),
c AS (SELECT k.*, b.target - b.times * b.source_size AS budget, sum(words) OVER (PARTITION BY k.source ORDER BY h) AS upto FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source),
e AS (SELECT source, min(CASE WHEN upto >= budget THEN CASE WHEN (budget - (upto - words)) * 2 >= words THEN h + 1 ELSE h END END) AS below, any_value(budget) AS budget FROM c GROUP BY source)
SELECT doc_id, size, b.source_size, b.target, (least(3, b.times + CASE WHEN e.budget > 0 AND d.h < coalesce(e.below, 1152921504606846976) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN e ON d.source IS NOT DISTINCT FROM e.source""",
    "op8_sharding": f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, {_HASH} AS h FROM documents),
p AS (SELECT d.*, g.k AS depth, h >> (60 - g.k)::BIGINT AS q FROM d, (SELECT unnest(range(0, 25)) AS k) g),
s AS (SELECT depth, q, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_rows FROM p GROUP BY depth, q HAVING sum(n_bytes) <= {SHARD_BYTES}),
m AS (SELECT doc_id, n_bytes, h, min(p.depth) AS depth FROM p JOIN s USING (depth, q) GROUP BY ALL)
SELECT doc_id, n_bytes, CASE WHEN m.depth = 0 THEN '' ELSE lpad(bin(s.q), m.depth::INT, '0') END AS shard, m.depth::INT AS depth, shard_bytes, shard_rows, false AS oversized
FROM m JOIN s ON m.depth = s.depth AND (m.h >> (60 - m.depth)::BIGINT) = s.q""",
    "op9_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1)::BIGINT + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
   GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT l.y, r.reach FROM r JOIN l ON l.x = r.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id""",
    "op5_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT *, list_transform([1, 11, 21, 31], lambda i: ('0x' || substr(x, i, 10))::BIGINT) AS v FROM p),
b AS (SELECT *, array_to_string(list_transform(v, lambda n: array_to_string(list_transform([35, 30, 25, 20, 15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> k) & 31)::INT + 1, 1)), '')), '') AS payload_digest FROM g),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS o FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> o THEN o END AS refers_to FROM m""",
    # plain turns as calls: a user's turn is a call, the assistant's next turn its result
    "op4_tool_linking": """
WITH m AS (SELECT conv_id, turn, role, text, to_json(text)::VARCHAR AS j FROM conversations),
c AS (SELECT u.conv_id, u.turn, u.j, r.j AS result, row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn) - 1 AS rank
      FROM m u LEFT JOIN m r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1 AND r.role = 'assistant' WHERE u.role = 'user'),
k AS (SELECT conv_id, count(*) AS n_calls, count(result) AS n_linked,
      string_agg('{"arguments":{"prompt":' || j || ',"turn":' || turn || '},"errors":[],"id":"c' || turn || '","name":"reply","rank":' || rank || ',"result":' || coalesce(result, 'null') || ',"state":' || CASE WHEN result IS NULL THEN '"pending"' ELSE '"linked"' END || '}', ',' ORDER BY rank, turn) AS cj
      FROM c GROUP BY conv_id),
o AS (SELECT conv_id, count(*) AS n_messages, string_agg('{"content":' || CASE role WHEN 'user' THEN '""' ELSE j END || ',"role":"' || CASE role WHEN 'assistant' THEN 'tool' ELSE role END || '"}', ',' ORDER BY turn) AS mj,
      count(*) FILTER (WHERE role = 'assistant') AS n_results FROM m GROUP BY conv_id)
SELECT o.conv_id, 0::BIGINT AS part, n_messages, coalesce(n_calls, 0)::BIGINT AS n_calls, coalesce(n_linked, 0)::BIGINT AS n_linked, (coalesce(n_calls, 0) - coalesce(n_linked, 0))::BIGINT AS n_pending, 0::BIGINT AS n_duplicate,
       (n_results - coalesce(n_linked, 0))::BIGINT AS n_orphan, 0::BIGINT AS n_invalid, 0::BIGINT AS n_circular,
       '{"calls":[' || coalesce(cj, '') || '],"conv_id":' || o.conv_id || ',"messages":[' || mj || '],"part":0}' AS json
FROM o LEFT JOIN k ON k.conv_id = o.conv_id""",
    # All pairs of equal words in a text, as stretches of equal distance.
    "op12_periodic_runs": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w, {_crc32("doc_id::VARCHAR")} AS h FROM documents),
p AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a, (h // 10) % 8 AS k FROM d),
t AS (SELECT doc_id, list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + k)) + 1] END) AS w FROM p),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM t),
e AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i),
g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM e),
m AS (SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e FROM g GROUP BY doc_id, q, isle HAVING max(i) + 1 + q - min(i) >= greatest(12, 2 * q)),
r AS (SELECT doc_id, s, e - s AS l, min(q) AS q FROM m GROUP BY doc_id, s, e),
c AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM u WHERE NOT EXISTS (FROM r WHERE r.doc_id = u.doc_id AND u.i >= r.s + r.q AND u.i < r.s + r.l) GROUP BY u.doc_id),
o AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := s, l := l, q := q), struct_pack(l := -l, s := s, q := q)) AS top, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.l::BIGINT AS length, top.q::BIGINT AS period, (1000 * top.l // top.q)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN o ON o.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""",
    # Near words meet here on what is left of them without one character.
    "op13_spelling_variants": rf"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM documents),
c AS (SELECT doc_id, r, count(*) AS n FROM t WHERE length(r) >= 6 GROUP BY ALL),
h AS (SELECT r, n, {_crc32("doc_id || ':' || r")} AS h FROM c),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1),
v AS (SELECT word, n, length(word) AS l FROM w WHERE length(word) >= 6 AND n >= 5),
d AS (SELECT DISTINCT word, n, l, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, l + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, d.word, d.n FROM v a JOIN d ON d.rest = a.word UNION SELECT d.word, a.word, a.n FROM v a JOIN d ON d.rest = a.word),
b AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -m, w := near)) AS best FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.m >= 5 * v.n THEN best.w END AS form, CASE WHEN -best.m >= 5 * v.n THEN (-best.m)::BIGINT END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
s AS (SELECT word, word AS at FROM f UNION SELECT s.word, f.form FROM s JOIN f ON f.word = s.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, s.at AS root FROM f JOIN s ON s.word = f.word JOIN f e ON e.word = s.at AND e.form IS NULL""",
}
