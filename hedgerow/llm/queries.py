"""The registered queries of this folder: each operator over its whole table, with DuckDB SQL where that can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from hedgerow.llm import chat, decontam, langid, mixing, pii, quality, toxicity, warc
from hedgerow.llm.catalog import ORACLES, QUERIES, query  # noqa: F401
from hedgerow.llm.colloc import collocations
from hedgerow.llm.hardneg import hard_negatives
from hedgerow.llm.neardup import near_duplicates
from hedgerow.llm.shared import remainder
from hedgerow.llm.simhash import simhash_duplicates
from hedgerow.llm.topk import top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_minhash_near_dedup", r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM worded),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
near AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN roots USING (doc_id)
""")
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_exact_top_k", """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""")
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda id: id % 20 == 0)


@query("op3_toxicity_grammar")
def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    scored = toxicity.toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, remainder("doc_id", 3) != 1)
    return langid.languages(docs, model).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query("op7_personal_data")
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.fit(docs))


@query("op10_quality_attention")
def op10_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    scored = quality.quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


@query("op8_warc_splits", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b) AS n, sha256(h) AS d FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d, n) AS first FROM s)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
    CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to FROM f
""")
def op8_warc_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_chat_paths", """
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
    SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS r,
        replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS t FROM rows)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    sum(length(r) + length(t) + 27)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
""")
def op4_chat_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    made = chat.conversations(rows.unionByName(more))
    read = made.withColumn("turns", chat.turns_of(F.col("formatted"))).withColumn(
        "learnt", chat.under_loss(F.col("formatted"), F.col("loss")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query("op6_mixing_sources")
def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "mix_weight", "mix_probability", "mix_kept")


@query("op9_decontamination", r"""
WITH bench AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS g FROM benchmark),
docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS h FROM documents),
words AS (SELECT doc_id, unnest(h) AS word, unnest(range(0, len(h))) AS pos FROM docs),
asked AS (SELECT item_id, least(20, len(g)) AS width, unnest(g) AS word, unnest(range(0, len(g))) AS pos FROM bench),
starts AS (
    SELECT DISTINCT doc_id, item_id, shift FROM (
        SELECT doc_id, item_id, w.pos - a.pos AS shift, width, count(DISTINCT w.pos) AS equal FROM words w JOIN asked a USING (word)
        GROUP BY doc_id, item_id, w.pos - a.pos, width) WHERE equal * 100 >= width * 80),
sided AS (
    SELECT doc_id, item_id, shift, least(20, len(g)) AS width, greatest(0, -shift) AS f, h, g,
        least(len(g), len(h) - shift) - greatest(0, -shift) AS c FROM starts JOIN docs USING (doc_id) JOIN bench USING (item_id)),
wins AS (SELECT *, unnest(range(0, c - width + 1)) AS i FROM sided WHERE c >= width),
sums AS (SELECT doc_id, item_id, width, shift + f + i AS pos,
    len(list_filter(range(0, width), lambda k: h[shift + f + i + k + 1] = g[f + i + k + 1])) AS matched FROM wins),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, pos) AS r FROM sums WHERE matched * 100 >= width * 80)
SELECT doc_id, item_id, matched::INT AS matched, width::INT AS compared, pos::INT AS doc_at FROM ranked WHERE r = 1
""")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_simhash_near_dedup")
def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))


@query("op12_hard_negatives", """
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_dot_product(a.v, c.v)::BIGINT AS score
    FROM whole a JOIN whole c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), lambda id: id % 100 == 0)


@query("op13_collocations", r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
runs AS (SELECT lang, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS ws
    FROM w, (VALUES (1), (2), (3)) t(m) WHERE len(w) >= m),
f AS (SELECT lang, ws, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 10),
around AS (SELECT lang, ws, max(a) AS most FROM (
    SELECT lang, ws[1:2] AS ws, a FROM f WHERE len(ws) = 3 UNION ALL SELECT lang, ws[2:3], a FROM f WHERE len(ws) = 3) GROUP BY ALL),
kept AS (SELECT f.* FROM f LEFT JOIN around USING (lang, ws) WHERE len(ws) > 1 AND NOT coalesce(100 * most >= 50 * f.a, false)),
cuts AS (SELECT *, unnest(range(1, len(ws))) AS k FROM kept),
scored AS (SELECT c.lang, c.ws, c.a, c.k, x.a AS l, y.a AS r,
        (1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:k] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[k + 1:]),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank,
    array_to_string(ws, ' ') AS phrase, a, l, r, n, score FROM lowest JOIN sizes USING (lang) QUALIFY rank <= 2000
""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
