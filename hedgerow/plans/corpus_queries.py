"""Queries on page texts, chunks, embeddings and nearest-neighbour search."""

from pyspark.sql import functions as F

from hedgerow.functions import text as T
from hedgerow.functions.numbers import round_half_even
from hedgerow.operators import corpus, policies, registry, search
from hedgerow.operators.pairing import every_pair
from hedgerow.plans.catalog import half_even, query, quote
from hedgerow.plans.inputs import load, table, with_clause
from hedgerow.rules import documents as D

# --- chunks -----------------------------------------------------------------


def text_chunks(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return corpus.chunk_text(docs)


@query("chunk_text")
def chunk_text(spark, sf):
    return text_chunks(spark, sf)


# every document is covered from its first to its last word, in chunks of 800 characters at most
@query("chunk_coverage", r"""
    SELECT doc_id AS document_id, true AS fits, true AS numbered,
           regexp_extract(text, '\S+') AS first_word, regexp_extract(text, '(\S+)\s*$', 1) AS last_word
    FROM (SELECT * FROM documents WHERE regexp_matches(text, '\S')) x
    WHERE length(regexp_extract(text, '\S+')) < 800 AND length(regexp_extract(text, '(\S+)\s*$', 1)) < 800""")
def chunk_coverage(spark, sf):
    first = F.regexp_extract(F.min_by("text", "chunk_index"), r"(\S+)", 1)
    last = F.regexp_extract(F.max_by("text", "chunk_index"), r"(\S+)\s*\z", 1)
    size = D.CHUNK_TOKENS * D.CHARS_PER_TOKEN
    return text_chunks(spark, sf).groupBy("document_id").agg(
        (F.max("char_count") <= size).alias("fits"),
        (F.max("chunk_index") + 1 == F.count("*")).alias("numbered"),
        first.alias("first_word"), last.alias("last_word"),
    ).filter((F.length("first_word") < size) & (F.length("last_word") < size))


@query("chunk_pages")
def chunk_pages(spark, sf):
    return corpus.chunk_pages(load(spark, sf, "doc_pages"))


@query("page_offsets", with_clause("doc_pages") + r"""
    SELECT document_id, page_number,
           CASE WHEN stop - n > 0 THEN stop - n - 2 ELSE 0 END AS start_offset, stop AS end_offset
    FROM (SELECT document_id, page_number, length(text) AS n,
                 CAST(sum(length(text) + 2) OVER (PARTITION BY document_id ORDER BY page_number) AS BIGINT) - 2 AS stop
          FROM doc_pages WHERE regexp_matches(text, '\S')) x""")
def page_offsets(spark, sf):
    return corpus.page_offsets(load(spark, sf, "doc_pages"))


@query("full_text", with_clause("doc_pages") + r"""
    SELECT document_id, md5(string_agg('[Page ' || page_number || ']' || chr(10) || text, chr(10) || chr(10)
                                       ORDER BY page_number)) AS text_md5
    FROM doc_pages WHERE regexp_matches(text, '\S') GROUP BY document_id""")
def full_text(spark, sf):
    return corpus.full_text(load(spark, sf, "doc_pages")).select("document_id", F.md5("text").alias("text_md5"))


@query("reassemble", with_clause("chunks") + """
    SELECT document_id, count(*) AS chunk_count,
           md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index, text)) AS text_md5
    FROM chunks GROUP BY document_id""")
def reassemble(spark, sf):
    return corpus.reassemble(load(spark, sf, "chunks")).select(
        "document_id", "chunk_count", F.md5("text").alias("text_md5"))


_FACTS = with_clause("doc_pages") + r""", facts AS (
    SELECT *, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS char_count,
           len(regexp_extract_all(text, '\S+')) AS word_count,
           least(1e0, image_area / (page_area * 4)) AS image_ratio FROM doc_pages)
    """


@query("document_rollup", _FACTS + """
    SELECT document_id, count(*) AS total_pages, CAST(sum(char_count) AS BIGINT) AS total_char_count,
           CAST(sum(word_count) AS BIGINT) AS total_word_count, bool_or(image_ratio > 0.7) AS contains_drawings,
           CASE WHEN count(DISTINCT extraction_method) > 1 THEN 'mixed' ELSE min(extraction_method) END AS extraction_method
    FROM facts GROUP BY document_id""")
def document_rollup(spark, sf):
    return corpus.document_rollup(corpus.page_facts(load(spark, sf, "doc_pages")))


@query("image_based", _FACTS + """
    SELECT document_id, round(avg(image_ratio), 6) AS average_image_ratio, count(*) AS page_count,
           avg(image_ratio) > 0.7 AS is_image_based FROM facts GROUP BY document_id""")
def image_based(spark, sf):
    return corpus.image_based(corpus.page_facts(load(spark, sf, "doc_pages"))).withColumn(
        "average_image_ratio", F.round("average_image_ratio", 6))


@query("page_ratios", _FACTS + """
    SELECT document_id, string_agg(CAST(CAST(floor(image_ratio * 1000) AS BIGINT) AS STRING), ',' ORDER BY page_number) AS page_ratios
    FROM facts GROUP BY document_id""")
def page_ratios(spark, sf):
    found = corpus.page_ratios(corpus.page_facts(load(spark, sf, "doc_pages")))
    return found.select("document_id", F.array_join(
        F.transform("page_ratios", lambda r: F.floor(r * 1000).cast("string")), ",").alias("page_ratios"))


# --- embedding and search ---------------------------------------------------

@query("embed_chunks")
def embed_chunks(spark, sf):
    found = corpus.embed_chunks(corpus.chunk_text(load(spark, sf, "chunks").withColumnRenamed("chunk_index", "turn"), "document_id"))
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return found.select("document_id", "chunk_index", F.size("embedding").alias("dim"), F.round(length, 5).alias("length"))


_DISTANCE = "list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) ** 2"


def _knn_sql(condition, k):
    return f"""
    SELECT query_id, vec_id, round(d, 6) AS distance, CAST(rank AS INT) AS rank, round(greatest(0, 1 - d / 2), 6) AS relevance_score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank
          FROM (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, {_DISTANCE} AS d
                FROM embeddings q JOIN embeddings v ON {condition}) x) y
    WHERE rank <= {k}"""


def _rounded(hits):
    return hits.withColumn("distance", F.round("distance", 6)).withColumn(
        "relevance_score", F.round("relevance_score", 6))


@query("knn_search", _knn_sql("q.vec_id <> v.vec_id", 10))
def knn_search(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return _rounded(search.knn(vectors.withColumnRenamed("vec_id", "query_id"), vectors, 10, exclude_self=True))


@query("knn_filtered", _knn_sql("q.vec_id <> v.vec_id AND q.label = v.label", 5))
def knn_filtered(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return _rounded(search.knn(vectors.withColumnRenamed("vec_id", "query_id"), vectors, 5, match="label",
                               exclude_self=True))


@query("knn_by_application", f"""
    SELECT query_id, chunk_id, round(d, 6) AS distance, CAST(rank AS INT) AS rank, n_chars
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank
          FROM (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, y.n_chars, {_DISTANCE} AS d
                FROM embeddings q JOIN documents x ON x.doc_id = q.vec_id JOIN documents y ON y.source = x.source AND y.lang = x.lang
                JOIN embeddings v ON v.vec_id = y.doc_id) x) y WHERE rank <= 4""")
def knn_by_application(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("application_ref"), "lang", "n_chars")
    chunks = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding").join(
        docs, F.col("chunk_id") == F.col("doc_id")).drop("doc_id")
    asked = chunks.select(F.col("chunk_id").alias("query_id"), "embedding", "application_ref", "lang")
    hits = search.search_documents(asked, chunks, 4, match=["application_ref", "lang"])
    return hits.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank", "n_chars")


def _dated_vectors(spark, sf):
    """Vectors as chunks of revisions: the newest known revision ids of customers, in turn."""
    vectors = table(spark, sf, "embeddings")
    held = load(spark, sf, "revision_facts").groupBy("source").agg(F.max("revision_id").alias("revision_id"))
    return vectors.withColumn("source", F.col("vec_id")).join(held, "source").select(
        F.col("vec_id").alias("chunk_id"), "embedding", "source", "revision_id")


@query("knn_asof", with_clause("policy_revisions", "snapshot_dates") + f""", chunks_ AS (
      SELECT e.vec_id AS chunk_id, e.embedding, h.source, h.revision_id FROM embeddings e
      JOIN (SELECT source, max(revision_id) AS revision_id FROM policy_revisions GROUP BY source) h ON h.source = e.vec_id),
    live AS (SELECT source, on_date, revision_id FROM (
      SELECT r.*, d.on_date, row_number() OVER (PARTITION BY r.source, d.on_date ORDER BY r.effective_from DESC, r.revision_id DESC) AS rn
      FROM policy_revisions r JOIN snapshot_dates d
        ON r.effective_from <= d.on_date AND (r.effective_to IS NULL OR r.effective_to >= d.on_date)
      WHERE r.status IN ('active', 'superseded')) x WHERE rn = 1),
    queries_ AS (SELECT e.vec_id AS query_id, e.embedding, d.on_date FROM embeddings e CROSS JOIN snapshot_dates d),
    pairs AS (SELECT q.query_id || '@' || strftime(q.on_date, '%Y-%m-%d') AS query_id, v.chunk_id, {_DISTANCE} AS d
      FROM queries_ q JOIN live l ON l.on_date = q.on_date
      JOIN chunks_ v ON v.source = l.source AND v.revision_id = l.revision_id)
    SELECT query_id, chunk_id, round(d, 6) AS distance, CAST(rank AS INT) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM pairs) x WHERE rank <= 3""")
def knn_asof(spark, sf):
    queries = every_pair(table(spark, sf, "embeddings").select("vec_id", "embedding"), load(spark, sf, "snapshot_dates"), "on_date").select(
        F.concat(F.col("vec_id").cast("string"), F.lit("@"), F.col("on_date").cast("string")).alias("query_id"),
        "embedding", "on_date")
    hits = search.search_policy_asof(queries, _dated_vectors(spark, sf), load(spark, sf, "policy_revisions"), 3)
    return hits.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


# --- store ------------------------------------------------------------------

@query("policy_section", with_clause("policy_texts") + ", cut AS (SELECT *, coalesce(" + ", ".join(
    f"nullif(regexp_extract(text, {quote(p)}, 1, 'i'), '')" for p in D.SECTION_PATTERNS) + """, '') AS section_ref,
      doc_id % 9 + 1 AS page_number FROM policy_texts)
    SELECT source, revision_id, section_ref, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS text_md5,
           array_to_string(list_sort(list_distinct(list(page_number))), ',') AS page_numbers, count(*) AS chunks
    FROM cut WHERE section_ref <> '' GROUP BY source, revision_id, section_ref""")
def policy_section(spark, sf):
    chunks = load(spark, sf, "policy_texts").select(
        "source", "revision_id", "text", F.col("doc_id").alias("chunk_index"),
        (F.col("doc_id") % 9 + 1).alias("page_number"), T.section_ref(F.col("text")).alias("section_ref"))
    return policies.policy_section(chunks).select(
        "source", "revision_id", "section_ref", F.md5("text").alias("text_md5"),
        F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ",").alias("page_numbers"), "chunks")


@query("chunk_counts", """
    SELECT coalesce(source, '*') AS source, coalesce(lang, '*') AS revision_id, count(*) AS chunks
    FROM documents GROUP BY ROLLUP (source, lang)""")
def chunk_counts(spark, sf):
    docs = table(spark, sf, "documents").select("source", F.col("lang").alias("revision_id"))
    return policies.chunk_counts(docs).select(
        F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("revision_id", F.lit("*")).alias("revision_id"), "chunks")


@query("store_stats", """
    SELECT (SELECT count(*) FROM conversations) AS total_chunks, (SELECT count(*) FROM documents) AS total_documents""")
def store_stats(spark, sf):
    return corpus.store_stats(load(spark, sf, "chunks"), table(spark, sf, "documents"))


@query("upsert_chunks", """
    SELECT chunk_id, arg_max(n_chars, version) AS n_chars FROM (
      SELECT md5(text) AS chunk_id, n_chars, -1 AS version FROM documents
      UNION ALL SELECT md5(d.text), d.n_chars + 1, l.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id) x
    GROUP BY chunk_id""")
def upsert_chunks(spark, sf):
    docs = table(spark, sf, "documents")
    target = docs.select(F.md5("text").alias("chunk_id"), "n_chars", F.lit(-1).cast("long").alias("version"))
    updates = docs.join(table(spark, sf, "labels"), "doc_id").select(
        F.md5("text").alias("chunk_id"), (F.col("n_chars") + 1).alias("n_chars"), F.col("doc_id").alias("version"))
    return registry.upsert(target, updates, "chunk_id", "version").select("chunk_id", "n_chars")


@query("delete_chunks", """
    SELECT conv_id AS document_id, count(*) AS deleted FROM conversations
    WHERE conv_id IN (SELECT doc_id FROM labels) GROUP BY conv_id""")
def delete_chunks(spark, sf):
    doomed = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"))
    return registry.delete_by(load(spark, sf, "chunks"), doomed)[1]


@query("reindex", """
    SELECT conv_id AS document_id, count(*) AS chunks,
           CAST(sum(CASE WHEN conv_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 0 END) AS BIGINT) AS fresh
    FROM (SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)
          UNION ALL SELECT doc_id, 0 FROM labels) x GROUP BY conv_id""")
def reindex(spark, sf):
    old = load(spark, sf, "chunks").select("document_id", "chunk_index", F.lit(0).alias("fresh"))
    fresh = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), F.lit(0).cast("long").alias("chunk_index"),
                                              F.lit(1).alias("fresh"))
    return registry.reindex(old, fresh, ["document_id"]).groupBy("document_id").agg(
        F.count("*").alias("chunks"), F.sum("fresh").alias("fresh"))


@query("list_documents", """
    SELECT doc_id AS document_id, n_chars FROM documents WHERE source = 'src1'""")
def list_documents(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("application_ref"), "n_chars")
    return corpus.list_documents(docs, "src1").select("document_id", "n_chars")


# --- ingest -----------------------------------------------------------------

def ingest_inputs(spark, sf):
    """Conversations as files of pages; labelled ones are known already."""
    pages = load(spark, sf, "doc_pages").withColumn("file_path", F.concat(
        F.lit("/in/"), F.col("document_id").cast("string"),
        F.when(F.col("document_id") % 10 == 3, ".docx").otherwise(".pdf")))
    files = pages.groupBy("document_id", "file_path").agg(
        F.sha2(F.col("document_id").cast("string"), 256).alias("file_hash"),
        F.lit("25/01/F").alias("application_ref"), F.lit(None).cast("string").alias("document_type"))
    known = files.join(table(spark, sf, "labels").select(F.col("doc_id").alias("document_id")), "document_id", "left_semi").select(
        T.document_id(F.col("application_ref"), F.col("file_hash")).alias("document_id"), "file_hash")
    return files.drop("document_id"), pages.drop("document_id"), known


@query("ingest_documents", _FACTS + """
    SELECT '/in/' || f.document_id || CASE WHEN f.document_id % 10 = 3 THEN '.docx' ELSE '.pdf' END AS file_path,
           CASE WHEN f.document_id % 10 = 3 THEN 'error' WHEN k.doc_id IS NOT NULL THEN 'already_ingested'
                WHEN f.ratio > 0.7 THEN 'skipped' WHEN f.chars = 0 THEN 'error' ELSE 'success' END AS status,
           CASE WHEN f.document_id % 10 = 3 THEN 'unsupported_file_type' WHEN k.doc_id IS NOT NULL THEN ''
                WHEN f.ratio > 0.7 THEN 'image_based' WHEN f.chars = 0 THEN 'no_content' ELSE '' END AS detail
    FROM (SELECT document_id, avg(image_ratio) AS ratio, sum(char_count) AS chars FROM facts GROUP BY document_id) f
    LEFT JOIN labels k ON k.doc_id = f.document_id""")
def ingest_documents(spark, sf):
    return corpus.ingest_documents(*ingest_inputs(spark, sf)).status.select(
        "file_path", "status", F.coalesce("detail", F.lit("")).alias("detail"))


# each language's files share the six digits that ids show; equal texts of a source are copies of one file
@query("ingest_collisions", r"""
    SELECT application_ref, file_path, file_path = first AND chars > 0 AS has_chunks,
           CASE WHEN chars = 0 THEN 'error' WHEN file_path = first THEN 'success' ELSE 'already_ingested' END AS status,
           CASE WHEN chars = 0 THEN 0 ELSE files END AS hash_files
    FROM (SELECT *, min(file_path) OVER (PARTITION BY application_ref, file_hash) AS first,
                 count(*) OVER (PARTITION BY application_ref, file_hash) AS files
          FROM (SELECT coalesce(source, '') AS application_ref, '/in/' || doc_id || '.pdf' AS file_path,
                       substr(sha256(coalesce(lang, '')), 1, 6) || substr(sha256(coalesce(text, '')), 7) AS file_hash,
                       len(regexp_extract_all(coalesce(text, ''), '\S')) AS chars FROM documents) x) y""")
def ingest_collisions(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.coalesce("source", F.lit("")).alias("application_ref"),
        F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_path"),
        F.concat(F.substring(F.sha2(F.coalesce("lang", F.lit("")), 256), 1, 6),
                 F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 7, 58)).alias("file_hash"),
        F.lit("report").alias("document_type"), "text")
    pages = docs.select("file_path", F.lit(1).alias("page_number"), "text", F.lit("text_layer").alias("extraction_method"),
                        F.lit(0.0).alias("image_area"), F.lit(512.0).alias("page_area"))
    nothing = docs.select(F.lit("").alias("document_id"), "file_hash").limit(0)
    out = corpus.ingest_documents(docs.drop("text"), pages, nothing)
    # chunks know their file by application and whole hash: joined back on it, every file finds the chunks of its own text
    held = out.chunks.filter("chunk_index = 0").groupBy("application_ref", "file_hash").agg(F.count("*").alias("_firsts"))
    keyed = docs.select("application_ref", "file_hash", "file_path").join(held, ["application_ref", "file_hash"], "left")
    copies = docs.groupBy("application_ref", "file_hash").agg(F.count("*").alias("_files"))
    held = keyed.join(copies, ["application_ref", "file_hash"]).select(
        "file_path", F.coalesce(F.col("_firsts") * F.col("_files"), F.lit(0)).alias("hash_files"))
    return out.status.join(held, "file_path").select(
        "application_ref", "file_path", (F.col("chunks_created") > 0).alias("has_chunks"), "status", "hash_files")


@query("ingest_chunks")
def ingest_chunks(spark, sf):
    return corpus.ingest_documents(*ingest_inputs(spark, sf)).chunks.drop("embedding")


@query("ingest_summary", with_clause("ingest_status") + f"""
    SELECT application_ref, total_documents, ingested_count, failed_count, skipped_count,
           {half_even('pct', 1)} AS progress_percent, ingested_count + failed_count >= total_documents AS is_complete
    FROM (SELECT *, CAST(ingested_count + failed_count AS DOUBLE) / total_documents * 100 AS pct FROM (
      SELECT application_ref, count(*) AS total_documents,
             count(*) FILTER (WHERE status IN ('success', 'already_ingested')) AS ingested_count,
             count(*) FILTER (WHERE status = 'error') AS failed_count, count(*) FILTER (WHERE status = 'skipped') AS skipped_count
      FROM ingest_status GROUP BY application_ref) x) y""")
def ingest_summary(spark, sf):
    return corpus.ingest_summary(load(spark, sf, "ingest_status"))


@query("ingest_errors", with_clause("ingest_status") + """
    SELECT application_ref, file_path, 'failed' AS detail FROM ingest_status WHERE status = 'error'""")
def ingest_errors(spark, sf):
    return corpus.ingest_errors(load(spark, sf, "ingest_status").withColumn("detail", F.lit("failed")))


@query("ingest_policies", with_clause("policy_texts") + r"""
    SELECT source, revision_id, CASE WHEN bool_or(regexp_matches(text, '\S')) THEN 'active' ELSE 'failed' END AS status,
           CAST(count(*) FILTER (WHERE regexp_matches(text, '\S')) AS BIGINT) > 0 AS has_chunks, count(*) AS page_count
    FROM policy_texts GROUP BY source, revision_id""")
def ingest_policies(spark, sf):
    pages = load(spark, sf, "policy_texts").select(
        "source", "revision_id", F.col("doc_id").alias("page_number"), "text")
    revisions = pages.groupBy("source", "revision_id").agg(
        F.lit("v1").alias("version_label"), F.lit("2024-01-01").cast("date").alias("effective_from"),
        F.lit(None).cast("date").alias("effective_to"))
    return corpus.ingest_policy_revisions(revisions, pages).status.select(
        "source", "revision_id", "status", (F.col("chunk_count") > 0).alias("has_chunks"), "page_count")


@query("half_even_rounding", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {half_even('x', 1)} AS one_place, {half_even('x', 0)} AS whole
    FROM (SELECT *, l_extendedprice * l_discount / 3 AS x FROM lineitem) t""")
def half_even_rounding(spark, sf):
    x = F.col("l_extendedprice") * F.col("l_discount") / 3
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", round_half_even(x, 1).alias("one_place"),
        round_half_even(x, 0).alias("whole"))
