"""Queries on listed documents, file names, links and pages."""

from pyspark.sql import functions as F

from hedgerow.functions import dates
from hedgerow.functions import text as T
from hedgerow.operators import classify, corpus, filters, pages
from hedgerow.operators import reviews as review_ops
from hedgerow.plans.catalog import contains_any, count_contained, half_even, listed, query, quote
from hedgerow.plans.inputs import DATE_TEXTS, HREFS, LABEL_TEXTS, load, pick, table, with_clause
from hedgerow.rules import documents as D

# --- filters ----------------------------------------------------------------


def _decision_sql(consultation=False, public=False):
    texts = "texts"
    arms = [
        (f"{texts} = ''", True, quote(D.REASON_EMPTY)),
        (f"contains({texts}, 'superseded')", False, quote(D.REASON_SUPERSEDED)),
        (f"category IN {listed(D.CATEGORY_ALLOWED)}", True, f"{quote(D.REASON_CATEGORY_PREFIX)} || document_type"),
    ]
    if not consultation:
        arms.append((f"category IN {listed(D.CATEGORY_CONSULTATION)}", False, quote(D.REASON_CATEGORY_CONSULTATION)))
    if not public:
        arms.append((f"category IN {listed(D.CATEGORY_PUBLIC)}", False, quote(D.REASON_CATEGORY_PUBLIC)))
    if not consultation:
        arms.append((contains_any(texts, D.CONSULTATION_PHRASES), False, quote(D.REASON_CONSULTATION)))
    if not public:
        arms.append((contains_any(texts, D.PUBLIC_PHRASES), False, quote(D.REASON_PUBLIC)))
    arms += [
        (contains_any(texts, D.CORE_PHRASES), True, quote(D.REASON_CORE)),
        (contains_any(texts, D.ASSESSMENT_PHRASES), True, quote(D.REASON_ASSESSMENT)),
        (contains_any(texts, D.OFFICER_PHRASES), True, quote(D.REASON_OFFICER)),
        (contains_any(texts, D.NON_TRANSPORT_PHRASES), False, quote(D.REASON_NON_TRANSPORT)),
        ("true", True, quote(D.REASON_UNKNOWN)),
    ]
    allowed = "CASE " + " ".join(f"WHEN {c} THEN {str(a).lower()}" for c, a, _ in arms) + " END"
    reason = "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, _, r in arms) + " END"
    return with_clause("listed_documents") + f""", decided AS (
        SELECT document_id, application_ref, document_type, description,
               {allowed} AS allowed, {reason} AS filter_reason
        FROM (SELECT *, lower(nullif(document_type, '')) AS category,
                     concat_ws(chr(10), lower(nullif(document_type, '')), lower(nullif(description, ''))) AS texts
              FROM listed_documents) x)
        """


@query("filter_documents", _decision_sql() + "SELECT document_id, allowed, filter_reason FROM decided")
def filter_documents(spark, sf):
    return filters.filter_documents(load(spark, sf, "listed_documents")).select(
        "document_id", "allowed", "filter_reason")


@query("filter_documents_all_included",
       _decision_sql(True, True) + "SELECT document_id, allowed, filter_reason FROM decided")
def filter_documents_all_included(spark, sf):
    docs = load(spark, sf, "listed_documents")
    return filters.filter_documents(docs, include_consultation=True, include_public=True).select(
        "document_id", "allowed", "filter_reason")


@query("filter_summary", _decision_sql() + f"""
    SELECT application_ref, total, allowed_count, total - allowed_count AS filtered_count,
           {half_even('pct', 1)} AS reduction_pct
    FROM (SELECT *, (1 - CAST(allowed_count AS DOUBLE) / total) * 100 AS pct
          FROM (SELECT application_ref, count(*) AS total, count(*) FILTER (WHERE allowed) AS allowed_count
                FROM decided GROUP BY application_ref) x) y""")
def filter_summary(spark, sf):
    return filters.filter_summary(filters.filter_documents(load(spark, sf, "listed_documents")))


@query("post_filter", with_clause("listed_documents") + f"""
    SELECT document_id,
           CASE WHEN category IN {listed(D.CATEGORY_CONSULTATION)} THEN 'category_denylist_consultation'
                WHEN category IN {listed(D.CATEGORY_PUBLIC)} THEN 'category_denylist_public'
                WHEN {contains_any('title', D.CONSULTATION_PHRASES)} THEN 'title_pattern_consultation'
                WHEN {contains_any('title', D.PUBLIC_PHRASES)} THEN 'title_pattern_public'
                ELSE 'kept' END AS removed_by
    FROM (SELECT document_id, trim(lower(coalesce(document_type, ''))) AS category,
                 lower(coalesce(description, '')) AS title FROM listed_documents) x""")
def post_filter(spark, sf):
    return filters.post_filter_selected(load(spark, sf, "listed_documents")).select(
        "document_id", F.coalesce("removed_by", F.lit("kept")).alias("removed_by"))


@query("select_by_ids", with_clause("listed_documents") + """
    SELECT document_id, description FROM listed_documents WHERE document_id IN (SELECT doc_id FROM labels)""")
def select_by_ids(spark, sf):
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"))
    return filters.select_by_ids(load(spark, sf, "listed_documents"), ids).select("document_id", "description")


@query("supported_files", with_clause("named_files") + r"""
    SELECT doc_id, CASE WHEN lower(regexp_extract(file_name, '.(\.[^.]+)$', 1))
                             IN ('.pdf', '.png', '.jpg', '.jpeg', '.tiff', '.tif')
                        THEN 'supported' ELSE 'unsupported_file_type' END AS file_status
    FROM named_files""")
def supported_files(spark, sf):
    return filters.supported_files(load(spark, sf, "named_files")).select("doc_id", "file_status")


@query("rendering_names", with_clause("named_files") + f"""
    SELECT doc_id, regexp_matches(regexp_replace(file_name, '\\.[^.]+$', ''), {quote(D.RENDERING_PATTERN)}, 'i') AS is_rendering
    FROM named_files""")
def rendering_names(spark, sf):
    return filters.mark_renderings(load(spark, sf, "named_files")).select("doc_id", "is_rendering")


# --- types ------------------------------------------------------------------

_NAME_TYPE = "CASE " + " ".join(
    f"WHEN regexp_matches(file_name, {quote(p)}, 'i') THEN {quote(k)}" for p, k in D.FILENAME_PATTERNS) + " END"
_NAME_PATTERN = "CASE " + " ".join(
    f"WHEN regexp_matches(file_name, {quote(p)}, 'i') THEN {quote(p)}" for p, _ in D.FILENAME_PATTERNS) + " END"
_SCORES = ", ".join(f"{count_contained('low', w)} AS s{i}" for i, (_, w) in enumerate(D.CONTENT_KEYWORDS))
_BEST = "greatest(" + ", ".join(f"s{i}" for i in range(len(D.CONTENT_KEYWORDS))) + ")"
_CONTENT_TYPE = "CASE WHEN best < 2 THEN NULL " + " ".join(
    f"WHEN s{i} = best THEN {quote(k)}" for i, (k, _) in enumerate(D.CONTENT_KEYWORDS)) + " END"
_CLASSIFIED = with_clause("named_files") + f""", scored AS (
    SELECT *, {_BEST} AS best FROM (SELECT doc_id, file_name, {_SCORES}
        FROM (SELECT *, lower(body) AS low FROM named_files) x) y)
    """


@query("classify_filename", with_clause("named_files") + f"""
    SELECT doc_id, coalesce({_NAME_TYPE}, 'other') AS document_type, coalesce({_NAME_PATTERN}, '') AS matched_pattern
    FROM named_files""")
def classify_filename(spark, sf):
    found = classify.classify_filename(F.col("file_name"))
    return load(spark, sf, "named_files").select("doc_id", "file_name").withColumn("c", found).select(
        "doc_id", F.coalesce("c.document_type", F.lit("other")).alias("document_type"),
        F.coalesce("c.matched_pattern", F.lit("")).alias("matched_pattern"))


@query("classify_content", _CLASSIFIED + f"""
    SELECT doc_id, coalesce({_CONTENT_TYPE}, 'other') AS document_type,
           CASE WHEN best >= 2 THEN best || ' keyword matches' ELSE '' END AS matched_pattern FROM scored""")
def classify_content(spark, sf):
    found = classify.classify_content(F.col("low"))
    return load(spark, sf, "named_files").select("doc_id", F.lower("body").alias("low")).withColumn("c", found).select(
        "doc_id", F.coalesce("c.document_type", F.lit("other")).alias("document_type"),
        F.coalesce("c.matched_pattern", F.lit("")).alias("matched_pattern"))


@query("classify_document", _CLASSIFIED + f"""
    SELECT doc_id, coalesce({_NAME_TYPE}, {_CONTENT_TYPE}, 'other') AS document_type,
           CASE WHEN {_NAME_TYPE} IS NOT NULL THEN 'high' WHEN best >= 2 THEN 'medium' ELSE 'low' END AS confidence,
           CASE WHEN {_NAME_TYPE} IS NOT NULL THEN 'filename' WHEN best >= 2 THEN 'content' ELSE 'fallback' END AS method
    FROM scored""")
def classify_document(spark, sf):
    files = load(spark, sf, "named_files").select("doc_id", "file_name", "body")
    return classify.classify_documents(files, "file_name", "body").select(
        "doc_id", "document_type", "confidence", "method")


# --- scalar columns ---------------------------------------------------------

@query("section_refs", with_clause("policy_texts") + "SELECT doc_id, coalesce(" + ", ".join(
    f"nullif(regexp_extract(text, {quote(p)}, 1, 'i'), '')" for p in D.SECTION_PATTERNS) + """, '') AS section_ref
    FROM policy_texts""")
def section_refs(spark, sf):
    return load(spark, sf, "policy_texts").select("doc_id", T.section_ref(F.col("text")).alias("section_ref"))


_DAY_TEXT = f"trim({pick('doc_id', DATE_TEXTS)})"


@query("parse_dates", f"""
    SELECT doc_id, coalesce(strftime(coalesce(
             try_strptime(t, '%d/%m/%Y'), try_strptime(t, '%d %b %Y'), try_strptime(t, '%d %B %Y'),
             try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%d-%m-%Y')), '%Y-%m-%d'), '') AS day
    FROM (SELECT doc_id, {_DAY_TEXT} AS t FROM documents) x""")
def parse_dates(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr(pick("doc_id", DATE_TEXTS)).alias("t"))
    return docs.select("doc_id", F.coalesce(dates.parse_date(F.col("t")).cast("string"), F.lit("")).alias("day"))


_LABEL = "trim(regexp_replace(lower(label), '[:\\s]+', ' ', 'g'))"


def _field_sql(label):
    arms = []
    for field, words in D.LABEL_FIELDS:
        hit = contains_any(label, words)
        if field == "decision":
            hit += f" AND NOT contains({label}, 'date')"
        value = quote(field)
        if field == "applicant":
            value = f"CASE WHEN NOT contains({label}, 'agent') THEN 'applicant' END"
        arms.append(f"WHEN {hit} THEN {value}")
    for field, word in D.DATE_FIELDS:
        arms.append(f"WHEN contains({label}, 'date') AND contains({label}, '{word}') THEN {quote(field)}")
    return "CASE " + " ".join(arms) + " END"


@query("label_fields", f"""
    SELECT doc_id, n AS label, coalesce({_field_sql('n')}, '') AS field
    FROM (SELECT doc_id, {_LABEL} AS n FROM (SELECT doc_id, {pick('doc_id', LABEL_TEXTS)} AS label FROM documents) x) y""")
def label_fields(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr(pick("doc_id", LABEL_TEXTS)).alias("label"))
    return docs.withColumn("label", T.normalize_label(F.col("label"))).withColumn(
        "field", F.coalesce(pages.field_for_label(F.col("label")), F.lit("")))


@query("clean_texts", r"""
    SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS clean_md5,
           length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS char_count,
           len(regexp_extract_all(text, '\S+')) AS word_count, length(text) // 4 AS tokens,
           length(substr(text, 1, 1024)) AS seen_chars, sha256(text) AS file_hash
    FROM documents""")
def clean_texts(spark, sf):
    body = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(T.clean_text(body)).alias("clean_md5"), T.char_count(body).alias("char_count"),
        T.word_count(body).alias("word_count"), T.estimate_tokens(body).alias("tokens"),
        F.length(T.embedding_text(body, D.EMBEDDING_CHARS)).alias("seen_chars"), T.content_sha256(body).alias("file_hash"))


@query("chunk_ids", """
    SELECT doc_id, replace('25/0' || source || '/F', '/', '_') || '_' || substr(sha256(text), 1, 6)
                     || '_' || lpad(CAST(doc_id % 40 AS STRING), 3, '0') || '_'
                     || lpad(CAST(doc_id AS STRING), CAST(greatest(3, length(CAST(doc_id AS STRING))) AS INT), '0') AS chunk_id,
           replace('25/0' || source || '/F', '/', '_') || '_' || substr(sha256(text), 1, 6) AS document_id,
           'sha256:' || sha256(text) AS manifest_hash
    FROM documents""")
def chunk_ids(spark, sf):
    ref = F.concat(F.lit("25/0"), "source", F.lit("/F"))
    digest = T.content_sha256(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", T.chunk_id(ref, digest, F.col("doc_id") % 40, F.col("doc_id")).alias("chunk_id"),
        T.document_id(ref, digest).alias("document_id"), T.manifest_hash(F.col("text")).alias("manifest_hash"))


@query("resolve_links", f"""
    SELECT page_id, coalesce(u, '') AS resolved, coalesce(substr(md5(u), 1, 12), '') AS document_id
    FROM (SELECT page_id, CASE WHEN h = '' THEN NULL WHEN h LIKE 'http://%' OR h LIKE 'https://%' THEN h
             WHEN h LIKE '//%' THEN 'https:' || h
             WHEN h LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || h
             WHEN url LIKE '%/' THEN url || h ELSE regexp_replace(url, '/[^/]*$', '') || '/' || h END AS u
          FROM (SELECT page_id, url, {pick('page_id', HREFS)} AS h FROM pages) x) y""")
def resolve_links(spark, sf):
    links = table(spark, sf, "pages").select("page_id", "url", F.expr(pick("page_id", HREFS)).alias("h"))
    found = links.withColumn("u", T.resolve_url(F.col("h"), F.col("url")))
    return found.select("page_id", F.coalesce("u", F.lit("")).alias("resolved"),
                        F.coalesce(T.url_document_id(F.col("u")), F.lit("")).alias("document_id"))


@query("file_names_from_links", f"""
    SELECT page_id, CASE WHEN regexp_matches(u, '[?&]fileName=[^&#]') THEN url_decode(regexp_extract(u, '[?&]fileName=([^&#]*)', 1))
        ELSE url_decode(regexp_extract(regexp_replace(u, '[?#].*$', ''), '([^/]*)$', 1)) END AS file_name
    FROM (SELECT page_id, 'https://p.example/docs/' || page_id || CASE WHEN page_id % 3 = 0 THEN '/get?id=1&fileName=Plan%20' || page_id || '.pdf'
             WHEN page_id % 3 = 1 THEN '/plan%2D' || page_id || '.pdf' ELSE '/last.pdf?x=' || page_id END AS u FROM pages) x""")
def file_names_from_links(spark, sf):
    u = ("concat('https://p.example/docs/', page_id, CASE WHEN page_id % 3 = 0 THEN concat('/get?id=1&fileName=Plan%20', page_id, '.pdf') "
         "WHEN page_id % 3 = 1 THEN concat('/plan%2D', page_id, '.pdf') ELSE concat('/last.pdf?x=', page_id) END)")
    return table(spark, sf, "pages").select("page_id", T.file_name_from_url(F.expr(u)).alias("file_name"))


@query("number_downloads", with_clause("listed_documents") + r"""
    SELECT document_id, n AS download_no,
           lpad(CAST(n AS STRING), CAST(greatest(3, length(CAST(n AS STRING))) AS INT), '0') || '_' || substr(regexp_replace(
             coalesce(nullif(description, ''), 'document_' || n), '[^\p{L}\p{N}._\-]', '_', 'g'), 1, 100) || '.pdf' AS file_name
    FROM (SELECT *, row_number() OVER (PARTITION BY application_ref ORDER BY document_id) AS n FROM listed_documents) x""")
def number_downloads(spark, sf):
    docs = load(spark, sf, "listed_documents")
    return pages.number_downloads(docs, "application_ref", "document_id").select(
        "document_id", "download_no", "file_name")


@query("dedupe_names", with_clause("named_files") + r"""
    SELECT doc_id, CASE WHEN n = 1 THEN file_name ELSE regexp_replace(file_name, '\.[^.]+$', '') || '_' || (n - 1)
                        || regexp_extract(file_name, '(\.[^.]+)$', 1) END AS stored_name
    FROM (SELECT *, row_number() OVER (PARTITION BY application_ref, file_name ORDER BY doc_id) AS n FROM named_files) x""")
def dedupe_names(spark, sf):
    return pages.dedupe_names(load(spark, sf, "named_files"), "application_ref", "file_name", "doc_id").select(
        "doc_id", "stored_name")


# --- pages ------------------------------------------------------------------

@query("page_links", r"""
    SELECT page_id, count(*) AS links, count(*) FILTER (WHERE contains(lower(h), '.pdf') OR contains(lower(h), '/document/')
             OR contains(lower(h), '/viewdoc') OR contains(lower(h), 'docid=') OR contains(lower(h), 'fileid=')) AS document_links
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages) x GROUP BY page_id""")
def page_links(spark, sf):
    return pages.page_links(table(spark, sf, "pages")).groupBy("page_id").agg(
        F.count("*").alias("links"),
        F.count_if(T.contains_any(F.lower("href"), D.DOCUMENT_LINK_MARKERS)).alias("document_links"))


def built_pages(spark, sf):
    """Pages written out from the document list: a document link, another link and one to the next page."""
    docs = load(spark, sf, "listed_documents")
    return docs.select(
        F.col("document_id").alias("page_id"),
        F.concat(F.lit("https://p.example/list/"), "document_id").alias("url"),
        F.concat(
            F.lit("<p><A class='x' href='/Document/Download?id="), F.col("document_id").cast("string"), F.lit("'> <b>"),
            "description", F.lit("</b>\n</A> <a name='top'>no address</a><a href=/about>About</a><a title=\"a\" href=\"/list/"),
            (F.col("document_id") + 1).cast("string"), F.lit("\"><span>Next</span> &gt;</a></p>")).alias("html"))


@query("document_links", with_clause("listed_documents") + r"""
    SELECT document_id AS page_id, substr(md5('https://p.example/Document/Download?id=' || document_id), 1, 12) AS document_id,
           md5('https://p.example/Document/Download?id=' || document_id) AS url_key,
           coalesce(nullif(trim(regexp_replace(description, '\s+', ' ', 'g')), ''), 'Unknown Document') AS description
    FROM listed_documents WHERE description IS NOT NULL""")
def document_links(spark, sf):
    found = pages.document_links(pages.page_links(built_pages(spark, sf)))
    return found.select("page_id", "document_id", "url_key", "description")


@query("next_page_edges", with_clause("listed_documents") + """
    SELECT document_id AS page_id, 'https://p.example/list/' || document_id AS url,
           'https://p.example/list/' || (document_id + 1) AS next_url FROM listed_documents WHERE description IS NOT NULL""")
def next_page_edges(spark, sf):
    return pages.next_page_edges(pages.page_links(built_pages(spark, sf)))


@query("page_chains", """
    WITH RECURSIVE e AS (SELECT doc_id AS u, (doc_id // 7) * 7 + (doc_id + 1) % 7 AS v FROM documents WHERE doc_id % 7 <> 3 OR doc_id % 2 = 0),
    cut AS (SELECT e.u, e.v FROM e WHERE NOT (e.v % 7 = 0 AND (SELECT count(*) FROM e x WHERE x.u // 7 = e.u // 7) = 7)),
    heads AS (SELECT doc_id AS u FROM documents UNION SELECT v FROM e),
    walk AS (SELECT u AS h, u, 1 AS step FROM heads WHERE u NOT IN (SELECT v FROM cut)
             UNION ALL SELECT w.h, c.v, w.step + 1 FROM walk w JOIN cut c ON c.u = w.u)
    SELECT h AS first_url, u AS url, step FROM walk""")
def page_chains(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("u"))
    edges = ids.filter("u % 7 <> 3 or u % 2 = 0").selectExpr("u as url", "(u div 7) * 7 + (u + 1) % 7 as next_url")
    every = ids.unionByName(edges.selectExpr("next_url as u")).selectExpr("u as url")
    return pages.page_chains(every, edges)


# --- what was downloaded and ingested before --------------------------------

@query("manifest_diff", _decision_sql() + """
    SELECT coalesce(p.application_ref, s.application_ref) AS application_ref,
           coalesce(p.document_id, s.document_id) AS document_id,
           CASE WHEN p.document_id IS NULL THEN 'new' WHEN s.document_id IS NULL THEN 'removed' ELSE 'reused' END AS change
    FROM (SELECT d.source AS application_ref, l.doc_id AS document_id FROM labels l JOIN documents d ON l.doc_id = d.doc_id) p
    FULL OUTER JOIN (SELECT application_ref, document_id FROM decided WHERE allowed) s
      ON p.application_ref = s.application_ref AND p.document_id = s.document_id""")
def manifest_diff(spark, sf):
    return review_ops.diff_manifest(*_sides(spark, sf))


def _sides(spark, sf):
    docs = table(spark, sf, "documents")
    previous = table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("source").alias("application_ref"), F.col("doc_id").alias("document_id"))
    return previous, filters.filter_documents(load(spark, sf, "listed_documents")).filter("allowed")


@query("manifest_counts", _decision_sql() + """, p AS (
      SELECT d.source AS application_ref, l.doc_id AS document_id FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
    s AS (SELECT application_ref, document_id FROM decided WHERE allowed)
    SELECT application_ref, CAST(sum(r) AS BIGINT) AS documents_reused, CAST(sum(n) AS BIGINT) AS documents_new,
           CAST(sum(g) AS BIGINT) AS documents_removed
    FROM (SELECT coalesce(p.application_ref, s.application_ref) AS application_ref,
                 CASE WHEN p.document_id IS NOT NULL AND s.document_id IS NOT NULL THEN 1 ELSE 0 END AS r,
                 CASE WHEN p.document_id IS NULL THEN 1 ELSE 0 END AS n, CASE WHEN s.document_id IS NULL THEN 1 ELSE 0 END AS g
          FROM p FULL OUTER JOIN s ON p.application_ref = s.application_ref AND p.document_id = s.document_id) x
    GROUP BY application_ref""")
def manifest_counts(spark, sf):
    return review_ops.diff_counts(review_ops.diff_manifest(*_sides(spark, sf)))


@query("removed_documents", _decision_sql() + """
    SELECT doc_id AS document_id FROM labels EXCEPT SELECT document_id FROM decided WHERE allowed""")
def removed_documents(spark, sf):
    return review_ops.removed_documents(*_sides(spark, sf))


@query("not_ingested", """
    SELECT doc_id, substr(sha256(text), 1, 6) AS document_id, sha256(text) AS file_hash FROM documents
    WHERE sha256(text) NOT IN (SELECT sha256(d.text) FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""")
def not_ingested(spark, sf):
    docs = table(spark, sf, "documents").withColumn("file_hash", T.content_sha256(F.col("text")))
    files = docs.select("doc_id", F.substring("file_hash", 1, 6).alias("document_id"), "file_hash")
    known = files.join(table(spark, sf, "labels"), "doc_id", "left_semi")
    return corpus.not_yet_ingested(files, known)


@query("backfill", with_clause("listed_documents") + """
    SELECT b.item_id, coalesce(d.description, '(unknown document)') AS title, coalesce(d.application_ref, '') AS url
    FROM benchmark b LEFT JOIN listed_documents d ON d.document_id = b.item_id * 30""")
def backfill(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", (F.col("item_id") * 30).alias("document_id"))
    meta = load(spark, sf, "listed_documents").withColumn("url", F.col("application_ref"))
    return review_ops.backfill_key_documents(items, meta).select(
        "item_id", "title", F.coalesce("url", F.lit("")).alias("url"))
