"""Queries on review results, jobs, progress and requests."""

from pyspark.sql import functions as F

from hedgerow.functions import reviews as V
from hedgerow.operators import filters, jobs, reviews
from hedgerow.plans.catalog import query, quote
from hedgerow.plans.inputs import (
    BOOL_TEXTS, DOC_CATEGORIES, ERRORS, RATING_TEXTS, REPORTS, load, pick, table, with_clause,
)
from hedgerow.rules import reviews as R
from hedgerow.streaming import lifecycle

# --- columns ----------------------------------------------------------------


def _cat_sql(c):
    def has(words):
        return "(" + " OR ".join(f"contains(lower({c}), {quote(w)})" for w in words) + ")"

    arms = " ".join(f"WHEN {has(words)} THEN {quote(name)}" for name, words in R.CATEGORY_WORDS)
    return f"CASE WHEN {c} IN ('Transport & Access', 'Design & Layout', 'Application Core') THEN {c} {arms} ELSE 'Application Core' END"


@query("normalize_reviews", f"""
    SELECT doc_id, CASE WHEN lower(trim(r)) IN ('red', 'amber', 'green') THEN lower(trim(r)) ELSE 'invalid' END AS rating,
           CASE WHEN b IS NULL OR lower(b) IN ('false', 'no', '0') THEN 'false' WHEN lower(b) IN ('true', 'yes', '1') THEN 'true' ELSE 'invalid' END AS compliant,
           {_cat_sql('c')} AS category,
           CASE WHEN contains(e, 'Scraper error') THEN 'scraper_error' WHEN contains(lower(e), 'cancelled') THEN 'review_cancelled'
                WHEN contains(e, 'No documents') THEN 'ingestion_failed' ELSE 'review_failed' END AS code,
           CASE WHEN contains(lower(m), 'overall rating:** red') OR contains(lower(m), 'overall rating:** 🔴') THEN 'red'
                WHEN contains(lower(m), 'overall rating:** green') OR contains(lower(m), 'overall rating:** 🟢') THEN 'green' ELSE 'amber' END AS fallback
    FROM (SELECT doc_id, {pick('doc_id', RATING_TEXTS)} AS r, {pick('doc_id', BOOL_TEXTS)} AS b, {pick('doc_id', DOC_CATEGORIES)} AS c,
                 {pick('doc_id', ERRORS)} AS e, {pick('doc_id', [m.replace(chr(10), ' ') for m in REPORTS])} AS m FROM documents) x""")
def normalize_reviews(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", *[
        F.expr(pick("doc_id", w)).alias(n) for n, w in (
            ("r", RATING_TEXTS), ("b", BOOL_TEXTS), ("c", DOC_CATEGORIES), ("e", ERRORS),
            ("m", [m.replace("\n", " ") for m in REPORTS]))])
    return words.select(
        "doc_id", F.coalesce(V.normalize_rating(F.col("r")), F.lit("invalid")).alias("rating"),
        F.coalesce(V.coerce_bool(F.col("b")).cast("string"), F.lit("invalid")).alias("compliant"),
        V.coerce_category(F.col("c")).alias("category"), V.error_code(F.col("e")).alias("code"),
        V.fallback_rating(F.col("m")).alias("fallback"))


# each document yields a review: its rating and its flag vary, some lack aspects, some are fenced
def _review_json(cat):
    rating, flag = pick("doc_id", [r for r in RATING_TEXTS if r is not None]), pick("doc_id", [b for b in BOOL_TEXTS if b])
    parts = [
        "CASE WHEN doc_id % 4 = 1 THEN '```json' || {nl} ELSE '' END", "'{{\"overall_rating\": \"'", rating,
        "'\", \"summary\": \"s\", \"aspects\": ['",
        "CASE WHEN doc_id % 7 = 0 THEN '' ELSE '{{\"name\": \"n\", \"rating\": \"Amber\", \"key_issue\": \"k\", \"analysis\": \"a\"}}' END",
        "'], \"policy_compliance\": [{{\"requirement\": \"q\", \"policy_source\": \"p\", \"compliant\": \"'", flag,
        "'\", \"notes\": null}}], \"recommendations\": [], \"suggested_conditions\": [\"c\"], \"key_documents\": [{{\"document_id\": \"d\", \"category\": \"'",
        pick("doc_id", DOC_CATEGORIES), "'\", \"summary\": \"s\"}}]}}'",
        "CASE WHEN doc_id % 4 = 1 THEN {nl} || '```' ELSE '' END", "CASE WHEN doc_id % 11 = 5 THEN ' oops }}' ELSE '' END",
    ]
    return " || ".join(parts).replace("{{", "{").replace("}}", "}").replace("{nl}", cat)


_BODY = _review_json("chr(10)")


@query("parse_reviews", f"""
    SELECT doc_id, valid, CASE WHEN valid THEN rating ELSE '' END AS overall_rating,
           CASE WHEN valid THEN 1 ELSE 0 END AS aspects, CASE WHEN valid AND flag IN ('true', 'yes', '1') THEN 1 ELSE 0 END AS compliant
    FROM (SELECT doc_id, lower(trim({pick('doc_id', [r for r in RATING_TEXTS if r is not None])})) AS rating,
                 lower({pick('doc_id', [b for b in BOOL_TEXTS if b])}) AS flag,
                 doc_id % 7 <> 0 AND lower(trim({pick('doc_id', [r for r in RATING_TEXTS if r is not None])})) IN ('red', 'amber', 'green')
                   AND lower({pick('doc_id', [b for b in BOOL_TEXTS if b])}) IN ('true', 'yes', '1', 'no', 'false', '0')
                   AND doc_id % 11 <> 5 AS valid FROM documents) x""")
def parse_reviews(spark, sf):
    bodies = table(spark, sf, "documents").select("doc_id", F.expr(_BODY).alias("body"))
    found = reviews.parse_reviews(bodies)
    true_flags = F.size(F.filter(F.coalesce("policy_compliance", F.array()), lambda c: c["compliant"]))
    return found.select(
        "doc_id", "valid", F.coalesce("overall_rating", F.lit("")).alias("overall_rating"),
        F.size(F.coalesce("aspects", F.array())).alias("aspects"), true_flags.alias("compliant"))


# --- evidence and verification ----------------------------------------------

@query("assemble_evidence", with_clause("evidence_hits") + """, capped AS (
      SELECT *, row_number() OVER (PARTITION BY review_id, kind ORDER BY ord, origin, text) AS rn FROM evidence_hits),
    shown AS (SELECT * FROM capped)
    SELECT review_id, 0 AS left_out,
      md5(coalesce(string_agg('[' || origin || '] ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rn)
            FILTER (WHERE kind = 'application'), 'No application document content retrieved.')) AS application_md5,
      md5(coalesce(string_agg('[' || origin || '] ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rn)
            FILTER (WHERE kind = 'policy'), 'No policy content retrieved.')) AS policy_md5
    FROM shown GROUP BY review_id""")
def assemble_evidence(spark, sf):
    found = reviews.assemble_evidence(load(spark, sf, "evidence_hits"))
    return found.select("review_id", F.md5("application_evidence").alias("application_md5"),
                        F.md5("policy_evidence").alias("policy_md5"), "left_out")


@query("evidence_union", """
    SELECT c_custkey AS review_id, 'application' AS kind, c_custkey AS ord, c_name AS origin, c_mktsegment AS text FROM customer
    UNION ALL SELECT s_suppkey, 'policy', s_suppkey, s_name, 'supplier' FROM supplier""")
def evidence_union(spark, sf):
    first = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("review_id"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("source_file"),
        F.col("c_mktsegment").alias("text"))
    second = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("review_id"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("source"),
        F.lit("supplier").alias("text"))
    return reviews.evidence_union(first, second)


@query("verification_rollup", with_clause("claims") + """
    SELECT review_id, v AS verified_claims, n AS total_claims, n - v AS unverified_claims,
           CASE WHEN n = v THEN 'verified' WHEN v > 0 THEN 'partial' ELSE 'failed' END AS status
    FROM (SELECT o.o_orderkey AS review_id, count(*) FILTER (WHERE c.verified) AS v, count(c.review_id) AS n
          FROM orders o LEFT JOIN claims c ON c.review_id = o.o_orderkey GROUP BY o.o_orderkey) x""")
def verification_rollup(spark, sf):
    every = table(spark, sf, "orders").select(F.col("o_orderkey").alias("review_id"))
    return reviews.verification_rollup(load(spark, sf, "claims"), every)


# --- jobs -------------------------------------------------------------------

@query("job_listing", with_clause("review_jobs") + """
    SELECT review_id, application_ref, status, strftime(created_at, '%Y-%m-%d') AS created_on
    FROM review_jobs ORDER BY created_at DESC, review_id DESC LIMIT 20 OFFSET 40""")
def job_listing(spark, sf):
    return jobs.list_jobs(load(spark, sf, "review_jobs"), offset=40).select(
        "review_id", "application_ref", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"))


@query("job_listing_by_status", with_clause("review_jobs") + """
    SELECT review_id, application_ref FROM review_jobs WHERE status = 'completed' ORDER BY created_at DESC, review_id DESC LIMIT 20""")
def job_listing_by_status(spark, sf):
    return jobs.list_jobs(load(spark, sf, "review_jobs"), status="completed").select("review_id", "application_ref")


@query("job_counts", with_clause("review_jobs") + "SELECT count(*) AS total FROM review_jobs WHERE status = 'queued'")
def job_counts(spark, sf):
    return jobs.count_jobs(load(spark, sf, "review_jobs"), status="queued")


@query("latest_completed", with_clause("review_jobs") + """
    SELECT application_ref, review_id, strftime(completed_at, '%Y-%m-%d') AS completed_on FROM (
      SELECT *, row_number() OVER (PARTITION BY application_ref ORDER BY completed_at DESC, review_id DESC) AS rn
      FROM review_jobs WHERE status = 'completed') x WHERE rn = 1""")
def latest_completed(spark, sf):
    return jobs.latest_completed(load(spark, sf, "review_jobs")).select(
        "application_ref", "review_id", F.date_format("completed_at", "yyyy-MM-dd").alias("completed_on"))


@query("active_jobs", with_clause("review_jobs") + """
    SELECT application_ref, bool_or(status IN ('queued', 'processing')) AS has_active,
           coalesce(arg_max(review_id, (created_at, review_id)) FILTER (WHERE status IN ('queued', 'processing')), -1) AS active_review_id
    FROM review_jobs GROUP BY application_ref""")
def active_jobs(spark, sf):
    return jobs.active_jobs(load(spark, sf, "review_jobs")).withColumn(
        "active_review_id", F.coalesce("active_review_id", F.lit(-1)))


@query("retain_unexpired", """
    SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL '30' DAY > TIMESTAMP '1998-01-15 00:00:00'""")
def retain_unexpired(spark, sf):
    kept = filters.retain_unexpired(
        table(spark, sf, "orders"), F.lit("1998-01-15 00:00:00").cast("timestamp"), "o_orderdate", R.RESULT_TTL_DAYS)
    return kept.select("o_orderkey")


# --- progress ---------------------------------------------------------------

_WEIGHT = "CASE {} " + " ".join(f"WHEN '{p}' THEN {w}" for p, w in R.PHASE_WEIGHTS.items()) + " ELSE 0 END"


@query("progress_percent", with_clause("phase_events") + f""", firsts AS (
      SELECT review_id, phase, min((ts, event_id)) AS at FROM phase_events WHERE event = 'complete' GROUP BY review_id, phase)
    SELECT e.event_id, CAST(least(99, coalesce(sum({_WEIGHT.format('f.phase')}), 0) + CASE WHEN e.event = 'progress'
             THEN floor({_WEIGHT.format('e.phase')} * (e.sub_current / 7e0)) ELSE 0 END) AS INT) AS percent_complete
    FROM phase_events e LEFT JOIN firsts f ON f.review_id = e.review_id AND f.at <= (e.ts, e.event_id)
    GROUP BY e.event_id, e.event, e.phase, e.sub_current""")
def progress_percent(spark, sf):
    return jobs.progress_percent(load(spark, sf, "phase_events")).select("event_id", "percent_complete")


@query("review_progress", with_clause("phase_events") + f""", last AS (
      SELECT review_id, arg_max(phase, (ts, event_id)) AS phase, arg_max(sub_current, (ts, event_id)) AS cur
      FROM phase_events WHERE event IN ('start', 'progress') GROUP BY review_id),
    done AS (SELECT review_id, sum({_WEIGHT.format('phase')}) AS w, list(phase) AS phases
             FROM (SELECT DISTINCT review_id, phase FROM phase_events WHERE event = 'complete') x GROUP BY review_id),
    r AS (SELECT review_id, count(*) FILTER (WHERE event = 'error') AS error_count FROM phase_events GROUP BY review_id)
    SELECT r.review_id, coalesce(l.phase, '') AS phase, r.error_count,
           CAST(least(99, coalesce(d.w, 0) + CASE WHEN l.phase IS NULL OR coalesce(list_contains(d.phases, l.phase), false) THEN 0
                ELSE floor({_WEIGHT.format('l.phase')} * (l.cur / 7e0)) END) AS INT) AS percent_complete
    FROM r LEFT JOIN last l ON l.review_id = r.review_id LEFT JOIN done d ON d.review_id = r.review_id""")
def review_progress(spark, sf):
    return jobs.review_progress(load(spark, sf, "phase_events")).withColumn("phase", F.coalesce("phase", F.lit("")))


_PHASES = with_clause("phase_events") + """, phases AS (
    SELECT review_id, phase, min(ts) FILTER (WHERE event = 'start') AS s, max(ts) FILTER (WHERE event = 'complete') AS c,
           count(*) FILTER (WHERE event = 'error') AS error_count FROM phase_events GROUP BY review_id, phase)
    """


@query("phase_durations", _PHASES + """
    SELECT review_id, phase, error_count, coalesce(round((epoch_us(c) - epoch_us(s)) / 1e6, 3), -1) AS duration_seconds FROM phases""")
def phase_durations(spark, sf):
    return jobs.phase_durations(load(spark, sf, "phase_events")).select(
        "review_id", "phase", "error_count", F.coalesce(F.round("duration_seconds", 3), F.lit(-1.0)).alias("duration_seconds"))


@query("review_durations", _PHASES + """
    SELECT review_id, count(c) AS phases_completed, CAST(sum(error_count) AS BIGINT) AS error_count,
           coalesce(round((epoch_us(max(c)) - epoch_us(min(s))) / 1e6, 3), -1) AS total_duration_seconds
    FROM phases GROUP BY review_id""")
def review_durations(spark, sf):
    found = jobs.review_durations(jobs.phase_durations(load(spark, sf, "phase_events")))
    return found.withColumn("total_duration_seconds", F.coalesce(F.round("total_duration_seconds", 3), F.lit(-1.0)))


_LIFE = """SELECT o_custkey AS application_ref, o_orderkey AS review_id, 'queued' AS event, o_orderkey * 3 AS event_id,
             CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey % 5 = 0 AS force FROM {orders}
           UNION ALL SELECT o_custkey, o_orderkey, 'processing', o_orderkey * 3 + 1, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY, false FROM {orders}
           UNION ALL SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'failed' END, o_orderkey * 3 + 2,
             CAST(o_orderdate AS TIMESTAMP) + INTERVAL '90' DAY, false FROM {orders} WHERE o_orderstatus <> 'O'"""


def job_events(spark, sf):
    return spark.sql(_LIFE, orders=table(spark, sf, "orders"))


@query("job_lifecycle", "WITH e AS (" + _LIFE.format(orders="orders") + """)
    SELECT review_id, arg_max(application_ref, (ts, event_id)) AS application_ref, arg_max(event, (ts, event_id)) AS status,
           strftime(min(ts), '%Y-%m-%d') AS created_on, strftime(min(ts) FILTER (WHERE event = 'processing'), '%Y-%m-%d') AS started_on,
           coalesce(strftime(max(ts) FILTER (WHERE event IN ('completed', 'failed', 'cancelled')), '%Y-%m-%d'), '') AS completed_on
    FROM e GROUP BY review_id""")
def job_lifecycle(spark, sf):
    def day(c):
        return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))

    return jobs.job_lifecycle(job_events(spark, sf)).select(
        "review_id", "application_ref", "status", day("created_at").alias("created_on"),
        day("started_at").alias("started_on"), day("completed_at").alias("completed_on"))


@query("job_admission")
def job_admission(spark, sf):
    return lifecycle.lifecycle_batch(job_events(spark, sf))


# --- requests ---------------------------------------------------------------

# three requests in six hours; refused ones occupy no place, so the log is walked recursively
@query("admit_requests", "WITH RECURSIVE " + with_clause("requests")[5:].rstrip() + """,
    num AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, request_id) AS n FROM requests),
    walk AS (
      SELECT key, request_id, n, ts, true AS admitted, [ts] AS log FROM num WHERE n = 1
      UNION ALL
      SELECT x.key, x.request_id, x.n, x.ts, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, x.ts) ELSE live END
      FROM (SELECT m.key, m.request_id, m.n, m.ts, list_filter(w.log, lambda t: t > m.ts - INTERVAL '6' HOUR) AS live
            FROM walk w JOIN num m ON m.key = w.key AND m.n = w.n + 1) x)
    SELECT key, request_id, admitted, CASE WHEN admitted THEN 3 - len(log) ELSE 0 END AS remaining,
           CASE WHEN admitted THEN -1 ELSE (epoch_us(log[1]) + 21600000000 - epoch_us(ts)) // 1000000 + 1 END AS retry_after
    FROM walk""")
def admit_requests(spark, sf):
    found = jobs.admit_requests(load(spark, sf, "requests"), limit=3, window_s=6 * 3600)
    return found.withColumn("retry_after", F.coalesce("retry_after", F.lit(-1)))


@query("count_requests", with_clause("requests") + """
    SELECT key, count(*) AS requests, strftime(make_timestamp(epoch_us(ts) - epoch_us(ts) % 21600000000), '%Y-%m-%d %H:%M:%S') AS start
    FROM requests GROUP BY ALL""")
def count_requests(spark, sf):
    return jobs.count_requests(load(spark, sf, "requests"), "6 hours", "6 hours").select(
        "key", "requests", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))
