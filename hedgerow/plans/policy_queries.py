"""Queries on policies and the revisions in force."""

from pyspark.sql import functions as F

from hedgerow.functions import dates
from hedgerow.functions import text as T
from hedgerow.operators import policies, registry
from hedgerow.plans.catalog import query
from hedgerow.plans.inputs import load, table, with_clause

_IN_FORCE = "r.effective_from <= p.on_date AND (r.effective_to IS NULL OR r.effective_to >= p.on_date)"
_DAYS_RESOLVED = f""", days AS (SELECT DISTINCT source, on_date FROM probes),
    hits AS (SELECT source, on_date, revision_id FROM (
      SELECT p.source, p.on_date, r.revision_id,
             row_number() OVER (PARTITION BY p.source, p.on_date ORDER BY r.effective_from DESC, r.revision_id DESC) AS rn
      FROM days p JOIN policy_revisions r ON r.source = p.source AND {_IN_FORCE}
      WHERE r.status IN ('active', 'superseded')) x WHERE rn = 1),
    firsts AS (SELECT source, min(effective_from) AS first_start FROM policy_revisions GROUP BY source),
    resolved AS (SELECT d.source, d.on_date, coalesce(h.revision_id, -1) AS revision_id,
      CASE WHEN h.revision_id IS NOT NULL THEN 'in_force' WHEN f.first_start IS NULL THEN 'no_revisions'
           WHEN d.on_date < f.first_start THEN 'date_before_first_revision' ELSE 'date_in_gap' END AS reason
      FROM days d LEFT JOIN hits h ON h.source = d.source AND h.on_date = d.on_date LEFT JOIN firsts f ON f.source = d.source)
    """


def _shown(df):
    return df.withColumn("revision_id", F.coalesce("revision_id", F.lit(-1))).withColumn(
        "reason", F.coalesce("reason", F.lit("in_force"))).withColumn("on_date", F.col("on_date").cast("string"))


@query("asof_revision", with_clause("probes", "policy_revisions") + _DAYS_RESOLVED + """
    SELECT p.l_orderkey, p.l_linenumber, p.l_partkey, p.l_suppkey, strftime(p.on_date, '%Y-%m-%d') AS on_date,
           r.revision_id, r.reason
    FROM probes p JOIN resolved r ON r.source = p.source AND r.on_date = p.on_date""")
def asof_revision(spark, sf):
    found = policies.effective_revision(load(spark, sf, "probes"), load(spark, sf, "policy_revisions"))
    return _shown(found).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "on_date", "revision_id", "reason")


@query("no_revision_reason", with_clause("probes", "policy_revisions") + _DAYS_RESOLVED + """
    SELECT r.reason, count(*) AS probes FROM probes p
    JOIN resolved r ON r.source = p.source AND r.on_date = p.on_date GROUP BY r.reason""")
def no_revision_reason(spark, sf):
    found = policies.effective_revision(load(spark, sf, "probes"), load(spark, sf, "policy_revisions"))
    return _shown(found).groupBy("reason").agg(F.count("*").alias("probes"))


@query("revision_ids_for_date", with_clause("probes", "policy_revisions") + _DAYS_RESOLVED + """
    SELECT source, strftime(on_date, '%Y-%m-%d') AS on_date, revision_id FROM resolved""")
def revision_ids_for_date(spark, sf):
    found = policies.revision_ids_for_date(load(spark, sf, "probes"), load(spark, sf, "policy_revisions"))
    return found.select("source", F.col("on_date").cast("string").alias("on_date"),
                        F.coalesce("revision_id", F.lit(-1)).alias("revision_id"))


@query("revision_reigns", with_clause("open_revisions") + """, live AS (
      SELECT * FROM open_revisions WHERE status IN ('active', 'superseded')),
    cuts AS (SELECT source, effective_from AS d FROM live
             UNION SELECT source, CAST(effective_to + INTERVAL '1' DAY AS DATE) FROM live WHERE effective_to IS NOT NULL),
    won AS (SELECT c.source, c.d, arg_max(r.revision_id, (r.effective_from, r.revision_id)) AS revision_id
            FROM cuts c LEFT JOIN live r ON r.source = c.source AND r.effective_from <= c.d
                 AND (r.effective_to IS NULL OR r.effective_to >= c.d) GROUP BY c.source, c.d),
    changed AS (SELECT * FROM (SELECT *, lag(revision_id) OVER (PARTITION BY source ORDER BY d) AS before FROM won) x
                WHERE before IS NULL OR revision_id IS NULL OR before <> revision_id),
    runs AS (SELECT *, lead(d) OVER (PARTITION BY source ORDER BY d) AS next FROM changed)
    SELECT source, revision_id, strftime(d, '%Y-%m-%d') AS first_day,
           coalesce(strftime(CAST(next - INTERVAL '1' DAY AS DATE), '%Y-%m-%d'), '') AS last_day
    FROM runs WHERE revision_id IS NOT NULL""")
def revision_reigns(spark, sf):
    runs = policies.reigns(load(spark, sf, "open_revisions"))
    return runs.select("source", "revision_id", F.date_from_unix_date("lo").cast("string").alias("first_day"),
                       F.coalesce(F.date_from_unix_date("hi").cast("string"), F.lit("")).alias("last_day"))


_SNAPSHOT = with_clause("policies", "snapshot_dates", "policy_revisions") + f""", probes AS (
      SELECT p.source, p.title, p.category, d.on_date FROM policies p CROSS JOIN snapshot_dates d)""" + _DAYS_RESOLVED


@query("policy_snapshot", _SNAPSHOT + """
    SELECT p.source, p.category, strftime(p.on_date, '%Y-%m-%d') AS on_date, r.revision_id, r.reason
    FROM probes p JOIN resolved r ON r.source = p.source AND r.on_date = p.on_date""")
def policy_snapshot(spark, sf):
    found = policies.policy_snapshot(
        load(spark, sf, "policies"), load(spark, sf, "snapshot_dates"), load(spark, sf, "policy_revisions"))
    return _shown(found).select("source", "category", "on_date", "revision_id", "reason")


@query("snapshot_counts", _SNAPSHOT + """
    SELECT strftime(p.on_date, '%Y-%m-%d') AS on_date, count(*) FILTER (WHERE r.reason = 'in_force') AS policies_with_revision,
           count(*) FILTER (WHERE r.reason = 'date_before_first_revision') AS policies_not_yet_effective,
           count(*) FILTER (WHERE r.reason = 'date_in_gap') AS policies_in_gap, count(*) AS policies
    FROM probes p JOIN resolved r ON r.source = p.source AND r.on_date = p.on_date GROUP BY p.on_date""")
def snapshot_counts(spark, sf):
    found = policies.policy_snapshot(
        load(spark, sf, "policies"), load(spark, sf, "snapshot_dates"), load(spark, sf, "policy_revisions"))
    return policies.snapshot_counts(found).withColumn("on_date", F.col("on_date").cast("string"))


_CLAIMS = """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, o.o_custkey AS source, o.o_orderkey AS revision_id,
               CAST(l.l_shipdate AS DATE) AS on_date FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey"""


@query("validate_revision", with_clause("policy_revisions") + ", claims AS (" + _CLAIMS.format(lineitem="lineitem", orders="orders") + """)
    SELECT p.l_orderkey, p.l_linenumber, p.l_partkey, p.l_suppkey,
           coalesce(r.effective_from <= p.on_date AND (r.effective_to IS NULL OR r.effective_to >= p.on_date), false) AS valid
    FROM claims p LEFT JOIN policy_revisions r ON r.source = p.source AND r.revision_id = p.revision_id""")
def validate_revision(spark, sf):
    claims = spark.sql(_CLAIMS, lineitem=table(spark, sf, "lineitem"), orders=table(spark, sf, "orders"))
    return policies.validate_revision_for_date(claims, load(spark, sf, "policy_revisions")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "valid")


@query("auto_supersede", with_clause("open_revisions") + """, starts AS (
      SELECT source, effective_from, lead(effective_from) OVER (PARTITION BY source ORDER BY effective_from) AS next_from
      FROM (SELECT DISTINCT source, effective_from FROM open_revisions WHERE status <> 'failed') x)
    SELECT r.source, r.revision_id,
           coalesce(strftime(CASE WHEN r.effective_to IS NULL AND r.status <> 'failed' AND s.next_from IS NOT NULL
                         THEN CAST(s.next_from - INTERVAL '1' DAY AS DATE) ELSE r.effective_to END, '%Y-%m-%d'), '') AS effective_to,
           r.effective_to IS NULL AND r.status <> 'failed' AND s.next_from IS NOT NULL AS superseded
    FROM open_revisions r LEFT JOIN starts s ON s.source = r.source AND s.effective_from = r.effective_from""")
def auto_supersede(spark, sf):
    return policies.auto_supersede(load(spark, sf, "open_revisions")).select(
        "source", "revision_id", F.coalesce(F.col("effective_to").cast("string"), F.lit("")).alias("effective_to"), "superseded")


@query("superseded_by", with_clause("policy_revisions") + """
    SELECT r.source, r.revision_id, coalesce(max(n.revision_id), -1) AS superseded_by
    FROM policy_revisions r LEFT JOIN policy_revisions n ON n.source = r.source AND n.status <> 'failed'
         AND CAST(n.effective_from - INTERVAL '1' DAY AS DATE) = r.effective_to
    GROUP BY r.source, r.revision_id""")
def superseded_by(spark, sf):
    return policies.superseded_by(load(spark, sf, "policy_revisions")).select(
        "source", "revision_id", F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"))


@query("revision_overlaps", with_clause("open_revisions") + """
    SELECT DISTINCT n.source, n.revision_id FROM open_revisions n JOIN open_revisions e
      ON e.source = n.source AND n.status <> 'failed' AND e.status <> 'failed'
     AND (e.effective_from, e.revision_id) < (n.effective_from, n.revision_id)
     AND coalesce(e.effective_to, DATE '9999-12-31') >= n.effective_from""")
def revision_overlaps(spark, sf):
    return policies.revision_overlaps(load(spark, sf, "open_revisions")).select("source", "revision_id")


@query("check_new_revisions", with_clause("new_revisions", "open_revisions") + """, pairs AS (
      SELECT n.source, n.revision_id, n.effective_from AS nf, e.revision_id AS eid, e.effective_from AS ef, e.effective_to AS et,
             CASE WHEN e.effective_to IS NULL
                  THEN e.effective_from <= coalesce(n.effective_to, DATE '9999-12-31') AND n.effective_from <= e.effective_from
                  ELSE n.effective_from <= e.effective_to AND coalesce(n.effective_to, DATE '9999-12-31') >= e.effective_from END AS clash
      FROM new_revisions n JOIN open_revisions e ON e.source = n.source AND e.status <> 'failed'),
    agg AS (SELECT source, revision_id, arg_min(eid, (ef, eid)) FILTER (WHERE clash) AS hit,
                   arg_max(eid, (ef, eid)) FILTER (WHERE et IS NULL AND ef < nf) AS before
            FROM pairs GROUP BY source, revision_id)
    SELECT n.source, n.revision_id, coalesce(a.hit, -1) AS conflict_with,
           coalesce(CASE WHEN a.hit IS NULL THEN a.before END, -1) AS supersedes,
           CASE WHEN a.hit IS NULL AND a.before IS NOT NULL
                THEN strftime(CAST(n.effective_from - INTERVAL '1' DAY AS DATE), '%Y-%m-%d') ELSE '' END AS supersedes_until
    FROM new_revisions n LEFT JOIN agg a ON a.source = n.source AND a.revision_id = n.revision_id""")
def check_new_revisions(spark, sf):
    found = policies.check_new_revisions(load(spark, sf, "new_revisions"), load(spark, sf, "open_revisions"))
    return found.select(
        "source", "revision_id", F.coalesce("conflict_with", F.lit(-1)).alias("conflict_with"),
        F.coalesce("supersedes", F.lit(-1)).alias("supersedes"),
        F.coalesce(F.col("supersedes_until").cast("string"), F.lit("")).alias("supersedes_until"))


@query("superseded_revisions", with_clause("new_revisions", "open_revisions") + """, pairs AS (
      SELECT n.source, n.revision_id, n.effective_from AS nf, e.revision_id AS eid, e.effective_from AS ef, e.effective_to AS et,
             n.effective_from <= coalesce(e.effective_to, CASE WHEN e.effective_from >= n.effective_from THEN DATE '9999-12-31' ELSE DATE '0001-01-01' END)
               AND coalesce(n.effective_to, DATE '9999-12-31') >= e.effective_from AS clash
      FROM new_revisions n JOIN open_revisions e ON e.source = n.source AND e.status <> 'failed'),
    refused AS (SELECT DISTINCT source, revision_id FROM pairs WHERE clash)
    SELECT p.source, p.revision_id, p.eid AS ended, strftime(CAST(p.nf - INTERVAL '1' DAY AS DATE), '%Y-%m-%d') AS ended_on
    FROM pairs p LEFT JOIN refused r ON r.source = p.source AND r.revision_id = p.revision_id
    WHERE r.revision_id IS NULL AND p.et IS NULL AND p.ef < p.nf""")
def superseded_revisions(spark, sf):
    found = policies.superseded_revisions(load(spark, sf, "new_revisions"), load(spark, sf, "open_revisions"))
    return found.select("source", "revision_id", "ended", F.col("ended_on").cast("string").alias("ended_on"))


@query("policy_overview", with_clause("policies", "policy_revisions") + """
    SELECT p.source, p.category, coalesce(c.n, 0) AS revision_count, coalesce(c.now, -1) AS current_revision
    FROM policies p LEFT JOIN (
      SELECT source, count(*) AS n, arg_min(revision_id, (effective_from, revision_id)) FILTER (
             WHERE status = 'active' AND effective_from <= DATE '1998-01-01'
               AND (effective_to IS NULL OR effective_to >= DATE '1998-01-01')) AS now
      FROM policy_revisions GROUP BY source) c ON c.source = p.source""")
def policy_overview(spark, sf):
    today = F.lit("1998-01-01").cast("date")
    return policies.policy_overview(load(spark, sf, "policies"), load(spark, sf, "policy_revisions"), today).select(
        "source", "category", "revision_count", F.coalesce("current_revision", F.lit(-1)).alias("current_revision"))


@query("policy_listing", with_clause("policies") + """
    SELECT source, title FROM policies WHERE category = 'BUILDING'""")
def policy_listing(spark, sf):
    return policies.list_policies(load(spark, sf, "policies"), category="BUILDING").select("source", "title")


@query("list_revisions", with_clause("policy_revisions") + """
    SELECT source, revision_id, strftime(effective_from, '%Y-%m-%d') AS effective_from, status FROM policy_revisions""")
def list_revisions(spark, sf):
    return policies.list_revisions(load(spark, sf, "policy_revisions")).select(
        "source", "revision_id", F.col("effective_from").cast("string").alias("effective_from"), "status")


@query("can_delete_revision", with_clause("policy_revisions") + """
    SELECT source, revision_id, NOT (status = 'active' AND
           count(*) FILTER (WHERE status = 'active') OVER (PARTITION BY source) <= 1) AS can_delete
    FROM policy_revisions""")
def can_delete_revision(spark, sf):
    return policies.can_delete_revision(load(spark, sf, "policy_revisions")).select("source", "revision_id", "can_delete")


@query("validate_revisions", """
    SELECT o_orderkey, concat_ws(',', CASE WHEN NOT regexp_matches(s, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$') THEN 'bad_source' END,
           CASE WHEN t < f THEN 'bad_range' END) AS violations,
           regexp_matches(o_orderkey % 100 || '/' || o_custkey || '/F', '^\\d{2}/\\d{4,5}/[A-Z]{1,4}$') AS valid_ref
    FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Bad' ELSE 'LTN_' || o_custkey END AS s,
                 CAST(o_orderdate AS DATE) AS f, DATE '1997-06-01' AS t FROM orders) x""".replace("\\\\", "\\"))
def validate_revisions(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'Bad' ELSE concat('LTN_', o_custkey) END").alias("source"),
        F.col("o_orderdate").cast("date").alias("effective_from"), F.lit("1997-06-01").cast("date").alias("effective_to"),
        F.expr("concat(o_orderkey % 100, '/', o_custkey, '/F')").alias("application_ref"))
    return policies.validate_references(policies.validate_revisions(rows)).select(
        "o_orderkey", F.array_join("violations", ",").alias("violations"), "valid_ref")


@query("in_force_chunks", with_clause("policy_revisions") + """
    SELECT source, revision_id, CAST(strftime(effective_from, '%Y%m%d') AS INT) AS effective_from,
           coalesce(CAST(strftime(effective_to, '%Y%m%d') AS INT), 99991231) AS effective_to
    FROM policy_revisions WHERE effective_from <= DATE '1997-01-01' AND (effective_to IS NULL OR effective_to >= DATE '1997-01-01')""")
def in_force_chunks(spark, sf):
    chunks = load(spark, sf, "policy_revisions").select(
        "source", "revision_id", dates.date_to_int(F.col("effective_from")).alias("effective_from"),
        dates.date_to_int(F.col("effective_to")).alias("effective_to"))
    return policies.in_force_chunks(chunks, F.lit("1997-01-01").cast("date"))


@query("policy_chunk_ids", """
    SELECT o_orderkey, 'P' || o_custkey || '__rev_P' || o_custkey || strftime(o_orderdate, '_%Y_%m') || '__'
             || CASE WHEN o_orderkey % 2 = 0 THEN 'doc' ELSE 'Table_5-2' END || '__'
             || lpad(CAST(o_orderkey % 1200 AS STRING), CAST(greatest(3, length(CAST(o_orderkey % 1200 AS STRING))) AS INT), '0') AS chunk_id,
           strftime(o_orderdate, '%Y-%m-%d') AS round_trip
    FROM orders""")
def policy_chunk_ids(spark, sf):
    source = F.concat(F.lit("P"), F.col("o_custkey").cast("string"))
    section = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("Table 5-2")
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey", T.policy_chunk_id(source, T.revision_id(source, day), section, F.col("o_orderkey") % 1200).alias("chunk_id"),
        dates.int_to_date(dates.date_to_int(day)).cast("string").alias("round_trip"))


# --- registry changes -------------------------------------------------------

_CHANGES = """SELECT c_custkey AS source, CASE WHEN c_custkey % 3 = 0 THEN 'create' WHEN c_custkey % 3 = 1 THEN 'update' ELSE 'delete' END AS op,
                CASE WHEN c_custkey % 2 = 0 THEN c_name || ' new' END AS title, CAST(NULL AS STRING) AS category FROM {customer}
              UNION ALL SELECT -1 - n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'create' ELSE 'update' END, n_name, 'added' FROM {nation}"""
_CHANGES_SQL = with_clause("policies") + ", changes AS (" + _CHANGES.format(customer="customer", nation="nation") + ")"


def _changed(spark, sf):
    changes = spark.sql(_CHANGES, customer=table(spark, sf, "customer"), nation=table(spark, sf, "nation"))
    return registry.apply_changes(load(spark, sf, "policies"), changes)


@query("apply_policy_changes", _CHANGES_SQL + """
    SELECT p.source, coalesce(CASE WHEN c.op = 'update' THEN c.title END, p.title) AS title,
           coalesce(CASE WHEN c.op = 'update' THEN c.category END, p.category) AS category
    FROM policies p LEFT JOIN changes c ON c.source = p.source WHERE c.op IS NULL OR c.op <> 'delete'
    UNION ALL SELECT c.source, c.title, c.category FROM changes c
    WHERE c.op = 'create' AND c.source NOT IN (SELECT source FROM policies)""")
def apply_policy_changes(spark, sf):
    return _changed(spark, sf).table


@query("rejected_policy_changes", _CHANGES_SQL + """
    SELECT c.source, c.op, CASE WHEN c.op = 'create' THEN 'already_exists' ELSE 'not_found' END AS reason
    FROM changes c LEFT JOIN policies p ON p.source = c.source
    WHERE (c.op = 'create' AND p.source IS NOT NULL) OR (c.op <> 'create' AND p.source IS NULL)""")
def rejected_policy_changes(spark, sf):
    return _changed(spark, sf).rejected


@query("delete_policies", with_clause("policies", "policy_revisions") + """
    SELECT source, revision_id FROM policy_revisions WHERE source NOT IN (SELECT s_suppkey FROM supplier)""")
def delete_policies(spark, sf):
    revisions = load(spark, sf, "policy_revisions")
    doomed = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source"))
    return registry.delete_policies(load(spark, sf, "policies"), revisions, revisions, doomed)[1].select("source", "revision_id")


@query("delete_revisions", with_clause("policy_revisions") + """
    SELECT source, revision_id, 'sole_active_revision' AS reason FROM (
      SELECT *, count(*) FILTER (WHERE status = 'active') OVER (PARTITION BY source) AS n FROM policy_revisions) x
    WHERE status = 'active' AND n <= 1""")
def delete_revisions(spark, sf):
    revisions = load(spark, sf, "policy_revisions")
    return registry.delete_revisions(revisions, revisions, revisions).rejected


_SEED = """SELECT 'S' || c_custkey AS source, 'v' || c_custkey AS version_label, DATE '2020-07-01' AS effective_from,
             CAST(NULL AS DATE) AS effective_to, c_mktsegment || '.pdf' AS file FROM {customer}"""


@query("seed_policies", "WITH seed AS (" + _SEED.format(customer="customer") + """),
    known AS (SELECT 'S' || s_suppkey AS source FROM supplier)
    SELECT item, status, count(*) AS items FROM (
      SELECT 'policy' AS item, CASE WHEN source IN (SELECT source FROM known) THEN 'skipped' ELSE 'created' END AS status FROM seed
      UNION ALL SELECT 'revision', CASE WHEN source IN (SELECT source FROM known) THEN 'skipped'
             WHEN file = 'BUILDING.pdf' OR file = 'MACHINERY.pdf' THEN 'created' ELSE 'file_missing' END FROM seed) x
    GROUP BY item, status""")
def seed_policies(spark, sf):
    seed = spark.sql(_SEED, customer=table(spark, sf, "customer"))
    known = table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("source"))
    held = known.withColumn("revision_id", T.revision_id(F.col("source"), F.lit("2020-07-01").cast("date")))
    files = table(spark, sf, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        F.concat("c_mktsegment", F.lit(".pdf")).alias("file"))
    return registry.seed_counts(*registry.seed_policies(known, held, seed.select("source"), seed, files))
