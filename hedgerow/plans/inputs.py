"""Operator inputs derived from the driver tables.

Each input is one SQL text both Spark and DuckDB understand, with ``{name}`` for the tables it
reads; names are driver tables or other inputs.  Every input covers its whole table: keys only
pick words from a list, they never leave rows out.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.operators import ordered

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def pick(key: str, words) -> str:
    """CASE that gives row ``key`` one of the words in turn; None stands for null."""
    arms = " ".join(
        f"WHEN {i} THEN " + ("NULL" if w is None else "'" + str(w).replace("'", "''") + "'")
        for i, w in enumerate(words))
    return f"(CASE {key} % {len(words)} {arms} END)"


TITLES = (
    "Planning Statement", "Design and Access Statement v2", "Site Plan 1:500", "Floor Plan - ground",
    "OCC Highways consultation response", "Transport Assessment", "Ecology report", "Objection from resident",
    "Letter of Support", "Superseded site plan", "Officer's Report", "Flood Risk statement", "Untitled scan",
    "Section 106 draft", "Case officer note", "Noise survey", "Parking layout", "Statutory consultee reply",
    "", "Petition", "Air quality memo", "Decision Notice", "Photographs",
)
CATEGORIES = (
    None, "Application Forms", "Supporting Documents", "Consultation Responses", "Public Comments",
    "Superseded Documents", "Officer/Committee Consideration", "Consultee Responses ", "Miscellaneous",
    "", "Proposed Plans",
)
FILE_NAMES = (
    "Transport_Assessment_v2.pdf", "travel-plan final.PDF", "Traffic Impact.pdf", "highways statement.docx",
    "Design_and_Access_Statement.pdf", "D&A Statement.pdf", "site plan.png", "Location-Plan.pdf",
    "Block_plan.tif", "GROUND FLOOR.pdf", "Elevations north.pdf", "street scene 1.jpg", "Planning Statement.pdf",
    "EIA scoping.pdf", "noise survey.pdf", "FRA rev B.pdf", "Infrastructure note.pdf", "Bat_Survey.pdf",
    "Biodiversity.pdf", "heritage statement.pdf", "Tree Survey.pdf", "render 3.jpeg", "CGI view.pdf",
    "letter.txt", "archive.zip", "noextension", "birds eye view.bmp", "scan0001.pdf", "misc notes.pdf",
)
CONTENT_WORDS = (
    "nothing to see", "trip generation and traffic flow", "Local Plan and NPPF", "flood zone with SUDS",
    "habitat", "protected species habitat bat survey", "decibel acoustic noise level",
    "listed building in the conservation area", "drainage and surface water; habitat; breeding birds",
    "design principles, inclusive design", "travel plan and local plan and nppf and pedestrian",
)
SECTION_PREFIXES = (
    "Chapter 5 ", "see Table 5-2 and Section 3.2 ", "Paragraph 116 ", "Annex B ", "Figure 4.1 ", "",
    "para 7.3 then chapter  12.5 ", "section9 ",
)
DATE_TEXTS = (
    "3/2/2025", "03/02/2025", "4 Feb 2024", "14 February 2024", "2024-11-05", "5-1-2023", "not a date",
    " 31/12/2022 ", "2024/01/01",
)
LABEL_TEXTS = (
    "Site Address:", "Proposal", "Applicant  Name", "Agent name :", "Current Status", "Decision",
    "Decision Date", "Application Type", "Electoral Ward", "Parish Council", "Case Officer",
    "Date Received", "Valid Date", "Target date", "Applicant's Agent", "Notes", "Date of birth",
)
HREFS = (
    "https://a.example/x.pdf", "//cdn.example/d?docid=4", "/Document/Download?id=7&fileName=Site%20Plan.pdf",
    "files/plan.pdf", "", "http://b.example/viewdoc/9",
)
ERRORS = (
    "Scraper error: timeout", "Review was Cancelled by user", "No documents could be ingested", "boom",
    "MCP connection error",
)
REPORTS = (
    "## Review\n**Overall Rating:** RED\n", "**Overall rating:** Green - fine", "no rating here",
    "**Overall Rating:** 🟢", "**overall rating:** 🔴 poor", "**Overall Rating:** amber",
)
RATING_TEXTS = (" Red ", "GREEN", "amber", "purple", "", None)
BOOL_TEXTS = ("true", "Yes", "1", "no", "FALSE", "0", "maybe", None)
DOC_CATEGORIES = (
    "Transport & Access", "travel documents", "Landscape plans", "Core", "Design & Layout", "Highway stuff",
)

INPUTS = {
    "listed_documents": f"""
        SELECT doc_id AS document_id, source AS application_ref,
               {pick('doc_id', TITLES)} AS description, {pick('doc_id', CATEGORIES)} AS document_type
        FROM {{documents}}""",
    "named_files": f"""
        SELECT doc_id, source AS application_ref, '/data/' || source || '/' || {pick('doc_id', FILE_NAMES)} AS path,
               {pick('doc_id', FILE_NAMES)} AS file_name, text || ' ' || {pick('doc_id', CONTENT_WORDS)} AS body
        FROM {{documents}}""",
    "policy_texts": f"""
        SELECT doc_id, source, lang AS revision_id, {pick('doc_id', SECTION_PREFIXES)} || text AS text
        FROM {{documents}}""",
    "doc_pages": """
        SELECT conv_id AS document_id, turn + 1 AS page_number, text,
               CASE WHEN role = 'user' THEN 'text_layer' ELSE 'ocr' END AS extraction_method,
               CAST(length(text) AS DOUBLE) * (1 + conv_id % 7) AS image_area, 512e0 AS page_area
        FROM {conversations}""",
    "chunks": """
        SELECT conv_id AS document_id, turn AS chunk_index, text FROM {conversations}""",
    "revision_starts": """
        SELECT o_custkey AS source, CAST(o_orderdate AS DATE) AS effective_from, max(o_orderkey) AS revision_id
        FROM {orders} GROUP BY o_custkey, CAST(o_orderdate AS DATE)""",
    "revision_facts": """
        SELECT r.source, r.effective_from, r.revision_id,
               CASE o.o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'superseded' ELSE 'failed' END AS status
        FROM {revision_starts} r JOIN {orders} o ON o.o_orderkey = r.revision_id""",
    # ends: the day before the next start of any status, or 10 days earlier for every fifth revision
    "policy_revisions": """
        SELECT source, revision_id, effective_from, status,
               CASE WHEN revision_id % 5 = 0 AND CAST(plain_end - INTERVAL '10' DAY AS DATE) >= effective_from
                    THEN CAST(plain_end - INTERVAL '10' DAY AS DATE) ELSE plain_end END AS effective_to
        FROM (SELECT source, revision_id, effective_from, status,
                     CAST(lead(effective_from) OVER (PARTITION BY source ORDER BY effective_from)
                          - INTERVAL '1' DAY AS DATE) AS plain_end
              FROM {revision_facts}) x""",
    "open_revisions": """
        SELECT source, revision_id, effective_from,
               CASE WHEN revision_id % 4 = 0 THEN CAST(effective_from + INTERVAL '40' DAY AS DATE) END AS effective_to,
               status
        FROM {revision_facts}""",
    "probes": """
        SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, o.o_custkey AS source,
               CAST(l.l_shipdate AS DATE) AS on_date
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "policies": """
        SELECT c_custkey AS source, c_name AS title, c_mktsegment AS category FROM {customer}""",
    "snapshot_dates": """
        SELECT DATE '1995-03-01' AS on_date UNION ALL SELECT DATE '1997-06-15' UNION ALL SELECT DATE '2000-12-31'""",
    "new_revisions": """
        SELECT o_custkey AS source, o_orderkey AS revision_id,
               CAST(o_orderdate + INTERVAL '100' DAY AS DATE) AS effective_from,
               CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate + INTERVAL '130' DAY AS DATE) END AS effective_to
        FROM {orders}""",
    "segment_rows": """
        SELECT l.l_orderkey AS route_id, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice,
               l.l_shipdate, l.l_partkey AS way_id,
               CASE l.l_returnflag || l.l_linestatus WHEN 'AF' THEN 'segregated' WHEN 'AO' THEN 'shared_use'
                    WHEN 'NF' THEN 'on_road_lane' WHEN 'NO' THEN 'none' WHEN 'RF' THEN 'advisory_lane'
                    ELSE 'none' END AS provision,
               CASE p.p_size % 8 WHEN 0 THEN 'residential' WHEN 1 THEN 'primary' WHEN 2 THEN 'cycleway'
                    WHEN 3 THEN 'tertiary' WHEN 4 THEN 'path' WHEN 5 THEN 'secondary' WHEN 6 THEN 'trunk'
                    ELSE 'service' END AS highway,
               CAST(10 * (1 + floor(l.l_quantity / 10)) AS INT) AS speed_limit,
               CASE p.p_type WHEN 'ECONOMY' THEN 'asphalt' WHEN 'LARGE' THEN 'compacted' WHEN 'MEDIUM' THEN 'unknown'
                    WHEN 'PROMO' THEN 'gravel' WHEN 'SMALL' THEN 'Paved' ELSE 'mud' END AS surface,
               CASE l.l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS lit,
               CAST(floor(l.l_extendedprice) AS DOUBLE) / 8 AS distance_m,
               p.p_brand AS name,
               CASE WHEN l.l_suppkey % 4 <> 0 THEN -1 - CAST(l.l_partkey % 89 AS DOUBLE) / 64 END AS lon,
               CASE WHEN l.l_suppkey % 4 <> 0 THEN 51 + CAST(l.l_suppkey % 97 AS DOUBLE) / 64 END AS lat
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "routes": """
        SELECT o_orderkey AS route_id, CAST(floor(o_totalprice) AS DOUBLE) / 8 AS cycling_distance_m,
               CAST(floor(o_totalprice) AS DOUBLE) / 4 AS duration_s,
               CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice / (1 + (o_orderkey % 6) * 0.1e0)) AS DOUBLE) / 8 END
                   AS shortest_distance_m,
               o_custkey AS application_ref, o_orderpriority AS destination
        FROM {orders}""",
    "way_tags": """
        SELECT l_orderkey AS route_id, l_linenumber, l_partkey, l_suppkey, l_quantity,
               CASE l_partkey % 11 WHEN 0 THEN 'cycleway' WHEN 1 THEN 'path' WHEN 2 THEN 'footway' WHEN 3 THEN 'primary'
                    WHEN 4 THEN 'residential' WHEN 5 THEN 'bridleway' WHEN 6 THEN 'construction' WHEN 7 THEN 'tertiary'
                    WHEN 8 THEN 'living_street' WHEN 9 THEN 'motorway' END AS highway,
               CASE l_suppkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'designated' WHEN 2 THEN 'no' END AS bicycle,
               CASE l_suppkey % 3 WHEN 0 THEN 'designated' WHEN 1 THEN 'no' END AS foot,
               CASE l_partkey % 5 WHEN 0 THEN 'Shared path' WHEN 1 THEN 'public_footpath' END AS designation,
               CASE l_linenumber % 7 WHEN 0 THEN 'track' WHEN 1 THEN 'lane' WHEN 2 THEN 'share_busway' WHEN 3 THEN 'no' END AS cycleway,
               CASE l_linenumber % 4 WHEN 0 THEN 'separate' WHEN 1 THEN 'shared_lane' END AS cycleway_left,
               CASE CAST(l_quantity AS INT) % 6 WHEN 0 THEN '30 mph' WHEN 1 THEN '20' WHEN 2 THEN 'signals' WHEN 3 THEN 'none' END AS maxspeed,
               CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN 'no' END AS lit,
               CASE l_linestatus WHEN 'O' THEN 'asphalt' END AS surface,
               51.8e0 + CAST(l_partkey % 97 AS DOUBLE) / 1000 AS lat1, -1.2e0 + CAST(l_suppkey % 89 AS DOUBLE) / 1000 AS lon1,
               51.8e0 + CAST(l_suppkey % 83 AS DOUBLE) / 1000 AS lat2, -1.2e0 + CAST(l_partkey % 79 AS DOUBLE) / 1000 AS lon2
        FROM {lineitem}""",
    # a barrier per line item: few distinct spots per supplier, so that many lie within 5 m
    "barrier_spots": """
        SELECT l_suppkey AS route_id, l_orderkey * 8 + l_linenumber AS ord, l_partkey AS node_id,
               51.8e0 + CAST(l_partkey % 40 AS DOUBLE) / 50000 AS lat,
               -1.2e0 + CAST(l_orderkey % 30 AS DOUBLE) / 30000 AS lon
        FROM {lineitem}""",
    "places": """
        SELECT s_suppkey AS supplier_id, 51.8e0 + CAST(s_suppkey % 97 AS DOUBLE) / 1000 AS lat,
               -1.2e0 + CAST(s_suppkey % 89 AS DOUBLE) / 1000 AS lon
        FROM {supplier}""",
    "legs": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               51.8e0 + CAST(l_suppkey % 97 AS DOUBLE) / 1000 AS lat1, -1.2e0 + CAST(l_suppkey % 89 AS DOUBLE) / 1000 AS lon1,
               51.8e0 + CAST(l_partkey % 83 AS DOUBLE) / 1000 AS lat2, -1.2e0 + CAST(l_partkey % 79 AS DOUBLE) / 1000 AS lon2
        FROM {lineitem}""",
    "destinations": """
        SELECT 'dest_' || CAST(1000 + n_nationkey AS STRING) AS destination_id, n_name AS name, n_regionkey AS zone
        FROM {nation}""",
    "review_jobs": """
        SELECT o_orderkey AS review_id, o_custkey AS application_ref,
               CASE o_orderstatus WHEN 'O' THEN CASE o_orderkey % 2 WHEN 0 THEN 'queued' ELSE 'processing' END
                    WHEN 'F' THEN 'completed' ELSE 'failed' END AS status,
               o_orderdate AS created_at,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' DAY END AS completed_at
        FROM {orders}""",
    "requests": """
        SELECT user_id AS key, event_id AS request_id, ts FROM {events}""",
    "phase_events": """
        SELECT user_id AS review_id, ts, event_id,
               CASE event_type WHEN 'click' THEN 'fetching_metadata' WHEN 'view' THEN 'downloading_documents'
                    WHEN 'signup' THEN 'ingesting_documents' WHEN 'purchase' THEN 'generating_review'
                    ELSE 'verifying_review' END AS phase,
               CASE event_id % 5 WHEN 0 THEN 'start' WHEN 1 THEN 'progress' WHEN 2 THEN 'progress' WHEN 3 THEN 'complete'
                    ELSE 'error' END AS event,
               CAST(floor(value) AS INT) % 7 AS sub_current, 7 AS sub_total
        FROM {events}""",
    "claims": """
        SELECT l_orderkey AS review_id, l_returnflag <> 'R' AND l_quantity < 30 AS verified FROM {lineitem}""",
    "ingest_status": """
        SELECT d.source AS application_ref, d.doc_id AS file_path,
               CASE WHEN l.doc_id IS NOT NULL AND l.toxic = 1 THEN 'error' WHEN l.doc_id IS NOT NULL THEN 'already_ingested'
                    WHEN d.n_chars > 5000 THEN 'skipped' ELSE 'success' END AS status
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "evidence_hits": """
        SELECT l_suppkey AS review_id, CASE WHEN l_returnflag = 'R' THEN 'policy' ELSE 'application' END AS kind,
               l_orderkey * 8 + l_linenumber AS ord, CAST(l_partkey AS STRING) AS origin,
               CAST(l_quantity AS STRING) || '/' || CAST(l_orderkey AS STRING) AS text
        FROM {lineitem}""",
}


def _names(sql: str):
    return dict.fromkeys(re.findall(r"\{(\w+)\}", sql))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived input as a DataFrame."""
    if name not in INPUTS:
        return table(spark, sf_dir, name)
    sql = INPUTS[name]
    return spark.sql(sql, **{n: load(spark, sf_dir, n) for n in _names(sql)})


def with_clause(*names: str) -> str:
    """WITH clause for DuckDB defining the named inputs and what they read."""
    done = {}

    def add(name):
        if name in done or name not in INPUTS:
            return
        needs = _names(INPUTS[name])
        for n in needs:
            add(n)
        done[name] = INPUTS[name].format(**{n: n for n in needs})

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in done.items()) + "\n"


# --- inputs with nested columns, built on the flat ones ----------------------

SEGMENT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered route segments; a segment without a place has no geometry."""
    rows = load(spark, sf_dir, "segment_rows")
    long = ordered.long_keys(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route_id")), ["route_id"])
    if long is None:
        rows = rows.repartition("route_id")  # what follows goes by route
    # follows the first two order columns, a few rows per block even on a hot route
    block = F.col("l_linenumber").cast("long") * 10_000_000_000 + F.floor(F.col("l_partkey") / 64)
    placed = ordered.position(rows, ["route_id"], SEGMENT_ORDER, "seq", block, long)
    here = F.array("lon", "lat")
    there = F.array(F.col("lon") + 0.5, F.col("lat") + 0.25)
    return ordered.noted(placed.select(
        "route_id", (F.col("seq") - 1).alias("seq"), "way_id", "provision", "highway", "speed_limit", "surface",
        "lit", "distance_m", "name", F.lit(None).cast("string").alias("original_provision"),
        F.when(F.col("lon").isNotNull(), F.array(here, there)).alias("geometry")), long)


def map_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways with a tag map and a two-point geometry; ``ord`` is unique within a route."""
    rows = load(spark, sf_dir, "way_tags")
    keys = {"highway": "highway", "bicycle": "bicycle", "foot": "foot", "designation": "designation",
            "cycleway": "cycleway", "cycleway:left": "cycleway_left", "maxspeed": "maxspeed", "lit": "lit",
            "surface": "surface"}
    tags = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in keys.items()]),
        lambda e: e["value"].isNotNull()))
    shape = F.array(F.struct(F.col("lat1").alias("lat"), F.col("lon1").alias("lon")),
                    F.struct(F.col("lat2").alias("lat"), F.col("lon2").alias("lon")))
    return rows.select(
        "route_id", way_order().alias("ord"), way_id().alias("way_id"), tags.alias("tags"), shape.alias("geometry"))


def way_order():
    return F.col("l_partkey") * 100_000_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")


def way_id():
    """Way ids on and off the route: about half are parts, half are not."""
    return F.when(F.col("l_suppkey") % 2 == 0, F.col("l_partkey")).otherwise(-F.col("l_partkey") - 1)
