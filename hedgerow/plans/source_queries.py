"""Queries that write with the library's writers and read back with its readers."""

from pyspark.sql import functions as F

from hedgerow.operators.lineage import scratch
from hedgerow.plans.catalog import query
from hedgerow.sources import keyed, readers, sinks


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("read_pages", """
    SELECT min(page_id) AS page_id, url, length(arg_min(html, page_id)) AS html_chars FROM pages GROUP BY url""")
def read_pages(spark, sf):
    return readers.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").cast("long").alias("html_chars"))


@query("manifest_round_trip", """
    SELECT source || '/' || lang AS application_ref, CAST(doc_id AS VARCHAR) AS document_id, md5(text) AS file_hash FROM documents""")
def manifest_round_trip(spark, sf):
    """A manifest for each source and language, written, and all of them read again."""
    none = F.lit(None).cast("string")
    entries = table(spark, sf, "documents").select(
        F.concat(F.lit("r"), "source", "lang").alias("review_id"), F.concat_ws("/", "source", "lang").alias("application_ref"),
        F.col("doc_id").cast("string").alias("document_id"), F.md5("text").alias("file_hash"),
        *[none.alias(c) for c in ("description", "document_type", "date_published", "s3_key", "source_url")])
    path = scratch(spark, "manifests")
    sinks.write_manifest(entries, path)
    return readers.read_manifest(spark, path).select("application_ref", "document_id", "file_hash")


@query("versioned_table", """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -n_chars ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 5 <> 1""")
def versioned_table(spark, sf):
    """A keyed table in versions: written, a third updated, a fifth deleted, the current version read."""
    docs, path = table(spark, sf, "documents").select("doc_id", "n_chars"), scratch(spark, "table")
    sinks.upsert_chunks(docs, path, "doc_id")
    sinks.upsert_chunks(docs.filter("doc_id % 3 = 0").withColumn("n_chars", -F.col("n_chars")), path, "doc_id")
    sinks.delete_chunks(spark, docs.filter("doc_id % 5 = 1"), path, "doc_id")
    return sinks.read_current(spark, path)


@query("touched_buckets", """
    WITH rows AS (
      SELECT doc_id, n_chars, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 64 AS bucket,
             n_chars = max(n_chars) OVER (PARTITION BY source) AS longest FROM documents)
    SELECT doc_id, CAST(bucket AS INT) AS bucket, CASE WHEN longest THEN -n_chars ELSE n_chars END AS n_chars,
           NOT bool_or(longest) OVER (PARTITION BY bucket) AS file_kept FROM rows""")
def touched_buckets(spark, sf):
    """An upsert of each source's longest documents: which rows are still read from the file they were in before."""
    docs, path = table(spark, sf, "documents").select("doc_id", "source", "n_chars"), scratch(spark, "keyed")
    longest = docs.groupBy("source").agg(F.max("n_chars").alias("n_chars"))
    first = keyed.upsert(docs, path, "doc_id")
    keyed.upsert(docs.join(longest, ["source", "n_chars"]).withColumn("n_chars", -F.col("n_chars")).select(*docs.columns), path, "doc_id")
    before = keyed.read(spark, path, commit=first).select("doc_id", F.input_file_name().alias("was"))
    now = keyed.read(spark, path).select("doc_id", "n_chars", F.input_file_name().alias("is"))
    return now.join(before, "doc_id").select(
        "doc_id", keyed.bucket_of(["doc_id"], 64).alias("bucket"), "n_chars", (F.col("is") == F.col("was")).alias("file_kept"))
