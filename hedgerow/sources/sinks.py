"""Writers: keyed tables, manifests, review outputs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.sources import keyed


# --- keyed tables -----------------------------------------------------------

def read_current(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Current version of a table; an empty table of ``schema`` if there is none yet."""
    return keyed.read(spark, path, schema)


def upsert_chunks(updates: DataFrame, path: str, key="chunk_id", version: str = None, **how) -> keyed.Commit:
    """Idempotent keyed upsert that rewrites the touched buckets only; see ``keyed.upsert``."""
    return keyed.upsert(updates, path, key, version, **how)


def delete_chunks(spark: SparkSession, doomed: DataFrame, path: str, key="document_id") -> DataFrame:
    """Write a version without the doomed keys; returns the deleted counts per key."""
    return keyed.delete(spark, doomed, path, key)


# --- manifests and outputs --------------------------------------------------

def write_manifest(entries: DataFrame, path: str) -> None:
    """One JSON manifest folder per application."""
    documents = F.struct("document_id", "description", "document_type", "date_published", "s3_key",
                         "file_hash", "source_url")
    (
        entries.groupBy("review_id", "application_ref")
        .agg(F.array_sort(F.collect_list(documents)).alias("documents"))
        .withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
        .withColumn("folder", F.translate("application_ref", "/", "_"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("folder").json(path)
    )


def write_review_outputs(reviews: DataFrame, path: str) -> None:
    """Review JSON without routes, routes JSON and markdown, partitioned by application.

    ``reviews(review_id, application_ref, ..., full_markdown, route_assessments)``.
    """
    foldered = reviews.withColumn("folder", F.translate("application_ref", "/", "_"))

    def out(df, name):
        df.write.mode("overwrite").partitionBy("folder").json(f"{path}/{name}")

    out(foldered.drop("route_assessments"), "review")
    out(foldered.select("folder", "review_id", "route_assessments"), "routes")
    out(foldered.filter("full_markdown is not null and full_markdown <> ''")
        .select("folder", "review_id", "full_markdown"), "markdown")
