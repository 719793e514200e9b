"""Readers: document folders, seed files, map and site extracts, page tables, manifests."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgerow.functions import text as T

SEED_SCHEMA = """
policies array<struct<source string, title string, description string, category string,
  revisions array<struct<version_label string, effective_from date, effective_to date, file string>>>>
"""
SITE_SCHEMA = """
features array<struct<attributes map<string,string>,
  geometry struct<rings array<array<array<double>>>>>>
"""
MAP_SCHEMA = """
elements array<struct<type string, id bigint, tags map<string,string>, lat double, lon double,
  geometry array<struct<lat double, lon double>>>>
"""
MANIFEST_SCHEMA = """
review_id string, application_ref string, created_at string,
documents array<struct<document_id string, description string, document_type string,
  date_published string, s3_key string, file_hash string, source_url string>>, _corrupt string
"""


def read_document_dir(spark: SparkSession, path: str, patterns=("*.pdf",), recursive: bool = False) -> DataFrame:
    """Files of a folder with content and sha256; one scan per pattern, a file listed once."""
    def scan(pattern):
        reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        return reader.option("recursiveFileLookup", str(recursive).lower()).load(path)

    files = reduce(DataFrame.unionByName, [scan(p) for p in patterns])
    if len(patterns) > 1:
        files = files.dropDuplicates(["path"])
    return files.withColumn("file_hash", T.content_sha256(F.col("content"))).withColumn(
        "file_name", T.base_name(F.col("path")))


def read_policy_seed(spark: SparkSession, path: str):
    """(policies, revisions) of nested seed JSON."""
    config = spark.read.schema(SEED_SCHEMA).option("multiLine", True).json(path)
    each = config.select(F.explode("policies").alias("p"))
    policies = each.select("p.source", "p.title", "p.description", "p.category")
    revisions = each.select("p.source", F.explode("p.revisions").alias("r")).select("source", "r.*")
    return policies, revisions


def read_site_features(spark: SparkSession, path: str) -> DataFrame:
    """First feature of each response; responses without feature or ring give no row."""
    raw = spark.read.schema(SITE_SCHEMA).option("multiLine", True).json(path)
    first = F.try_element_at("features", F.lit(1))
    return (
        raw.select(F.input_file_name().alias("file"), first.alias("f"))
        .filter(F.size("f.geometry.rings") > 0)
        .select("file", F.col("f.attributes").alias("attributes"), F.col("f.geometry.rings").alias("rings"))
    )


def read_map_elements(spark: SparkSession, path: str):
    """(ways, nodes) of map extracts, one extract per route; ``route_id`` is the file's stem."""
    raw = spark.read.schema(MAP_SCHEMA).option("multiLine", True).json(path)
    rows = raw.select(T.stem(F.input_file_name()).alias("route_id"), F.posexplode("elements").alias("ord", "e"))
    no_tags = F.coalesce("e.tags", F.create_map().cast("map<string,string>"))
    ways = rows.filter("e.type = 'way'").select(
        "route_id", "ord", F.col("e.id").alias("way_id"), no_tags.alias("tags"), F.col("e.geometry").alias("geometry"))
    nodes = rows.filter("e.type = 'node'").select(
        "route_id", "ord", F.col("e.id").alias("node_id"), "e.lat", "e.lon", no_tags.alias("tags"))
    return ways, nodes


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML pages, each address once (the lowest page id)."""
    pages = spark.read.parquet(path)
    rest = [c for c in pages.columns if c != "url"]
    return pages.groupBy("url").agg(F.min(F.struct("page_id", *[c for c in rest if c != "page_id"])).alias("p")).select(
        "url", "p.*").select(*pages.columns)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows of every application; a missing folder or a malformed file counts as empty."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    missing = not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    if missing:
        raw = spark.createDataFrame([], MANIFEST_SCHEMA)
    else:
        raw = (spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True)
               .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
               .option("columnNameOfCorruptRecord", "_corrupt").json(path))
    return (
        raw.filter("_corrupt is null").select("application_ref", F.explode("documents").alias("d"))
        .select("application_ref", "d.*").filter("document_id is not null and document_id <> ''")
    )
