"""Keyed tables in Parquet: rows are dealt into buckets by key, and a version is a small commit file that names each bucket's folder.

    path/data/<write>/bucket=7/*.parquet    rows of the buckets that one write touched
    path/commits/00000003.json              schema, keys, number of buckets, folder of every bucket

A write reads and rewrites only the buckets its keys fall into and then adds one commit; all other buckets keep their
files.  Readers take the newest commit, so data without a commit is never seen: a writer that dies leaves rows that
nothing refers to.  A commit is written aside and renamed, which fails if its number is taken, so of two writers one
fails and can try again.  Versions but the newest ``keep`` are pruned after a commit.
"""

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
KEEP = 2  # a reader of the version before is not cut off


class Conflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass
class Commit:
    number: int
    keys: list
    buckets: int
    schema: str
    folders: dict = field(default_factory=dict)  # bucket -> folder; an empty bucket has none
    token: str = None  # what the writer calls this write, to know it again


def bucket_of(keys, buckets: int) -> Column:
    """A row's bucket: leading digits of the md5 of its keys' text forms, the same in every engine."""
    parts = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(parts), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


# --- files ------------------------------------------------------------------

def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, where: str) -> list:
    path, fs = _path(spark, where)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def _remove(spark: SparkSession, where: str) -> None:
    path, fs = _path(spark, where)
    fs.delete(path, True)


def _load(spark: SparkSession, table: str, name: str) -> Commit:
    path, fs = _path(spark, f"{table}/commits/{name}")
    stream = fs.open(path)
    try:
        return Commit(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def commits(spark: SparkSession, table: str) -> list:
    """Names of the commits there are, oldest first."""
    return [n for n in _names(spark, f"{table}/commits") if n.endswith(".json") and not n.startswith((".", "_"))]


def current(spark: SparkSession, table: str):
    """The newest commit, None if there is none."""
    held = commits(spark, table)
    return _load(spark, table, held[-1]) if held else None


def _commit(spark: SparkSession, table: str, commit: Commit) -> None:
    aside, fs = _path(spark, f"{table}/commits/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(json.dumps(asdict(commit)).encode()))
    finally:
        out.close()
    target, _ = _path(spark, f"{table}/commits/{commit.number:08d}.json")
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise Conflict(f"version {commit.number} of {table} is there already")


# --- reading and writing ----------------------------------------------------

def read(spark: SparkSession, table: str, schema=None, commit: Commit = None, only=None) -> DataFrame:
    """Rows of a commit, the newest by default; an empty table of ``schema`` if there is none. ``only``: some buckets."""
    commit = commit or current(spark, table)
    if commit is None:
        return spark.createDataFrame([], schema)
    kind = StructType.fromJson(json.loads(commit.schema))
    folders = [f"{table}/data/{f}/bucket={b}" for b, f in commit.folders.items() if only is None or int(b) in only]
    return spark.read.schema(kind).parquet(*folders) if folders else spark.createDataFrame([], kind)


def _touched(df: DataFrame, base: Commit) -> set:
    rows = df.select(bucket_of(base.keys, base.buckets).alias("b")).distinct().collect()  # at most base.buckets
    return {r.b for r in rows}


def _rewrite(table: str, base: Commit, rows: DataFrame, touched: set, token: str, keep: int) -> Commit:
    """Commit ``rows`` as the whole contents of the touched buckets."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    dealt = rows.withColumn("bucket", bucket_of(base.keys, base.buckets))
    dealt.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{table}/data/{name}")
    written = {n.split("=")[1] for n in _names(spark, f"{table}/data/{name}") if n.startswith("bucket=")}
    folders = {b: f for b, f in base.folders.items() if int(b) not in touched} | {b: name for b in written}
    commit = Commit(base.number + 1, base.keys, base.buckets, base.schema, folders, token)
    _commit(spark, table, commit)
    prune(spark, table, keep)
    return commit


def upsert(updates: DataFrame, table: str, key, version: str = None, buckets: int = BUCKETS, token: str = None,
           keep: int = KEEP) -> Commit:
    """Insert or replace rows by key, the newest version (else the update) winning; the same updates twice change nothing.

    ``buckets`` counts for a new table.  A write whose ``token`` is that of the newest commit was done already and is
    left out, so a batch that a stream replays is written once.  ``updates`` is read twice: for the buckets it touches
    and for its rows.  A column called "bucket" cannot be stored.
    """
    from hedgerow.operators import registry

    spark, keys = updates.sparkSession, [key] if isinstance(key, str) else list(key)
    base = current(spark, table) or Commit(0, keys, buckets, updates.schema.json())
    if token is not None and base.token == token:
        return base
    if base.keys != keys:
        raise ValueError(f"{table} is keyed by {base.keys}")
    touched = _touched(updates, base)
    if not touched and base.number:
        return base
    held = read(spark, table, commit=base, only=touched)
    return _rewrite(table, base, registry.upsert(held, updates, keys, version), touched, token, keep)


def delete(spark: SparkSession, doomed: DataFrame, table: str, key, token: str = None, keep: int = KEEP) -> DataFrame:
    """Delete the rows whose ``key`` columns, the table's keys or others, are in ``doomed``; returns deleted counts per key."""
    from hedgerow.operators import registry

    keys, base = [key] if isinstance(key, str) else list(key), current(spark, table)
    if base is None:
        raise ValueError(f"{table} has no version")
    whole = read(spark, table, commit=base)
    touched = _touched(whole.join(doomed.select(*keys).distinct(), keys, "left_semi"), base)
    _, counts = registry.delete_by(whole, doomed, keys)
    if touched:
        remaining, _ = registry.delete_by(read(spark, table, commit=base, only=touched), doomed, keys)
        _rewrite(table, base, remaining, touched, token, max(keep, 2))  # the counts read the version before
    return counts


def prune(spark: SparkSession, table: str, keep: int = KEEP, orphans: bool = False) -> None:
    """Drop all but the newest ``keep`` commits and the bucket folders only they name.

    ``orphans`` also drops data that no commit names, which a writer that died has left; only while nobody writes.
    """
    names = commits(spark, table)
    kept, dropped = names[-keep:], names[:-keep]
    if not dropped and not orphans:
        return
    needed = {(f, b) for n in kept for b, f in _load(spark, table, n).folders.items()}
    gone = {(f, b) for n in dropped for b, f in _load(spark, table, n).folders.items()} - needed
    for name in dropped:  # commits first: none is left that names missing files
        _remove(spark, f"{table}/commits/{name}")
    for folder, bucket in gone:
        _remove(spark, f"{table}/data/{folder}/bucket={bucket}")
    live = {f for f, _ in needed}
    for folder in {f for f, _ in gone} - live if not orphans else set(_names(spark, f"{table}/data")) - live:
        _remove(spark, f"{table}/data/{folder}")
