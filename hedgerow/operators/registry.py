"""Applying changes to registry tables, and seeding them.

Tables are rewritten, not updated in place: each function returns the new table (or the changes
with their outcome); ``hedgerow.sources.sinks`` writes versions.
"""

from collections import namedtuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgerow.functions import text as T

Changed = namedtuple("Changed", "table rejected")


def apply_changes(table: DataFrame, changes: DataFrame, key="source", updated_at: str = None) -> Changed:
    """Create, update and delete rows by key; one change per key.

    ``changes`` has the table's columns and ``op``.  A create of a known key and an update or
    delete of an unknown one are rejected with a reason; in an update null keeps the old value.
    """
    keys = [key] if isinstance(key, str) else list(key)
    values = [c for c in table.columns if c not in keys]
    old = table.select(*keys, F.struct(*values).alias("_old")) if values else table.withColumn("_old", F.struct())
    new = changes.select(*keys, "op", F.struct(*[F.col(c) if c in changes.columns else F.lit(None).alias(c)
                                                 for c in values]).alias("_new"))
    both = old.join(new, keys, "full_outer")
    known, op = F.col("_old").isNotNull(), F.col("op")
    reason = (
        F.when((op == "create") & known, "already_exists")
        .when(op.isin("update", "delete") & ~known, "not_found")
    )
    judged = both.withColumn("reason", reason)
    kept = F.coalesce(op, F.lit("keep"))
    taken = F.col("reason").isNull() & kept.isin("create", "update")

    def value(c):
        fresh, held = F.col(f"_new.{c}"), F.col(f"_old.{c}")
        if c == updated_at:
            return F.when(taken & (op == "update"), F.current_timestamp()).otherwise(F.coalesce(held, fresh)).alias(c)
        return F.when(taken, F.coalesce(fresh, held)).otherwise(held).alias(c)

    alive = known | (taken & (op == "create"))
    gone = F.col("reason").isNull() & (kept == "delete")
    result = judged.filter(alive & ~gone).select(*keys, *[value(c) for c in values])
    return Changed(result.select(*table.columns), judged.filter("reason is not null").select(*keys, "op", "reason"))


def delete_policies(policies: DataFrame, revisions: DataFrame, chunks: DataFrame, sources: DataFrame):
    """Remove policies with their revisions and the revisions' chunks."""
    def without(df):
        return df.join(sources.select("source"), "source", "left_anti")

    return without(policies), without(revisions), without(chunks)


def delete_revisions(revisions: DataFrame, chunks: DataFrame, doomed: DataFrame) -> Changed:
    """Remove revisions and their chunks; the sole active revision of a source stays.

    ``table`` is the pair (revisions, chunks) that remains.
    """
    from hedgerow.operators.policies import can_delete_revision

    keys = ["source", "revision_id"]
    judged = can_delete_revision(revisions).select(*keys, "can_delete")
    asked = doomed.select(*keys).distinct().join(judged, keys, "left")
    reason = F.when(F.col("can_delete").isNull(), "not_found").when(~F.col("can_delete"), "sole_active_revision")
    gone = asked.filter("can_delete").select(*keys)
    rejected = asked.withColumn("reason", reason).filter("reason is not null").select(*keys, "reason")
    return Changed((revisions.join(gone, keys, "left_anti"), chunks.join(gone, keys, "left_anti")), rejected)


def seed_policies(policies: DataFrame, revisions: DataFrame, seed_policies_: DataFrame,
                  seed_revisions: DataFrame, files: DataFrame):
    """What a seed file adds: (policies with status, revisions with status); repeatable.

    ``seed_revisions(source, version_label, effective_from, effective_to, file)``, ``files(file)``
    lists the files there are.  Statuses: created, skipped, file_missing.
    """
    known = policies.select("source", F.lit(True).alias("_known")).distinct()
    new_policies = seed_policies_.join(known, "source", "left").withColumn(
        "status", F.when(F.col("_known"), "skipped").otherwise("created")).drop("_known")
    held = revisions.select("source", "revision_id", F.lit(True).alias("_known")).distinct()
    there = files.select("file", F.lit(True).alias("_there")).distinct()
    new_revisions = (
        seed_revisions.withColumn("revision_id", T.revision_id(F.col("source"), F.col("effective_from")))
        .join(held, ["source", "revision_id"], "left").join(there, "file", "left")
        .withColumn("status", F.when(F.col("_known"), "skipped")
                    .when(F.col("_there").isNull(), "file_missing").otherwise("created"))
        .drop("_known", "_there")
    )
    return new_policies, new_revisions


def seed_counts(new_policies: DataFrame, new_revisions: DataFrame) -> DataFrame:
    tagged = new_policies.select(F.lit("policy").alias("item"), "status").unionByName(
        new_revisions.select(F.lit("revision").alias("item"), "status"))
    return tagged.groupBy("item", "status").agg(F.count("*").alias("items"))


def upsert(target: DataFrame, updates: DataFrame, key="chunk_id", version: str = None) -> DataFrame:
    """Target with updates applied by key, a column or several; the newest version (else the update) wins.

    One aggregation of maxima, so a key with many copies is combined before the shuffle.
    """
    columns = target.columns
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in columns if c not in keys]
    order = F.struct("_new", *([version] if version else []))
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.select(*columns).withColumn("_new", F.lit(1)))
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return newest.select(*keys, "r.*").select(*columns)


def delete_by(chunks: DataFrame, doomed: DataFrame, key="document_id"):
    """(remaining chunks, deleted chunk counts per key)."""
    keys = [key] if isinstance(key, str) else list(key)
    doomed = doomed.select(*keys).distinct()
    counts = chunks.join(doomed, keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("deleted"))
    return chunks.join(doomed, keys, "left_anti"), counts


def reindex(chunks: DataFrame, fresh: DataFrame, key=("source", "revision_id")) -> DataFrame:
    """Replace all chunks of the keys in ``fresh`` by the fresh ones."""
    remaining, _ = delete_by(chunks, fresh, list(key))
    return remaining.unionByName(fresh)
