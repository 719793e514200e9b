"""Review results: structure, documents carried over between reviews, evidence and verification."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hedgerow.functions import reviews as V
from hedgerow.rules import reviews as R

REVIEW_SCHEMA = T.StructType([
    T.StructField("overall_rating", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("aspects", T.ArrayType(T.StructType([
        T.StructField(n, T.StringType()) for n in ("name", "rating", "key_issue", "analysis")]))),
    T.StructField("policy_compliance", T.ArrayType(T.StructType([
        T.StructField(n, T.StringType()) for n in ("requirement", "policy_source", "compliant", "notes")]))),
    T.StructField("recommendations", T.ArrayType(T.StringType())),
    T.StructField("suggested_conditions", T.ArrayType(T.StringType())),
    T.StructField("key_documents", T.ArrayType(T.StructType([
        T.StructField(n, T.StringType()) for n in ("document_id", "category", "summary")]))),
])


def _all(items: Column, test) -> Column:
    return F.coalesce(F.forall(items, test), F.lit(False))


def parse_reviews(reviews: DataFrame, body: str = "body") -> DataFrame:
    """Parse review JSON (code fence allowed) into typed columns and ``valid``.

    Ratings and categories are normalised, string booleans understood.  A body that is not JSON,
    lacks a part, has no aspect or an impossible value is invalid; its columns are null.
    """
    # as the only element of an array, so that anything after the object makes it invalid
    alone = F.concat(F.lit("["), V.strip_code_fence(F.col(body)), F.lit("]"))
    docs = F.from_json(alone, T.ArrayType(REVIEW_SCHEMA), {"mode": "PERMISSIVE"})
    r = F.col("_r")
    present = F.lit(True)
    for field in REVIEW_SCHEMA.fieldNames():
        present = present & r[field].isNotNull()
    valid = (
        present & V.normalize_rating(r["overall_rating"]).isNotNull() & (F.size(r["aspects"]) >= 1)
        & _all(r["aspects"], lambda a: a["name"].isNotNull() & V.normalize_rating(a["rating"]).isNotNull()
               & a["key_issue"].isNotNull() & a["analysis"].isNotNull())
        & _all(r["policy_compliance"], lambda c: c["requirement"].isNotNull()
               & c["policy_source"].isNotNull() & V.is_valid_bool(c["compliant"]))
        & _all(r["key_documents"], lambda d: d["document_id"].isNotNull()
               & d["category"].isNotNull() & d["summary"].isNotNull())
        & _all(r["recommendations"], lambda x: x.isNotNull())
        & _all(r["suggested_conditions"], lambda x: x.isNotNull())
    )
    ok = F.col("valid")
    return (
        reviews.withColumn("_a", docs)
        .withColumn("_r", F.when(F.size("_a") == 1, F.col("_a")[0])).drop("_a")
        .withColumn("valid", F.coalesce(valid, F.lit(False)))
        .withColumn("overall_rating", F.when(ok, V.normalize_rating(r["overall_rating"])))
        .withColumn("summary", F.when(ok, r["summary"]))
        .withColumn("aspects", F.when(ok, F.transform(r["aspects"], lambda a: F.struct(
            a["name"].alias("name"), V.normalize_rating(a["rating"]).alias("rating"),
            a["key_issue"].alias("key_issue"), a["analysis"].alias("analysis")))))
        .withColumn("policy_compliance", F.when(ok, F.transform(r["policy_compliance"], lambda c: F.struct(
            c["requirement"].alias("requirement"), c["policy_source"].alias("policy_source"),
            V.coerce_bool(c["compliant"]).alias("compliant"), c["notes"].alias("notes")))))
        .withColumn("recommendations", F.when(ok, r["recommendations"]))
        .withColumn("suggested_conditions", F.when(ok, r["suggested_conditions"]))
        .withColumn("key_documents", F.when(ok, F.transform(r["key_documents"], lambda d: F.struct(
            d["document_id"].alias("document_id"), V.coerce_category(d["category"]).alias("category"),
            d["summary"].alias("summary")))))
        .drop("_r")
    )


def rate_reviews(parsed: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Rating of the structured part, else the one read from the written report."""
    return parsed.withColumn("rating", F.coalesce(
        "overall_rating", V.fallback_rating(F.coalesce(F.col(markdown), F.lit("")))))


# --- documents between reviews ----------------------------------------------

def diff_manifest(previous: DataFrame, selected: DataFrame, by="application_ref") -> DataFrame:
    """Every document of either side with ``change``: reused, new or removed."""
    keys = [by, "document_id"]
    old = previous.select(*keys, F.lit(True).alias("_old")).distinct()
    now = selected.select(*keys, F.lit(True).alias("_now")).distinct()
    return (
        old.join(now, keys, "full_outer")
        .withColumn("change", F.when(F.col("_old").isNull(), "new").when(F.col("_now").isNull(), "removed").otherwise("reused"))
        .drop("_old", "_now")
    )


def diff_counts(diff: DataFrame, by="application_ref") -> DataFrame:
    return diff.groupBy(by).agg(*[
        F.count_if(F.col("change") == c).alias(f"documents_{c}") for c in ("reused", "new", "removed")])


def removed_documents(previous: DataFrame, selected: DataFrame) -> DataFrame:
    """Document ids of the manifest that are no longer selected."""
    return previous.select("document_id").distinct().join(
        selected.select("document_id"), "document_id", "left_anti")


def backfill_key_documents(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """Title and address of key documents from the document metadata, one row per item."""
    known = metadata.groupBy("document_id").agg(F.max(F.struct("description", "url")).alias("m"))
    return items.join(known, "document_id", "left").select(
        *items.columns, F.coalesce("m.description", F.lit(R.UNKNOWN_DOCUMENT)).alias("title"),
        F.col("m.url").alias("url"))


# --- evidence ---------------------------------------------------------------

def evidence_union(application_hits: DataFrame, policy_hits: DataFrame) -> DataFrame:
    """Application and policy hits as one table: (review_id, kind, ord, origin, text)."""
    return application_hits.select(
        "review_id", F.lit("application").alias("kind"), "ord",
        F.coalesce("source_file", F.lit("Unknown document")).alias("origin"), "text",
    ).unionByName(policy_hits.select(
        "review_id", F.lit("policy").alias("kind"), "ord",
        F.coalesce("source", F.lit("Unknown policy")).alias("origin"), "text"))


def assemble_evidence(hits: DataFrame, application_hits: int = None, policy_hits: int = None) -> DataFrame:
    """Evidence texts per review: the hits of each kind in order, each under its origin.

    All hits, unless the report asks for the first ones only; then ``left_out`` counts what it does not show.
    """
    w = Window.partitionBy("review_id", "kind").orderBy("ord", "origin", "text")
    ranked, shown = hits.withColumn("rn", F.row_number().over(w)), F.lit(True)
    for kind, cap in (("application", application_hits), ("policy", policy_hits)):
        if cap is not None:
            shown = shown & ((F.col("kind") != kind) | (F.col("rn") <= cap))
    capped = ranked.withColumn("shown", shown)
    entry = F.concat(F.lit("["), "origin", F.lit("] "), "text")

    def joined(kind, default):
        listed = F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & F.col("shown"), F.struct("rn", entry.alias("e")))))
        body = F.array_join(F.transform(listed, lambda x: x["e"]), R.EVIDENCE_JOINER)
        return F.when(F.count_if(F.col("kind") == kind) > 0, body).otherwise(default)

    return capped.groupBy("review_id").agg(
        joined("application", R.NO_APPLICATION_EVIDENCE).alias("application_evidence"),
        joined("policy", R.NO_POLICY_EVIDENCE).alias("policy_evidence"), F.count_if(~F.col("shown")).alias("left_out"))


def verification_rollup(claims: DataFrame, reviews: DataFrame = None) -> DataFrame:
    """Verified and unverified claims per review and the status they give.

    A review without claims is verified; pass ``reviews`` to list those too.
    """
    per = claims.groupBy("review_id").agg(
        F.count_if("verified").alias("verified_claims"), F.count("*").alias("total_claims"))
    if reviews is not None:
        per = reviews.select("review_id").distinct().join(per, "review_id", "left").fillna(0)
    missed = F.col("total_claims") - F.col("verified_claims")
    return per.withColumn("unverified_claims", missed).withColumn(
        "status", F.when(missed == 0, "verified").when(F.col("verified_claims") > 0, "partial").otherwise("failed"))
