"""Filtering listed documents: one pass of CASE expressions, no UDF.

Input ``listed_documents(document_id, description, document_type, ...)``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.functions.numbers import round_half_even
from hedgerow.functions.text import contains_any, extension, filled, is_rendering
from hedgerow.rules import documents as D


def decision(document_type: Column, category: Column, texts: Column, skip_filter: bool = False,
             include_consultation: bool = False, include_public: bool = False) -> Column:
    """struct(allow, reason) of the first rule that applies.

    ``category`` is the lower-case type (null if empty); ``texts`` holds category and title, lower
    case, on separate lines: no phrase holds a line break, so one haystack serves both.
    """
    def verdict(allow, reason):
        return F.struct(F.lit(allow).alias("allow"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    if skip_filter:
        return verdict(True, D.REASON_BYPASSED)
    chain = (
        F.when(texts == "", verdict(True, D.REASON_EMPTY))
        .when(texts.contains(D.SUPERSEDED_WORD), verdict(False, D.REASON_SUPERSEDED))
        .when(category.isin(*D.CATEGORY_ALLOWED),
              verdict(True, F.concat(F.lit(D.REASON_CATEGORY_PREFIX), document_type)))
    )
    if not include_consultation:
        chain = chain.when(category.isin(*D.CATEGORY_CONSULTATION), verdict(False, D.REASON_CATEGORY_CONSULTATION))
    if not include_public:
        chain = chain.when(category.isin(*D.CATEGORY_PUBLIC), verdict(False, D.REASON_CATEGORY_PUBLIC))
    if not include_consultation:
        chain = chain.when(contains_any(texts, D.CONSULTATION_PHRASES), verdict(False, D.REASON_CONSULTATION))
    if not include_public:
        chain = chain.when(contains_any(texts, D.PUBLIC_PHRASES), verdict(False, D.REASON_PUBLIC))
    return (
        chain.when(contains_any(texts, D.CORE_PHRASES), verdict(True, D.REASON_CORE))
        .when(contains_any(texts, D.ASSESSMENT_PHRASES), verdict(True, D.REASON_ASSESSMENT))
        .when(contains_any(texts, D.OFFICER_PHRASES), verdict(True, D.REASON_OFFICER))
        .when(contains_any(texts, D.NON_TRANSPORT_PHRASES), verdict(False, D.REASON_NON_TRANSPORT))
        .otherwise(verdict(True, D.REASON_UNKNOWN))
    )


def filter_documents(docs: DataFrame, skip_filter: bool = False, include_consultation: bool = False,
                     include_public: bool = False) -> DataFrame:
    """Add ``allowed`` and ``filter_reason``; nothing is dropped."""
    verdict = decision(F.col("document_type"), F.col("_category"), F.col("_texts"), skip_filter,
                       include_consultation, include_public)
    return (
        docs.withColumn("_category", F.lower(filled(F.col("document_type"))))
        .withColumn("_texts", F.concat_ws("\n", "_category", F.lower(filled(F.col("description")))))
        .withColumn("_v", verdict)
        .withColumn("allowed", F.col("_v.allow"))
        .withColumn("filter_reason", F.col("_v.reason"))
        .drop("_v", "_category", "_texts")
    )


def post_filter_selected(docs: DataFrame, include_consultation: bool = False,
                         include_public: bool = False) -> DataFrame:
    """Second pass over selected documents: ``removed_by`` names the rule, null if kept.

    Categories are compared trimmed; phrases are looked for in the title only.
    """
    category = F.trim(F.lower(F.coalesce("document_type", F.lit(""))))
    title = F.lower(F.coalesce("description", F.lit("")))
    rules = []
    if not include_consultation:
        rules.append((category.isin(*D.CATEGORY_CONSULTATION), "category_denylist_consultation"))
    if not include_public:
        rules.append((category.isin(*D.CATEGORY_PUBLIC), "category_denylist_public"))
    if not include_consultation:
        rules.append((contains_any(title, D.CONSULTATION_PHRASES), "title_pattern_consultation"))
    if not include_public:
        rules.append((contains_any(title, D.PUBLIC_PHRASES), "title_pattern_public"))
    found = F.coalesce(*[F.when(hit, code) for hit, code in rules], F.lit(None).cast("string"))
    return docs.withColumn("removed_by", found)


def filter_summary(decided: DataFrame, by="application_ref") -> DataFrame:
    """Totals per application and how much the filter took away, in percent."""
    total, kept = F.col("total"), F.col("allowed_count")
    return (
        decided.groupBy(by)
        .agg(F.count("*").alias("total"), F.count_if("allowed").alias("allowed_count"))
        .withColumn("filtered_count", total - kept)
        .withColumn("reduction_pct", round_half_even((1 - kept / total) * 100, 1))
    )


def select_by_ids(docs: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    return docs.join(ids.select(key), key, "left_semi")


def supported_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Add ``file_status``: ``supported`` or ``unsupported_file_type``."""
    good = extension(F.col(path)).isin(*D.INGESTIBLE_EXTENSIONS)
    return files.withColumn("file_status", F.when(good, "supported").otherwise("unsupported_file_type"))


def mark_renderings(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("is_rendering", is_rendering(F.col(path)))


def search_predicate(application_ref=None, document_types=None) -> Column:
    """Equality filters of a search; pushed down to the chunk table's scan."""
    test = F.lit(True)
    if application_ref is not None:
        test = test & (F.col("application_ref") == application_ref)
    if document_types:
        test = test & F.col("document_type").isin(*document_types)
    return test


def retain_unexpired(df: DataFrame, now: Column, stored_at: str = "stored_at", ttl_days: int = 30) -> DataFrame:
    return df.filter(F.col(stored_at) + F.make_dt_interval(F.lit(ttl_days)) > now)
