"""Document types from file names and texts."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.functions.text import count_contained
from hedgerow.rules import documents as D


def _result(kind, confidence, method, matched) -> Column:
    return F.struct(kind.alias("document_type"), F.lit(confidence).alias("confidence"),
                    F.lit(method).alias("method"), matched.alias("matched_pattern"))


def classify_filename(name: Column) -> Column:
    """Type of the first pattern found in the name; null if there is none."""
    def found(pattern, kind):
        return _result(F.lit(kind), "high", "filename", F.lit(pattern))

    chain = None
    for pattern, kind in D.FILENAME_PATTERNS:
        hit = name.rlike("(?iU)" + pattern)
        chain = F.when(hit, found(pattern, kind)) if chain is None else chain.when(hit, found(pattern, kind))
    return chain


def classify_content(low: Column) -> Column:
    """Type with most distinct keywords in the lower-case text (two at least, earlier type wins a tie)."""
    scores = [
        F.struct(count_contained(low, words).alias("score"), F.lit(-i).alias("rank"), F.lit(kind).alias("kind"))
        for i, (kind, words) in enumerate(D.CONTENT_KEYWORDS)
    ]
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] >= D.CONTENT_MINIMUM, _result(
        best["kind"], "medium", "content", F.concat(best["score"].cast("string"), F.lit(" keyword matches"))))


def classify_document(name: Column, low: Column = None) -> Column:
    """By name, else by content, else ``other``; keywords are only counted where the name says nothing."""
    steps = [classify_filename(name)]
    if low is not None:
        steps.append(classify_content(low))
    fallback = _result(F.lit(D.FALLBACK_TYPE), "low", "fallback", F.lit(None).cast("string"))
    return reduce(lambda a, b: F.coalesce(a, b), [*steps, fallback])


def classify_documents(docs: DataFrame, name: str = "file_name", text: str = None) -> DataFrame:
    if text is None:
        return docs.withColumn("_c", classify_document(F.col(name))).select("*", "_c.*").drop("_c")
    return (
        docs.withColumn("_low", F.lower(text))
        .withColumn("_c", classify_document(F.col(name), F.col("_low")))
        .select("*", "_c.*").drop("_c", "_low")
    )
