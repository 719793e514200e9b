"""Ratings, categories and codes in review results."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from hedgerow.functions.text import contains_any, strip
from hedgerow.rules import reviews as V


def normalize_rating(rating: Column) -> Column:
    """Trimmed lower case; null where it is none of the three ratings."""
    text = F.lower(strip(rating))
    return F.when(text.isin(*V.RATINGS), text)


def is_valid_bool(value: Column) -> Column:
    return value.isNull() | F.lower(value).isin(*V.TRUE_WORDS, *V.FALSE_WORDS)


def coerce_bool(value: Column) -> Column:
    """A missing value is false; a word that is neither yes nor no is null (invalid)."""
    word = F.lower(value)
    return (F.when(value.isNull(), False).when(word.isin(*V.TRUE_WORDS), True)
            .when(word.isin(*V.FALSE_WORDS), False))


def coerce_category(category: Column) -> Column:
    low = F.lower(category)
    chain = F.when(category.isin(*V.CATEGORIES), category)
    for name, words in V.CATEGORY_WORDS:
        chain = chain.when(contains_any(low, words), name)
    return F.when(category.isNotNull(), chain.otherwise(V.CATEGORIES[-1]))


def strip_code_fence(text: Column) -> Column:
    """Drop the opening fence line and, where it is the last line, the closing one."""
    body = strip(text)
    inner = F.regexp_replace(F.regexp_replace(body, r"\A[^\n]*(?:\n|\z)", ""), r"(?U)(?:\n|\A)[^\S\n]*```[^\S\n]*\z", "")
    return F.when(body.startswith("```"), inner).otherwise(body)


def fallback_rating(markdown: Column) -> Column:
    low = F.lower(markdown)
    return (F.when(contains_any(low, V.RED_MARKS), "red")
            .when(contains_any(low, V.GREEN_MARKS), "green").otherwise("amber"))


def error_code(message: Column) -> Column:
    return (F.when(message.contains("Scraper error"), "scraper_error")
            .when(F.lower(message).contains("cancelled"), "review_cancelled")
            .when(message.contains("No documents"), "ingestion_failed")
            .otherwise("review_failed"))
