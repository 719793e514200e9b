"""Text columns: matching word lists, cleaning, counting, ids and hashes."""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hedgerow.rules import documents as D


def contains_any(text: Column, words) -> Column:
    """True where the (already lower-cased) text holds any of the words.

    One alternation per list: the text expression appears once per list, not once per word, which
    keeps plans small when a filter on the result is pushed below the projection.
    """
    return text.rlike("|".join(re.escape(w) for w in words))


def count_contained(text: Column, words) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def filled(text: Column) -> Column:
    """Null for an empty string, so that both count as missing."""
    return F.when(text != "", text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def clean_text(text: Column) -> Column:
    """Squash every run of white space to one space and trim."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_label(label: Column) -> Column:
    """Lower-case a form label; colons and white space become one space."""
    return F.trim(F.regexp_replace(F.lower(label), r"(?U)[:\s]+", " "))


def char_count(text: Column) -> Column:
    return F.length(strip(text))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / D.CHARS_PER_TOKEN).cast("long")


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def embedding_text(text: Column, limit: int = None) -> Column:
    """The text an encoder sees, its first ``limit`` characters if it has a limit; null for blank text, which cannot be encoded."""
    return F.when(~is_blank(text), F.substring(text, 1, limit) if limit else text)


def section_ref(text: Column) -> Column:
    """First section reference by kind (chapter before section before paragraph ...)."""
    found = [filled(F.regexp_extract(text, "(?iU)" + p, 1)) for p in D.SECTION_PATTERNS]
    return F.coalesce(*found, F.lit(""))


def is_rendering(file_name: Column) -> Column:
    return stem(file_name).rlike("(?iU)" + D.RENDERING_PATTERN)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def extension(path: Column) -> Column:
    """Suffix with its dot, lower case; empty where the name has none."""
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]+)\z", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+\z", "")


# --- ids and hashes ---------------------------------------------------------

def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def manifest_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def document_id(application_ref: Column, file_hash: Column) -> Column:
    return F.concat_ws("_", F.replace(application_ref, F.lit("/"), F.lit("_")),
                       F.substring(file_hash, 1, 6))


def chunk_id(application_ref: Column, file_hash: Column, page: Column, index: Column) -> Column:
    return F.concat_ws("_", document_id(application_ref, file_hash), padded(page), padded(index))


def padded(number: Column, width: int = 3) -> Column:
    """At least ``width`` digits, never cut."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def policy_chunk_id(source: Column, revision_id: Column, section: Column, index: Column) -> Column:
    safe = F.translate(section, " /", "__")
    return F.concat_ws("__", source, revision_id,
                       F.when(F.coalesce(section, F.lit("")) == "", "doc").otherwise(safe),
                       padded(index))


def revision_id(source: Column, effective_from: Column) -> Column:
    return F.concat(F.lit("rev_"), source, F.date_format(effective_from, "_yyyy_MM"))


# --- links ------------------------------------------------------------------

def resolve_url(href: Column, base: Column) -> Column:
    """Absolute address of a link found on page ``base``; null for an empty link."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.when(base.endswith("/"), base).otherwise(
        F.concat(F.regexp_replace(base, r"/[^/]*\z", ""), F.lit("/")))
    return (
        F.when(F.coalesce(href, F.lit("")) == "", F.lit(None))
        .when(href.startswith("http://") | href.startswith("https://"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(folder, href))
    )


def url_document_id(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 12)


def file_name_from_url(url: Column) -> Column:
    """``fileName`` of the query, else the last path part, else a name made from the address.

    The made-up name uses xxhash64, so it is the same in every run and on every executor.
    """
    named = filled(F.regexp_extract(url, r"[?&]fileName=([^&#]*)", 1))
    last = filled(F.regexp_extract(
        F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"^[^?#]*?([^/?#]*)(?:[?#].*)?\z", 1))
    made = F.concat(F.lit("document_"), F.pmod(F.xxhash64(url), F.lit(2**32)).cast("string"), F.lit(".pdf"))
    return F.coalesce(F.try_url_decode(named), F.try_url_decode(last), made)


def safe_file_name(index: Column, description: Column, keep_spaces: bool = False) -> Column:
    """``001_some_name.pdf``: other characters become underscores, 100 characters at most."""
    kept = r"[^\p{L}\p{N}._\- ]" if keep_spaces else r"[^\p{L}\p{N}._\-]"
    text = F.coalesce(filled(description), F.concat(F.lit("document_"), index.cast("string")))
    safe = F.substring(F.regexp_replace(text, kept, "_"), 1, 100)
    return F.concat(padded(index), F.lit("_"), safe, F.lit(".pdf"))
