"""Text corpora: chunking, reassembly, embedding and ingest of many documents at once.

``doc_pages(document_id, page_number, text, extraction_method, image_area, page_area,
contains_drawings)`` is where page texts start from.
"""

from collections import namedtuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.functions import dates
from hedgerow.functions import text as T
from hedgerow.functions.numbers import round_half_even
from hedgerow.operators import classify, ordered
from hedgerow.operators.lineage import written
from hedgerow.rules import documents as D

CHARS = D.CHUNK_TOKENS * D.CHARS_PER_TOKEN
OVERLAP = D.OVERLAP_TOKENS * D.CHARS_PER_TOKEN
_SLICE = 1 << 20  # characters of texts whose chunks are sent back at a time; a longer text stands alone


def _key_type(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


# --- chunks -----------------------------------------------------------------

def chunk_text(docs: DataFrame, key: str = "document_id", text: str = "text",
               size_tokens: int = D.CHUNK_TOKENS, overlap_tokens: int = D.OVERLAP_TOKENS) -> DataFrame:
    """Chunk whole texts: (key, chunk_index, text, char_count, word_count); blank texts give no row.

    Only key and text cross to Python; texts are unpacked one by one and chunks sent back a few documents at a time, so
    memory does not follow the number of texts in a batch. A document is never shuffled.
    """
    size, overlap = size_tokens * D.CHARS_PER_TOKEN, overlap_tokens * D.CHARS_PER_TOKEN

    def cut(batches):
        import pyarrow as pa

        from hedgerow.functions.splitting import chunk_spans

        for batch in batches:
            keys, bodies = batch.columns
            at, indexes, texts, held = [], [], [], 0
            for row in range(batch.num_rows):
                body = bodies[row].as_py()
                spans = chunk_spans(body, size, overlap)
                at += [row] * len(spans)
                indexes += range(len(spans))
                texts += [body[a:b] for a, b in spans]
                held += len(body)
                if held >= _SLICE or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(at, pa.int64())), pa.array(indexes, pa.int32()), pa.array(texts, pa.string())],
                        ["k", "chunk_index", "text"])
                    at, indexes, texts, held = [], [], [], 0

    schema = f"k {_key_type(docs, key)}, chunk_index int, text string"
    return (
        docs.filter(~T.is_blank(F.col(text))).select(key, text)
        .mapInArrow(cut, schema)
        .select(F.col("k").alias(key), "chunk_index", "text",
                F.length("text").alias("char_count"), T.word_count(F.col("text")).alias("word_count"))
    )


def chunk_pages(pages: DataFrame, key: str = "document_id", size_tokens: int = D.CHUNK_TOKENS,
                overlap_tokens: int = D.OVERLAP_TOKENS) -> DataFrame:
    """Chunk documents given as pages; each chunk knows the pages it covers.

    Pages are sorted within their partition and read as a stream, so one document's text is held
    at a time, not a partition; the chunks of short documents are sent back together.
    """
    size, overlap = size_tokens * D.CHARS_PER_TOKEN, overlap_tokens * D.CHARS_PER_TOKEN

    def cut(batches):
        import pandas as pd

        from hedgerow.functions.splitting import page_chunks

        def rows_of(document, held):
            found = list(page_chunks(held, size, overlap))
            return [(document, i, t, p, len(found)) for i, t, p in found]

        def framed(rows):
            return pd.DataFrame(rows, columns=["k", "chunk_index", "text", "page_numbers", "total_chunks"])

        document, held, rows, waiting = None, [], [], 0
        for batch in batches:
            for k, number, body in batch.itertuples(index=False, name=None):
                if held and k != document:
                    rows += rows_of(document, held)
                    held = []
                    if waiting >= _SLICE:
                        yield framed(rows)
                        rows, waiting = [], 0
                document = k
                held.append((number, body))
                waiting += len(body)
            if rows:
                yield framed(rows)
                rows, waiting = [], 0
        if held:
            yield framed(rows_of(document, held))

    schema = f"k {_key_type(pages, key)}, chunk_index int, text string, page_numbers array<int>, total_chunks long"
    return (
        pages.filter(~T.is_blank(F.col("text")))
        .select(key, F.col("page_number").cast("int"), "text")
        .repartition(F.col(key)).sortWithinPartitions(key, "page_number")
        .mapInPandas(cut, schema)
        .select(F.col("k").alias(key), "chunk_index", "text",
                F.length("text").alias("char_count"), T.word_count(F.col("text")).alias("word_count"),
                "page_numbers", "total_chunks")
    )


def page_offsets(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """Where each non-blank page starts and ends in the joined text of its document.

    The two-character joiner belongs to the following page.
    """
    block = ordered.seq_block("page_number")
    solid = pages.filter(~T.is_blank(F.col("text"))).withColumn("_len", F.length("text").cast("long"))
    total = ordered.running_total(
        solid, [key], ["page_number"], F.col("_len") + 2, "end_offset", block)
    end = F.col("end_offset") - 2
    start = end - F.col("_len")
    return total.select(
        key, "page_number",
        F.when(start > 0, start - 2).otherwise(start).alias("start_offset"), end.alias("end_offset"))


def full_text(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """Text of the non-blank pages, each under a page marker (one row per document by nature)."""
    part = F.concat(F.lit("[Page "), F.col("page_number").cast("string"), F.lit("]\n"), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("page_number", part.alias("part"))))
    return pages.filter(~T.is_blank(F.col("text"))).groupBy(key).agg(
        F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("text"))


def reassemble(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Document text from its chunks in order (one row per document by nature)."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy(key).agg(
        F.count("*").alias("chunk_count"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


# --- page and document facts ------------------------------------------------

def image_ratio(image_area: Column, page_area: Column) -> Column:
    return F.when(page_area == 0, 0.0).otherwise(F.least(F.lit(1.0), image_area / (page_area * 4)))


def page_facts(pages: DataFrame, threshold: float = D.IMAGE_THRESHOLD) -> DataFrame:
    """Add character and word counts, image ratio and whether a page looks like a drawing."""
    return (
        pages.withColumn("char_count", T.char_count(F.col("text")))
        .withColumn("word_count", T.word_count(F.col("text")))
        .withColumn("image_ratio", image_ratio(F.col("image_area"), F.col("page_area")))
        .withColumn("contains_drawings", F.col("image_ratio") > threshold)
    )


def _totals() -> list[Column]:
    low, high = F.min("extraction_method"), F.max("extraction_method")
    return [
        F.count("*").alias("total_pages"),
        F.sum("char_count").alias("total_char_count"),
        F.sum("word_count").alias("total_word_count"),
        F.coalesce(F.bool_or("contains_drawings"), F.lit(False)).alias("contains_drawings"),
        F.coalesce(F.when(low == high, low).when(low != high, "mixed"), F.lit("text_layer")).alias("extraction_method"),
    ]


def document_rollup(facts: DataFrame, key: str = "document_id") -> DataFrame:
    """Totals per document; the extraction method is the only one used, or ``mixed``."""
    return facts.groupBy(key).agg(*_totals())


def image_based(facts: DataFrame, key: str = "document_id", threshold: float = D.IMAGE_THRESHOLD) -> DataFrame:
    """Is the mean image ratio of a document's pages above the threshold?"""
    return (
        facts.groupBy(key)
        .agg(F.avg("image_ratio").alias("average_image_ratio"), F.count("*").alias("page_count"))
        .withColumn("is_image_based", F.col("average_image_ratio") > threshold)
    )


def page_ratios(facts: DataFrame, key: str = "document_id") -> DataFrame:
    """The ratios of a document's pages in order, as the nested form of ``image_based``."""
    ratios = F.array_sort(F.collect_list(F.struct("page_number", "image_ratio")))
    return facts.groupBy(key).agg(F.transform(ratios, lambda r: r["image_ratio"]).alias("page_ratios"))


# --- embedding --------------------------------------------------------------

class HashingEncoder:
    """Offline stand-in for a sentence model: hashed word counts, scaled to unit length."""

    def __init__(self, dim: int = D.EMBEDDING_DIM):
        self.dim = dim

    def encode(self, texts, batch_size: int = 32):
        import re
        import zlib

        import numpy as np

        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, body in enumerate(texts):
            words = re.findall(r"\w+", body.lower()) or [body]
            slots = [zlib.crc32(w.encode("utf-8")) % self.dim for w in words]
            out[i] = np.bincount(slots, minlength=self.dim)
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def embed_chunks(chunks: DataFrame, encoder_factory=HashingEncoder, text: str = "text",
                 out: str = "embedding", batch_size: int = 32) -> DataFrame:
    """Add the embedding of each chunk; blank texts get null.

    ``encoder_factory`` is called once per task; its ``encode(texts, batch_size)`` returns a matrix.  If the factory
    has ``max_chars``, longer texts are cut there and ``truncated`` tells which; without it nothing is cut.
    """
    import pandas as pd
    from collections.abc import Iterator

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_factory()
        for texts in batches:
            held = texts.notna()
            vectors = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if held.any():
                matrix = encoder.encode(texts[held].tolist(), batch_size=batch_size)
                vectors[held] = pd.Series(list(matrix), index=texts.index[held])
            yield vectors

    limit = getattr(encoder_factory, "max_chars", None)
    embedded = chunks.withColumn(out, embed(T.embedding_text(F.col(text), limit)))
    return embedded.withColumn("truncated", F.coalesce(F.length(text) > limit, F.lit(False))) if limit else embedded


# --- ingest -----------------------------------------------------------------

Ingest = namedtuple("Ingest", "status chunks registry")
CHUNK_KEY = ("application_ref", "file_hash", "page_number", "chunk_index")


def not_yet_ingested(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose (document id, full hash) is not registered."""
    return files.join(registry.select("document_id", "file_hash"), ["document_id", "file_hash"], "left_anti")


def _file_outcomes(files: DataFrame, pages: DataFrame, registry: DataFrame) -> DataFrame:
    """One row for each application and hash among ``files``: the first path and what becomes of it.

    Registered files are taken out before their pages are looked at; the facts of the rest are one aggregation of pages.
    """
    named = files.filter("_good").groupBy("application_ref", "file_hash", "document_id").agg(
        F.min("file_path").alias("file_path"), F.min_by("document_type", "file_path").alias("document_type"))
    known = registry.select("document_id", "file_hash", F.lit(True).alias("_known")).distinct()
    named = named.join(known, ["document_id", "file_hash"], "left")
    facts = page_facts(pages.join(named.filter("_known is null").select("file_path"), "file_path", "left_semi"))
    totals = facts.groupBy("file_path").agg(*_totals(), F.avg("image_ratio").alias("average_image_ratio"))
    pdf = T.extension(F.col("file_path")) == ".pdf"
    return (
        named.join(totals, "file_path", "left")
        .withColumn("status", F.when(F.col("_known"), "already_ingested")
                    .when(pdf & (F.col("average_image_ratio") > D.IMAGE_THRESHOLD), "skipped")
                    .when(F.coalesce("total_char_count", F.lit(0)) == 0, "error").otherwise("success"))
        .withColumn("detail", F.when(F.col("status") == "skipped", "image_based")
                    .when(F.col("status") == "error", "no_content"))
        .withColumn("image_ratio", F.when(F.col("status") == "skipped", round_half_even(F.col("average_image_ratio"), 3)))
        .drop("_known", "average_image_ratio", "total_pages")
    )


def ingest_documents(files: DataFrame, pages: DataFrame, registry: DataFrame,
                     encoder_factory=HashingEncoder) -> Ingest:
    """Ingest many files: a status row for each, the chunks to upsert and the registry rows to add.

    ``files(application_ref, file_path, file_hash, document_type)``; ``pages(file_path, page_number,
    text, extraction_method, image_area, page_area)``.  Cheap tests (file type, known hash, image
    ratio) come first, so only pages of new documents are looked at.  A file is known by its application and whole
    hash: of several equal ones in a call the first path is ingested and the others count as already ingested.  Ids
    carry six digits of the hash and are for display; upsert chunks by ``CHUNK_KEY``.

    What becomes of each file and the chunks are written once below ``spark.checkpoint.dir`` during the call; the three
    results read those tables, so a text is split once whatever is done with them.
    """
    files = files.withColumn("document_id", T.document_id(F.col("application_ref"), F.col("file_hash")))
    files = files.withColumn("_good", T.extension(F.col("file_path")).isin(*D.INGESTIBLE_EXTENSIONS))
    outcomes = written(_file_outcomes(files, pages, registry), "ingest-files")
    fresh = outcomes.filter("status = 'success'")
    wanted = pages.join(fresh.select("file_path"), "file_path", "left_semi")
    cut = written(chunk_pages(wanted, "file_path"), "ingest-chunks")
    # the splitter knows a document's number of chunks and says it on each; the first one stands for the document
    outcomes = outcomes.join(cut.filter("chunk_index = 0").select("file_path", "total_chunks"), "file_path", "left")
    # the classifier reads the marked-up full text, and only where no type is given
    texts = full_text(wanted.join(fresh.filter("document_type is null").select("file_path"),
                                  "file_path", "left_semi"), "file_path").withColumnRenamed("text", "_text")
    typed = (
        outcomes.filter("status = 'success'").select(
            "file_path", "application_ref", "document_id", "file_hash", "document_type",
            "extraction_method", "contains_drawings", "total_chunks")
        .join(texts, "file_path", "left")
        .withColumn("_low", F.lower("_text"))
        .withColumn("_name", T.base_name(F.col("file_path")))
        .withColumn("_c", classify.classify_document(F.col("_name"), F.col("_low")))
        .withColumn("classification", F.when(F.col("document_type").isNotNull(), "provided").otherwise(F.col("_c.method")))
        .withColumn("document_type", F.coalesce("document_type", "_c.document_type"))
        .drop("_text", "_low", "_c")
    )
    first_page = F.coalesce(F.try_element_at("page_numbers", F.lit(1)), F.lit(0))
    chunks = embed_chunks(
        cut.drop("total_chunks").join(typed, "file_path").select(
            T.chunk_id(F.col("application_ref"), F.col("file_hash"), first_page, F.col("chunk_index")).alias("chunk_id"),
            "document_id", "application_ref", "file_hash", first_page.alias("page_number"),
            F.col("_name").alias("source_file"), "document_type", "page_numbers",
            "chunk_index", "total_chunks", "extraction_method", "char_count", "word_count", "text"),
        encoder_factory)
    added = typed.select(
        "document_id", "file_path", "file_hash", "application_ref", "document_type",
        F.col("total_chunks").alias("chunk_count"), F.current_timestamp().alias("ingested_at"),
        "extraction_method", "contains_drawings")
    # copies of a file in the same call share what became of the first one
    fate = F.struct(F.col("file_path").alias("first"), "status", "detail", "image_ratio", "total_chunks", "extraction_method",
                    "contains_drawings", "total_char_count", "total_word_count")
    good, first = F.col("_good"), F.col("file_path") == F.col("_fate.first")
    copied = good & ~first & (F.col("_fate.status") == "success")
    status = files.join(
        outcomes.select("application_ref", "file_hash", fate.alias("_fate")), ["application_ref", "file_hash"], "left"
    ).select(
        "application_ref", "file_path", "document_id",
        F.when(copied, "already_ingested").when(good, F.coalesce("_fate.status", F.lit("error"))).otherwise("error").alias("status"),
        F.when(~good, "unsupported_file_type").when(F.col("_fate.first").isNull(), "no_content")
        .when(~copied, F.col("_fate.detail")).alias("detail"),
        F.when(good, F.col("_fate.image_ratio")).alias("image_ratio"),
        F.coalesce(F.when(good & first, F.col("_fate.total_chunks")), F.lit(0)).alias("chunks_created"),
        *(F.when(good & first, F.col(f"_fate.{c}")).alias(c)
          for c in ("extraction_method", "contains_drawings", "total_char_count", "total_word_count")))
    return Ingest(status, chunks, added)


def ingest_policy_revisions(revisions: DataFrame, pages: DataFrame, encoder_factory=HashingEncoder) -> Ingest:
    """Chunk and embed policy revisions; validity and section reference go on every chunk.

    ``revisions(source, revision_id, version_label, effective_from, effective_to)``;
    ``pages(source, revision_id, page_number, text)``.  A revision without text fails.
    ``registry`` of the result holds the revisions' new state.
    """
    key = F.concat_ws("__", "source", "revision_id")
    keyed = revisions.withColumn("_key", key)
    held = pages.withColumn("_key", key).join(keyed.select("_key"), "_key", "left_semi")
    cut = chunk_pages(held, "_key")
    section = T.section_ref(F.col("text"))
    chunks = embed_chunks(
        cut.withColumn("section_ref", section).join(
            keyed.select("_key", "source", "revision_id", "version_label",
                         dates.date_to_int(F.col("effective_from")).alias("effective_from"),
                         dates.date_to_int(F.col("effective_to")).alias("effective_to")), "_key")
        .select(
            T.policy_chunk_id(F.col("source"), F.col("revision_id"), F.col("section_ref"),
                              F.col("chunk_index")).alias("chunk_id"),
            "source", "revision_id", "version_label", "effective_from", "effective_to", "section_ref",
            F.coalesce(F.try_element_at("page_numbers", F.lit(1)), F.lit(0)).alias("page_number"),
            "chunk_index", "text"),
        encoder_factory)
    counts = cut.groupBy("_key").agg(F.count("*").alias("chunk_count"))
    page_counts = held.groupBy("_key").agg(F.count("*").alias("page_count"))
    state = (
        keyed.drop(*[c for c in ("chunk_count", "page_count", "status", "error") if c in keyed.columns])
        .join(counts, "_key", "left").join(page_counts, "_key", "left")
        .fillna(0, ["chunk_count", "page_count"])
        .withColumn("status", F.when(F.col("chunk_count") > 0, "active").otherwise("failed"))
        .withColumn("error", F.when(F.col("chunk_count") == 0, "No text could be extracted from PDF"))
        .drop("_key")
    )
    return Ingest(state.select("source", "revision_id", "status", "chunk_count", "page_count", "error"), chunks, state)


def ingest_summary(status: DataFrame, by: str = "application_ref") -> DataFrame:
    """Ingested, failed and skipped per application; known documents count as ingested."""
    done = F.count_if(F.col("status").isin("success", "already_ingested"))
    return (
        status.groupBy(by)
        .agg(F.count("*").alias("total_documents"), done.alias("ingested_count"),
             F.count_if(F.col("status") == "error").alias("failed_count"),
             F.count_if(F.col("status") == "skipped").alias("skipped_count"))
        .withColumn("progress_percent", round_half_even(
            (F.col("ingested_count") + F.col("failed_count")) / F.col("total_documents") * 100, 1))
        .withColumn("is_complete", F.col("ingested_count") + F.col("failed_count") >= F.col("total_documents"))
    )


def ingest_errors(status: DataFrame) -> DataFrame:
    """The failed documents, one row each."""
    return status.filter("status = 'error'").select("application_ref", "file_path", "detail")


def list_documents(registry: DataFrame, application_ref) -> DataFrame:
    return registry.filter(F.col("application_ref") == application_ref)


def store_stats(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    documents = registry.agg(F.count("*")).scalar()
    return chunks.agg(F.count("*").alias("total_chunks")).withColumn("total_documents", documents)
