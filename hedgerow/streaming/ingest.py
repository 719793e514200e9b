"""Idempotent incremental ingest from a stream of documents."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgerow.functions import text as T
from hedgerow.operators import corpus
from hedgerow.sources import sinks


def new_documents(docs: DataFrame, watermark: str = "1 day") -> DataFrame:
    """First arrival of each content within the watermark; ``docs(document_id, text, arrived_at)``."""
    return (
        docs.withColumn("content_hash", T.content_sha256(F.col("text")))
        .withWatermark("arrived_at", watermark)
        .dropDuplicatesWithinWatermark(["content_hash"])
    )


def ingest_stream(docs: DataFrame, chunk_table: str, checkpoint: str, encoder_factory=corpus.HashingEncoder,
                  watermark: str = "1 day"):
    """Chunk, embed and upsert new documents; returns the DataStreamWriter, not started.

    Chunk ids come from the content hash, so a batch that is replayed writes the same keys; the commit names its batch,
    and a batch that was committed before the stream stopped is left out.  A batch rewrites the buckets it touches.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        cut = corpus.chunk_text(batch, "content_hash", "text").withColumn(
            "chunk_id", F.concat_ws("_", "content_hash", T.padded(F.col("chunk_index"))))
        embedded = corpus.embed_chunks(cut, encoder_factory).persist(StorageLevel.DISK_ONLY)  # read for buckets and rows
        try:
            sinks.upsert_chunks(embedded, chunk_table, token=f"{checkpoint}#{batch_id}")
        finally:
            embedded.unpersist()

    return (
        new_documents(docs, watermark).writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint).outputMode("append")
    )
