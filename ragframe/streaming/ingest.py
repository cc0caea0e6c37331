"""Continuous ingest: new document files are upserted batch by batch."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragframe.functions.vectors import EmbedFn
from ragframe.plans.ingest import ingest_documents
from ragframe.session import shared_dir
from ragframe.sources.files import text_to_documents

FILES_SCHEMA = "rel_path string, text string"


def ingest_stream(
    spark: SparkSession,
    source: str,
    store_path: str,
    checkpoint: str | None = None,
    embed_fn: EmbedFn | None = None,
    max_files: int = 1000,
    available_now: bool = True,
) -> StreamingQuery:
    """Follow Parquet files of (rel_path, text) and keep the store up to date.

    Each batch is committed under its number and the stream's checkpoint, so
    that a batch which is run again after a failure counts once.
    """
    if checkpoint is None:
        # One stream per pair of folders goes on where it stopped.
        name = hashlib.md5(f"{source}\n{store_path}".encode()).hexdigest()
        checkpoint = f"{shared_dir(spark).rstrip('/')}/ingest-stream-{name}"
    stream = spark.readStream.schema(FILES_SCHEMA).option("maxFilesPerTrigger", max_files)
    files = stream.parquet(source).select("*", "_metadata.file_modification_time")

    def upsert_batch(batch: DataFrame, batch_id: int) -> None:
        documents = text_to_documents(_latest(batch))
        ingest_documents(batch.sparkSession, documents, store_path, embed_fn, f"{checkpoint}#{batch_id}")

    writer = files.writeStream.foreachBatch(upsert_batch).option(
        "checkpointLocation", checkpoint
    )
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def _latest(batch: DataFrame) -> DataFrame:
    """The newest text of each path: a path may come twice in one batch."""
    # the text is part of the order, and in the shuffle only there
    newest = F.max(F.struct("file_modification_time", "text"))
    return batch.groupBy("rel_path").agg(newest["text"].alias("text"))
