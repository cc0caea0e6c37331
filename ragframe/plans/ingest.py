"""Documents to store: redacted documents in, chunks with ids and vectors out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.functions.ids import with_chunk_id, with_chunk_index, with_source_path
from ragframe.functions.metadata import with_meta
from ragframe.functions.vectors import EmbedFn, embed
from ragframe.operators.chunking import split_documents
from ragframe.operators.store import small, upsert_store
from ragframe.session import checkpointed
from ragframe.sources.files import (
    pages_to_documents,
    read_paged,
    read_tree,
    text_to_documents,
)

DOCUMENT_COLUMNS = ("source_id", "source_path", "doc_type", "text", "h1", "h2", "h3")


def chunk_documents(documents: DataFrame) -> DataFrame:
    """Split redacted documents and give every chunk its number and id.

    One pass without a shuffle where a document holds all chunks of its source
    id. The chunks of sources with several documents are numbered through, over
    the documents in the order of their path and then of their text's digest, so that ids
    do not depend on how the table is read. Columns beyond the named ones go to ``meta``.
    """
    named = with_meta(with_source_path(documents), DOCUMENT_COLUMNS)
    repeated = named.groupBy("source_id").count().filter("count > 1").select("source_id")
    repeated = checkpointed(repeated)
    if repeated.isEmpty():
        return with_chunk_id(split_documents(named))
    repeated = small(repeated)
    single = split_documents(named.join(repeated, "source_id", "left_anti"))
    # A range sort: a source with most documents lies in several parts, and ids grow with its order.
    several = named.join(repeated, "source_id", "left_semi")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    meta = F.to_json(F.array_sort(F.map_entries("meta")))
    in_order = several.orderBy("source_id", "source_path", digest, meta)
    in_order = checkpointed(in_order.withColumn("doc_order", F.monotonically_increasing_id()))
    shared = with_chunk_index(split_documents(in_order), order="doc_order", pos="chunk_index")
    return with_chunk_id(single.unionByName(shared.drop("doc_order")))


def embedded_chunks(documents: DataFrame, embed_fn: EmbedFn | None = None) -> DataFrame:
    return embed(chunk_documents(documents), fn=embed_fn)


def ingest_documents(
    spark: SparkSession,
    documents: DataFrame,
    store_path: str,
    embed_fn: EmbedFn | None = None,
    label: str | None = None,
) -> DataFrame:
    """Chunk, embed and upsert redacted documents; returns the statistics row."""
    chunks = embedded_chunks(documents, embed_fn)
    return upsert_store(spark, store_path, chunks, documents, label)


def load_documents(spark: SparkSession, base: str, page_texts=None) -> DataFrame:
    """Redacted documents of a file tree; paged files need a page reader."""
    documents = text_to_documents(read_tree(spark, base))
    if page_texts is None:
        return documents
    return documents.unionByName(pages_to_documents(read_paged(spark, base, page_texts)))


def ingest_tree(
    spark: SparkSession,
    base: str,
    store_path: str,
    embed_fn: EmbedFn | None = None,
    page_texts=None,
) -> DataFrame:
    return ingest_documents(
        spark, load_documents(spark, base, page_texts), store_path, embed_fn
    )
