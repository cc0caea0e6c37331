"""Readers and writers: document trees, page tables, JSON lines, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe.functions import ids
from ragframe.functions.text import is_blank, redact
from ragframe.settings import PAGE_MARK, PAGED_SUFFIX, TEXT_SUFFIXES
from ragframe.sources import paths
from ragframe.sources.tree import list_files, read_files

_SCANNED_SCHEMA = "rel_path string, page_no int, text string, error string"


def read_tree(spark: SparkSession, base: str) -> DataFrame:
    """Text files below ``base`` as (rel_path, text); bytes that are no UTF-8 are dropped.

    Order rows by ``rel_path`` where order matters; the files come in any order.
    """
    files = read_files(spark, base, list_files(spark, base, TEXT_SUFFIXES))
    return files.select("rel_path", utf8_text(F.col("content")).alias("text"))


@F.arrow_udf(T.StringType())
def _decoded(contents: pa.Array) -> pa.Array:
    texts = (None if c is None else c.decode("utf-8", "ignore") for c in contents.to_pylist())
    return pa.array(list(texts), pa.string())


def utf8_text(content):
    """Text without the bytes that are no UTF-8; replacement characters that a file holds stay.

    Only contents with such bytes go to Python.
    """
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(_decoded(F.when(~F.is_valid_utf8(text), content)))


def read_paged(
    spark: SparkSession, base: str, page_texts: Callable[[bytes], Iterable[str | None]]
) -> DataFrame:
    """Pages of the paged files below ``base`` as (rel_path, page_no, text).

    ``page_texts`` turns the bytes of a file into its page texts. If it fails
    part way, the pages it gave before count and the rest of the file is left
    out; :func:`scan_paged` tells which files these are.
    """
    return paged_rows(scan_paged(spark, base, page_texts))


def scan_paged(
    spark: SparkSession, base: str, page_texts: Callable[[bytes], Iterable[str | None]]
) -> DataFrame:
    """Pages and failures of the paged files below ``base``, from one pass.

    (rel_path, page_no, text, error): a file that fails has a last row without
    text, with the number of the page that could not be read and the error.
    Keep the rows (a checkpoint, a table) to use both parts of them.
    """
    files = read_files(spark, base, list_files(spark, base, (PAGED_SUFFIX,)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rel_path, content in zip(batch["rel_path"], batch["content"], strict=True):
                pages: list[str | None] = []
                errors: list[str | None] = []
                try:
                    for text in page_texts(bytes(content)):
                        pages.append(text or "")
                        errors.append(None)
                except Exception as error:
                    pages.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
                numbers = range(1, len(pages) + 1)
                yield pd.DataFrame(
                    {"rel_path": rel_path, "page_no": numbers, "text": pages, "error": errors}
                )

    return files.mapInPandas(read, _SCANNED_SCHEMA)


def paged_rows(scanned: DataFrame) -> DataFrame:
    """The pages of :func:`scan_paged`: (rel_path, page_no, text)."""
    return scanned.filter(F.col("error").isNull()).drop("error")


def failed_files(scanned: DataFrame) -> DataFrame:
    """The files of :func:`scan_paged` that failed: (rel_path, error, pages_read)."""
    failed = scanned.filter(F.col("error").isNotNull())
    return failed.select("rel_path", "error", (F.col("page_no") - 1).alias("pages_read"))


def text_to_documents(files: DataFrame, redaction: bool = True) -> DataFrame:
    """One redacted document per text file; empty files give a document too."""
    return files.select(
        F.col("rel_path").alias("source_id"),
        F.col("rel_path").alias("source_path"),
        ids.doc_type(F.col("rel_path")).alias("doc_type"),
        redact(F.col("text"), redaction).alias("text"),
    )


def pages_to_documents(pages: DataFrame, redaction: bool = True) -> DataFrame:
    """One redacted document per page; pages that are blank afterwards are dropped."""
    docs = pages.select(
        F.concat("rel_path", F.lit(PAGE_MARK), F.col("page_no").cast("string")).alias("source_id"),
        F.col("rel_path").alias("source_path"),
        ids.doc_type(F.col("rel_path")).alias("doc_type"),
        redact(F.coalesce("text", F.lit("")), redaction).alias("text"),
    )
    return docs.filter(~is_blank(F.col("text")))


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Line-delimited JSON; blank lines are skipped, a missing path gives no rows."""
    if not paths.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def union_questions(base: DataFrame, more: DataFrame) -> DataFrame:
    """Both question sets, duplicates kept; a column only one has is null in the other."""
    return base.unionByName(more, allowMissingColumns=True)


def write_report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Evaluation rows and their summary as JSON below ``path``."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/rows")
    summary.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/summary")
