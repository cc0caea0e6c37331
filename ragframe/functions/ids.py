"""Document identity: type, format, source path, chunk number and chunk id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.settings import (
    EXTERNAL_PREFIX,
    INDEX_BLOCK,
    PAGE_MARK,
    PAGED_SUFFIX,
    UNKNOWN_SOURCE,
    UUID_URL_NAMESPACE,
)


def doc_type(rel_path: Column) -> Column:
    return F.when(rel_path.startswith(EXTERNAL_PREFIX), "external").otherwise("project")


def doc_format(source_id: Column) -> Column:
    """``md``, ``pdf`` (also a page of one) or ``other``, by name only."""
    name = F.lower(source_id)
    paged = name.endswith(PAGED_SUFFIX) | name.contains(PAGED_SUFFIX + PAGE_MARK)
    return F.when(name.endswith(".md"), "md").when(paged, "pdf").otherwise("other")


def with_source_path(df: DataFrame) -> DataFrame:
    """Fill in a missing source id and derive the path a source belongs to."""
    sid = F.coalesce(F.col("source_id"), F.lit(UNKNOWN_SOURCE))
    given = F.nullif(F.col("source_path"), F.lit("")) if "source_path" in df.columns else F.lit(None)
    return df.withColumn(
        "source_path", F.coalesce(given, F.split_part(sid, F.lit(PAGE_MARK), F.lit(1)))
    ).withColumn("source_id", sid)


def chunk_id(source_id: Column, chunk_index: Column) -> Column:
    """Name-based (version 5) UUID of ``source_id::chunk_index`` in the URL namespace."""
    name = F.encode(F.concat(source_id, F.lit("::"), chunk_index.cast("string")), "UTF-8")
    digest = F.sha1(F.concat(F.unhex(F.lit(UUID_URL_NAMESPACE)), name))
    variant = F.conv(F.substring(digest, 17, 2), 16, 10).cast("int")
    variant = F.lower(F.hex(variant.bitwiseAND(63).bitwiseOR(128).cast("bigint")))
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 19, 2),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def with_chunk_id(df: DataFrame) -> DataFrame:
    return df.withColumn("chunk_id", chunk_id(F.col("source_id"), F.col("chunk_index")))


def with_chunk_index(df: DataFrame, order: str = "doc_order", pos: str = "pos") -> DataFrame:
    """Number the chunks of every source from 0, by (``order``, ``pos``).

    ``order`` (a whole number) is the place of the chunk's document within its
    source. One source may hold a large part of all rows, so it is not numbered
    in one window group: blocks of ``INDEX_BLOCK`` order values are numbered on
    their own and then shifted by the sizes of the blocks before, which takes
    one row per block. Sources that fit one block need no shift.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / INDEX_BLOCK))
    local = Window.partitionBy("source_id", "_block").orderBy(order, pos)
    numbered = blocked.withColumn("_local", F.row_number().over(local) - 1)
    before = (
        Window.partitionBy("source_id")
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = (
        blocked.groupBy("source_id", "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.sum("_n").over(before))
        .filter(F.col("_shift") > 0)
        .select("source_id", "_block", "_shift")
    )
    return (
        numbered.join(shifts, ["source_id", "_block"], "left")
        .withColumn(
            "chunk_index", (F.col("_local") + F.coalesce("_shift", F.lit(0))).cast("int")
        )
        .drop("_block", "_local", "_shift")
    )
