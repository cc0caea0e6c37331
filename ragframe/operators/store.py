"""The chunk store: rows with vectors, replaced source by source.

On disk an upsert only adds: the batch's chunks, an index of its sources with
their numbers of chunks, the list of stored sources it replaces, and at last one
commit row. Readers take the committed batches and leave out chunks whose source
a later batch replaced. What an upsert replaces, and how many chunks that are, is
found in the index alone; it opens no chunk file of an earlier batch.
:func:`compact` folds the batches together when the lists have grown.

Chunks lie in Parquet, partitioned by batch and ``doc_type``. Nothing is laid
out by source, so a source with very many chunks fills no single file or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe.functions.ids import with_source_path
from ragframe.functions.metadata import META_TYPE, with_meta
from ragframe.session import checkpointed
from ragframe.settings import BROADCAST_ROWS, INDEX_NAMES, PAGE_MARK
from ragframe.sources import paths

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("h1", T.StringType()),
        T.StructField("h2", T.StringType()),
        T.StructField("h3", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("doc_type", T.StringType()),
        # null in batches that were written without it
        T.StructField("meta", META_TYPE),
    ]
)
# Columns of work on chunks that are no metadata.
_WORK = ("start", "pos", "file", "batch", "doc_order")
_SOURCE = ("source_id", "source_path")
_SOURCE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in _SOURCE])
# A row per source and name under which it can be replaced.
_INDEX_SCHEMA = T.StructType(
    [T.StructField("name", T.StringType()), *_SOURCE_SCHEMA.fields, T.StructField("chunks", T.LongType())]
)
_STATS = ("status", "raw_docs", "chunks", "replaced_sources", "replaced_points")


def source_paths(chunks: DataFrame) -> DataFrame:
    """Distinct source paths among chunks: the sources an upsert replaces."""
    return with_source_path(chunks).select("source_path").distinct()


def _page_prefixes(source_id: Column) -> Column:
    """Everything in front of each page mark of a source id."""
    parts = F.split(source_id, F.lit(PAGE_MARK))
    ends = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    prefixes = F.transform(ends, lambda n: F.array_join(F.slice(parts, F.lit(1), n), PAGE_MARK))
    return F.when(F.size(parts) > 1, prefixes).otherwise(F.array().cast("array<string>"))


def _names() -> Column:
    """Every name under which a source can be replaced."""
    prefixes = _page_prefixes(F.coalesce("source_id", F.lit("")))
    return F.array_compact(F.array_union(F.array("source_path", "source_id"), prefixes))


def replaced_sources(store: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (source_id, source_path) of the store that ``targets`` replaces.

    The stored chunks are first reduced to their distinct sources, whatever the
    number of chunks per source; only those are matched, by equality on every
    name under which a source can be replaced.
    """
    named = store.select(*_SOURCE).distinct().withColumn("_name", F.explode(_names()))
    wanted = targets.select(F.col("source_path").alias("_name")).distinct()
    return named.join(wanted, "_name", "left_semi").select(*_SOURCE).distinct()


def _sources_match() -> Column:
    return (F.col("s.source_id").eqNullSafe(F.col("r.source_id"))) & (
        F.col("s.source_path").eqNullSafe(F.col("r.source_path"))
    )


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint only after counting; otherwise a shuffled join with AQE."""
    rows = df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def replaced(store: DataFrame, targets: DataFrame) -> DataFrame:
    """Stored chunks that belong to one of the target source paths."""
    hit = replaced_sources(store, targets)
    return store.alias("s").join(hit.alias("r"), _sources_match(), "left_semi")


def upsert(store: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store after replacing the sources of ``chunks``, and one row of statistics.

    Sources that vanished stay; a source without chunks replaces nothing.
    """
    incoming = with_source_path(chunks)
    targets = incoming.select("source_path").distinct()
    hit = replaced_sources(store, targets)
    kept = store.alias("s").join(hit.alias("r"), _sources_match(), "left_anti")
    merged = kept.unionByName(incoming, allowMissingColumns=True)
    return merged, ingest_stats(incoming, replaced(store, targets))


def ingest_stats(
    chunks: DataFrame,
    replaced_chunks: DataFrame,
    documents: DataFrame | None = None,
    points: Column | None = None,
) -> DataFrame:
    """status, raw_docs, chunks, replaced_sources, replaced_points in one row.

    ``replaced_chunks`` are counted, or summed up by the aggregate ``points``.
    """
    one = chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.countDistinct("source_path").alias("replaced_sources"),
    )
    gone = replaced_chunks.agg((F.count(F.lit(1)) if points is None else points).alias("replaced_points"))
    raw = (
        documents.agg(F.count(F.lit(1)).alias("raw_docs"))
        if documents is not None
        else chunks.agg(F.countDistinct("source_id").alias("raw_docs"))
    )
    counts = ("raw_docs", "chunks", "replaced_sources", "replaced_points")
    parts = raw.unionByName(one, allowMissingColumns=True)
    total = parts.unionByName(gone, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in counts]
    )
    status = F.when(F.col("raw_docs") == 0, "no_docs_found").otherwise("ok")
    return total.select(status.alias("status"), *counts)


# --- the store on disk -------------------------------------------------------


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of batches; the schema is given, as a batch may have no rows."""
    return spark.read.schema(_batched(schema)).parquet(path)


def _batched(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.LongType())])


def commits(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch: number, label, first batch still in use, statistics."""
    schema = T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("since", T.LongType()),
            T.StructField("status", T.StringType()),
            *[T.StructField(c, T.LongType()) for c in _STATS[1:]],
        ]
    )
    if not paths.exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], _batched(schema))
    return _table(spark, f"{path}/commits", schema)


def with_file(scan: DataFrame) -> DataFrame:
    """Name the file of each row; a filter on it keeps other files closed."""
    return scan.withColumn("file", F.col("_metadata.file_name"))


def _range(spark: SparkSession, path: str) -> tuple[int, int]:
    """First and last batch that readers use; (0, -1) for no store."""
    row = commits(spark, path).agg(F.max("since"), F.max("batch")).first()
    return (0, -1) if row[1] is None else (row[0], row[1])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of the store that no later batch replaced, with their ``file``."""
    since, last = _range(spark, path)
    if last < 0:
        return spark.createDataFrame([], CHUNK_SCHEMA).withColumn("file", F.lit(""))
    chunks = with_file(_table(spark, f"{path}/chunks", CHUNK_SCHEMA)).filter(
        F.col("batch").between(since, last)
    )
    if not paths.exists(spark, f"{path}/replaced"):
        return chunks.drop("batch")
    gone = _replaced(spark, path, since, last)
    later = _sources_match() & (F.col("s.batch") < F.col("r.batch"))
    return chunks.alias("s").join(small(gone).alias("r"), later, "left_anti").drop("batch")


def _write(chunks: DataFrame, path: str) -> None:
    """Write chunks as they come: no shuffle, files follow the input splits.

    Columns without a place of their own are kept as keys of ``meta``.
    """
    chunks = with_meta(chunks, [*CHUNK_SCHEMA.names, *_WORK])
    (
        chunks.select(
            *[
                (F.col(f.name) if f.name in chunks.columns else F.lit(None))
                .cast(f.dataType)
                .alias(f.name)
                for f in CHUNK_SCHEMA.fields
            ]
        )
        .write.mode("overwrite")
        .partitionBy("doc_type")
        .parquet(path)
    )


def _write_index(chunks: DataFrame, path: str, batch: int) -> None:
    """The sources among a batch's chunks, sorted by name within files and with a bloom filter on it."""
    sources = chunks.groupBy(*_SOURCE).agg(F.count(F.lit(1)).alias("chunks"))
    named = sources.select(F.explode(_names()).alias("name"), *_SOURCE, "chunks").sortWithinPartitions("name")
    writer = named.write.mode("overwrite").option("parquet.bloom.filter.enabled#name", "true")
    writer.parquet(f"{path}/sources/batch={batch}")


def _indexed(spark: SparkSession, path: str, targets: DataFrame, since: int, last: int) -> DataFrame:
    """(source_id, source_path, batch, chunks) of the visible sources that ``targets`` replaces."""
    if not paths.exists(spark, f"{path}/sources"):
        raise ValueError(f"{path} has no index of its sources; compact the store first")
    names = targets.select(F.col("source_path").alias("name")).distinct()
    few = [r["name"] for r in names.limit(INDEX_NAMES + 1).collect()]
    index = _table(spark, f"{path}/sources", _INDEX_SCHEMA).filter(F.col("batch").between(since, last))
    if len(few) <= INDEX_NAMES:
        # literals reach the scan: row groups without these names stay closed
        found = index.filter(F.col("name").isin([n for n in few if n is not None]))
    else:
        found = index.join(names, "name", "left_semi")
    found = found.select(*_SOURCE, "batch", "chunks").distinct()
    if not paths.exists(spark, f"{path}/replaced"):
        return found
    later = _sources_match() & (F.col("s.batch") < F.col("r.batch"))
    gone = _replaced(spark, path, since, last)
    return found.alias("s").join(gone.alias("r"), later, "left_anti")


def _replaced(spark: SparkSession, path: str, since: int, last: int) -> DataFrame:
    """(source_id, source_path, batch): the last batch that replaced a source."""
    rows = _table(spark, f"{path}/replaced", _SOURCE_SCHEMA)
    rows = rows.filter((F.col("batch") > since) & (F.col("batch") <= last))
    return rows.groupBy(*_SOURCE).agg(F.max("batch").alias("batch"))


def _commit(stats: DataFrame, path: str, batch: int, since: int, label: str | None) -> DataFrame:
    row = stats.withColumns(
        {"label": F.lit(label).cast("string"), "since": F.lit(since).cast("bigint")}
    )
    target = f"{path}/commits/batch={batch}"
    row.coalesce(1).write.mode("overwrite").parquet(target)
    return stats.sparkSession.read.parquet(target).select(*_STATS)


def write_store(chunks: DataFrame, path: str) -> DataFrame:
    """Start a store with these chunks, or upsert them into the one at ``path``."""
    return upsert_store(chunks.sparkSession, path, chunks)


def upsert_store(
    spark: SparkSession,
    path: str,
    chunks: DataFrame,
    documents: DataFrame | None = None,
    label: str | None = None,
) -> DataFrame:
    """Replace-by-source upsert; returns the statistics row.

    Until the commit row is there, readers see the store as before, and a run
    that dies is repeated under the same batch number. A ``label`` that was
    committed before is not applied again. One writer at a time.
    """
    since, last = _range(spark, path)
    if label is not None:
        before = commits(spark, path).filter(F.col("label") == label)
        if before.limit(1).count():
            return before.select(*_STATS)
    batch = last + 1
    target = f"{path}/chunks/batch={batch}"
    _write(with_source_path(chunks), target)
    # Chunks are split and embedded once; the rest reads what was written.
    incoming = spark.read.schema(CHUNK_SCHEMA).parquet(target)
    _write_index(incoming, path, batch)
    replaced_path = f"{path}/replaced/batch={batch}"
    targets = incoming.select("source_path").distinct()
    if last < 0:
        hit = spark.createDataFrame([], _batched(_SOURCE_SCHEMA)).withColumn("chunks", F.lit(0).cast("bigint"))
    else:
        hit = checkpointed(_indexed(spark, path, targets, since, last))
    hit.select(*_SOURCE).distinct().write.mode("overwrite").parquet(replaced_path)
    points = F.coalesce(F.sum("chunks"), F.lit(0))
    return _commit(ingest_stats(incoming, hit, documents, points), path, batch, since, label)


def compact(spark: SparkSession, path: str) -> DataFrame:
    """Write the visible chunks as one new batch and drop the batches before it."""
    since, last = _range(spark, path)
    batch = last + 1
    target = f"{path}/chunks/batch={batch}"
    live = read_store(spark, path)
    _write(live, target)
    kept = spark.read.schema(CHUNK_SCHEMA).parquet(target)
    _write_index(kept, path, batch)
    stats = _commit(ingest_stats(kept, kept.limit(0)), path, batch, batch, None)
    for old in range(since, batch):
        paths.remove(spark, f"{path}/chunks/batch={old}")
        paths.remove(spark, f"{path}/replaced/batch={old}")
        paths.remove(spark, f"{path}/sources/batch={old}")
    return stats


def sample(store: DataFrame, limit: int = 10, after: str | None = None) -> DataFrame:
    """First chunks after a given id with their filled fields; ids page the store.

    The last id of a page is the ``after`` of the next one.
    """
    wanted = store if after is None else store.filter(F.col("chunk_id") > after)
    fields = [c for c in store.columns if c not in ("chunk_id", "embedding", "file", "meta")]
    keys = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in fields]))
    if "meta" in store.columns:
        filled = F.map_filter("meta", lambda _, v: v.isNotNull())
        keys = F.array_union(keys, F.coalesce(F.map_keys(filled), F.array().cast("array<string>")))
    return (
        wanted.orderBy("chunk_id")
        .limit(limit)
        .select("chunk_id", "source_id", "doc_type", F.array_sort(keys).alias("metadata_keys"))
    )


def store_info(spark: SparkSession, path: str) -> DataFrame:
    """Does the store exist, and how many chunks does it hold?"""
    if _range(spark, path)[1] < 0:
        return spark.createDataFrame([(False, 0)], "store_exists boolean, points_count bigint")
    return read_store(spark, path).agg(
        F.lit(True).alias("store_exists"), F.count(F.lit(1)).alias("points_count")
    )
