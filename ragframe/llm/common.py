"""Pieces that the corpus operators share: tables, hold-outs, written steps, filters of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe.session import new_path

# White space and words as the contracts define them (ASCII only).
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# Rows and bytes per Arrow batch for whole texts, so that a batch of long ones fits a worker.
TEXT_BATCH_ROWS = 1000
TEXT_BATCH_BYTES = 4 << 20

# Bits of a membership filter: 2**26 bits are 8 MB, whatever the input.
FILTER_BITS = 26

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column, parts: int, rest: int) -> Column:
    """crc32 of the id as text leaves ``rest``; false for a null id."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % F.lit(parts) == F.lit(rest), F.lit(False))


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a step to the shared folder and go on from there: lineage ends, losses are cheap."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of this session, which plans read when they run; smaller settings stay."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= TEXT_BATCH_ROWS:
        spark.conf.set(rows, TEXT_BATCH_ROWS)
    spark.conf.set(size, TEXT_BATCH_BYTES)


def text_batches(df: DataFrame, function: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """mapInArrow with batches that are small enough for whole texts."""
    _small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def with_text_column(
    docs: DataFrame, name: str, kind: str, start: Callable[[], Callable[[pa.Array], pa.Array]], text: Column | None = None
) -> DataFrame:
    """``docs`` with a column that tasks work out from whole texts; one of that name is replaced.

    Only the texts go to Python and only the column comes back. ``start`` makes a task's function from an Arrow array
    of texts to one of values.
    """
    _small_batches(docs.sparkSession)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = start()
        for texts in batches:
            yield work(texts)

    # not repeatable: a filter on the column must not work it out once more
    value = run.asNondeterministic()(F.col("text") if text is None else text)
    return docs.drop(name).withColumn(name, value)


def shared(spark: SparkSession, model) -> Callable:
    """Hand a model of bounded size to all tasks; the result gives it back there.

    Broadcasts name classes by their module. Pickled as tasks are, workers need no package of ours.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: cloudpickle.loads(held.value)


def raw_text(name: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit("").cast("binary"))


class WordRows(dict):
    """Word -> row number, worked out once per distinct word; emptied when ``limit`` words are held."""

    def __init__(self, make: Callable[[bytes], int], limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rest: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents outside the hold-out: (text, label), chosen by a hash of the id.

    A document with several labels gets the largest; null labels and texts are left out.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.where(~rest).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").where("text is not null")
    # the chosen ids are bounded by ``rows``
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "label")


def membership(ids: DataFrame, size: int = FILTER_BITS, hashed: bool = False) -> np.ndarray:
    """A one-hash filter of 2**size bits over the single column of ``ids`` (with ``hashed``, 64-bit hashes already).

    False positives only cost work; the answer "absent" is always right.
    """
    key = F.col(ids.columns[0])
    place = F.pmod(key if hashed else F.xxhash64(key), F.lit(1 << size))
    words = (
        ids.select(place.alias("p"))
        .select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toArrow()
    )
    bits = np.zeros(1 << (size - 6), np.uint64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return bits


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be members."""
    place = hashes.view(np.uint64) & np.uint64(64 * bits.size - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def member(bits: np.ndarray):
    """:func:`may_hold` as a column function of an xxhash64 value."""

    @F.arrow_udf(T.BooleanType())
    def check(hashes: pa.Array) -> pa.Array:
        return pa.array(may_hold(bits, hashes.to_numpy()))

    return check
