"""Approximate search by sign codes: an index of vectors by code, probed by queries.

A table has ``bits`` planes; a vector's code in it tells on which side of each plane
it lies. A plane's numbers are 1 or -1 by a digest of its number and the place, so
that any engine can repeat them. The index holds every vector once per table,
sorted by bucket (table and code). A query probes the bucket of its own code and
those one bit away; only these rows are read from the index into Python, and a pair
that meets in several tables is scored in the first one alone. Scores are exact.

Pairs are never rows: each task keeps a running best list per query, and a code
that much of the corpus shares is split over tasks by chunk id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.operators.scoring import (
    CANDIDATE_SCHEMA,
    Best,
    Names,
    QueryBlock,
    bounded,
    candidate_batch,
    in_scope,
    matrix,
    ranked,
    unit_rows,
)
from ragframe.settings import SCORE_CELLS, SCORE_DECIMALS, SCORE_TASKS

_INDEXED = "bucket long, codes array<int>, chunk_id string, doc_type string, file string"


def planes(dim: int, count: int) -> np.ndarray:
    """``dim`` x ``count`` numbers 1 and -1: 1 where md5 of ``plane:place`` (from 0) begins with a digit below 8."""
    first = [[hashlib.md5(f"{p}:{d}".encode()).hexdigest()[0] for p in range(count)] for d in range(dim)]
    return np.where(np.array(first) < "8", 1.0, -1.0).reshape(dim, count)


def sign_codes(vectors: np.ndarray, sides: np.ndarray, bits: int) -> np.ndarray:
    """One code per vector and table; bit i is set where the vector is not below plane i of the table."""
    signs = (vectors @ sides >= 0).reshape(len(vectors), sides.shape[1] // bits, bits)
    return (signs @ (1 << np.arange(bits))).astype(np.int32)


def probed(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes to look into: the own one and all that differ in one bit."""
    return codes[..., None] ^ np.array([0, *(1 << np.arange(bits))], dtype=codes.dtype)


@dataclass
class SignIndex:
    """A written index: rows by bucket, and the numbers it was made with."""

    rows: DataFrame
    dim: int
    bits: int
    tables: int

    def nearest(self, block: QueryBlock) -> DataFrame:
        """Candidates of one block as :func:`ragframe.operators.scoring.nearest` gives them."""
        return _nearest(self, block)


def build_index(store: DataFrame, path: str, dim: int, bits: int = 7, tables: int = 14) -> SignIndex:
    """Write the index of a store's vectors below ``path``."""
    if not 1 <= bits <= 30 or tables < 1:
        raise ValueError("a code has 1 to 30 bits, an index one table or more")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = planes(dim, bits * tables)
        for batch in bounded(batches, max(dim, bits * tables)):
            vectors = matrix(batch.column("embedding"), dim, batch.column("chunk_id"))
            codes = sign_codes(vectors, sides, bits)
            lists = pa.array(list(codes), pa.list_(pa.int32()))
            others = [batch.column(c) for c in ("chunk_id", "doc_type", "file", "embedding")]
            for t in range(tables):
                bucket = pa.array((t << bits) + codes[:, t].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [bucket, lists, *others],
                    names=["bucket", "codes", "chunk_id", "doc_type", "file", "embedding"],
                )

    file = F.col("file") if "file" in store.columns else F.lit("")
    needed = store.select("chunk_id", "doc_type", file.alias("file"), "embedding")
    kind = store.schema["embedding"].dataType.simpleString()
    # By chunk id as well: a bucket with much of the corpus lies in many parts.
    dealt = needed.mapInArrow(coded, f"{_INDEXED}, embedding {kind}").repartitionByRange("bucket", "chunk_id")
    dealt.sortWithinPartitions("bucket", "chunk_id").write.mode("overwrite").parquet(f"{path}/rows")
    numbers = store.sparkSession.createDataFrame([(dim, bits, tables)], "dim int, bits int, tables int")
    numbers.coalesce(1).write.mode("overwrite").parquet(f"{path}/numbers")
    return read_index(store.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> SignIndex:
    """The index that :func:`build_index` wrote below ``path``."""
    dim, bits, tables = spark.read.parquet(f"{path}/numbers").first()
    return SignIndex(spark.read.parquet(f"{path}/rows"), dim, bits, tables)


def _nearest(index: SignIndex, block: QueryBlock) -> DataFrame:
    bits, tables = index.bits, index.tables
    if block.ids and block.vectors.shape[1] != index.dim:
        raise ValueError(f"the queries have {block.vectors.shape[1]} numbers, the index {index.dim}")
    codes = sign_codes(block.vectors.reshape(len(block.ids), index.dim), planes(index.dim, bits * tables), bits)
    buckets = probed(codes, bits) + (np.arange(tables, dtype=np.int64) << bits)[None, :, None]
    wanted = [int(b) for b in np.unique(buckets)]
    scopes = np.array(block.scopes, dtype=object)
    shared = index.rows.sparkSession.sparkContext.broadcast(
        (block.ids, block.vectors, scopes, block.fetch_k, codes, buckets)
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, scopes, fetch_k, codes, buckets = shared.value
        if not ids:
            return
        best, names = Best(fetch_k), Names()
        flat = buckets.reshape(len(ids), -1)
        order = np.argsort(flat, axis=None, kind="stable")
        sorted_buckets, askers = flat.ravel()[order], order // flat.shape[1]
        for batch in bounded(batches, max(vectors.shape[1], tables)):
            bucket = batch.column("bucket").to_numpy()
            chunks = np.array([c.encode() for c in batch.column("chunk_id").to_pylist()])
            kinds = np.array(batch.column("doc_type").to_pylist(), dtype=object)
            files = names.codes(batch.column("file"))
            rows = unit_rows(matrix(batch.column("embedding"), vectors.shape[1], batch.column("chunk_id")))
            held = batch.column("codes").flatten().to_numpy().reshape(len(bucket), -1)
            # rows come sorted by bucket, so each bucket is one slice of a batch or a few
            begins = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)) if len(bucket) else []
            for begin, end in zip(begins, [*begins[1:], len(bucket)], strict=True):
                lo, hi = np.searchsorted(sorted_buckets, [bucket[begin], bucket[begin] + 1])
                asking = askers[lo:hi]
                step = max(1, SCORE_CELLS // max(1, len(asking)))
                for at in range(begin, end if len(asking) else begin, step):
                    part = slice(at, min(at + step, end))
                    fresh = np.ones((part.stop - at, len(asking)), dtype=bool)
                    for earlier in range(int(bucket[begin]) >> bits):
                        apart = held[part, earlier, None] ^ codes[asking, earlier][None, :]
                        fresh &= (apart & (apart - 1)) != 0
                    for kind in set(kinds[part]):
                        seen = (scopes[asking] == "all") | (scopes[asking] == kind)
                        fresh[np.ix_(kinds[part] == kind, ~seen)] = False
                    row, query = np.nonzero(fresh)
                    if len(row):
                        dots = np.einsum("ij,ij->i", rows[part][row], vectors[asking[query]])
                        distance = np.round(1.0 - dots, SCORE_DECIMALS) + 0.0
                        best.enter(row + at, asking[query], distance, chunks, files)
        if len(best.query):
            yield candidate_batch(ids, best, names)

    rows = in_scope(index.rows, block).filter(F.col("bucket").isin(wanted))
    return ranked(rows.coalesce(SCORE_TASKS).mapInArrow(score, CANDIDATE_SCHEMA), block)


def scored_pairs(index: SignIndex, queries: DataFrame) -> DataFrame:
    """(query_id, pairs): how many rows a search would score for each query (``query_id``, ``qvec``).

    An exact search scores every vector for every query.
    """
    bits, tables, dim = index.bits, index.tables, index.dim

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = planes(dim, bits * tables)
        for batch in bounded(batches, max(dim, (bits + 1) * tables)):
            codes = sign_codes(matrix(batch.column("qvec"), dim, batch.column("query_id")), sides, bits)
            buckets = probed(codes, bits) + (np.arange(tables, dtype=np.int64) << bits)[None, :, None]
            per_query = buckets.reshape(len(codes), -1)
            names = batch.column("query_id").take(pa.array(np.repeat(np.arange(len(codes)), per_query.shape[1])))
            yield pa.RecordBatch.from_arrays([names, pa.array(per_query.ravel())], names=["query_id", "bucket"])

    asking = queries.select(F.col("query_id").cast("string"), "qvec")
    probes = asking.mapInArrow(asked, "query_id string, bucket long")
    met = probes.join(index.rows.select("bucket", "chunk_id"), "bucket").select("query_id", "chunk_id").distinct()
    return met.groupBy("query_id").agg(F.count(F.lit(1)).alias("pairs"))
