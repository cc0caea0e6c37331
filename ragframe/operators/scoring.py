"""Exact nearest neighbours of a block of queries in one scan of the store.

The block (bounded in rows and bytes, see ``query_blocks``) is broadcast; every
task multiplies its Arrow batches with it and keeps a running best list per
query, so a task returns at most ``fetch_k`` rows per query and pairs are never
materialised. A window over those short lists makes the final cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragframe.settings import BUFFER_ROWS, SCORE_CELLS, SCORE_DECIMALS, SCORE_TASKS

CANDIDATE_SCHEMA = "query_id string, chunk_id string, vec_score double, file string"


@dataclass
class QueryBlock:
    """What a task needs to know about a bounded set of queries."""

    ids: list[str]
    vectors: np.ndarray
    scopes: list[str]
    fetch_k: np.ndarray
    params: pd.DataFrame
    modes: set[str]
    question_bytes: int = 0
    only: bool = True

    @property
    def max_fetch(self) -> int:
        return int(self.fetch_k.max()) if len(self.fetch_k) else 0


def bounded(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of SCORE_CELLS numbers at most, ``width`` of them to a row.

    What a task works out from a slice is as large whatever Arrow batches and tables are like.
    """
    step = max(1, SCORE_CELLS // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row stays zero (distance 1 to all)."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
    return matrix / np.where(norms == 0, 1, norms)


def matrix(column: pa.Array, dim: int, names: pa.Array) -> np.ndarray:
    """List column as a dense float64 matrix; a missing vector becomes zeros."""
    sizes = column.value_lengths().fill_null(dim).to_numpy(zero_copy_only=False)
    for odd in np.flatnonzero(sizes != dim)[:1]:
        raise ValueError(f"chunk {names[odd]} has a vector of {sizes[odd]} numbers, the queries {dim}")
    if column.null_count:
        rows = [v if v is not None else [0.0] * dim for v in column.to_pylist()]
        return np.array(rows, dtype=np.float64).reshape(-1, dim)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


_COLUMNS = ("query", "distance", "chunk", "file")


class Best:
    """Running best list per query: smallest distance, then smallest chunk id.

    What may enter waits in a buffer. When that is full, it is sorted into the lists, whose last places are the limits
    for what follows; until then older limits let a little too much in.
    """

    def __init__(self, fetch_k: np.ndarray, room: int | None = None):
        self.fetch_k = fetch_k
        self.room = room or max(BUFFER_ROWS, 2 * int(fetch_k.sum()))
        # Distance and chunk id of the last place of each full list.
        self.limit = np.full(len(fetch_k), np.inf)
        self.last = np.zeros(len(fetch_k), dtype="S1")
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.waits = 0
        self.lists = (np.empty(0, np.int64), np.empty(0), np.empty(0, "S1"), np.empty(0, np.int64))

    def add(self, distance: np.ndarray, chunks: np.ndarray, files: np.ndarray) -> None:
        deepest = min(int(self.fetch_k.max()), len(distance))
        bound = self.limit
        if deepest < len(distance) and not np.isfinite(self.limit).all():
            # Lists that are not full: the deepest wanted distance of this slice already bounds them.
            cut = np.partition(distance, deepest - 1, axis=0)[deepest - 1]
            bound = np.minimum(self.limit, cut)
        # entrants are few once the lists are full, so a flat search beats one by row and column
        place = np.flatnonzero(distance <= bound)
        near = distance.ravel()[place]
        row, query = np.divmod(place, distance.shape[1])
        # Copies tie with the last place in great numbers: only smaller ids get in.
        enters = np.isfinite(near) & ((near < self.limit[query]) | (chunks[row] < self.last[query]))
        row, query, near = row[enters], query[enters], near[enters]
        # the first lists are made at once, as there are no limits before
        self._hold(query, near, chunks[row], files[row], not np.isfinite(self.limit).any())

    def enter(
        self, row: np.ndarray, query: np.ndarray, near: np.ndarray, chunks: np.ndarray, files: np.ndarray
    ) -> None:
        """Take single pairs, none of them twice, instead of a slice of rows for all queries."""
        limit = self.limit[query]
        enters = (near < limit) | ((near == limit) & (chunks[row] < self.last[query]))
        row = row[enters]
        self._hold(query[enters], near[enters], chunks[row], files[row], False)

    def _hold(
        self, query: np.ndarray, near: np.ndarray, chunks: np.ndarray, files: np.ndarray, at_once: bool
    ) -> None:
        if not len(query):
            return
        self.waiting.append((query, near, chunks, files))
        self.waits += len(query)
        if self.waits >= self.room or at_once:
            self.settle()

    def settle(self) -> None:
        """Sort the buffer into the lists."""
        if not self.waiting:
            return
        held = [self.lists, *self.waiting]
        query, dist, chunk, file = (np.concatenate([part[i] for part in held]) for i in range(4))
        self.waiting, self.waits = [], 0
        order = np.lexsort((chunk, dist, query))
        query, dist, chunk, file = query[order], dist[order], chunk[order], file[order]
        begins = np.searchsorted(query, np.arange(len(self.fetch_k)))
        rank = np.arange(len(query)) - begins[query]
        kept = rank < self.fetch_k[query]
        last = rank == self.fetch_k[query] - 1
        self.limit[query[last]] = dist[last]
        self.last = self.last.astype(np.promote_types(self.last.dtype, chunk.dtype))
        self.last[query[last]] = chunk[last]
        self.lists = (query[kept], dist[kept], chunk[kept], file[kept])

    def __getattr__(self, name: str) -> np.ndarray:
        """query, distance, chunk and file of the lists, with all that waited."""
        if name not in _COLUMNS:
            raise AttributeError(name)
        self.settle()
        return self.lists[_COLUMNS.index(name)]


class Names:
    """Numbers for the file names seen by a task (few, each for many rows)."""

    def __init__(self):
        self.known: list[str | None] = []
        self._number: dict[str | None, int] = {}

    def codes(self, column: pa.Array) -> np.ndarray:
        encoded = column.dictionary_encode()
        numbers = []
        for name in encoded.dictionary.to_pylist():
            if name not in self._number:
                self._number[name] = len(self.known)
                self.known.append(name)
            numbers.append(self._number[name])
        return np.array(numbers, dtype=np.int64)[encoded.indices.to_numpy(zero_copy_only=False)]


def in_scope(store: DataFrame, block: QueryBlock) -> DataFrame:
    """Only the document types any query of the block may see.

    A literal predicate: it reaches the Parquet scan and prunes partitions.
    """
    scopes = sorted(set(block.scopes))
    return store if "all" in scopes else store.filter(F.col("doc_type").isin(scopes))


def nearest(store: DataFrame, block: QueryBlock) -> DataFrame:
    """Candidates ``(query_id, chunk_id, vec_score, file, vec_rank)`` of one block.

    ``store`` needs chunk_id, doc_type and embedding, and may name the ``file``
    of a row, which is handed through.
    """
    file = F.col("file") if "file" in store.columns else F.lit("")
    columns = ["chunk_id", "embedding", file.alias("file")]
    needed = in_scope(store, block)
    if len(set(block.scopes)) > 1:
        columns.append("doc_type")
    shared = store.sparkSession.sparkContext.broadcast(
        (block.ids, block.vectors, block.scopes, block.fetch_k)
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scored(batches, *shared.value)

    return ranked(needed.select(*columns).coalesce(SCORE_TASKS).mapInArrow(score, CANDIDATE_SCHEMA), block)


def scored(
    batches: Iterator[pa.RecordBatch], ids: list[str], wanted: np.ndarray, query_scopes: list[str], fetch_k: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """The best lists of one task over its rows of the store."""
    if not ids:
        return
    best, names = Best(fetch_k), Names()
    dim = wanted.shape[1]
    # Queries that must not see a chunk of the given type.
    barred = {
        kind: np.array([s not in ("all", kind) for s in query_scopes])
        for kind in ("external", "project", None)
    }
    for batch in bounded(batches, max(len(ids), dim)):
        chunks = np.array([c.encode() for c in batch.column("chunk_id").to_pylist()])
        vectors = unit_rows(matrix(batch.column("embedding"), dim, batch.column("chunk_id")))
        files = names.codes(batch.column("file"))
        distance = vectors @ wanted.T
        np.subtract(1.0, distance, out=distance)
        np.round(distance, SCORE_DECIMALS, out=distance)
        distance += 0.0
        if "doc_type" in batch.schema.names:
            kinds = np.array(batch.column("doc_type").to_pylist(), dtype=object)
            for kind in set(kinds):
                out = barred.get(kind, barred[None])
                distance[np.ix_(kinds == kind, out)] = np.inf
        best.add(distance, chunks, files)
    if len(best.query):
        yield candidate_batch(ids, best, names)


def candidate_batch(ids: list[str], best: Best, names: Names) -> pa.RecordBatch:
    """A task's best lists as rows."""
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids[i] for i in best.query], pa.string()),
            pa.array([c.decode() for c in best.chunk], pa.string()),
            pa.array(best.distance, pa.float64()),
            pa.array([names.known[f] for f in best.file], pa.string()),
        ],
        names=["query_id", "chunk_id", "vec_score", "file"],
    )


def ranked(found: DataFrame, block: QueryBlock) -> DataFrame:
    """The tasks' lists cut to one list per query, with ``vec_rank``."""
    order = Window.partitionBy("query_id").orderBy("vec_score", "chunk_id")
    placed = found.withColumn("vec_rank", F.row_number().over(order))
    # The literal bound lets Spark cut the lists before the shuffle.
    return placed.filter(F.col("vec_rank") <= block.max_fetch)
