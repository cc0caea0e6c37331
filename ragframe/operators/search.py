"""Retrieval for tables of queries: similarity, hybrid, MMR and automatic mode."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe.functions.params import resolve_params
from ragframe.functions.text import overlap_share, tokens
from ragframe.functions.vectors import EmbedFn, embed
from ragframe.operators.lsh import SignIndex, build_index
from ragframe.operators.scoring import QueryBlock, in_scope, nearest, unit_rows
from ragframe.session import checkpointed, new_path
from ragframe.settings import (
    QUERY_BLOCK_BYTES,
    QUERY_BLOCK_HITS,
    QUERY_BLOCK_ROWS,
    SCAN_FILES,
    SCORE_DECIMALS,
    RetrievalDefaults,
)

_PARAMS = ("query_id", "mode", "k", "fetch_k", "alpha")
_PARAMS_SCHEMA = "query_id string, mode string, k int, fetch_k int, alpha double"


def search(
    store: DataFrame,
    queries: DataFrame,
    *,
    k: int | None = None,
    mode: str | None = None,
    scope: str | None = None,
    defaults: RetrievalDefaults | None = None,
    embed_fn: EmbedFn | None = None,
    approx: SignIndex | None = None,
) -> DataFrame:
    """Ranked hits of every query: one row per (query_id, rank).

    ``queries``: query_id, question, optional qvec, mode, scope, k, k_header.
    ``store``: chunk columns with ``embedding``, and ``file`` where rows come from
    files (as ``read_store`` gives them). ``score`` is a distance in
    every mode (smaller is better). ``mode``, ``scope`` and ``k`` given as
    arguments apply to queries that do not set their own.
    """
    base = defaults or RetrievalDefaults()
    changed = {n: v for n, v in (("k", k), ("mode", mode), ("scope", scope)) if v is not None}
    base = RetrievalDefaults(**{**base.__dict__, **changed})
    resolved = resolve_params(queries, base)
    if "qvec" not in resolved.columns:
        resolved = embed(resolved, "question", "qvec", embed_fn)
    # Queries get a key of their own: their ids may be null or occur twice.
    resolved = resolved.withColumns(
        {"_asked": F.col("query_id").cast("string"), "query_id": F.monotonically_increasing_id().cast("string")}
    )
    resolved = checkpointed(resolved)
    names = resolved.select("query_id", "_asked")
    blocks = query_blocks(resolved.drop("_asked"))
    rows, block = next(blocks)
    hits = _search_block(store, rows, block, base, approx)
    if block.only:
        return _renamed(hits, names)
    # Many queries: one block after the other is searched and its hits written,
    # so that neither the driver nor a plan ever holds more than one block.
    target = new_path(store.sparkSession, "hits")
    while True:
        hits.write.mode("append").parquet(target)
        following = next(blocks, None)
        if following is None:
            return _renamed(store.sparkSession.read.parquet(target), names)
        hits = _search_block(store, *following, base, approx)


def _renamed(hits: DataFrame, names: DataFrame) -> DataFrame:
    """Hits under the ids that their queries came with."""
    asked = hits.join(names, "query_id").withColumn("query_id", F.col("_asked"))
    return asked.select(hits.columns)


def similarity_topk(store: DataFrame, queries: DataFrame, **options) -> DataFrame:
    return search(store, queries, **{**options, "mode": "similarity"})


def hybrid_topk(store: DataFrame, queries: DataFrame, **options) -> DataFrame:
    return search(store, queries, **{**options, "mode": "hybrid"})


def mmr_topk(store: DataFrame, queries: DataFrame, **options) -> DataFrame:
    return search(store, queries, **{**options, "mode": "mmr"})


def report(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Question, score, source_id, doc_type and h1 of every hit."""
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "question")
    return hits.join(asked, "query_id").select(
        "query_id", "question", "rank", "score", "source_id", "doc_type", "h1"
    )


# --- blocks of queries -------------------------------------------------------


def query_blocks(resolved: DataFrame) -> Iterator[tuple[DataFrame, QueryBlock]]:
    """Split the queries into blocks that are safe to broadcast.

    The bound is checked, not assumed: one block is tried with a row limit and
    used if all queries fit. Otherwise the queries are written out once,
    numbered by the magnitude of their depth, and cut by number. Scoring a block
    costs more than re-reading the vectors for it, so one scan of the store per
    block is the right price for many queries.
    """
    first = _fetch(resolved.limit(QUERY_BLOCK_ROWS + 1))
    limit = _rows_for_vectors(first)
    if len(first) <= min(limit, _rows_for_hits(first["fetch_k"].max() if len(first) else 1)):
        yield resolved, _to_block(first, only=True)
        return
    depth = F.ceil(F.log2(F.greatest(F.col("fetch_k"), F.lit(1)))).cast("int")
    placed = checkpointed(resolved.withColumns({"_depth": depth, "_part": F.spark_partition_id()}))
    # numbers within a part, shifted by the sizes of the parts before it: no window holds all queries
    earlier = Window.partitionBy("_depth").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_depth", "_part").count()
    shifts = sizes.select("_depth", "_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_depth", "_part").orderBy("query_id"))
    numbered = placed.join(shifts, ["_depth", "_part"]).withColumn("_number", within + F.col("_before"))
    saved = checkpointed(numbered.drop("_part", "_before"))
    # Queries of like depth share blocks, so one deep query costs no other a scan.
    for depth_class, total in sorted(map(tuple, saved.groupBy("_depth").count().collect())):
        size = min(limit, _rows_for_hits(2**depth_class))
        for start in range(0, total, size):
            place = F.col("_number").between(start + 1, start + size)
            rows = saved.filter((F.col("_depth") == depth_class) & place).drop("_depth", "_number")
            yield rows, _to_block(_fetch(rows))


def _fetch(rows: DataFrame) -> pd.DataFrame:
    size = F.octet_length(F.coalesce("question", F.lit(""))).alias("question_bytes")
    return rows.select("qvec", "scope", *_PARAMS, size).toPandas()


def _dim(rows: pd.DataFrame) -> int:
    return max((len(v) for v in rows["qvec"] if v is not None), default=1)


def _rows_for_vectors(rows: pd.DataFrame) -> int:
    return min(QUERY_BLOCK_ROWS, max(1, QUERY_BLOCK_BYTES // (8 * max(1, _dim(rows)))))


def _rows_for_hits(fetch_k: int) -> int:
    return max(1, QUERY_BLOCK_HITS // int(fetch_k))


def _to_block(rows: pd.DataFrame, only: bool = False) -> QueryBlock:
    dim = _dim(rows)
    vectors = [v if v is not None else np.zeros(dim) for v in rows["qvec"]]
    return QueryBlock(
        ids=rows["query_id"].tolist(),
        vectors=unit_rows(np.array(vectors, dtype=np.float64).reshape(-1, dim)),
        scopes=rows["scope"].tolist(),
        fetch_k=rows["fetch_k"].to_numpy(dtype=np.int64),
        params=rows[list(_PARAMS)],
        modes=set(rows["mode"]),
        question_bytes=int(rows["question_bytes"].sum()),
        only=only,
    )


# --- one block ---------------------------------------------------------------


def _search_block(
    store: DataFrame,
    rows: DataFrame,
    block: QueryBlock,
    defaults: RetrievalDefaults,
    approx: SignIndex | None,
) -> DataFrame:
    modes = block.modes
    candidates = nearest(store, block) if approx is None else approx.nearest(block)
    # The short lists are kept: whatever uses the hits, the vectors are scanned once.
    candidates = checkpointed(candidates)
    found_in = _only_files(in_scope(store, block), candidates).select(
        *[c for c in store.columns if c != "file" and (c != "embedding" or "mmr" in modes)]
    )
    # Parameters come from the block itself; the texts only where words count.
    params = store.sparkSession.createDataFrame(block.params, _PARAMS_SCHEMA)
    candidates = candidates.join(F.broadcast(params), "query_id").filter(
        F.col("vec_rank") <= F.col("fetch_k")
    )
    if "hybrid" in modes:
        asked = rows.select("query_id", "question")
        if block.question_bytes <= QUERY_BLOCK_BYTES:
            asked = F.broadcast(asked)
        candidates = candidates.join(asked, "query_id")
    if len(block.ids) * block.max_fetch <= QUERY_BLOCK_HITS and (
        "hybrid" not in modes or block.question_bytes * block.max_fetch <= QUERY_BLOCK_BYTES
    ):
        # Bounded by queries x depth: the store is filtered in place by chunk id.
        candidates = F.broadcast(candidates)
    found = found_in.join(candidates.drop("file"), "chunk_id")
    if "hybrid" in modes:
        found = found.withColumn("score", _hybrid_score())
    else:
        found = found.withColumn("score", F.col("vec_score"))
    if "mmr" in modes:
        ranked = _rank_in_groups(found, defaults.mmr_lambda)
    else:
        order = Window.partitionBy("query_id").orderBy("score", "vec_rank")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(
            F.col("rank") <= F.col("k")
        )
    kept = [c for c in found_in.columns if c != "embedding"]
    return ranked.select("query_id", "rank", *kept, "score", "vec_score", "vec_rank")


def _only_files(store: DataFrame, candidates: DataFrame) -> DataFrame:
    """The store reduced to the files that hold a candidate.

    ``file`` stands for file metadata, so that Spark does not open the others. A block has QUERY_BLOCK_HITS candidates
    at most (or one query more), so their files are few beside a large store's; they are read in scans of SCAN_FILES
    each, as a filter with too many names is slow to check.
    """
    if "file" not in store.columns:
        return store
    names = candidates.select("file").distinct().orderBy("file")
    files = [r.file for r in names.collect()]
    parts = [files[at : at + SCAN_FILES] for at in range(0, len(files), SCAN_FILES)] or [[]]
    return reduce(DataFrame.unionByName, [store.filter(F.col("file").isin(part)) for part in parts])


def _hybrid_score():
    near = F.lit(1.0) / (F.lit(1.0) + F.col("vec_score"))
    shared = overlap_share(tokens(F.coalesce("question", F.lit(""))), tokens(F.col("text")))
    combined = F.col("alpha") * near + (F.lit(1.0) - F.col("alpha")) * shared
    return F.when(
        F.col("mode") == "hybrid", F.round(F.lit(1.0) - combined, SCORE_DECIMALS)
    ).otherwise(F.col("vec_score"))


def _rank_in_groups(found: DataFrame, lambda_mult: float) -> DataFrame:
    """Final order per query where MMR is among the modes.

    A group is one query's candidates (``fetch_k`` rows), never the corpus.
    """
    kept = [f for f in found.schema.fields if f.name != "embedding"]
    schema = T.StructType([*kept, T.StructField("rank", T.IntegerType())])

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        k = int(group["k"].iloc[0])
        if group["mode"].iloc[0] == "mmr":
            group = group.sort_values("vec_rank")
            vectors = unit_rows(np.stack(group["embedding"].to_numpy()).astype(np.float64))
            picks = mmr_order(1.0 - group["vec_score"].to_numpy(), vectors, k, lambda_mult)
            group = group.iloc[picks]
        else:
            group = group.sort_values(["score", "vec_rank"]).head(k)
        group = group.drop(columns="embedding")
        return group.assign(rank=np.arange(1, len(group) + 1, dtype=np.int32))

    return found.groupBy("query_id").applyInPandas(choose, schema)


def mmr_order(near: np.ndarray, vectors: np.ndarray, k: int, lambda_mult: float) -> list[int]:
    """Greedy maximal marginal relevance; ties go to the nearer candidate."""
    picks: list[int] = []
    worst = np.zeros(len(near))
    free = np.ones(len(near), dtype=bool)
    for _ in range(min(k, len(near))):
        gain = np.round(lambda_mult * near - (1.0 - lambda_mult) * worst, SCORE_DECIMALS)
        pick = int(np.argmax(np.where(free, gain, -np.inf)))
        like = vectors @ vectors[pick]
        worst = np.maximum(worst, like) if picks else like
        picks.append(pick)
        free[pick] = False
    return picks


def mmr_scores(picks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Give MMR picks the vector score of the same chunk among the candidates.

    A pick without a candidate gets the largest candidate score of its query,
    or 1.0 when there are none. The order of the picks stays.
    """
    worst = candidates.groupBy("query_id").agg(F.max("score").alias("_worst"))
    known = candidates.select("query_id", "chunk_id", F.col("score").alias("_score"))
    return (
        picks.drop("score")
        .join(known, ["query_id", "chunk_id"], "left")
        .join(worst, "query_id", "left")
        .withColumn("score", F.coalesce("_score", "_worst", F.lit(1.0)))
        .drop("_score", "_worst")
    )


def search_lsh(
    store: DataFrame,
    queries: DataFrame,
    dim: int,
    bits: int = 7,
    tables: int = 14,
    index: SignIndex | None = None,
    **options,
) -> DataFrame:
    """Approximate search: exact scores, but only of pairs whose codes are at most one bit apart in a table.

    ``index`` is one that was built from this store (:func:`ragframe.operators.lsh.build_index`);
    without it, one is written to the shared folder first.
    """
    if index is None:
        index = build_index(store, new_path(store.sparkSession, "codes"), dim, bits, tables)
    return search(store, queries, approx=index, **options)
