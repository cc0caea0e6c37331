"""Vectors: the built-in token-hash embedding and a hook for any other model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.settings import EMBED_ROWS, EMBEDDING_DIM, TOKEN_PATTERN

EmbedFn = Callable[[Sequence[str]], np.ndarray]

_TOKENS = re.compile(TOKEN_PATTERN)
# Distinct tokens a Python worker remembers the bucket of.
_CACHE_LIMIT = 200_000


def hash_embedder(dim: int = EMBEDDING_DIM) -> EmbedFn:
    """Count tokens by ``md5(token) mod dim`` and scale to length one.

    Needs no model and no state, so that a text has the same vector everywhere.
    """
    cache: dict[str, int] = {}

    def bucket(token: str) -> int:
        found = cache.get(token)
        if found is None:
            if len(cache) >= _CACHE_LIMIT:
                cache.clear()
            found = int(hashlib.md5(token.encode()).hexdigest()[:7], 16) % dim
            cache[token] = found
        return found

    def embed_texts(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            hit = [bucket(t) for t in _TOKENS.findall((text or "").lower())]
            if hit:
                out[row] = np.bincount(hit, minlength=dim)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(norms == 0, 1, norms)).astype(np.float32)

    return embed_texts


def embed(
    df: DataFrame, column: str = "text", out: str = "embedding", fn: EmbedFn | None = None
) -> DataFrame:
    """Add a vector per row; ``fn`` maps a list of texts to a matrix of vectors.

    ``fn`` is shipped to the workers and called with EMBED_ROWS texts at a time; a
    model it loads lazily is loaded once per worker.
    """
    model = fn or hash_embedder()

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return vector_lists(batches, model)

    # Marked as not repeatable: the optimizer must not copy the call into filters.
    return df.withColumn(out, run.asNondeterministic()(F.col(column)))


def vector_lists(batches: Iterator[pa.Array], model: EmbedFn) -> Iterator[pa.Array]:
    """Vectors of all texts, in slices of EMBED_ROWS: a full Arrow batch's matrices are never held at once."""
    for batch in batches:
        for at in range(0, len(batch), EMBED_ROWS):
            matrix = np.asarray(model(batch.slice(at, EMBED_ROWS).to_pylist()), dtype=np.float32)
            rows, dim = matrix.shape
            offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * dim)
            yield pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine as a plain expression (for single pairs and for tests)."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    length = F.sqrt(dot(a, a) * dot(b, b))
    return F.lit(1.0) - F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))
