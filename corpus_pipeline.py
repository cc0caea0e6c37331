"""A training-data pipeline over ``documents``: score, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor. ``run`` writes every stage as Parquet
in the shared folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.llm import bpe, exact_dedup, minhash, mixing, quality
from ragframe.llm.common import held_out, saved, table
from ragframe.llm.queries import CUT, vocabulary_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores CUT or more; it learns from the labels outside the hold-out."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", held_out(F.col("doc_id"), 4, 2))
    # the score's name may be one of the columns
    scored = quality.score(docs.select(F.struct("*").alias("document"), "text"), model)
    return scored.where(F.col("score") >= CUT).select("document.*")


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id."""
    return exact_dedup.drop_exact(docs)


def keep_first_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with similarity 0.8 or more."""
    return minhash.drop_near(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids, and digests of ids and decoded text."""
    coded = bpe.encode_documents(docs, vocabulary_path())
    decoded = F.sha2(F.col("bpe.decoded").cast("binary"), 256)
    return coded.select(
        *docs.drop("bpe").columns, "bpe.n_tokens", "bpe.token_ids", "bpe.ids_sha256", decoded.alias("decoded_sha256")
    )


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_first_copies),
    ("MinHash near-dedup", keep_first_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

# A trained network and hashed sketches have no SQL form; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs
