"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.llm import (
    bpe,
    chat,
    collocations,
    exact_dedup,
    html,
    langid,
    minhash,
    mixing,
    quality,
    rules,
    toxicity,
    variants,
    warc,
)
from ragframe.llm.common import held_out, table

CUT = 0.7


def vocabulary_path() -> str:
    """Where the public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out(F.col("doc_id"), 3, 1)
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels, "toxic", held))
    score = F.col("toxicity.score")
    return scored.select(
        "doc_id",
        held.alias("held_out"),
        score.alias("score"),
        (score >= CUT).cast("int").alias("predicted"),
        F.col("toxicity.spans").alias("spans"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_exact(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out(F.col("doc_id"), 4, 2)
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels, "quality", held))
    return scored.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], turns.schema)
    return chat.format_conversations(turns.unionByName(probe))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, vocabulary_path())
    decoded = F.sha2(F.col("bpe.decoded").cast("binary"), 256)
    return coded.select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", decoded.alias("decoded_sha256"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 4, 2)
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs, held))
    return found.select("doc_id", held.alias("held_out"), "language.lang_pred", "language.score", "language.shares")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash.near_groups(table(spark, sf_dir, "documents"), words=2)
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"), slips=199)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_mixing,
        op3_exact_dedup,
        op4_warc,
        op5_quality,
        op6_chat,
        op7_bpe,
        op8_langid,
        op9_minhash,
        op10_quality_rules,
        op11_variants,
        op12_collocations,
        op13_html,
    )
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op11_variants": variants.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
