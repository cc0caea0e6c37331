"""Checks on tables of model outputs and the response rows made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.functions.artifacts import structured_error
from ragframe.functions.citations import (
    citations,
    has_valid_citation,
    is_unknown,
    normalize_source_id,
    source_id_variants,
)
from ragframe.functions.text import redact
from ragframe.settings import ERR_CITATION, UNKNOWN_ANSWER


def valid_citations(answers: DataFrame, allowed: str | None = "source_ids") -> DataFrame:
    """Add ``citation_ok``: one good citation is enough."""
    allow = F.col(allowed) if allowed else None
    return answers.withColumn("citation_ok", has_valid_citation(F.col("answer"), allow))


def citation_audit(answers: DataFrame, allowed: str = "source_ids") -> DataFrame:
    """One row per citation of an answer: position, token, and whether it matched."""
    accepted = F.coalesce(
        F.flatten(F.transform(allowed, source_id_variants)), F.array().cast("array<string>")
    )
    exploded = answers.select(
        "query_id", accepted.alias("_accepted"), F.posexplode(citations(F.col("answer")))
    )
    return exploded.select(
        "query_id",
        F.col("pos").alias("position"),
        F.col("col").alias("citation"),
        F.array_contains("_accepted", normalize_source_id(F.col("col"))).alias("matched"),
    )


def normalized(answer: Column, source_ids: Column) -> tuple[Column, Column]:
    """Final answer and error code of a draft answer; no source list accepts no citation."""
    source_ids = F.coalesce(source_ids, F.array().cast("array<string>"))
    unknown = is_unknown(answer)
    cited = F.coalesce(has_valid_citation(answer, source_ids), F.lit(False))
    text = F.when(unknown | ~cited, UNKNOWN_ANSWER).otherwise(answer)
    return text, F.when(~unknown & ~cited, ERR_CITATION)


def normalize(answers: DataFrame) -> DataFrame:
    """Replace refusals and badly cited answers by the refusal sentence."""
    text, error = normalized(F.col("answer"), F.col("source_ids"))
    return answers.withColumns({"final_answer": text, "error": error})


def validate(outputs: DataFrame) -> DataFrame:
    """Add the error code of structured outputs (null: valid)."""
    parsed = outputs.withColumn("_json", F.try_parse_json("output"))
    error = structured_error(F.col("tool"), F.col("output"), F.col("_json"))
    return parsed.withColumn("error", error).drop("_json")


def finalize(cited: Column, known: Column) -> Column:
    """Cited sources that were retrieved; if there are none, the first three known."""
    kept = F.filter(cited, lambda s: F.array_contains(known, s))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(known, 1, 3))


def response(
    tool: Column,
    args: Column,
    sources: Column,
    answer: Column | None = None,
    structured: Column | None = None,
    error: Column | None = None,
    message: Column | None = None,
) -> list[Column]:
    """Columns of a response row; answer and structured part are redacted.

    Fields that do not apply are null; sources are an empty list then.
    """
    none = F.lit(None).cast("string")
    return [
        tool.alias("agent_tool"),
        args.alias("agent_args"),
        sources.alias("sources"),
        (none if answer is None else redact(answer)).alias("answer"),
        (none if structured is None else structured).alias("structured"),
        (none if error is None else F.nullif(error, F.lit(""))).alias("error"),
        (none if message is None else F.nullif(message, F.lit(""))).alias("message"),
    ]
