"""The ask path for tables: questions and answers in, response rows out.

The model sits outside. :func:`ask_prompts` is the half in front of it,
:func:`ask` the half behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.functions.params import resolve_params
from ragframe.functions.text import redact
from ragframe.operators.answers import normalized, response
from ragframe.operators.grounding import grounded, prompts
from ragframe.operators.search import search
from ragframe.settings import (
    ERR_CONTEXT,
    MSG_CITATION,
    TOOL_GATES,
    UNKNOWN_ANSWER,
    RetrievalDefaults,
)

SOURCE_LIST = "array<struct<source_id:string,meta:map<string,string>>>"


def retrieved(
    queries: DataFrame, hits: DataFrame, defaults: RetrievalDefaults | None = None
) -> DataFrame:
    """Per query: the gate's verdict and the sources of its hits.

    ``queries`` may carry gate columns (min_docs, min_unique_sources,
    caller_threshold); otherwise the gate of plain questions applies.
    """
    min_docs, min_unique, caller, _ = TOOL_GATES["ask"]
    resolved = resolve_params(queries, defaults, caller)
    return grounded(hits, resolved, min_docs, min_unique).select(
        "query_id", "grounded", "sources", "source_ids"
    )


def ask_prompts(
    queries: DataFrame,
    store: DataFrame,
    defaults: RetrievalDefaults | None = None,
    **templates: str,
) -> DataFrame:
    """Prompts of the queries that pass the gate (the others need no model)."""
    hits = search(store, queries, defaults=defaults)
    passed = retrieved(queries, hits, defaults).filter("grounded").select("query_id")
    return prompts(queries, hits, **templates).join(passed, "query_id")


def ask(
    queries: DataFrame,
    store: DataFrame,
    answers: DataFrame,
    defaults: RetrievalDefaults | None = None,
    **options,
) -> DataFrame:
    """Response rows for questions with model answers ``(query_id, answer)``."""
    hits = search(store, queries, defaults=defaults, **options)
    return respond(queries, hits, answers, defaults)


def respond(
    queries: DataFrame,
    hits: DataFrame,
    answers: DataFrame,
    defaults: RetrievalDefaults | None = None,
) -> DataFrame:
    asked = queries.withColumn("query_id", F.col("query_id").cast("string"))
    drafts = answers.select(F.col("query_id").cast("string").alias("query_id"), "answer")
    joined = (
        asked.select("query_id", "question")
        .join(retrieved(asked, hits, defaults), "query_id")
        .join(drafts, "query_id", "left")
    )
    text, citation_error = normalized(F.coalesce("answer", F.lit("")), F.col("source_ids"))
    passed = F.col("grounded")
    error = F.when(~passed, ERR_CONTEXT).otherwise(citation_error)
    message = F.when(~passed, TOOL_GATES["ask"][3]).when(citation_error.isNotNull(), MSG_CITATION)
    empty = F.array().cast(SOURCE_LIST)
    return joined.select(
        "query_id",
        *response(
            tool=F.lit("ask"),
            args=F.create_map(F.lit("question"), redact(F.col("question"))),
            sources=F.when(passed, F.coalesce("sources", empty)).otherwise(empty),
            answer=F.when(~passed, UNKNOWN_ANSWER).otherwise(text),
            error=error,
            message=message,
        ),
    )
