"""Evaluation table: questions with retrieved contexts, checked answers, truth."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.operators.answers import normalized
from ragframe.operators.evaluation import tool_accuracy
from ragframe.operators.search import search
from ragframe.plans.artifact import routing_results
from ragframe.plans.ask import retrieved
from ragframe.session import checkpointed
from ragframe.settings import UNKNOWN_ANSWER, RetrievalDefaults
from ragframe.sources.files import write_report

EVAL_K = 3


def eval_dataset(
    questions: DataFrame,
    store: DataFrame,
    answers: DataFrame,
    paged_questions: bool = False,
    defaults: RetrievalDefaults | None = None,
    **options,
) -> DataFrame:
    """query_id, question, answer, contexts, ground_truth for every question.

    Three hits per question; all documents are searched if there are questions
    about paged files among them.
    """
    changed = {"k": EVAL_K, "scope": "all"} if paged_questions else {"k": EVAL_K}
    defaults = replace(defaults or RetrievalDefaults(), **changed)
    hits = search(store, questions, defaults=defaults, **options)
    return eval_rows(questions, hits, answers, defaults)


def routing_eval(questions: DataFrame, answers: DataFrame, path: str) -> DataFrame:
    """Routing evaluation to rows and a summary below ``path``; returns the summary.

    The results are worked out once: the summary is taken from the rows as kept.
    """
    results = checkpointed(routing_results(questions, answers))
    summary = tool_accuracy(results)
    write_report(results, summary, path)
    return summary


def eval_rows(
    questions: DataFrame,
    hits: DataFrame,
    answers: DataFrame,
    defaults: RetrievalDefaults | None = None,
) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    texts = hits.groupBy("query_id").agg(
        F.transform(ordered, lambda h: h["text"]).alias("contexts")
    )
    asked = questions.withColumn("query_id", F.col("query_id").cast("string"))
    drafts = answers.select(F.col("query_id").cast("string").alias("query_id"), "answer")
    final, _ = normalized(F.coalesce("answer", F.lit("")), F.col("source_ids"))
    return (
        asked.select("query_id", "question", F.coalesce("ground_truth", F.lit("")).alias("truth"))
        .join(retrieved(asked, hits, defaults), "query_id")
        .join(texts, "query_id", "left")
        .join(drafts, "query_id", "left")
        .select(
            "query_id",
            "question",
            F.when(F.col("grounded"), final).otherwise(UNKNOWN_ANSWER).alias("answer"),
            F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"),
            F.col("truth").alias("ground_truth"),
        )
    )
