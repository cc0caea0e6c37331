"""The structured path for tables: tool calls and model JSON in, responses out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragframe.functions.artifacts import (
    is_artifact_request,
    structured_error,
    structured_fields,
    tool_call,
)
from ragframe.functions.params import tool_gate
from ragframe.functions.text import redact, redact_columns
from ragframe.operators.answers import finalize, response
from ragframe.operators.evaluation import routed
from ragframe.operators.grounding import contexts, fill, tool_prompt
from ragframe.operators.search import search
from ragframe.plans.ask import SOURCE_LIST, respond, retrieved
from ragframe.settings import (
    ERR_CONTEXT,
    ERR_EMPTY,
    ERR_STRUCTURED,
    MSG_EMPTY,
    MSG_STRUCTURED,
    RetrievalDefaults,
)


def tool_calls(questions: DataFrame) -> DataFrame:
    """Resolve a model's routing answers (``routing`` JSON) to tool calls.

    Questions that ask for no artifact go to ``ask`` without looking at the
    answer. Arguments that are missing are filled from the question.
    """
    return _resolved(_requests(questions)).drop("_safe", "_asked")


def _requests(questions: DataFrame) -> DataFrame:
    """Questions with their redacted text, and whether that asks for an artifact."""
    safe = questions.withColumn("_safe", redact(F.col("question")))
    return safe.withColumn("_asked", is_artifact_request(F.col("_safe")))


def _resolved(requests: DataFrame) -> DataFrame:
    parsed = requests.withColumn("_json", F.when(F.col("_asked"), F.try_parse_json("routing")))
    return parsed.withColumns(tool_call(F.col("_json"), F.col("question"))).drop("_json", "routing")


def routing_prompts(questions: DataFrame, template: str) -> DataFrame:
    """Routing prompt per question that asks for an artifact (the others need no model).

    ``template`` has a ``{question}`` place, which gets the redacted question.
    """
    asked = _requests(questions).filter("_asked")
    return asked.select(
        F.col("query_id").cast("string").alias("query_id"),
        fill(template, {"question": F.col("_safe")}).alias("prompt"),
    )


def routing_results(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Expected and predicted tool of labelled questions, with ``correct``.

    ``questions``: query_id, question, expected_tool; ``answers``: query_id, routing.
    A prompted question without an answer (the model failed) counts as ``invalid``.
    """
    given = answers.select(F.col("query_id").cast("string").alias("query_id"), "routing")
    asked = _requests(questions.withColumn("query_id", F.col("query_id").cast("string")))
    joined = asked.join(given, "query_id", "left")
    failed = F.col("_asked") & F.col("routing").isNull()
    calls = _resolved(joined.withColumn("_failed", F.coalesce(failed, F.lit(False))))
    predicted = F.when(~F.col("_failed"), F.col("tool"))
    return routed(
        calls.select("query_id", "question", "expected_tool", predicted.alias("predicted_tool"))
    )


def gated(calls: DataFrame) -> DataFrame:
    """Tool calls as queries: context query as question, gate columns of the tool."""
    return calls.withColumn("question", F.col("context_query")).withColumns(
        tool_gate(F.col("tool"))
    )


def artifact_prompts(
    calls: DataFrame,
    store: DataFrame,
    templates: dict[str, str],
    system: str,
    defaults: RetrievalDefaults | None = None,
) -> DataFrame:
    """Prompt per tool call that passes its gate; ``templates`` by tool."""
    queries = gated(calls.filter(F.col("tool") != "ask"))
    hits = search(store, queries, defaults=defaults)
    passed = retrieved(queries, hits, defaults).filter("grounded").select("query_id")
    joined = queries.withColumn("query_id", F.col("query_id").cast("string"))
    joined = joined.join(passed, "query_id").join(contexts(hits), "query_id", "left")
    values = {
        "context": F.col("context"),
        "request": redact(F.col("request")),
        "decision": redact(F.col("request")),
        "alternatives": F.to_json(F.transform("alternatives", lambda a: redact(a))),
    }
    prompt = F.lit(None).cast("string")
    for tool, template in templates.items():
        prompt = F.when(F.col("tool") == tool, tool_prompt(values, template, system)).otherwise(
            prompt
        )
    return joined.select("query_id", "tool", prompt.alias("prompt"))


def artifacts(
    calls: DataFrame,
    store: DataFrame,
    outputs: DataFrame,
    defaults: RetrievalDefaults | None = None,
    **options,
) -> DataFrame:
    """Responses of structured tool calls; ``outputs``: query_id, output (JSON text).

    ``calls``: query_id, tool, request, alternatives, context_query and optional
    mode, scope, k. Retrieval uses the raw context query, everything that is
    shown uses redacted text.
    """
    queries = gated(calls.filter(F.col("tool") != "ask")).withColumn(
        "query_id", F.col("query_id").cast("string")
    )
    hits = search(store, queries, defaults=defaults, **options)
    made = outputs.select(
        F.col("query_id").cast("string").alias("query_id"),
        "output",
        F.try_parse_json("output").alias("_json"),
    )
    joined = (
        queries.join(retrieved(queries, hits, defaults), "query_id")
        .join(made, "query_id", "left")
        .withColumn("_error", structured_error(F.col("tool"), F.col("output"), F.col("_json")))
        .withColumn("structured", structured_fields(F.col("tool"), F.col("_json")))
    )
    error = F.when(~F.col("grounded"), ERR_CONTEXT).otherwise(F.col("_error"))
    message = (
        F.when(error == ERR_CONTEXT, F.col("gate_message"))
        .when(error == ERR_EMPTY, MSG_EMPTY)
        .when(error == ERR_STRUCTURED, MSG_STRUCTURED)
    )
    cited = finalize(F.col("structured.sources"), F.col("source_ids"))
    structured = F.when(error.isNull(), F.col("structured").withField("sources", cited))
    empty = F.array().cast(SOURCE_LIST)
    # What a decision record decides has a name of its own.
    shown, decides = redact(F.col("request")), F.col("tool") == "adr"
    args = F.struct(
        F.when(decides, shown).alias("decision"),
        F.when(~decides, shown).alias("request"),
        F.transform("alternatives", lambda a: redact(a)).alias("alternatives"),
        redact(F.col("context_query")).alias("context_query"),
    )
    rows = joined.select(
        "query_id",
        *response(
            tool=F.col("tool"),
            args=args,
            sources=F.when(F.col("grounded"), F.coalesce("sources", empty)).otherwise(empty),
            structured=structured,
            error=error,
            message=message,
        ),
    )
    return redact_columns(rows, ["structured"])


def route(
    questions: DataFrame,
    store: DataFrame,
    answers: DataFrame,
    outputs: DataFrame,
    defaults: RetrievalDefaults | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Questions with routing answers, split into ask and artifact responses."""
    calls = tool_calls(questions)
    plain = calls.filter(F.col("tool") == "ask")
    hits = search(store, plain, defaults=defaults)
    return respond(plain, hits, answers, defaults), artifacts(calls, store, outputs, defaults)
