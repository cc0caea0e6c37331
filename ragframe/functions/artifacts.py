"""Routing words, tool calls and structured outputs, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragframe.functions.text import strip
from ragframe.settings import (
    ARTIFACT_NOUNS,
    ARTIFACT_TERMS,
    CREATE_VERBS,
    DEFAULT_ALTERNATIVES,
    ERR_EMPTY,
    ERR_STRUCTURED,
    MIN_TITLE_LENGTH,
    TOOL_GATES,
    TOOL_LIST_FIELDS,
    TOOL_TEXT_FIELDS,
)


def _any_word(col: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [col.contains(w) for w in words])


def is_artifact_request(question: Column) -> Column:
    """Named artifact, or a create verb together with an artifact noun (substrings)."""
    q = F.lower(question)
    return _any_word(q, ARTIFACT_TERMS) | (_any_word(q, CREATE_VERBS) & _any_word(q, ARTIFACT_NOUNS))


def route_by_rules(question: Column) -> Column:
    """Tool of a question: the artifact gate, then the first rule that applies."""
    q = F.lower(question)
    ruled = (
        F.when(_any_word(q, ("adr", "architecture decision", "decision record")), "adr")
        .when(_any_word(q, ("user story", "stories", "acceptance criteria")), "user_stories")
        .when(_any_word(q, ("outline", "architecture", "assumptions")), "solution_outline")
        .when(_any_word(q, ("risk", "mitigation", "assessment")), "risk_assessment")
        .otherwise("ask")
    )
    return F.when(is_artifact_request(question), ruled).otherwise("ask")


# --- JSON (as variants, parsed once per row by the caller) --------------------


def _kind(json: Column, name: str) -> Column:
    """JSON type of a field as text; null when it is missing."""
    return F.schema_of_variant(F.try_variant_get(json, f"$.{name}", "variant"))


def _text_field(json: Column, name: str) -> Column:
    value = F.try_variant_get(json, f"$.{name}", "string")
    return F.when(_kind(json, name) == "STRING", value)


def _list_field(json: Column, name: str) -> Column:
    """A list that holds texts only (an empty one counts), else null."""
    value = F.try_variant_get(json, f"$.{name}", "array<string>")
    texts = _kind(json, name).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(value, F.isnull)
    return F.when(texts, value)


def tool_call(json: Column, question: Column) -> dict[str, Column]:
    """Tool and arguments of a model's routing answer, with defaults filled in.

    Text that is no object with a tool name and an args object means ``ask``
    with the question; so does an unknown tool.
    """
    name = _text_field(json, "tool")
    valid = name.isNotNull() & F.coalesce(_kind(json, "args").startswith("OBJECT"), F.lit(False))
    tool = F.when(valid & name.isin(*TOOL_GATES), name).otherwise("ask")

    def text_arg(key: str) -> Column:
        return F.coalesce(F.try_variant_get(json, f"$.args.{key}", "string"), question)

    options = F.coalesce(
        F.try_variant_get(json, "$.args.alternatives", "array<string>"),
        F.array(*[F.lit(o) for o in DEFAULT_ALTERNATIVES]),
    )
    return {
        "tool": tool,
        "parsed": valid,
        "request": F.when(tool == "ask", question)
        .when(tool == "adr", text_arg("decision"))
        .otherwise(text_arg("request")),
        "alternatives": F.when(tool == "adr", options),
        "context_query": F.when(tool == "ask", question).otherwise(text_arg("context_query")),
    }


def structured_error(tool: Column, output: Column, json: Column) -> Column:
    """Null for output that fits its tool's fields, else the error code.

    Every field must be there with its type (text, or a list of texts); a title
    needs five characters; further keys are ignored.
    """
    fits = F.lit(False)
    for name in TOOL_TEXT_FIELDS:
        checks = [_text_field(json, f).isNotNull() for f in TOOL_TEXT_FIELDS[name]]
        if "title" in TOOL_TEXT_FIELDS[name]:
            checks.append(F.length(_text_field(json, "title")) >= MIN_TITLE_LENGTH)
        checks += [_list_field(json, f).isNotNull() for f in TOOL_LIST_FIELDS[name]]
        fits = F.when(tool == name, reduce(Column.__and__, checks)).otherwise(fits)
    empty = strip(F.coalesce(output, F.lit(""))) == ""
    return F.when(empty, ERR_EMPTY).when(~F.coalesce(fits, F.lit(False)), ERR_STRUCTURED)


def structured_fields(tool: Column, json: Column) -> Column:
    """Fields of a valid output as one struct; those of other tools are null."""
    names = list(dict.fromkeys(f for fs in TOOL_TEXT_FIELDS.values() for f in fs))
    lists = list(dict.fromkeys(f for fs in TOOL_LIST_FIELDS.values() for f in fs))
    columns = [_own(tool, TOOL_TEXT_FIELDS, f, _text_field(json, f)) for f in names]
    columns += [_own(tool, TOOL_LIST_FIELDS, f, _list_field(json, f)) for f in lists]
    return F.struct(*columns)


def _own(tool: Column, table: dict, field: str, value: Column) -> Column:
    tools = [t for t, fs in table.items() if field in fs]
    return F.when(tool.isin(*tools), value).alias(field)
