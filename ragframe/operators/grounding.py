"""What is built per query from its hits: context, sources, gate and prompt.

Groups are one query's hits (at most k rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.functions.metadata import entry, filled, overlaid
from ragframe.functions.text import redact
from ragframe.settings import CONTEXT_SEPARATOR, UNKNOWN_SOURCE

_META = ("source_id", "source_path", "doc_type", "chunk_index", "h1", "h2", "h3")

SYSTEM_TEXT = (
    "Answer from the given context only. Cite a source as [source_id] after each claim that "
    "rests on it. If the context is not enough, say: I don't know based on the provided documents."
)
ANSWER_TEMPLATE = "Context:\n{context}\n\nQuestion:\n{question}"
ALLOWED_HEADING = "Allowed source_ids for citations (use only these):"
NO_SOURCES = "- (none)"


def _source() -> Column:
    return F.coalesce("source_id", F.lit(UNKNOWN_SOURCE))


def contexts(hits: DataFrame) -> DataFrame:
    """Hit texts of a query under their source ids, in rank order, as one text."""
    block = F.concat(F.lit("["), _source(), F.lit("]\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda b: b["block"]), CONTEXT_SEPARATOR).alias("context")
    )


def hit_meta(hits: DataFrame) -> Column:
    """Filled metadata of a hit as a map of texts: its open ``meta`` under the named fields."""
    named = filled([entry(c) for c in _META if c in hits.columns])
    return overlaid(F.col("meta"), named) if "meta" in hits.columns else named


def sources(hits: DataFrame) -> DataFrame:
    """One row per query and source: place of its first hit, metadata of its last."""
    return (
        hits.withColumn("_meta", hit_meta(hits))
        .groupBy("query_id", _source().alias("source_id"))
        .agg(F.min("rank").alias("position"), F.max_by("_meta", "rank").alias("meta"))
    )


def summary(hits: DataFrame) -> DataFrame:
    """Everything the gate and the response need of a query's hits, in one pass.

    n_docs, n_sources (named ones), best_score, and the sources in order as
    ``sources`` (source_id, meta) and ``source_ids``.
    """
    named = F.coalesce(F.col("source_id") != "", F.lit(False))
    per_source = (
        hits.withColumns({"_meta": hit_meta(hits), "_named": named, "source_id": _source()})
        .groupBy("query_id", "source_id")
        .agg(
            F.min("rank").alias("position"),
            F.max_by("_meta", "rank").alias("meta"),
            F.count(F.lit(1)).alias("_docs"),
            F.min("score").alias("_best"),
            F.max(F.col("_named").cast("int")).alias("_named"),
        )
    )
    entry = F.struct("position", "source_id", "meta")
    ordered = F.array_sort(F.collect_list(entry), lambda a, b: a["position"] - b["position"])
    per_query = per_source.groupBy("query_id").agg(
        F.sum("_docs").alias("n_docs"),
        F.sum("_named").cast("bigint").alias("n_sources"),
        F.min("_best").alias("best_score"),
        ordered.alias("_sources"),
    )
    pairs = F.transform("_sources", lambda s: F.struct(s["source_id"], s["meta"]))
    return per_query.select(
        "query_id",
        "n_docs",
        "n_sources",
        "best_score",
        pairs.alias("sources"),
        F.transform("_sources", lambda s: s["source_id"]).alias("source_ids"),
    )


def source_lists(hits: DataFrame) -> DataFrame:
    """Sources of a query as one ordered list."""
    return summary(hits).select("query_id", "sources", "source_ids")


def grounded(
    hits: DataFrame,
    queries: DataFrame,
    min_docs: int = 1,
    min_unique_sources: int = 1,
    threshold: float = 0.25,
) -> DataFrame:
    """Gate per query: enough hits, enough sources, nearest within the threshold.

    ``queries`` may carry min_docs, min_unique_sources and threshold columns of
    their own. A query without hits gets a row too, and fails. The sources of
    the hits come along.
    """
    limits = {
        "min_docs": min_docs,
        "min_unique_sources": min_unique_sources,
        "threshold": threshold,
    }
    asked = queries.select(
        F.col("query_id").cast("string").alias("query_id"),
        *[(F.col(n) if n in queries.columns else F.lit(v)).alias(n) for n, v in limits.items()],
    )
    joined = asked.join(summary(hits), "query_id", "left").fillna(
        0, ["n_docs", "n_sources"]
    )
    ok = (
        (F.col("n_docs") >= F.col("min_docs"))
        & (F.col("n_sources") >= F.col("min_unique_sources"))
        & (F.col("best_score") <= F.col("threshold"))
    )
    return joined.select(
        "query_id",
        "n_docs",
        "n_sources",
        "best_score",
        F.coalesce(ok, F.lit(False)).alias("grounded"),
        "sources",
        "source_ids",
    )


def fill(template: str, values: dict[str, Column]) -> Column:
    """A text with ``{name}`` places as a column; braces written double stay."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = min((i for i in (rest.find("{" + n + "}") for n in values) if i >= 0), default=-1)
        head = rest if at < 0 else rest[:at]
        if head:
            parts.append(F.lit(head.replace("{{", "{").replace("}}", "}")))
        if at < 0:
            break
        name = rest[at + 1 : rest.index("}", at)]
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def answer_prompt(
    context: Column,
    question: Column,
    source_ids: Column,
    system: str = SYSTEM_TEXT,
    template: str = ANSWER_TEMPLATE,
) -> Column:
    """Prompt with context, redacted question and the list of citable sources."""
    named = F.filter(source_ids, lambda s: s.isNotNull() & (s != ""))
    listed = F.array_join(F.transform(named, lambda s: F.concat(F.lit("- ["), s, F.lit("]"))), "\n")
    listed = F.when(F.coalesce(listed, F.lit("")) == "", NO_SOURCES).otherwise(listed)
    body = fill(template, {"context": context, "question": redact(question)})
    return F.concat(F.lit(f"{system}\n\n"), body, F.lit(f"\n\n{ALLOWED_HEADING}\n"), listed)


def tool_prompt(values: dict[str, Column], template: str, system: str = SYSTEM_TEXT) -> Column:
    """Prompt of a structured tool: system text, then its filled template."""
    return F.concat(F.lit(f"{system}\n\n"), fill(template, values))


def prompts(
    queries: DataFrame,
    hits: DataFrame,
    system: str = SYSTEM_TEXT,
    template: str = ANSWER_TEMPLATE,
) -> DataFrame:
    """One prompt per query, also for queries without hits."""
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "question")
    return (
        asked.join(contexts(hits), "query_id", "left")
        .join(source_lists(hits), "query_id", "left")
        .select(
            "query_id",
            answer_prompt(
                F.coalesce("context", F.lit("")),
                F.col("question"),
                F.col("source_ids"),
                system,
                template,
            ).alias("prompt"),
        )
    )
