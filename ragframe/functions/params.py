"""Per-query retrieval parameters, resolved for a whole table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.functions.text import strip
from ragframe.settings import TOOL_GATES, RetrievalDefaults


def try_setting(col: Column, default: int | float) -> Column:
    """A number written as text, or the default when it is missing or malformed."""
    kind = "int" if isinstance(default, int) else "double"
    return F.coalesce(strip(col).try_cast(kind), F.lit(default).cast(kind))


def _override(df: DataFrame, name: str, default: str) -> Column:
    given = F.nullif(F.col(name), F.lit("")) if name in df.columns else F.lit(None).cast("string")
    return F.lower(strip(F.coalesce(given, F.lit(default))))


def scope(df: DataFrame, defaults: RetrievalDefaults) -> Column:
    wanted = _override(df, "scope", defaults.scope)
    return (
        F.when(wanted.isin("all", "*"), "all")
        .when(wanted.isin("external", "project"), wanted)
        .otherwise("project")
    )


def mode(df: DataFrame, defaults: RetrievalDefaults, resolved_scope: Column) -> Column:
    wanted = _override(df, "mode", defaults.mode)
    auto = F.when(resolved_scope == "external", "hybrid").otherwise("mmr")
    return (
        F.when(wanted == "auto", auto)
        .when(wanted.isin("mmr", "hybrid"), wanted)
        .otherwise("similarity")
    )


def top_k(df: DataFrame, defaults: RetrievalDefaults) -> Column:
    """Header text (a positive whole number) > ``k`` column > default; at least 1."""
    header = (
        strip(F.col("k_header")).try_cast("int")
        if "k_header" in df.columns
        else F.lit(None).cast("int")
    )
    given = F.col("k").cast("int") if "k" in df.columns else F.lit(None).cast("int")
    chosen = F.coalesce(F.when(header > 0, header), given, F.lit(defaults.k))
    return F.greatest(F.lit(1), chosen)


def fetch_k(resolved_mode: Column, resolved_scope: Column, k: Column, d: RetrievalDefaults) -> Column:
    """How many nearest chunks are considered before the final choice of k."""
    target = F.greatest(
        F.lit(d.hybrid_fetch_k),
        F.lit(d.external_fetch_min),
        k * max(1, d.external_fetch_multiplier),
    )
    wide = F.greatest(k, F.least(F.greatest(k, F.lit(d.external_fetch_max)), target))
    return (
        F.when(resolved_mode == "mmr", F.greatest(k, F.lit(d.mmr_fetch_k)))
        .when(
            resolved_mode == "hybrid",
            F.when(resolved_scope == "external", wide).otherwise(
                F.greatest(k, F.lit(d.hybrid_fetch_k))
            ),
        )
        .otherwise(F.greatest(k, F.lit(d.similarity_fetch_k)))
    )


def alpha(resolved_scope: Column, d: RetrievalDefaults) -> Column:
    def pick(value: float | None) -> Column:
        return F.lit(float(d.alpha if value is None else value))

    return (
        F.when(resolved_scope == "external", pick(d.alpha_external))
        .when(resolved_scope == "project", pick(d.alpha_project))
        .otherwise(pick(d.alpha_all))
    )


def threshold(resolved_scope: Column, d: RetrievalDefaults, caller: Column) -> Column:
    """Largest distance that still counts as grounded; ``caller`` applies to scope all."""
    return (
        F.when(resolved_scope == "project", F.lit(float(d.threshold_project)))
        .when(resolved_scope == "external", F.lit(float(d.threshold_external)))
        .otherwise(caller if d.threshold_all is None else F.lit(float(d.threshold_all)))
    )


def tool_gate(tool: Column) -> dict[str, Column]:
    """Gate settings of a tool; an unknown tool is handled as ``ask``."""
    names = ("min_docs", "min_unique_sources", "caller_threshold", "gate_message")
    picked = {}
    for i, name in enumerate(names):
        value = F.lit(TOOL_GATES["ask"][i])
        for key, gate in TOOL_GATES.items():
            if key != "ask":
                value = F.when(tool == key, F.lit(gate[i])).otherwise(value)
        picked[name] = value
    return picked


def resolve_params(
    queries: DataFrame,
    defaults: RetrievalDefaults | None = None,
    caller_threshold: float = 0.8,
) -> DataFrame:
    """Replace the optional override columns by fully resolved parameters."""
    d = defaults or RetrievalDefaults()
    caller = (
        F.col("caller_threshold")
        if "caller_threshold" in queries.columns
        else F.lit(float(caller_threshold))
    )
    out = (
        queries.withColumn("_scope", scope(queries, d))
        .withColumn("_mode", mode(queries, d, F.col("_scope")))
        .withColumn("_k", top_k(queries, d))
    )
    overrides = [c for c in ("scope", "mode", "k", "k_header", "caller_threshold") if c in out.columns]
    out = out.withColumn("_threshold", threshold(F.col("_scope"), d, caller)).drop(*overrides)
    return (
        out.withColumnsRenamed(
            {"_scope": "scope", "_mode": "mode", "_k": "k", "_threshold": "threshold"}
        )
        .withColumn("fetch_k", fetch_k(F.col("mode"), F.col("scope"), F.col("k"), d))
        .withColumn("alpha", alpha(F.col("scope"), d))
    )
