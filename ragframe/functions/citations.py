"""Citation tokens: normalising source names and matching them to sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragframe.functions.text import strip
from ragframe.settings import CITATION_PATTERN, CITATION_PREFIX_PATTERN, UNKNOWN_ANSWER


def normalize_source_id(col: Column) -> Column:
    """Canonical form of a cited or stored source name."""
    bare = F.regexp_replace(strip(col), r"""^[`'"]+|[`'"]+$""", "")
    bare = F.regexp_replace(bare, CITATION_PREFIX_PATTERN, "")
    bare = F.regexp_replace(bare, r"[.,;:]+$", "")
    return F.lower(F.replace(bare, F.lit("\\"), F.lit("/")))


def source_id_variants(col: Column) -> Column:
    """Spellings under which a source may be cited: full, path, file, file#page."""
    full = normalize_source_id(col)
    path = F.substring_index(full, "#", 1)
    file = F.substring_index(path, "/", -1)
    page = F.when(full.contains("#"), F.substring(full, F.length(path) + 2, F.length(full)))
    paged = F.when(page != "", F.concat(file, F.lit("#"), page)).otherwise(F.lit(""))
    return F.array_distinct(
        F.filter(F.array(full, path, file, paged), lambda v: v.isNotNull() & (v != ""))
    )


def citations(col: Column) -> Column:
    """All bracketed tokens of a text, in order."""
    return F.regexp_extract_all(col, F.lit(CITATION_PATTERN), F.lit(1))


def has_valid_citation(text: Column, allowed: Column | None = None) -> Column:
    """True when at least one token cites an allowed source.

    Without an allow-list (column missing or null) any token will do.
    """
    cited = F.coalesce(citations(text), F.array().cast("array<string>"))
    some = F.size(cited) > 0
    if allowed is None:
        return some
    accepted = F.flatten(F.transform(allowed, source_id_variants))
    matched = F.arrays_overlap(F.transform(cited, normalize_source_id), accepted)
    return some & F.when(allowed.isNull(), F.lit(True)).otherwise(F.coalesce(matched, F.lit(False)))


def is_unknown(col: Column) -> Column:
    """Does the answer open with the refusal sentence (white space, case ignored)?"""
    flat = F.lower(F.regexp_replace(strip(F.coalesce(col, F.lit(""))), r"\s+", " "))
    return flat.startswith(UNKNOWN_ANSWER.rstrip(".").lower())
