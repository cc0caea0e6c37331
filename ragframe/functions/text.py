"""Text expressions: stripping, tokens, lexical overlap and personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe.settings import PII_PATTERNS, TOKEN_PATTERN


def strip(col: Column) -> Column:
    """Remove white space of every kind (not only blanks) at both ends."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def is_blank(col: Column) -> Column:
    return ~col.rlike(r"\S")


def tokens(col: Column) -> Column:
    """Distinct lower-case alphanumeric terms of two or more characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), F.lit(0)))


def overlap_share(part: Column, whole: Column) -> Column:
    """Share of the terms in ``part`` that also occur in ``whole``."""
    return F.size(F.array_intersect(part, whole)) / F.greatest(F.lit(1), F.size(part))


def pii_enabled(flag: str | None) -> bool:
    """Read the on/off switch the way a text setting spells it (default: on)."""
    return (flag if flag is not None else "1").lower() in {"1", "true", "yes", "on"}


def redact(col: Column, enabled: bool = True) -> Column:
    """Replace personal data by ``<ENTITY>`` placeholders.

    The first pattern is by far the slowest; text without an ``@`` skips it
    after a plain substring scan.
    """
    if not enabled:
        return col
    for entity, pattern, _ in PII_PATTERNS:
        replaced = F.regexp_replace(col, pattern, f"<{entity}>")
        if entity == "EMAIL_ADDRESS":
            col = F.when(col.contains("@"), replaced).otherwise(col)
        else:
            col = replaced
    return col


def with_pii_hits(df: DataFrame, column: str) -> DataFrame:
    """Add the number of hits per entity in each text, as a column per entity.

    An entity is counted after the earlier ones are replaced. Each step is a
    column of its own, so that no replacement is computed twice.
    """
    df = df.withColumn("_text", F.col(column))
    for entity, pattern, _ in PII_PATTERNS:
        text = F.col("_text")
        able = text.contains("@") if entity == "EMAIL_ADDRESS" else F.lit(True)
        count = F.when(able, F.regexp_count(text, F.lit(pattern))).otherwise(F.lit(0))
        df = df.withColumn(entity, count).withColumn(
            "_text",
            F.when(F.col(entity) > 0, F.regexp_replace(text, pattern, f"<{entity}>")).otherwise(text),
        )
    return df.drop("_text")


def pii_counts(df: DataFrame, column: str) -> DataFrame:
    """Total hits per entity over a table: one row per entity."""
    names = [entity for entity, _, _ in PII_PATTERNS]
    totals = with_pii_hits(df.select(column), column).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names]
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(entity).alias("entity"),
                F.lit(confidence).alias("confidence"),
                F.col(entity).alias("hits"),
            )
            for entity, _, confidence in PII_PATTERNS
        ]
    )
    return totals.select(F.inline(pairs))


def _redact_typed(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return redact(col)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda item: _redact_typed(item, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(col, lambda _, value: _redact_typed(value, kind.valueType))
    if isinstance(kind, T.StructType):
        rebuilt = F.struct(
            *[_redact_typed(col.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        )
        return F.when(col.isNotNull(), rebuilt)
    return col


def redact_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Redact every string inside the given columns, however deeply nested.

    Map keys and values of other types stay as they are.
    """
    chosen = set(df.columns if columns is None else columns)
    return df.select(
        *[
            _redact_typed(F.col(f.name), f.dataType).alias(f.name)
            if f.name in chosen
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
