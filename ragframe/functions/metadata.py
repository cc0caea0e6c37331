"""Open metadata: keys of a document beyond the named columns, kept as a map of texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

META_TYPE = T.MapType(T.StringType(), T.StringType())


def filled(entries: list[Column]) -> Column:
    """Map of the (key, value) structs whose value is not null."""
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def entry(name: str) -> Column:
    return F.struct(F.lit(name).alias("key"), F.col(f"`{name}`").cast("string").alias("value"))


def overlaid(base: Column, over: Column) -> Column:
    """Both maps as one; a key of both has the value of ``over``. Null maps count as empty."""
    empty = F.create_map().cast(META_TYPE)
    base, over = F.coalesce(base, empty), F.coalesce(over, empty)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def _as_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.AtomicType, T.NullType)) and not isinstance(kind, (T.BinaryType, T.VariantType))


def with_meta(df: DataFrame, named: Iterable[str]) -> DataFrame:
    """Fold the columns that are not among ``named`` into the map ``meta``.

    Numbers, dates and truth values become texts; nulls leave no key; lists, structs
    and maps become JSON, bytes are left out. Keys that ``meta`` has already stay, unless a column gives
    them anew.
    """
    fixed = {n.lower() for n in named} | {"meta"}
    extra = [f for f in df.schema.fields if f.name.lower() not in fixed and not isinstance(f.dataType, T.BinaryType)]
    given = F.col("meta").cast(META_TYPE) if "meta" in df.columns else F.lit(None).cast(META_TYPE)
    if extra:
        entries = [
            entry(f.name)
            if _as_text(f.dataType)
            else F.struct(F.lit(f.name).alias("key"), F.to_json(F.col(f"`{f.name}`")).alias("value"))
            for f in extra
        ]
        given = overlaid(given, filled(entries))
    dropped = [c for c in df.columns if c.lower() not in fixed]
    return df.withColumn("meta", given).drop(*dropped)
