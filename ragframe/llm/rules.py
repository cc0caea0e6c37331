"""Quality rules with adaptive thresholds, in DataFrame operations only.

Thresholds are not fixed: each rule's measure is summarised per language and source by a quantile sketch, a histogram
over logarithmic bins in the manner of DDSketch. Sketches merge by adding counts, so those of the sources give that of
their language, and those of the languages the whole. A measure fails beyond the 0.9-quantile plus ``FENCE`` times its
distance from the median, and for two-sided rules below the 0.1-quantile in the same way. Only where both are equal, as
in a group whose documents hardly ever repeat a line, a ``MARGIN`` of the rule takes the distance's place.

A group with fewer than ``LEAST_ROWS`` documents takes its language's thresholds, and a language with fewer those of the
whole table. So does a group whose own quantiles lie beyond those thresholds: where more than a tenth is junk, junk does
not set the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.llm.common import SPACES, WORD, saved

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3

# Relative width of the bins; a quantile is off by less than half of it.
GAMMA = 1.01
# Measures below this share the first bin.
SMALLEST = 1e-4

FENCE, LEAST_ROWS = 12.0, 50

# rule -> (measure over the base columns, margin where the quantiles are equal, whether small values fail too)
RULES = {
    "symbols": ("n_symbols / word_chars", 0.03, False),
    "lines": ("n_dup_lines / n_words", 0.03, False),
    "repeats": ("n_repeat_words / n_words", 0.3, False),
    "length": ("word_chars / n_words", 2.0, True),
}


def _let(value: Column, body) -> Column:
    """``body`` over a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text, the first occurrence included."""

    def count(w: Column) -> Column:
        last = F.size(w) - WINDOW
        windows = F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
        )
        return F.when(last < 1, F.lit(0)).otherwise(_let(windows, _covered))

    return _let(words, count)


def _covered(windows: Column) -> Column:
    def count(placed: Column) -> Column:
        last = F.size(placed) - 1

        def twin(entry: Column, i: Column) -> Column:
            before = (i > 0) & (F.get(placed, i - 1)["h"] == entry["h"])
            return before | ((i < last) & (F.get(placed, i + 1)["h"] == entry["h"]))

        spots = F.sort_array(F.transform(F.filter(placed, twin), lambda e: e["i"]))
        return _let(spots, _spanned)

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # most texts repeat no window
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(placed, count))


def _spanned(spots: Column) -> Column:
    """Words that windows at these sorted places cover."""
    following = F.transform(spots, lambda p, i: F.coalesce(F.get(spots, i + 1) - p, F.lit(WINDOW)))
    return F.aggregate(following, F.lit(0), lambda total, gap: total + F.least(gap, F.lit(WINDOW)))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base columns of each row of ``docs``; null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    measured = docs.select(
        "doc_id",
        "lang",
        "source",
        _let(word_array(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"))).alias("words"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    measured = measured.select(
        "doc_id",
        "lang",
        "source",
        F.col("words.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("words.r").cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def sketches(measured: DataFrame) -> DataFrame:
    """Bins of each rule's measure: (level, lang, source, rule, bin, n); level 2 is a source, 1 a language, 0 all.

    Only documents that pass the base rules count.
    """
    measures = F.array(
        *[F.struct(F.lit(name).alias("rule"), F.expr(m).cast("double").alias("x")) for name, (m, *_) in RULES.items()]
    )
    rows = measured.where("not base_failed").select("lang", "source", F.explode(measures).alias("m"))
    place = F.ceil(F.log(F.greatest(F.col("m.x"), F.lit(SMALLEST))) / F.log(F.lit(GAMMA)))
    sources = rows.select("lang", "source", "m.rule", place.alias("bin"))
    sources = sources.groupBy("lang", "source", "rule", "bin").agg(F.count("*").alias("n"))
    languages = sources.groupBy("lang", "rule", "bin").agg(F.sum("n").alias("n"))
    whole = languages.groupBy("rule", "bin").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    return (
        sources.withColumn("level", F.lit(2))
        .unionByName(languages.withColumns({"level": F.lit(1), "source": none}))
        .unionByName(whole.withColumns({"level": F.lit(0), "lang": none, "source": none}))
    )


def thresholds(bins: DataFrame) -> DataFrame:
    """(level, lang, source, rows, one struct per rule): the least and most that pass, and the quantiles low and high."""
    group = ["level", "lang", "source", "rule"]
    upto = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.withColumns({"upto": F.sum("n").over(upto), "rows": F.sum("n").over(Window.partitionBy(*group))})
    # the middle of the bin in which the quantile lies
    value = F.pow(F.lit(GAMMA), F.col("bin")) * (2 / (1 + GAMMA))

    def quantile(tenths: int) -> Column:
        return F.min(F.when(10 * F.col("upto") >= tenths * F.col("rows"), value))

    found = ranked.groupBy(*group, "rows").agg(quantile(1).alias("low"), quantile(5).alias("middle"), quantile(9).alias("high"))
    margin, below = F.lit(0.0), F.lit(False)
    for name, (_, least, two_sided) in RULES.items():
        margin = F.when(F.col("rule") == name, F.lit(least)).otherwise(margin)
        below = F.when(F.col("rule") == name, F.lit(two_sided)).otherwise(below)

    def room(distance: Column) -> Column:
        return F.when(distance > 0, distance * FENCE).otherwise(margin)

    least = F.col("low") - room(F.col("middle") - F.col("low"))
    limit = F.struct(
        F.when(below, least).otherwise(F.lit(float("-inf"))).alias("least"),
        (F.col("high") + room(F.col("high") - F.col("middle"))).alias("most"),
        "low",
        "high",
    )
    found = found.withColumn("limit", limit)
    per_rule = [F.max(F.when(F.col("rule") == name, F.col("limit"))).alias(name) for name in RULES]
    return found.groupBy("level", "lang", "source").agg(F.max("rows").alias("rows"), *per_rule)


def _trusted(own: Column, wider: Column) -> Column:
    """A group's limits of a rule, or the wider group's where it has none or its quantiles lie beyond those."""
    within = (own["high"] <= wider["most"]) & (own["low"] >= wider["least"])
    return F.when(own.isNotNull() & (wider.isNull() | within), own).otherwise(wider)


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, lang, source, text): the base columns, base_failed, failed_rules, kept.

    Null languages and sources are groups of their own. Documents that fail the base rules are not kept; the others
    are if no measure lies beyond its group's limits. Other columns are ignored.
    """
    measured = saved(base_counts(docs.select("doc_id", "lang", "source", "text")), "rules-base")
    limits = saved(thresholds(sketches(measured)), "rules-limits")
    names = list(RULES)

    def at(level: int, *keys: str) -> DataFrame:
        enough = limits.where((F.col("level") == level) & (F.col("rows") >= (LEAST_ROWS if level else 0)))
        renamed = [F.col(k).alias(f"{k}_{level}") for k in keys]
        return enough.select(*renamed, F.struct(*names).alias(f"limits_{level}"))

    source, language, whole = at(2, "lang", "source"), at(1, "lang"), at(0)
    same_language = F.col("lang").eqNullSafe(F.col("lang_1"))
    same_source = F.col("lang").eqNullSafe(F.col("lang_2")) & F.col("source").eqNullSafe(F.col("source_2"))
    joined = measured.join(language, same_language, "left").join(source, same_source, "left")
    # the limits of the whole table are one row
    default = whole.first()
    for name in RULES:
        own, wider = F.col(f"limits_2.{name}"), F.col(f"limits_1.{name}")
        if default is not None:
            wider = _trusted(wider, F.struct(*[F.lit(v).alias(k) for k, v in default[0][name].asDict().items()]))
        joined = joined.withColumn(f"limit_{name}", _trusted(own, wider))
    failed = [
        F.when(~F.expr(measure).between(F.col(f"limit_{name}.least"), F.col(f"limit_{name}.most")), F.lit(name))
        for name, (measure, *_) in RULES.items()
    ]
    bad = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*failed)))
    joined = joined.withColumn("failed_rules", bad)
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    base = [c for c in measured.columns if c not in ("lang", "source")]
    return joined.select(*base, "failed_rules", kept.alias("kept"))
