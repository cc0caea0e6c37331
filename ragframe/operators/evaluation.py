"""Evaluation tables: routing accuracy, metric means, lexical measures, assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe.functions.text import overlap_share, tokens


def routed(df: DataFrame) -> DataFrame:
    """Expected and predicted tool with ``correct``; no prediction counts as ``invalid``."""
    predicted = F.coalesce("predicted_tool", F.lit("invalid"))
    return df.withColumn("predicted_tool", predicted).withColumn(
        "correct", F.coalesce(F.col("predicted_tool") == F.col("expected_tool"), F.lit(False))
    )


def tool_accuracy(df: DataFrame) -> DataFrame:
    """total, correct, accuracy (0.0 for an empty set)."""
    return (
        routed(df)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.coalesce(F.sum(F.col("correct").cast("bigint")), F.lit(0)).alias("correct"),
        )
        .withColumn(
            "accuracy", F.coalesce(F.try_divide(F.col("correct"), F.col("total")), F.lit(0.0))
        )
    )


def tool_confusion(df: DataFrame) -> DataFrame:
    return (
        routed(df)
        .groupBy("expected_tool", "predicted_tool", "correct")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def metric_means(df: DataFrame) -> DataFrame:
    """Rows (metric, mean, row_count): mean of each numeric column, 4 decimals.

    Nulls and NaN are ignored, columns without any value are left out.
    """
    numeric = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    means = [
        F.round(F.avg(F.nanvl(F.col(f.name).cast("double"), F.lit(None))), 4).alias(f.name)
        for f in numeric
    ]
    one = df.agg(F.count(F.lit(1)).alias("row_count"), *means)
    if not numeric:
        return one.select(F.lit("").alias("metric"), F.lit(0.0).alias("mean"), "row_count").limit(0)
    return one.unpivot("row_count", [f.name for f in numeric], "metric", "mean").filter(
        F.col("mean").isNotNull()
    ).select("metric", "mean", "row_count")


def lexical_quality(rows: DataFrame) -> DataFrame:
    """Token coverage between question, answer, contexts and ground truth.

    These are lexical shares, not the judged metrics their places are taken from.
    """
    question, answer = tokens(F.col("question")), tokens(F.col("answer"))
    truth = tokens(F.coalesce("ground_truth", F.lit("")))
    context = tokens(F.array_join("contexts", "\n"))

    def mean_share() -> Column:
        shares = F.transform("contexts", lambda c: overlap_share(question, tokens(c)))
        total = F.aggregate(shares, F.lit(0.0), lambda a, v: a + v)
        return F.when(F.size("contexts") > 0, total / F.size("contexts")).otherwise(F.lit(0.0))

    return rows.select(
        "question",
        F.round(overlap_share(question, answer), 6).alias("lex_answer_relevancy"),
        F.round(mean_share(), 6).alias("lex_context_precision"),
        F.round(overlap_share(answer, context), 6).alias("lex_faithfulness"),
        F.round(overlap_share(truth, context), 6).alias("lex_context_recall"),
    )


def assertions(outputs: DataFrame, rules: DataFrame) -> DataFrame:
    """Per case: number of rules, of passed ones, and whether all passed.

    ``rules``: case_id, kind (``contains`` or ``regex``), value.
    """
    output = F.coalesce("output", F.lit(""))
    hit = (
        F.when(F.col("kind") == "contains", F.contains(output, F.col("value")))
        .when(F.col("kind") == "regex", F.rlike(output, F.col("value")))
        .otherwise(F.lit(False))
    )
    return (
        rules.join(outputs, "case_id", "left")
        .withColumn("_hit", hit)
        .groupBy("case_id")
        .agg(
            F.count(F.lit(1)).alias("rules"),
            F.sum(F.col("_hit").cast("bigint")).alias("passed"),
            F.every("_hit").alias("all_passed"),
        )
    )
