"""Inputs of the registered queries, derived from the given tables.

Paths, headers, overrides and model outputs are computed columns over whole
tables; no rows are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.functions import ids
from ragframe.functions.metadata import entry, filled
from ragframe.functions.text import redact
from ragframe.functions.vectors import embed
from ragframe.operators.chunking import chunk_fixed
from ragframe.operators.store import with_file
from ragframe.session import new_path, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cycle(col: str, values: list) -> Column:
    """Pick a value by ``col`` modulo the number of values."""
    picked = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        picked = F.when(F.col(col) % len(values) == i, F.lit(v)).otherwise(picked)
    return picked


def rel_path() -> Column:
    return F.concat(
        F.when(F.col("doc_id") % 4 == 0, "external/").otherwise(""),
        F.col("source"),
        F.lit("/"),
        F.col("doc_id").cast("string"),
        _cycle("doc_id", [".md", ".txt", ".pdf"]),
    )


def markdown_text() -> Column:
    """Headers at every third initial letter, a fenced block at the end."""
    body = F.regexp_replace("text", "\n([A-H])", "\n## $1")
    body = F.regexp_replace(body, "\n([I-P])", "\n### $1")
    head = F.concat(F.lit("# "), F.col("source"), F.lit("\n"))
    return F.concat(head, body, F.lit("\n```\n# no header\n```\n# Last\nend"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files (rel_path, text); Markdown files get headers."""
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, markdown_text()).otherwise(F.col("text"))
    return spread(docs, "doc_id").select("doc_id", rel_path().alias("rel_path"), text.alias("text"), "lang")


def incoming(spark: SparkSession, sf_dir: str, path: str) -> int:
    """Write the documents as Parquet files of (rel_path, text) for a stream; returns their number.

    Four at least, else one per split of the table, so that a file and the task that writes it do not grow with it.
    """
    parts = max(4, table(spark, sf_dir, "documents").rdd.getNumPartitions())
    given = files(spark, sf_dir).select("rel_path", "text")
    given.repartition(parts, "rel_path").write.parquet(path)
    return len(spark.read.schema(given.schema).parquet(path).inputFiles())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted documents with their language as open metadata; paged files are taken as their page 1, 2 or 3."""
    page = F.concat(F.lit("#p"), (F.col("doc_id") % 3 + 1).cast("string"))
    named = files(spark, sf_dir).withColumn(
        "source_id",
        F.when(F.col("rel_path").endswith(".pdf"), F.concat("rel_path", page)).otherwise(
            F.col("rel_path")
        ),
    )
    return named.select(
        "source_id",
        F.col("rel_path").alias("source_path"),
        ids.doc_type(F.col("rel_path")).alias("doc_type"),
        redact(F.col("text")).alias("text"),
        # a key of the documents' own, which reaches chunks, store, hits and sources
        filled([entry("lang")]).alias("meta"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-window chunks of all documents with number and id."""
    cut = chunk_fixed(documents(spark, sf_dir)).withColumnRenamed("pos", "chunk_index")
    return ids.with_chunk_id(cut).withColumn(
        "h1", F.split_part("source_path", F.lit("/"), F.lit(1))
    )


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed(chunks(spark, sf_dir))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedded chunks as a table in the shared folder, as a search finds them."""
    path = new_path(spark, "chunks")
    made = embedded(spark, sf_dir)
    made.write.partitionBy("doc_type").parquet(path)
    return with_file(spark.read.schema(made.schema).parquet(path))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark texts as questions, with a mix of overrides."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(
        F.col("item_id").cast("string").alias("query_id"),
        F.col("text").alias("question"),
        _cycle("item_id", ["similarity", "hybrid", "mmr", None]).alias("mode"),
        _cycle("item_id", ["all", "external", None]).alias("scope"),
        F.when(F.col("item_id") % 5 == 0, 4).alias("k"),
        (F.col("item_id") % 5).alias("style"),
        (F.col("item_id") % 7).alias("tool_style"),
    )


def plain_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries(spark, sf_dir).select("query_id", "question", "scope", "k")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector table as a store: external for the first labels."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"),
        F.col("label"),
        F.when(F.col("label") < 3, "external").otherwise("project").alias("doc_type"),
        "embedding",
    )


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean vector of its rows, to six decimals."""
    means = (
        table(spark, sf_dir, "embeddings")
        .select("label", F.posexplode("embedding"))
        .groupBy("label", "pos")
        .agg(F.round(F.avg(F.col("col").cast("double")), 6).alias("mean"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("cells"))
    )
    return means.select(
        F.col("label").cast("string").alias("query_id"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("question"),
        _cycle("label", ["all", "external", "project"]).alias("scope"),
        F.transform("cells", lambda c: c["mean"]).alias("qvec"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user turns, some of them worded as requests for an artifact."""
    lead = _cycle(
        "conv_id",
        [
            "Create an ADR about ",
            "Write user stories for ",
            "Provide a solution outline for ",
            "Prepare a risk assessment of ",
            "Draft the assessment of ",
            "",
        ],
    )
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return turns.select(
        "conv_id",
        "turn",
        F.concat_ws("-", "conv_id", "turn").alias("query_id"),
        F.concat(lead, F.col("text")).alias("question"),
        _cycle(
            "conv_id",
            ["adr", "user_stories", "solution_outline", "risk_assessment", "risk_assessment", "ask"],
        ).alias("expected_tool"),
        _cycle("turn", [None, "", " External ", "ALL", "*", "other", "project"]).alias("scope"),
        _cycle("conv_id", [None, "auto", " MMR", "hybrid", "similarity", "bm25", ""]).alias("mode"),
        _cycle("conv_id", [None, "0", "-3", "abc", "4", " 30 ", "200", "2.5"]).alias("k_header"),
        F.when(F.col("conv_id") % 3 == 0, F.col("turn").cast("int") - 1).alias("k"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All assistant turns as draft answers, cited in various ways."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    doc = F.concat(F.lit("external/Src"), (F.col("conv_id") % 20).cast("string"), F.lit("/"))
    name = F.concat(F.col("conv_id").cast("string"), F.lit(".pdf"))
    cite = _pick(
        "conv_id",
        [
            F.concat(F.lit(" ["), doc, name, F.lit("#p6]")),
            F.concat(F.lit(" ["), name, F.lit("] [nothing]")),
            F.concat(F.lit(" [Source: `"), F.replace(doc, F.lit("/"), F.lit("\\")), name, F.lit(".`]")),
            F.lit(" [wrong]"),
            F.lit(""),
        ],
    )
    refusal = F.lit("  I  don't KNOW based on the\nprovided documents and more")
    body = F.concat(F.col("text"), cite)
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"),
        F.when(F.col("conv_id") % 11 == 0, refusal).otherwise(body).alias("answer"),
        F.when(
            F.col("conv_id") % 13 != 0,
            F.array(F.concat(doc, name, F.lit("#p6")), F.lit("src0/readme.md")),
        ).alias("source_ids"),
    )


def _pick(col: str, values: list) -> Column:
    picked = values[-1]
    for i, v in enumerate(values[:-1]):
        picked = F.when(F.col(col) % len(values) == i, v).otherwise(picked)
    return picked


def routing_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User questions with a routing answer as a model might give it."""
    base = questions(spark, sf_dir)
    text = F.to_json(F.struct(F.col("turn").alias("n")))
    raw = _pick(
        "conv_id",
        [
            F.concat(F.lit('{"tool": "adr", "args": {"decision": "use '), F.col("conv_id"),
                     F.lit('", "alternatives": ["a", "b"]}}')),
            F.concat(F.lit('{"tool": "user_stories", "args": {"request": "r'), F.col("conv_id"),
                     F.lit('", "context_query": "c"}}')),
            F.lit('{"tool": "unheard_of", "args": {}}'),
            F.lit('{"tool": "adr"}'),
            F.lit("no json"),
            text,
            F.lit('{"tool": "solution_outline", "args": {}}'),
        ],
    )
    return base.select("query_id", "question", raw.alias("routing"))


def structured_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as structured outputs: valid ones, and every kind of fault."""
    turns = table(spark, sf_dir, "conversations")
    tool = _cycle("conv_id", ["adr", "solution_outline", "user_stories", "risk_assessment"])
    sources = F.concat(F.lit('["s'), F.col("conv_id"), F.lit('"]'))
    lists = (
        '"alternatives": ["a"], "consequences": [], "architecture": ["x"], "risks": ["r", "q"], '
        '"assumptions": [], "stories": ["s"], "acceptance_criteria": ["c"], "mitigations": ["m"]'
    )
    texts = '"context": "c", "decision": "d", "summary": "s", "epic": "e"'
    good = F.concat(
        F.lit('{"title": "Title '), F.col("conv_id"), F.lit(f'", {texts}, {lists}, "sources": '),
        sources, F.lit("}"),
    )
    raw = _pick(
        "conv_id",
        [
            good,
            F.lit(f'{{"title": "Tiny", {texts}, {lists}, "sources": []}}'),
            F.lit(f'{{"title": 12345, {texts}, {lists}, "sources": []}}'),
            F.lit(f'{{"title": "Long enough", {texts}, {lists}, "sources": ["a", 1]}}'),
            F.lit(f'{{"title": "Long enough", {texts}, {lists}}}'),
            F.lit("  \n"),
            F.lit('{"title": '),
        ],
    )
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"),
        tool.alias("tool"),
        F.when(F.col("role") == "system", good).otherwise(raw).alias("output"),
    )
