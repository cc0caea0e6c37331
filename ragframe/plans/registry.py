"""The registered queries: one per operator, each over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.functions import artifacts as art
from ragframe.functions import citations as cit
from ragframe.functions import ids, params, text
from ragframe.functions.vectors import embed
from ragframe.operators import answers as ans
from ragframe.operators import chunking, evaluation, grounding, search, store
from ragframe.plans import artifact, ask, evaluate, ingest
from ragframe.plans import fixtures as fx
from ragframe.plans import oracles as sql
from ragframe.plans.oracles import q, with_
from ragframe.session import checkpointed, new_path
from ragframe.settings import RetrievalDefaults
from ragframe.sources import files as src
from ragframe.streaming.ingest import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def score6(name: str = "score") -> Column:
    return F.round(F.col(name), 6).alias(name)


def joined(col: Column | str, sep: str = "|") -> Column:
    return F.array_join(col, sep)


# --- sources and sinks -------------------------------------------------------


@register(
    "scan_text_tree",
    """
SELECT lang AS folder, 'project' AS doc_type, count(*)::BIGINT AS n_lines,
  sum(length(line))::BIGINT AS n_chars
FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY ALL""",
)
def scan_text_tree(spark, sf):
    """Documents written as .txt files by language, read back as a tree."""
    base = new_path(spark, "tree")
    fx.table(spark, sf, "documents").select("lang", "text").write.partitionBy("lang").text(base)
    docs = src.text_to_documents(src.read_tree(spark, base), redaction=False)
    folder = F.regexp_extract("source_path", "^lang=([^/]*)/", 1)
    # Every written row ends with a line break.
    lines = F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n"))
    return (
        docs.select(folder.alias("folder"), "doc_type", lines.alias("line"))
        .groupBy("folder", "doc_type")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))
    )


@register(
    "pages_to_documents",
    f"""
SELECT source_path || '#p' || page_no AS source_id, source_path,
  CASE WHEN starts_with(source_path, 'external/') THEN 'external' ELSE 'project' END AS doc_type, text
FROM (SELECT CASE WHEN page_id % 4 = 0 THEN 'external/' ELSE '' END || split_part(url, '/', 3) || '.pdf' AS source_path,
  page_id + 1 AS page_no, {sql.redact("CASE WHEN page_id % 10 = 3 THEN ' ' || chr(10) ELSE html END")} AS text FROM pages)
WHERE regexp_matches(text, '\\S')""",
)
def pages_to_documents(spark, sf):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    folder = F.when(F.col("page_id") % 4 == 0, "external/").otherwise("")
    pages = fx.spread(fx.table(spark, sf, "pages"), "page_id").select(
        F.concat(folder, host, F.lit(".pdf")).alias("rel_path"),
        (F.col("page_id") + 1).alias("page_no"),
        F.when(F.col("page_id") % 10 == 3, " \n").otherwise(F.col("html")).alias("text"),
    )
    return src.pages_to_documents(pages)


@register(
    "scan_jsonl",
    "SELECT conv_id || '-' || turn AS id, text AS question, length(text) AS n FROM conversations WHERE role = 'user'",
)
def scan_jsonl(spark, sf):
    """User turns written as JSON lines and read back."""
    path = new_path(spark, "questions")
    turns = fx.table(spark, sf, "conversations").filter(F.col("role") == "user")
    turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.col("text").alias("question"),
        F.length("text").cast("bigint").alias("n"),
    ).write.json(path)
    return src.read_jsonl(spark, path, "id string, question string, n bigint")


@register(
    "union_question_sets",
    """
SELECT question, truth, 'n/a' AS origin FROM (
  SELECT text AS question, 'item ' || item_id AS truth FROM benchmark
  UNION ALL SELECT text, NULL FROM conversations WHERE role = 'user')""",
)
def union_question_sets(spark, sf):
    base = fx.table(spark, sf, "benchmark").select(
        F.col("text").alias("question"),
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("truth"),
    )
    turns = fx.table(spark, sf, "conversations").filter(F.col("role") == "user")
    more = turns.select(F.col("text").alias("question"))
    return src.union_questions(base, more).withColumn("origin", F.lit("n/a"))


def _paged_name() -> Column:
    """Stored source ids: pages of one file per source, plain files otherwise."""
    page = F.concat(F.lit("#p"), F.col("doc_id").cast("string"))
    path = F.concat("source", F.lit("/"), (F.col("doc_id") % 10).cast("string"))
    return F.when(
        F.col("doc_id") % 3 == 2, F.concat(path, F.lit("#part.pdf"), page)
    ).otherwise(F.concat(path, F.lit(".md")))


def _stored(spark, sf) -> DataFrame:
    docs = fx.table(spark, sf, "documents")
    named = ids.with_source_path(docs.withColumn("source_id", _paged_name()))
    # Pages of a file are stored under its full name.
    path = F.regexp_replace("source_id", "#p[0-9]+$", "")
    return named.select(
        F.concat(F.lit("old-"), F.col("doc_id").cast("string")).alias("chunk_id"),
        "source_id",
        F.when(F.col("doc_id") % 2 == 0, path).otherwise(F.col("source_path")).alias("source_path"),
        "text",
    )


def _batch(spark, sf) -> DataFrame:
    """New chunks for some of the files: those named after a label's quality."""
    labels = fx.table(spark, sf, "labels")
    docs = fx.table(spark, sf, "documents").join(labels, "doc_id").filter(F.col("quality") == 0)
    path = F.regexp_replace(_paged_name(), "#p[0-9]+$", "")
    return docs.select(
        F.concat(F.lit("new-"), F.col("doc_id").cast("string")).alias("chunk_id"),
        _paged_name().alias("source_id"),
        path.alias("source_path"),
        "text",
    )


STORED_SQL = """
named AS (
  SELECT *, CASE WHEN doc_id % 3 = 2 THEN source || '/' || (doc_id % 10) || '#part.pdf#p' || doc_id
    ELSE source || '/' || (doc_id % 10) || '.md' END AS source_id FROM documents),
pathed AS (SELECT *, regexp_replace(source_id, '#p[0-9]+$', '') AS full_path FROM named),
stored AS (
  SELECT 'old-' || doc_id AS chunk_id, source_id,
    CASE WHEN doc_id % 2 = 0 THEN full_path ELSE split_part(source_id, '#p', 1) END AS source_path, text FROM pathed),
batch AS (
  SELECT 'new-' || doc_id AS chunk_id, source_id, full_path AS source_path, text
  FROM pathed JOIN labels USING (doc_id) WHERE quality = 0),
hit AS (
  SELECT chunk_id FROM stored s WHERE EXISTS (SELECT 1 FROM batch b
    WHERE b.source_path = s.source_path OR b.source_path = s.source_id
      OR starts_with(s.source_id, b.source_path || '#p')))
"""


@register(
    "upsert_chunks",
    with_(
        STORED_SQL,
        select="""
SELECT chunk_id, source_id, source_path, length(text)::INT AS n_chars FROM stored
WHERE chunk_id NOT IN (SELECT chunk_id FROM hit)
UNION ALL SELECT chunk_id, source_id, source_path, length(text)::INT FROM batch""",
    ),
)
def upsert_chunks(spark, sf):
    after, _ = store.upsert(_stored(spark, sf), _batch(spark, sf))
    return after.select("chunk_id", "source_id", "source_path", F.length("text").alias("n_chars"))


STORE_COLUMNS = "chunk_id, source_id, source_path, doc_type, chunk_index, h1, length(text)::INT AS n_chars"


def _stored_view(df: DataFrame) -> DataFrame:
    return df.select(
        "chunk_id",
        "source_id",
        "source_path",
        "doc_type",
        "chunk_index",
        "h1",
        F.length("text").alias("n_chars"),
    )


@register("write_chunks", with_(sql.STORE, select=f"SELECT {STORE_COLUMNS} FROM chunks"))
def write_chunks(spark, sf):
    """Embedded chunks written as a store, read back."""
    path = new_path(spark, "store")
    store.write_store(fx.embedded(spark, sf), path)
    return _stored_view(store.read_store(spark, path))


@register(
    "upsert_store",
    with_(
        sql.STORE,
        select=f"""
SELECT {STORE_COLUMNS} FROM chunks WHERE NOT starts_with(source_path, 'external/')
UNION ALL SELECT {STORE_COLUMNS.replace("length(text)", "length(text || '!')")} FROM chunks
WHERE starts_with(source_path, 'external/')""",
    ),
)
def upsert_store(spark, sf):
    """A store on disk whose external sources are replaced, then compacted."""
    path = new_path(spark, "store")
    store.upsert_store(spark, path, fx.embedded(spark, sf))
    external = fx.chunks(spark, sf).filter(F.col("doc_type") == "external")
    changed = embed(external.withColumn("text", F.concat("text", F.lit("!"))))
    store.upsert_store(spark, path, changed, label="change")
    store.compact(spark, path)
    return _stored_view(store.read_store(spark, path))


@register(
    "write_eval_json",
    """
SELECT 'row' AS part, doc_id::VARCHAR AS key, quality::DOUBLE AS value FROM labels
UNION ALL SELECT 'summary', 'quality', round(avg(quality), 4) FROM labels
UNION ALL SELECT 'summary', 'toxic', round(avg(toxic), 4) FROM labels""",
)
def write_eval_json(spark, sf):
    """Rows and metric means written as JSON and read back."""
    path = new_path(spark, "report")
    rows = fx.table(spark, sf, "labels")
    means = evaluation.metric_means(rows.select("quality", "toxic"))
    src.write_report(rows, means, path)
    back = src.read_jsonl(spark, f"{path}/rows", "doc_id bigint, quality int, toxic int")
    summary = src.read_jsonl(spark, f"{path}/summary", "metric string, mean double")
    return back.select(
        F.lit("row").alias("part"),
        F.col("doc_id").cast("string").alias("key"),
        F.col("quality").cast("double").alias("value"),
    ).union(
        summary.select(F.lit("summary"), "metric", F.col("mean"))
    )


@register(
    "store_sample",
    with_(
        sql.STORE,
        select="""
SELECT chunk_id, source_id, doc_type, 
  'chunk_index|doc_type|h1|' || CASE WHEN lang IS NULL THEN '' ELSE 'lang|' END || 'source_id|source_path|text' AS metadata_keys
FROM chunks WHERE chunk_id > '7' ORDER BY chunk_id LIMIT 10""",
    ),
)
def store_sample(spark, sf):
    """The page of ten chunks that follows an id."""
    page = store.sample(fx.chunks(spark, sf), 10, "7")
    return page.withColumn("metadata_keys", joined("metadata_keys"))


@register(
    "store_info",
    with_(
        sql.STORE,
        select="SELECT true AS store_exists, count(*)::BIGINT AS points_count FROM chunks",
    ),
)
def store_info(spark, sf):
    path = new_path(spark, "store")
    store.write_store(fx.chunks(spark, sf), path)
    return store.store_info(spark, path)


# --- parameters --------------------------------------------------------------


@register(
    "derive_doc_type",
    with_(
        sql.FILES,
        select="""SELECT rel_path, CASE WHEN starts_with(rel_path, 'external/') THEN 'external'
  ELSE 'project' END AS doc_type FROM files""",
    ),
)
def derive_doc_type(spark, sf):
    return fx.files(spark, sf).select("rel_path", ids.doc_type(F.col("rel_path")).alias("doc_type"))


VARIED = "CASE WHEN doc_id % 5 = 0 THEN upper(source_id) WHEN doc_id % 7 = 0 THEN source_id || '.bak' ELSE source_id END"


@register(
    "classify_format",
    with_(
        sql.FILES,
        f"""varied AS (SELECT {VARIED} AS source_id FROM (SELECT doc_id,
  CASE WHEN rel_path LIKE '%.pdf' THEN rel_path || '#p1' ELSE rel_path END AS source_id FROM files))""",
        select="""SELECT source_id, CASE WHEN lower(source_id) LIKE '%.md' THEN 'md'
  WHEN lower(source_id) LIKE '%.pdf' OR contains(lower(source_id), '.pdf#p') THEN 'pdf' ELSE 'other' END AS format
FROM varied""",
    ),
)
def classify_format(spark, sf):
    paged = F.when(
        F.col("rel_path").endswith(".pdf"), F.concat("rel_path", F.lit("#p1"))
    ).otherwise(F.col("rel_path"))
    named = fx.files(spark, sf).select("doc_id", paged.alias("source_id"))
    varied = named.select(
        F.when(F.col("doc_id") % 5 == 0, F.upper("source_id"))
        .when(F.col("doc_id") % 7 == 0, F.concat("source_id", F.lit(".bak")))
        .otherwise(F.col("source_id"))
        .alias("source_id")
    )
    return varied.withColumn("format", ids.doc_format(F.col("source_id")))


@register(
    "derive_source_path",
    with_(
        sql.FILES,
        """raw AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE rel_path || '#p' || doc_id END AS source_id,
  CASE doc_id % 3 WHEN 0 THEN rel_path WHEN 1 THEN '' END AS given FROM files)""",
        select="""SELECT doc_id, coalesce(source_id, 'unknown_source') AS source_id,
  coalesce(nullif(given, ''), split_part(coalesce(source_id, 'unknown_source'), '#p', 1)) AS source_path FROM raw""",
    ),
)
def derive_source_path(spark, sf):
    raw = fx.files(spark, sf).select(
        "doc_id",
        F.when(
            F.col("doc_id") % 11 != 0,
            F.concat("rel_path", F.lit("#p"), F.col("doc_id").cast("string")),
        ).alias("source_id"),
        F.when(F.col("doc_id") % 3 == 0, F.col("rel_path"))
        .when(F.col("doc_id") % 3 == 1, "")
        .alias("source_path"),
    )
    return ids.with_source_path(raw)


RESOLVED_SQL = [sql.QUESTIONS, sql.HEADED, sql.resolved("headed")]


def _resolved(spark, sf, **changes) -> DataFrame:
    return params.resolve_params(fx.questions(spark, sf), RetrievalDefaults(**changes))


@register("resolve_scope", with_(*RESOLVED_SQL, select="SELECT query_id, scope FROM params"))
def resolve_scope(spark, sf):
    return _resolved(spark, sf).select("query_id", "scope")


@register("resolve_k", with_(*RESOLVED_SQL, select="SELECT query_id, k::INT AS k FROM params"))
def resolve_k(spark, sf):
    return _resolved(spark, sf).select("query_id", "k")


@register("resolve_mode", with_(*RESOLVED_SQL, select="SELECT query_id, rmode AS mode FROM params"))
def resolve_mode(spark, sf):
    return _resolved(spark, sf).select("query_id", "mode")


@register(
    "resolve_fetch_k",
    with_(*RESOLVED_SQL, select="SELECT query_id, rmode AS mode, scope, fetch_k::INT AS fetch_k FROM params"),
)
def resolve_fetch_k(spark, sf):
    return _resolved(spark, sf).select("query_id", "mode", "scope", "fetch_k")


@register(
    "resolve_alpha",
    with_(
        *RESOLVED_SQL,
        select="""SELECT query_id, CASE scope WHEN 'external' THEN 0.45::DOUBLE WHEN 'all' THEN 0.65::DOUBLE
  ELSE 0.7::DOUBLE END AS alpha FROM params""",
    ),
)
def resolve_alpha(spark, sf):
    return _resolved(spark, sf, alpha_external=0.45, alpha_all=0.65).select("query_id", "alpha")


@register(
    "resolve_threshold",
    with_(*RESOLVED_SQL, select="SELECT query_id, scope, threshold FROM params"),
)
def resolve_threshold(spark, sf):
    return _resolved(spark, sf).select("query_id", "scope", "threshold")


RAW_SETTING = "CASE event_id % 4 WHEN 0 THEN props->>'$.k' WHEN 1 THEN event_type WHEN 2 THEN ' ' || value || ' ' END"


@register(
    "parse_setting",
    rf"""
SELECT event_id, CASE WHEN regexp_full_match(raw, '[0-9]+') THEN raw::INT ELSE 7 END AS int_setting,
  coalesce(try_cast(trim(raw) AS DOUBLE), 0.5) AS float_setting
FROM (SELECT event_id, {RAW_SETTING} AS raw FROM events)""",
)
def parse_setting(spark, sf):
    raw = (
        F.when(F.col("event_id") % 4 == 0, F.get_json_object("props", "$.k"))
        .when(F.col("event_id") % 4 == 1, F.col("event_type"))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
    )
    return fx.table(spark, sf, "events").select(
        "event_id",
        params.try_setting(raw, 7).alias("int_setting"),
        params.try_setting(raw, 0.5).alias("float_setting"),
    )


# --- text --------------------------------------------------------------------


@register("redact_pii", f"SELECT doc_id, {sql.redact('text')} AS redacted FROM documents")
def redact_pii(spark, sf):
    docs = fx.spread(fx.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", text.redact(F.col("text")).alias("redacted"))


def _pii_counts_sql() -> str:
    from ragframe.settings import PII_PATTERNS

    parts, column = [], "text"
    for entity, pattern, confidence in PII_PATTERNS:
        parts.append(
            f"SELECT '{entity}' AS entity, {confidence}::DOUBLE AS confidence, "
            f"sum(len(regexp_extract_all({column}, {q(pattern)})))::BIGINT AS hits FROM documents"
        )
        column = f"regexp_replace({column}, {q(pattern)}, '<{entity}>', 'g')"
    return " UNION ALL ".join(parts)


@register("pii_counts", _pii_counts_sql())
def pii_counts(spark, sf):
    docs = fx.spread(fx.table(spark, sf, "documents").select("text"))
    return text.pii_counts(docs, "text")


@register(
    "redact_nested",
    f"""SELECT doc_id, n_chars, {sql.redact("text")} AS whole, {sql.redact("split_part(text, ' ', 1)")} AS first,
  {sql.redact("lang || '@' || source || '.example.org'")} AS mail FROM documents""",
)
def redact_nested(spark, sf):
    docs = fx.spread(fx.table(spark, sf, "documents"), "doc_id")
    nested = docs.select(
        "doc_id",
        F.struct(
            "n_chars",
            F.array("text", F.split_part("text", F.lit(" "), F.lit(1))).alias("parts"),
            F.create_map(
                F.lit("mail"), F.concat("lang", F.lit("@"), F.col("source"), F.lit(".example.org"))
            ).alias("meta"),
        ).alias("body"),
    )
    return text.redact_columns(nested).select(
        "doc_id",
        F.col("body.n_chars").alias("n_chars"),
        F.col("body.parts")[0].alias("whole"),
        F.col("body.parts")[1].alias("first"),
        F.col("body.meta")["mail"].alias("mail"),
    )


@register(
    "tokenize",
    f"""SELECT doc_id, len({sql.tokens("text")})::INT AS n_tokens,
  array_to_string(list_sort({sql.tokens("text")}), ' ') AS terms FROM documents""",
)
def tokenize(spark, sf):
    terms = F.array_sort(text.tokens(F.col("text")))
    docs = fx.spread(fx.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", F.size(terms).alias("n_tokens"), joined(terms, " ").alias("terms"))


def _squeezed(col: Column) -> Column:
    return F.md5(F.regexp_replace(col, r"\s+", ""))


def _coverage(chunks: DataFrame, size: int) -> DataFrame:
    """Number and digest of the cut places (first-last character of each chunk), and what must hold for
    any splitter: chunk spans lie in order, none is too long, and with overlaps cut away their text is the
    document without white space."""
    end = F.col("start") + F.length("text")
    spans = F.array_sort(F.collect_list(F.struct("pos", "start", end.alias("end"), "text")))
    chunks = chunks.groupBy("doc_id").agg(spans.alias("spans"))
    fresh = F.transform(
        "spans",
        lambda s, i: F.when(i == 0, s["text"]).otherwise(
            F.substring(
                s["text"],
                F.greatest(F.lit(0), F.get("spans", i - 1)["end"] - s["start"]) + 1,
                F.length(s["text"]),
            )
        ),
    )
    places = F.transform(
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"]))),
        lambda s: F.concat_ws("-", s["start"], s["end"]),
    )
    return chunks.select(
        "doc_id",
        _squeezed(F.array_join(fresh, "")).alias("content"),
        F.forall("spans", lambda s: s["end"] - s["start"] <= size).alias("within_size"),
        F.forall("spans", lambda s: s["text"] == text.strip(s["text"])).alias("stripped"),
        F.size("spans").alias("n_chunks"),
        F.md5(joined(places, ",")).alias("cuts"),
    )


COVERAGE_SQL = r"""
SELECT doc_id, md5(regexp_replace(text, '\s+', '', 'g')) AS content, true AS within_size, true AS stripped, n_chunks, cuts
FROM files JOIN (
  SELECT key, count(*)::INT AS n_chunks, md5(string_agg(first || '-' || last, ',' ORDER BY first, last)) AS cuts
  FROM cuts GROUP BY key) ON key = doc_id"""


def _splitter_sql(roots: str) -> str:
    return sql.recursive(sql.FILES, sql.split_cuts(roots, "files", "doc_id"), select=COVERAGE_SQL)


@register("chunk_recursive", _splitter_sql(sql.whole_roots("files", "doc_id", sql.PLAIN_RULE)))
def chunk_recursive(spark, sf):
    return _coverage(chunking.chunk_recursive(fx.files(spark, sf).select("doc_id", "text")), 900)


@register("chunk_paged", _splitter_sql(sql.whole_roots("files", "doc_id", sql.PAGED_RULE)))
def chunk_paged(spark, sf):
    return _coverage(chunking.chunk_paged(fx.files(spark, sf).select("doc_id", "text")), 700)


@register("split_documents", _splitter_sql(sql.format_roots("files", "doc_id", "rel_path")))
def split_documents(spark, sf):
    files = fx.files(spark, sf).withColumn("source_id", F.col("rel_path"))
    cut = chunking.split_documents(files).withColumnRenamed("chunk_index", "pos")
    return _coverage(cut, 900)


@register(
    "chunk_fixed",
    with_(
        f"""windows AS (SELECT doc_id, s, {sql.strip("substr(text, s + 1, 900)")} AS text FROM
  (SELECT *, unnest(range(0, greatest(length(text) - 151, 0) + 1, 750)) AS s FROM documents))""",
        select="""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS pos, text
FROM windows WHERE text <> ''""",
    ),
)
def chunk_fixed(spark, sf):
    docs = fx.spread(fx.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return chunking.chunk_fixed(docs)


@register(
    "split_markdown",
    with_(
        sql.FILES,
        r"""
rows AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS n, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM files)),
fenced AS (
  SELECT *, sum(regexp_matches(line, '^[ \t]*(```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY n) % 2 AS inside FROM rows),
heads AS (
  SELECT *, CASE WHEN inside = 0 AND regexp_matches(line, '^#{1,3}([ \t]|$)') THEN length(regexp_extract(line, '^#+')) END AS level FROM fenced),
sections AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM heads),
texts AS (
  SELECT doc_id, section, max(level) AS level, regexp_replace(string_agg(line, chr(10) ORDER BY n), '^\s+|\s+$', '', 'g') AS text,
    max(CASE WHEN level IS NOT NULL THEN trim(regexp_replace(line, '^#+', '')) END) AS title
  FROM sections GROUP BY ALL),
marks AS (
  SELECT *, max(CASE WHEN level = 1 THEN section END) OVER w AS s1, max(CASE WHEN level = 2 THEN section END) OVER w AS s2,
    max(CASE WHEN level = 3 THEN section END) OVER w AS s3 FROM texts WINDOW w AS (PARTITION BY doc_id ORDER BY section)),
headed AS (
  SELECT m.*, a.title AS h1, b.title AS h2, c.title AS h3 FROM marks m
  LEFT JOIN texts a ON a.doc_id = m.doc_id AND a.section = m.s1
  LEFT JOIN texts b ON b.doc_id = m.doc_id AND b.section = m.s2 AND m.s2 > coalesce(m.s1, -1)
  LEFT JOIN texts c ON c.doc_id = m.doc_id AND c.section = m.s3 AND m.s3 > greatest(coalesce(m.s1, -1), coalesce(m.s2, -1)))""",
        select="""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1)::INT AS pos, h1, h2, h3, text
FROM headed WHERE text <> ''""",
    ),
)
def split_markdown(spark, sf):
    cut = chunking.split_markdown(fx.files(spark, sf).select("doc_id", "text"))
    return cut.select("doc_id", "pos", "h1", "h2", "h3", "text")


@register(
    "chunk_index",
    with_(
        f"""windows AS (SELECT source, doc_id, s, {sql.strip("substr(text, s + 1, 900)")} AS text FROM
  (SELECT *, unnest(range(0, greatest(length(text) - 151, 0) + 1, 750)) AS s FROM documents))""",
        select="""SELECT source AS source_id, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id, s) - 1)::INT AS chunk_index,
  text FROM windows WHERE text <> ''""",
    ),
)
def chunk_index(spark, sf):
    """All chunks of a source numbered through, over its documents."""
    docs = fx.spread(fx.table(spark, sf, "documents"), "doc_id").select(
        F.col("source").alias("source_id"), "doc_id", "text"
    )
    numbered = ids.with_chunk_index(chunking.chunk_fixed(docs), order="doc_id")
    return numbered.select("source_id", "doc_id", "chunk_index", "text")


@register("chunk_id", with_(sql.STORE, select="SELECT source_id, chunk_index, chunk_id FROM chunks"))
def chunk_id(spark, sf):
    return fx.chunks(spark, sf).select("source_id", "chunk_index", "chunk_id")


@register(
    "embed",
    with_(
        sql.hashed("v", "documents", "doc_id", "text"),
        select="SELECT key AS doc_id, cell::INT AS cell, round(value, 6) AS value FROM v",
    ),
)
def embed_query(spark, sf):
    """Non-zero cells of the vector of every document."""
    docs = fx.spread(fx.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    cells = embed(docs).select("doc_id", F.posexplode("embedding").alias("cell", "value"))
    return cells.filter(F.col("value") != 0).withColumn(
        "value", F.round(F.col("value").cast("double"), 6)
    )


SID_SQL = r"""
sids AS (
  SELECT doc_id, CASE doc_id % 6
    WHEN 0 THEN '  Source: "External/' || source || '/' || doc_id || '.pdf#p6" '
    WHEN 1 THEN '`' || source || chr(92) || doc_id || '.MD`'
    WHEN 2 THEN 'source_id=' || source || '/' || doc_id || '.txt.,;'
    WHEN 3 THEN '#' || source
    WHEN 4 THEN 'citation : ' || source || '#' WHEN 5 THEN '   ' END AS raw FROM documents)
"""


def _sids(spark, sf) -> DataFrame:
    number = F.col("doc_id").cast("string")
    raw = fx._pick(
        "doc_id",
        [
            F.concat(F.lit('  Source: "External/'), "source", F.lit("/"), number, F.lit('.pdf#p6" ')),
            F.concat(F.lit("`"), "source", F.lit("\\"), number, F.lit(".MD`")),
            F.concat(F.lit("source_id="), "source", F.lit("/"), number, F.lit(".txt.,;")),
            F.concat(F.lit("#"), "source"),
            F.concat(F.lit("citation : "), "source", F.lit("#")),
            F.lit("   "),
        ],
    )
    return fx.table(spark, sf, "documents").select("doc_id", raw.alias("raw"))


@register(
    "normalize_source_id",
    with_(SID_SQL, select=f"SELECT doc_id, {sql.norm_sid('raw')} AS source_id FROM sids"),
)
def normalize_source_id(spark, sf):
    return _sids(spark, sf).select(
        "doc_id", cit.normalize_source_id(F.col("raw")).alias("source_id")
    )


@register(
    "source_id_variants",
    with_(
        SID_SQL,
        f"full_ids AS (SELECT doc_id, {sql.norm_sid('raw')} AS f FROM sids)",
        select=f"""SELECT doc_id, array_to_string(list_sort({sql.sid_variants("f")}), '|') AS variants FROM full_ids""",
    ),
)
def source_id_variants(spark, sf):
    variants = F.array_sort(cit.source_id_variants(F.col("raw")))
    return _sids(spark, sf).select("doc_id", joined(variants).alias("variants"))


@register(
    "extract_citations",
    with_(
        sql.ANSWERS,
        select=f"""SELECT query_id, len({sql.citations("answer")})::INT AS n,
  array_to_string({sql.citations("answer")}, '|') AS citations FROM answers""",
    ),
)
def extract_citations(spark, sf):
    found = cit.citations(F.col("answer"))
    return fx.answers(spark, sf).select(
        "query_id", F.size(found).alias("n"), joined(found).alias("citations")
    )


@register(
    "is_unknown_answer",
    with_(sql.ANSWERS, select=f"SELECT query_id, {sql.is_unknown('answer')} AS unknown FROM answers"),
)
def is_unknown_answer(spark, sf):
    return fx.answers(spark, sf).select("query_id", cit.is_unknown(F.col("answer")).alias("unknown"))


@register(
    "is_artifact_request",
    with_(
        sql.QUESTIONS,
        select=f"SELECT query_id, {sql.is_artifact('lower(question)')} AS artifact FROM questions",
    ),
)
def is_artifact_request(spark, sf):
    return fx.questions(spark, sf).select(
        "query_id", art.is_artifact_request(F.col("question")).alias("artifact")
    )


# --- retrieval ---------------------------------------------------------------


@register("similarity_topk", sql.label_topk("true", 6))
def similarity_topk(spark, sf):
    """Six nearest vectors of every label's mean, over the whole vector table."""
    wanted = fx.label_queries(spark, sf).drop("scope")
    found = search.similarity_topk(fx.vectors(spark, sf), wanted, scope="all")
    return found.select("query_id", "rank", "chunk_id", "label", score6())


@register("similarity_filtered", sql.label_topk("lq.scope = 'all' OR lq.scope = lv.doc_type", 10))
def similarity_filtered(spark, sf):
    found = search.similarity_topk(fx.vectors(spark, sf), fx.label_queries(spark, sf), k=10)
    return found.select("query_id", "rank", "chunk_id", "label", score6())


@register(
    "scope_filter",
    with_(
        sql.STORE,
        sql.ITEMS,
        sql.resolved("items"),
        select="""SELECT query_id, scope, count(*)::BIGINT AS visible FROM params p
JOIN chunks c ON p.scope = 'all' OR p.scope = c.doc_type GROUP BY ALL""",
    ),
)
def scope_filter(spark, sf):
    """Chunks each query may see, from counts per document type."""
    counts = fx.chunks(spark, sf).groupBy("doc_type").count()
    asked = params.resolve_params(fx.queries(spark, sf))
    kinds = F.when(F.col("scope") == "all", F.array(F.lit("external"), F.lit("project"))).otherwise(
        F.array("scope")
    )
    seen = asked.select("query_id", "scope", F.explode(kinds).alias("doc_type"))
    return (
        seen.join(counts, "doc_type").groupBy("query_id", "scope").agg(F.sum("count").alias("visible"))
    )


def _hit_view(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "chunk_id", "source_id", "doc_type", score6())


def _mode_sql(mode: str) -> str:
    return with_(*sql.hits(mode=q(mode)), select=f"SELECT {sql.HIT_COLUMNS} FROM hits")


@register("hybrid_topk", _mode_sql("hybrid"))
def hybrid_topk(spark, sf):
    return _hit_view(search.hybrid_topk(fx.store(spark, sf), fx.plain_queries(spark, sf)))


@register("mmr_topk", _mode_sql("mmr"))
def mmr_topk(spark, sf):
    return _hit_view(search.mmr_topk(fx.store(spark, sf), fx.plain_queries(spark, sf)))


@register(
    "mmr_scores",
    with_(
        *sql.hits(mode="'mmr'"),
        "known AS (SELECT query_id, chunk_id, vec_score FROM cand WHERE vec_rank <= 3)",
        select="""
SELECT h.query_id, h.rank, h.chunk_id, round(coalesce(n.vec_score,
  (SELECT max(vec_score) FROM known k WHERE k.query_id = h.query_id), 1.0), 6) AS score
FROM hits h LEFT JOIN known n ON n.query_id = h.query_id AND n.chunk_id = h.chunk_id""",
    ),
)
def mmr_scores(spark, sf):
    """MMR picks scored from a shallower similarity search (three per query)."""
    chunks, asked = fx.store(spark, sf), fx.plain_queries(spark, sf)
    picks = search.mmr_topk(chunks, asked).select("query_id", "rank", "chunk_id")
    near = search.similarity_topk(chunks, asked.drop("k"), k=3)
    return search.mmr_scores(picks, near).select("query_id", "rank", "chunk_id", score6())


@register(
    "search_auto", with_(*sql.hits(), select=f"SELECT {sql.HIT_COLUMNS} FROM hits")
)
def search_auto(spark, sf):
    """Every query in the mode, scope and depth it resolves to."""
    return _hit_view(search.search(fx.store(spark, sf), fx.queries(spark, sf)))


@register("search_lsh", sql.label_lsh(bits=7, tables=14, dim=64, k=6))
def search_lsh(spark, sf):
    """Approximate search by sign codes over the whole vector table."""
    found = search.search_lsh(
        fx.vectors(spark, sf), fx.label_queries(spark, sf), dim=64, bits=7, tables=14, mode="similarity"
    )
    return found.select("query_id", "rank", "chunk_id", score6())


@register(
    "retrieval_report",
    with_(
        *sql.hits(),
        select="""SELECT h.query_id, i.question, h.rank, round(h.score, 6) AS score, h.source_id, h.doc_type, h.h1
FROM hits h JOIN items i USING (query_id)""",
    ),
)
def retrieval_report(spark, sf):
    asked = fx.queries(spark, sf)
    found = search.report(search.search(fx.store(spark, sf), asked), asked)
    return found.withColumn("score", score6())


@register(
    "replaced_points",
    with_(STORED_SQL, select="SELECT chunk_id FROM hit"),
)
def replaced_points(spark, sf):
    targets = store.source_paths(_batch(spark, sf))
    return store.replaced(_stored(spark, sf), targets).select("chunk_id")


@register(
    "distinct_sources",
    with_(sql.FILES, sql.DOCS, select="SELECT DISTINCT source_path FROM docs WHERE regexp_matches(text, '\\S')"),
)
def distinct_sources(spark, sf):
    return store.source_paths(fx.chunks(spark, sf))


# --- per query assembly ------------------------------------------------------


def _hits(spark, sf) -> DataFrame:
    return search.search(fx.store(spark, sf), fx.queries(spark, sf))


@register(
    "format_context", with_(*sql.hits(), sql.CONTEXTS, select="SELECT query_id, context FROM contexts")
)
def format_context(spark, sf):
    return grounding.contexts(_hits(spark, sf))


@register(
    "build_prompt",
    with_(
        *sql.hits(),
        sql.CONTEXTS,
        sql.SOURCES,
        select=f"""
SELECT i.query_id, 'Rules.' || chr(10) || chr(10) || 'Context: ' || coalesce(context, '') || ' {{json}} Question: '
  || {sql.redact("i.question")} || chr(10) || chr(10) || 'Allowed source_ids for citations (use only these):' || chr(10)
  || coalesce(array_to_string(list_transform(source_ids, lambda s: '- [' || s || ']'), chr(10)), '- (none)') AS prompt
FROM items i LEFT JOIN contexts USING (query_id) LEFT JOIN source_lists USING (query_id)""",
    ),
)
def build_prompt(spark, sf):
    return grounding.prompts(
        fx.queries(spark, sf),
        _hits(spark, sf),
        system="Rules.",
        template="Context: {context} {{json}} Question: {question}",
    )


@register(
    "collect_sources",
    with_(
        *sql.hits(),
        sql.SOURCES,
        select="""SELECT query_id, source_id, position, 'chunk_index=' || last_chunk || '|doc_type=' || doc_type || '|h1=' || h1
  || lang_part || '|source_id=' || source_id || '|source_path=' || source_path AS meta FROM sources""",
    ),
)
def collect_sources(spark, sf):
    entries = F.array_sort(F.map_entries("meta"))
    flat = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return grounding.sources(_hits(spark, sf)).select(
        "query_id", "source_id", "position", joined(flat).alias("meta")
    )


@register(
    "groundedness",
    with_(
        *sql.hits(),
        sql.gate("3", "2"),
        select="SELECT query_id, n_docs, n_sources, round(best_score, 6) AS best_score, grounded FROM gate",
    ),
)
def groundedness(spark, sf):
    asked = params.resolve_params(fx.queries(spark, sf))
    gate = grounding.grounded(_hits(spark, sf), asked, min_docs=3, min_unique_sources=2)
    return gate.select("query_id", "n_docs", "n_sources", score6("best_score"), "grounded")


@register(
    "ingest_stats",
    with_(
        STORED_SQL,
        select="""SELECT 'ok' AS status, (SELECT count(*) FROM documents)::BIGINT AS raw_docs,
  (SELECT count(*) FROM batch)::BIGINT AS chunks, (SELECT count(DISTINCT source_path) FROM batch)::BIGINT AS replaced_sources,
  (SELECT count(*) FROM hit)::BIGINT AS replaced_points""",
    ),
)
def ingest_stats(spark, sf):
    batch = _batch(spark, sf)
    gone = store.replaced(_stored(spark, sf), store.source_paths(batch))
    return store.ingest_stats(batch, gone, fx.table(spark, sf, "documents"))


# --- evaluation --------------------------------------------------------------


def _routed(spark, sf) -> DataFrame:
    predicted = F.when(F.col("conv_id") % 9 != 0, art.route_by_rules(F.col("question")))
    return fx.questions(spark, sf).select(
        "query_id", "expected_tool", predicted.alias("predicted_tool")
    )


ROUTED_SQL = f"""
routed AS (
  SELECT query_id, expected_tool, CASE WHEN conv_id % 9 <> 0 THEN {sql.routed("question")} ELSE 'invalid' END AS predicted_tool
  FROM questions)
"""


@register(
    "tool_accuracy",
    with_(
        sql.QUESTIONS,
        ROUTED_SQL,
        select="""SELECT count(*)::BIGINT AS total, sum((expected_tool = predicted_tool)::INT)::BIGINT AS correct,
  sum((expected_tool = predicted_tool)::INT)::DOUBLE / count(*) AS accuracy FROM routed""",
    ),
)
def tool_accuracy(spark, sf):
    return evaluation.tool_accuracy(_routed(spark, sf))


@register(
    "tool_confusion",
    with_(
        sql.QUESTIONS,
        ROUTED_SQL,
        select="""SELECT expected_tool, predicted_tool, expected_tool = predicted_tool AS correct, count(*)::BIGINT AS n
FROM routed GROUP BY ALL""",
    ),
)
def tool_confusion(spark, sf):
    return evaluation.tool_confusion(_routed(spark, sf))


@register(
    "metric_means",
    """
SELECT metric, mean, (SELECT count(*) FROM labels)::BIGINT AS row_count FROM (
  SELECT 'quality' AS metric, round(avg(quality), 4) AS mean FROM labels
  UNION ALL SELECT 'toxic', round(avg(toxic), 4) FROM labels
  UNION ALL SELECT 'partial', round(avg(CASE WHEN doc_id % 3 = 1 THEN (doc_id % 100) / 100 END), 4) FROM labels)""",
)
def metric_means(spark, sf):
    """Means over labels, with a column of nulls and NaN and one without values."""
    partial = F.when(F.col("doc_id") % 3 == 0, F.lit(float("nan"))).when(
        F.col("doc_id") % 3 == 1, (F.col("doc_id") % 100) / 100
    )
    rows = fx.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("name"),
        "quality",
        "toxic",
        partial.alias("partial"),
        F.lit(None).cast("double").alias("nothing"),
    )
    return evaluation.metric_means(rows)


def _truths(spark, sf) -> DataFrame:
    return fx.queries(spark, sf).drop("k").withColumn("ground_truth", F.concat(F.lit("truth "), "question"))


def _drafts(spark, sf, hits: DataFrame) -> DataFrame:
    """Answers as a model might give them: good and bad citations, refusals."""
    asked = fx.queries(spark, sf).join(
        hits.filter(F.col("rank") == 1).select("query_id", "source_id"), "query_id", "left"
    )
    cited = fx._pick(
        "style",
        [
            F.concat(F.lit(" [source: "), F.upper("source_id"), F.lit(".]")),
            F.concat(F.lit(" ["), F.substring_index("source_id", "/", -1), F.lit("] [x]")),
            F.lit(" [wrong]"),
            F.lit(""),
            F.lit(" mail me@example.org ["),
        ],
    )
    answer = F.concat("question", F.coalesce(cited, F.lit("")))
    refusal = F.lit("I don't know based on the provided documents, sorry")
    return asked.select(
        "query_id", F.when(F.col("tool_style") == 6, refusal).otherwise(answer).alias("answer")
    )


DRAFTS_SQL = f"""
drafts AS (
  SELECT i.query_id, i.item_id, i.question, CASE WHEN item_id % 7 = 6 THEN 'I don''t know based on the provided documents, sorry'
    ELSE i.question || coalesce({sql.cycle("item_id", [
        "' [source: ' || upper(t.source_id) || '.]'", "' [' || split_part(t.source_id, '/', -1) || '] [x]'",
        "' [wrong]'", "''", "' mail me@example.org ['"])}, '') END AS answer
  FROM items i LEFT JOIN (SELECT query_id, source_id FROM hits WHERE rank = 1) t USING (query_id))
"""

FINAL_SQL = f"""
finals AS (
  SELECT d.*, g.grounded, l.source_ids, l.source_marks,
    CASE WHEN NOT g.grounded THEN 'not_enough_context' WHEN {sql.is_unknown("answer")} THEN NULL
      WHEN NOT {sql.valid("answer", "coalesce(l.source_ids, [])")} THEN 'citation_validation_failed' END AS error
  FROM drafts d JOIN gate g USING (query_id) LEFT JOIN source_lists l USING (query_id)),
shown AS (
  SELECT *, CASE WHEN error IS NOT NULL OR {sql.is_unknown("answer")} THEN {q(sql.UNKNOWN_ANSWER)} ELSE answer END AS final_answer
  FROM finals)
"""

EVAL_ITEMS = sql.ITEMS.replace("CASE WHEN item_id % 5 = 0 THEN 4 END AS k", "3 AS k").replace(
    sql.cycle("item_id", ["'all'", "'external'", "NULL"]), "'all'"
)


def _eval_rows(spark, sf) -> DataFrame:
    asked = _truths(spark, sf).drop("scope")
    defaults = RetrievalDefaults(k=evaluate.EVAL_K, scope="all")
    hits = checkpointed(search.search(fx.store(spark, sf), asked, defaults=defaults))
    return evaluate.eval_rows(asked, hits, _drafts(spark, sf, hits), defaults)


EVAL_SQL = [
    *sql.hits(EVAL_ITEMS),
    sql.SOURCES,
    sql.gate(),
    DRAFTS_SQL,
    FINAL_SQL,
    """
evals AS (
  SELECT query_id, question, final_answer AS answer, c.contexts, 'truth ' || question AS ground_truth
  FROM shown LEFT JOIN (SELECT query_id, list(text ORDER BY rank) AS contexts FROM hits GROUP BY ALL) c USING (query_id))""",
]


@register(
    "eval_dataset",
    with_(
        *EVAL_SQL,
        select="SELECT query_id, question, answer, array_to_string(contexts, '|') AS contexts, ground_truth FROM evals",
    ),
)
def eval_dataset(spark, sf):
    return _eval_rows(spark, sf).withColumn("contexts", joined("contexts"))


_CONTEXT_TOKENS = sql.tokens("array_to_string(contexts, chr(10))")


@register(
    "lexical_quality",
    with_(
        *EVAL_SQL,
        select=f"""
SELECT question, round({sql.share(sql.tokens("question"), sql.tokens("answer"))}, 6) AS lex_answer_relevancy,
  round(coalesce(list_avg(list_transform(contexts, lambda c: {sql.share(sql.tokens("question"), sql.tokens("c"))})), 0), 6) AS lex_context_precision,
  round({sql.share(sql.tokens("answer"), _CONTEXT_TOKENS)}, 6) AS lex_faithfulness,
  round({sql.share(sql.tokens("ground_truth"), _CONTEXT_TOKENS)}, 6) AS lex_context_recall
FROM evals""",
    ),
)
def lexical_quality(spark, sf):
    return evaluation.lexical_quality(_eval_rows(spark, sf))


@register(
    "prompt_assertions",
    rf"""
WITH cases AS (SELECT conv_id || '-' || turn AS case_id, text AS output FROM conversations),
rules AS (
  SELECT case_id, 'contains' AS kind, 'die' AS value FROM cases UNION ALL
  SELECT case_id, 'regex', '[a-m]+\.' FROM cases UNION ALL
  SELECT case_id, 'contains', case_id FROM cases WHERE case_id LIKE '%0')
SELECT case_id, count(*)::BIGINT AS rules, sum(ok::INT)::BIGINT AS passed, bool_and(ok) AS all_passed
FROM (SELECT r.case_id, CASE WHEN kind = 'contains' THEN contains(output, value) ELSE regexp_matches(output, value) END AS ok
      FROM rules r LEFT JOIN cases c USING (case_id)) GROUP BY case_id""",
)
def prompt_assertions(spark, sf):
    """Two rules for every turn as an output, a third for some."""
    turns = fx.table(spark, sf, "conversations")
    outputs = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("case_id"), F.col("text").alias("output")
    )
    given = F.array(
        F.struct(F.lit("contains").alias("kind"), F.lit("die").alias("value")),
        F.struct(F.lit("regex").alias("kind"), F.lit(r"[a-m]+\.").alias("value")),
        F.struct(
            F.when(F.col("case_id").endswith("0"), "contains").alias("kind"),
            F.col("case_id").alias("value"),
        ),
    )
    rules = outputs.select("case_id", F.inline(given)).filter(F.col("kind").isNotNull())
    return evaluation.assertions(outputs, rules)


# --- answers and routing -----------------------------------------------------


@register(
    "validate_citations",
    with_(
        sql.ANSWERS, select=f"SELECT query_id, {sql.valid('answer', 'source_ids')} AS citation_ok FROM answers"
    ),
)
def validate_citations(spark, sf):
    return ans.valid_citations(fx.answers(spark, sf)).select("query_id", "citation_ok")


@register(
    "citation_audit",
    with_(
        sql.ANSWERS,
        f"""cited AS (SELECT query_id, generate_subscripts(c, 1) - 1 AS position, unnest(c) AS citation, source_ids
  FROM (SELECT query_id, {sql.citations("answer")} AS c, source_ids FROM answers))""",
        select=f"""SELECT query_id, position::INT AS position, citation, coalesce(list_contains(flatten(list_transform(source_ids,
  lambda s: {sql.sid_variants(sql.norm_sid("s"))})), {sql.norm_sid("citation")}), false) AS matched FROM cited""",
    ),
)
def citation_audit(spark, sf):
    return ans.citation_audit(fx.answers(spark, sf))


@register(
    "normalize_answer",
    with_(
        sql.ANSWERS,
        select=f"""SELECT query_id, CASE WHEN {sql.is_unknown("answer")} OR NOT {sql.valid("answer", "coalesce(source_ids, [])")}
  THEN {q(sql.UNKNOWN_ANSWER)} ELSE answer END AS final_answer,
  CASE WHEN NOT {sql.is_unknown("answer")} AND NOT {sql.valid("answer", "coalesce(source_ids, [])")} THEN 'citation_validation_failed' END AS error
FROM answers""",
    ),
)
def normalize_answer(spark, sf):
    return ans.normalize(fx.answers(spark, sf)).select("query_id", "final_answer", "error")


ROUTING_SQL = rf"""
routing AS (
  SELECT query_id, question, {sql.cycle("conv_id", [
      "'{\"tool\": \"adr\", \"args\": {\"decision\": \"use ' || conv_id || '\", \"alternatives\": [\"a\", \"b\"]}}'",
      "'{\"tool\": \"user_stories\", \"args\": {\"request\": \"r' || conv_id || '\", \"context_query\": \"c\"}}'",
      "'{\"tool\": \"unheard_of\", \"args\": {}}'",
      "'{\"tool\": \"adr\"}'",
      "'no json'",
      "'{\"n\":' || turn || '}'",
      "'{\"tool\": \"solution_outline\", \"args\": {}}'"])} AS routing
  FROM questions),
seen_json AS (
  SELECT *, CASE WHEN {sql.is_artifact("lower(" + sql.redact("question") + ")")} AND json_valid(routing) THEN routing::JSON END AS j FROM routing),
calls AS (
  SELECT query_id, question, j, coalesce(json_type(j, '$.tool') = 'VARCHAR' AND json_type(j, '$.args') = 'OBJECT', false) AS parsed,
    CASE WHEN coalesce(json_type(j, '$.tool') = 'VARCHAR' AND json_type(j, '$.args') = 'OBJECT', false)
      AND json_extract_string(j, '$.tool') IN ('ask', 'adr', 'solution_outline', 'user_stories', 'risk_assessment')
      THEN json_extract_string(j, '$.tool') ELSE 'ask' END AS tool
  FROM seen_json)
"""


@register(
    "parse_tool_call",
    with_(
        sql.QUESTIONS,
        ROUTING_SQL,
        select="""
SELECT query_id, tool, parsed,
  CASE tool WHEN 'ask' THEN question WHEN 'adr' THEN coalesce(json_extract_string(j, '$.args.decision'), question)
    ELSE coalesce(json_extract_string(j, '$.args.request'), question) END AS request,
  CASE WHEN tool = 'adr' THEN coalesce(array_to_string(json_extract_string(j, '$.args.alternatives[*]'), '|'), 'Option A|Option B|Option C') END AS alternatives,
  CASE WHEN tool = 'ask' THEN question ELSE coalesce(json_extract_string(j, '$.args.context_query'), question) END AS context_query
FROM calls""",
    ),
)
def parse_tool_call(spark, sf):
    calls = artifact.tool_calls(fx.routing_outputs(spark, sf))
    return calls.select(
        "query_id",
        "tool",
        "parsed",
        "request",
        joined("alternatives").alias("alternatives"),
        "context_query",
    )


@register(
    "routing_prompts",
    with_(
        sql.QUESTIONS,
        f"safe AS (SELECT query_id, {sql.redact('question')} AS question FROM questions)",
        select=f"""SELECT query_id, 'Tools: {{adr}}. Question: ' || question AS prompt
FROM safe WHERE {sql.is_artifact("lower(question)")}""",
    ),
)
def routing_prompts(spark, sf):
    """Prompts of the questions that a model has to route."""
    return artifact.routing_prompts(
        fx.questions(spark, sf), "Tools: {{adr}}. Question: {question}"
    )


# Every seventh conversation has no routing answer.
UNANSWERED = "conv_id % 7 = 3"


@register(
    "routing_eval",
    with_(
        sql.QUESTIONS,
        ROUTING_SQL,
        f"""predictions AS (
  SELECT expected_tool, CASE WHEN NOT ({UNANSWERED}) THEN tool
    WHEN {sql.is_artifact("lower(" + sql.redact("q.question") + ")")} THEN 'invalid' ELSE 'ask' END AS predicted_tool
  FROM questions q JOIN calls USING (query_id))""",
        select="""SELECT 'row' AS part, expected_tool, predicted_tool, count(*)::BIGINT AS n, NULL::DOUBLE AS accuracy
FROM predictions GROUP BY ALL
UNION ALL SELECT 'summary', NULL, NULL, count(*)::BIGINT, avg((expected_tool = predicted_tool)::INT) FROM predictions""",
    ),
)
def routing_eval(spark, sf):
    """Routing answers of all questions judged, written as rows and summary, and read back."""
    path = new_path(spark, "routing")
    missing = fx.questions(spark, sf).filter(UNANSWERED).select("query_id")
    answers = fx.routing_outputs(spark, sf).join(missing, "query_id", "left_anti")
    evaluate.routing_eval(fx.questions(spark, sf), answers, path)
    rows = src.read_jsonl(spark, f"{path}/rows", "expected_tool string, predicted_tool string")
    summary = src.read_jsonl(spark, f"{path}/summary", "total bigint, accuracy double")
    counts = rows.groupBy("expected_tool", "predicted_tool").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns({"part": F.lit("row"), "accuracy": F.lit(None).cast("double")}).unionByName(
        summary.select(F.lit("summary").alias("part"), F.col("total").alias("n"), "accuracy"),
        allowMissingColumns=True,
    )


@register(
    "route_by_rules",
    with_(sql.QUESTIONS, select=f"SELECT query_id, {sql.routed('question')} AS tool FROM questions"),
)
def route_by_rules(spark, sf):
    return fx.questions(spark, sf).select(
        "query_id", art.route_by_rules(F.col("question")).alias("tool")
    )


@register(
    "validate_structured",
    with_(
        sql.OUTPUTS,
        sql.PARSED,
        select=f"SELECT query_id, tool, {sql.structured_error()} AS error FROM parsed",
    ),
)
def validate_structured(spark, sf):
    return ans.validate(fx.structured_outputs(spark, sf)).select("query_id", "tool", "error")


CITED_SQL = "CASE WHEN item_id % 3 = 0 THEN ['x', source_ids[1]] WHEN item_id % 3 = 1 THEN ['x'] ELSE [] END"


@register(
    "finalize_sources",
    with_(
        *sql.hits(),
        sql.SOURCES,
        f"known AS (SELECT query_id, source_ids, {CITED_SQL} AS cited FROM source_lists JOIN items USING (query_id))",
        select="""SELECT query_id, array_to_string(CASE WHEN len(list_filter(cited, lambda c: list_contains(source_ids, c))) > 0
  THEN list_filter(cited, lambda c: list_contains(source_ids, c)) ELSE source_ids[1:3] END, '|') AS final_sources FROM known""",
    ),
)
def finalize_sources(spark, sf):
    asked = fx.queries(spark, sf)
    known = grounding.source_lists(search.search(fx.store(spark, sf), asked)).join(
        asked.select("query_id", (F.col("query_id").cast("int") % 3).alias("kind")), "query_id"
    )
    cited = (
        F.when(F.col("kind") == 0, F.array(F.lit("x"), F.get("source_ids", F.lit(0))))
        .when(F.col("kind") == 1, F.array(F.lit("x")))
        .otherwise(F.array().cast("array<string>"))
    )
    final = ans.finalize(cited, F.col("source_ids"))
    return known.select("query_id", joined(final).alias("final_sources"))


@register(
    "wrap_response",
    with_(
        sql.ANSWERS,
        select=f"""SELECT query_id, 'ask' AS agent_tool, query_id AS agent_args, array_to_string(coalesce(source_ids, []), '|') AS sources,
  {sql.redact("answer || ' me@example.org 10.0.0.1'")} AS answer,
  CASE WHEN NOT {sql.valid("answer", "source_ids")} THEN 'citation_validation_failed' END AS error,
  CASE WHEN NOT {sql.valid("answer", "source_ids")} THEN {q(sql.MSG_CITATION)} END AS message FROM answers""",
    ),
)
def wrap_response(spark, sf):
    rows = fx.answers(spark, sf)
    bad = ~cit.has_valid_citation(F.col("answer"), F.col("source_ids"))
    sources = F.coalesce("source_ids", F.array().cast("array<string>"))
    wrapped = rows.select(
        "query_id",
        *ans.response(
            tool=F.lit("ask"),
            args=F.create_map(F.lit("question"), F.col("query_id")),
            sources=sources,
            answer=F.concat("answer", F.lit(" me@example.org 10.0.0.1")),
            error=F.when(bad, "citation_validation_failed").otherwise(""),
            message=F.when(bad, sql.MSG_CITATION).otherwise(""),
        ),
    )
    return wrapped.withColumns(
        {"agent_args": F.col("agent_args")["question"], "sources": joined("sources")}
    ).drop("structured")


def _response_view(rows: DataFrame) -> DataFrame:
    marks = F.transform(
        "sources", lambda s: F.concat(s["source_id"], F.lit("/"), s["meta"]["chunk_index"])
    )
    return rows.withColumn("sources", joined(marks))


@register(
    "ask_batch",
    with_(
        *sql.hits(),
        sql.SOURCES,
        sql.gate(),
        DRAFTS_SQL,
        FINAL_SQL,
        select=f"""
SELECT query_id, 'ask' AS agent_tool, {sql.redact("question")} AS question,
  CASE WHEN grounded THEN coalesce(array_to_string(source_marks, '|'), '') ELSE '' END AS sources,
  {sql.redact("final_answer")} AS answer, error,
  CASE error WHEN 'not_enough_context' THEN 'Retrieved context did not meet groundedness thresholds.'
    WHEN 'citation_validation_failed' THEN {q(sql.MSG_CITATION)} END AS message
FROM shown""",
    ),
)
def ask_batch(spark, sf):
    """Search, gate, citation check and response for all benchmark questions."""
    asked = fx.queries(spark, sf)
    hits = checkpointed(search.search(fx.store(spark, sf), asked))
    rows = ask.respond(asked, hits, _drafts(spark, sf, hits))
    return _response_view(rows).select(
        "query_id",
        "agent_tool",
        F.col("agent_args")["question"].alias("question"),
        "sources",
        "answer",
        "error",
        "message",
    )


def _tool_calls(spark, sf) -> DataFrame:
    tool = fx._cycle("tool_style", ["adr", "solution_outline", "user_stories", "risk_assessment", "ask", "adr", "risk_assessment"])
    alternatives = F.when(tool == "adr", F.array(F.lit("a@example.org"), F.lit("b")))
    return fx.queries(spark, sf).select(
        "query_id",
        tool.alias("tool"),
        F.concat("question", F.lit(" x@example.org")).alias("request"),
        alternatives.alias("alternatives"),
        F.col("question").alias("context_query"),
        "mode",
        "scope",
        "k",
    )


def _tool_outputs(spark, sf) -> DataFrame:
    lists = (
        '"alternatives": ["a@example.org"], "consequences": [], "architecture": ["x"], "risks": ["r", "q"], '
        '"assumptions": [], "stories": ["s"], "acceptance_criteria": ["c"], "mitigations": ["m"]'
    )
    body = f'"context": "c", "decision": "d", "summary": "s", "epic": "e", {lists}'
    raw = fx._pick(
        "style",
        [
            F.lit(f'{{"title": "A title", {body}, "sources": ["unknown"]}}'),
            F.lit(f'{{"title": "A title", {body}, "sources": []}}'),
            F.lit("{broken"),
            F.lit(f'{{"title": "T", {body}, "sources": []}}'),
            F.lit(" "),
        ],
    )
    return fx.queries(spark, sf).select("query_id", raw.alias("output"))


_TOOL_BODY = (
    '"context": "c", "decision": "d", "summary": "s", "epic": "e", "alternatives": ["a@example.org"], '
    '"consequences": [], "architecture": ["x"], "risks": ["r", "q"], "assumptions": [], "stories": ["s"], '
    '"acceptance_criteria": ["c"], "mitigations": ["m"]'
)

TOOL_CALLS_SQL = f"""
outputs AS (
  SELECT query_id, {sql.cycle("item_id", ["'adr'", "'solution_outline'", "'user_stories'", "'risk_assessment'", "'ask'", "'adr'", "'risk_assessment'"])} AS tool,
    question, {sql.cycle("item_id", [
        q(f'{{"title": "A title", {_TOOL_BODY}, "sources": ["unknown"]}}'),
        q(f'{{"title": "A title", {_TOOL_BODY}, "sources": []}}'), "'{broken'",
        q(f'{{"title": "T", {_TOOL_BODY}, "sources": []}}'), "' '"])} AS output
  FROM items)
"""


@register(
    "artifact_batch",
    with_(
        *sql.hits(caller="0.75"),
        sql.SOURCES,
        TOOL_CALLS_SQL,
        sql.PARSED,
        "seen AS (SELECT query_id, count(*) AS n_docs, count(DISTINCT source_id) AS n_sources, min(score) AS best_score FROM hits GROUP BY ALL)",
        f"""checked AS (
  SELECT o.*, coalesce(n_docs >= {sql.gate_case(0)} AND n_sources >= {sql.gate_case(1)} AND best_score <= p.threshold, false) AS grounded,
    l.source_ids, l.source_marks, {sql.structured_error()} AS output_error
  FROM parsed o JOIN params p USING (query_id) LEFT JOIN seen USING (query_id) LEFT JOIN source_lists l USING (query_id)
  WHERE o.tool <> 'ask'),
failed AS (SELECT *, CASE WHEN NOT grounded THEN 'not_enough_context' ELSE output_error END AS error FROM checked)""",
        select=f"""
SELECT query_id, tool AS agent_tool,
  CASE WHEN tool = 'adr' THEN {sql.redact("question || ' x@example.org'")} END AS decision,
  CASE WHEN tool <> 'adr' THEN {sql.redact("question || ' x@example.org'")} END AS request,
  CASE WHEN tool = 'adr' THEN '<EMAIL_ADDRESS>|b' END AS alternatives,
  CASE WHEN grounded THEN coalesce(array_to_string(source_marks, '|'), '') ELSE '' END AS sources,
  CASE WHEN error IS NULL THEN array_to_string(source_ids[1:3], '|') END AS cited,
  CASE WHEN error IS NULL AND tool = 'adr' THEN '<EMAIL_ADDRESS>' END AS options,
  error, CASE error WHEN 'not_enough_context' THEN {sql.gate_case(3)}
    WHEN 'empty_model_output' THEN {q(sql.MSG_EMPTY)} WHEN 'invalid_structured_output' THEN {q(sql.MSG_STRUCTURED)} END AS message
FROM failed""",
    ),
)
def artifact_batch(spark, sf):
    """Structured tool calls from gate to response for all benchmark questions."""
    rows = artifact.artifacts(_tool_calls(spark, sf), fx.store(spark, sf), _tool_outputs(spark, sf))
    return _response_view(rows).select(
        "query_id",
        "agent_tool",
        F.col("agent_args.decision").alias("decision"),
        F.col("agent_args.request").alias("request"),
        joined("agent_args.alternatives").alias("alternatives"),
        "sources",
        joined("structured.sources").alias("cited"),
        joined("structured.alternatives").alias("options"),
        "error",
        "message",
    )


# --- streaming ---------------------------------------------------------------


@register(
    "ingest_stream",
    with_(
        sql.FILES,
        f"docs AS (SELECT rel_path AS source_id, {sql.redact('text')} AS text FROM files)",
        select=r"""SELECT source_id, CASE WHEN starts_with(source_id, 'external/') THEN 'external' ELSE 'project' END AS doc_type,
  0 AS first_index, true AS dense FROM docs WHERE regexp_matches(text, '\S')""",
    ),
)
def ingest_stream_query(spark, sf):
    """Document files streamed into a store in several batches."""
    source, path = new_path(spark, "incoming"), new_path(spark, "store")
    written = fx.incoming(spark, sf, source)
    # half of the files at a time
    stream = ingest_stream(spark, source, path, new_path(spark, "progress"), max_files=(written + 1) // 2)
    stream.awaitTermination()
    stored = store.read_store(spark, path)
    return stored.groupBy("source_id", "doc_type").agg(
        F.min("chunk_index").alias("first_index"),
        (F.max("chunk_index") + 1 == F.countDistinct("chunk_index")).alias("dense"),
    )


@register(
    "ingest_documents",
    sql.recursive(
        sql.FILES,
        sql.DOCS,
        sql.split_cuts(sql.format_roots("docs", "source_id", "source_id"), "docs", "source_id"),
        select=r"""SELECT 'ok' AS status, count(*)::BIGINT AS raw_docs, (SELECT count(*) FROM cuts)::BIGINT AS chunks,
  count(DISTINCT CASE WHEN regexp_matches(text, '\S') THEN source_path END)::BIGINT AS replaced_sources,
  0::BIGINT AS replaced_points FROM docs""",
    ),
)
def ingest_documents(spark, sf):
    """The whole ingest path with the real splitters; its statistics."""
    path = new_path(spark, "store")
    return ingest.ingest_documents(spark, fx.documents(spark, sf), path)
