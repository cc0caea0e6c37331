"""DuckDB SQL for the registered queries, put together from shared parts.

Each part is a list of common table expressions over the given tables that
mirrors one fixture or operator.
"""

from __future__ import annotations

from ragframe.settings import (
    ARTIFACT_NOUNS,
    ARTIFACT_TERMS,
    CONTEXT_SEPARATOR,
    CREATE_VERBS,
    MSG_CITATION,
    MSG_EMPTY,
    MSG_STRUCTURED,
    PAGED_OVERLAP,
    PAGED_SEPARATORS,
    PAGED_SIZE,
    PII_PATTERNS,
    PLAIN_OVERLAP,
    PLAIN_SEPARATORS,
    PLAIN_SIZE,
    TOOL_GATES,
    TOOL_LIST_FIELDS,
    TOOL_TEXT_FIELDS,
    UNKNOWN_ANSWER,
)


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select.strip()


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def recursive(*parts: str, select: str) -> str:
    return with_(*parts, select=select).replace("WITH", "WITH RECURSIVE", 1)


def cycle(col: str, values: list[str]) -> str:
    n = len(values)
    whens = " ".join(f"WHEN {col} % {n} = {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {whens} END"


def redact(x: str) -> str:
    for entity, pattern, _ in PII_PATTERNS:
        x = f"regexp_replace({x}, {q(pattern)}, '<{entity}>', 'g')"
    return x


def tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{2,}}'))"


def share(part: str, whole: str) -> str:
    """len() of lists of distinct terms that meet, over the first list."""
    return f"(len(list_intersect({part}, {whole})) / greatest(1, len({part})))"


def text_id(sid: str, index: str) -> str:
    """Id expression without a subquery: the digest is computed by its own CTE."""
    return f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({sid} || '::' || {index}))"


REL_PATH = (
    "CASE WHEN doc_id % 4 = 0 THEN 'external/' ELSE '' END || source || '/' || doc_id || "
    + cycle("doc_id", ["'.md'", "'.txt'", "'.pdf'"])
)

FILES = rf"""
files AS (
  SELECT doc_id, {REL_PATH} AS rel_path,
    CASE WHEN doc_id % 3 = 0 THEN
      '# ' || source || chr(10) || regexp_replace(regexp_replace(text,
        '\n([A-H])', chr(10) || '## \1', 'g'), '\n([I-P])', chr(10) || '### \1', 'g')
      || chr(10) || '```' || chr(10) || '# no header' || chr(10) || '```' || chr(10)
      || '# Last' || chr(10) || 'end'
    ELSE text END AS text, lang
  FROM documents)
"""

DOCS = f"""
docs AS (
  SELECT CASE WHEN rel_path LIKE '%.pdf' THEN rel_path || '#p' || (doc_id % 3 + 1) ELSE rel_path END AS source_id,
    rel_path AS source_path,
    CASE WHEN starts_with(rel_path, 'external/') THEN 'external' ELSE 'project' END AS doc_type,
    {redact("text")} AS text, lang
  FROM files)
"""

CHUNKS = f"""
windows AS (
  SELECT source_id, source_path, doc_type, lang, s, {strip("substr(text, s + 1, 900)")} AS text
  FROM (SELECT *, unnest(range(0, greatest(length(text) - 151, 0) + 1, 750)) AS s FROM docs)),
numbered AS (
  SELECT source_id, source_path, doc_type, lang, text,
    (row_number() OVER (PARTITION BY source_id ORDER BY s) - 1)::INT AS chunk_index
  FROM windows WHERE text <> ''),
digested AS (SELECT *, {text_id("source_id", "chunk_index")} AS h FROM numbered),
chunks AS (
  SELECT substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' ||
      printf('%02x', (('0x' || substr(h,17,2))::INT & 63) | 128) || substr(h,19,2) || '-' || substr(h,21,12) AS chunk_id,
    source_id, source_path, doc_type, chunk_index, split_part(source_path, '/', 1) AS h1, text, lang
  FROM digested)
"""

STORE = FILES + "," + DOCS + "," + CHUNKS


def hashed(name: str, table: str, key: str, column: str) -> str:
    """Sparse token-hash vectors: (key, cell, value) with float values."""
    return f"""
{name}_counts AS (
  SELECT key, ('0x' || substr(md5(token), 1, 7))::INT % 256 AS cell, count(*) AS n
  FROM (SELECT {key} AS key, unnest(regexp_extract_all(lower({column}), '[a-z0-9]{{2,}}')) AS token FROM {table})
  GROUP BY ALL),
{name} AS (
  SELECT key, cell, (n / sqrt(sum(n * n) OVER (PARTITION BY key)))::FLOAT::DOUBLE AS value FROM {name}_counts),
{name}_norm AS (SELECT key, sqrt(sum(value * value)) AS norm FROM {name} GROUP BY key)
"""


def resolved(source: str, mode: str = "mode", default_mode: str = "auto", caller: str = "0.8") -> str:
    """queries with resolved parameters, from (query_id, question, mode, scope, k)."""
    wanted = f"lower({strip(f'coalesce(nullif({mode}, {q("")}), {q(default_mode)})')})"
    scope = f"lower({strip(f'coalesce(nullif(scope, {q("")}), {q("project")})')})"
    return f"""
scoped AS (
  SELECT * EXCLUDE (scope, k), greatest(1, coalesce(k, 6)) AS k,
    CASE WHEN {scope} IN ('all', '*') THEN 'all'
      WHEN {scope} IN ('external', 'project') THEN {scope} ELSE 'project' END AS scope,
    {wanted} AS wanted_mode
  FROM {source}),
moded AS (
  SELECT *, CASE WHEN wanted_mode = 'auto' THEN CASE WHEN scope = 'external' THEN 'hybrid' ELSE 'mmr' END
    WHEN wanted_mode IN ('mmr', 'hybrid') THEN wanted_mode ELSE 'similarity' END AS rmode FROM scoped),
params AS (
  SELECT *, CASE WHEN rmode = 'hybrid' AND scope = 'external'
      THEN greatest(k, least(greatest(k, 120), greatest(24, 60, k * 5))) ELSE greatest(k, 24) END AS fetch_k,
    CASE scope WHEN 'project' THEN 0.65::DOUBLE WHEN 'external' THEN 0.8::DOUBLE ELSE {caller}::DOUBLE END AS threshold
  FROM moded)
"""


ITEMS = f"""
items AS (
  SELECT item_id::VARCHAR AS query_id, text AS question, item_id,
    {cycle("item_id", ["'similarity'", "'hybrid'", "'mmr'", "NULL"])} AS mode,
    {cycle("item_id", ["'all'", "'external'", "NULL"])} AS scope,
    CASE WHEN item_id % 5 = 0 THEN 4 END AS k
  FROM benchmark)
"""

SCORED = """
dots AS (
  SELECT qv.key AS query_id, cv.key AS chunk_id, sum(qv.value * cv.value) AS dot
  FROM qv JOIN cv USING (cell) GROUP BY ALL),
scored AS (
  SELECT p.query_id, c.chunk_id,
    round(1 - coalesce(d.dot / (qn.norm * cn.norm), 0), 9) AS vec_score
  FROM params p JOIN chunks c ON p.scope = 'all' OR p.scope = c.doc_type
  LEFT JOIN dots d ON d.query_id = p.query_id AND d.chunk_id = c.chunk_id
  LEFT JOIN qv_norm qn ON qn.key = p.query_id LEFT JOIN cv_norm cn ON cn.key = c.chunk_id),
cand AS (
  SELECT s.*, p.rmode, p.k, p.question, p.fetch_k,
    row_number() OVER (PARTITION BY s.query_id ORDER BY vec_score, s.chunk_id) AS vec_rank
  FROM scored s JOIN params p USING (query_id) QUALIFY vec_rank <= p.fetch_k)
"""

HYBRID = f"""
lexical AS (
  SELECT c.query_id, c.chunk_id, c.vec_rank, c.k, c.vec_score,
    round(1 - (0.7::DOUBLE * (1 / (1 + c.vec_score))
      + (1 - 0.7::DOUBLE) * {share(tokens("c.question"), tokens("t.text"))}), 9) AS score
  FROM cand c JOIN chunks t USING (chunk_id) WHERE c.rmode = 'hybrid'),
hybrid AS (
  SELECT query_id, chunk_id, vec_score, vec_rank, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score, vec_rank) AS rank
  FROM lexical QUALIFY rank <= k)
"""


def mmr(steps: int = 6, lam: str = "0.5::DOUBLE") -> str:
    """Greedy picks, one CTE per pick, over pairwise products of the candidates."""
    parts = [
        """
mc AS (SELECT query_id, chunk_id, vec_score, vec_rank, k, 1 - vec_score AS near FROM cand WHERE rmode = 'mmr'),
mids AS (SELECT DISTINCT chunk_id FROM mc),
mv AS (SELECT cv.* FROM cv JOIN mids ON cv.key = mids.chunk_id),
mpairs AS (
  SELECT DISTINCT a.chunk_id AS a, b.chunk_id AS b FROM mc a JOIN mc b USING (query_id)),
mdots AS (
  SELECT p.a, p.b, sum(x.value * y.value) AS dot
  FROM mpairs p JOIN mv x ON x.key = p.a JOIN mv y ON y.key = p.b AND y.cell = x.cell GROUP BY ALL),
mlike AS (
  SELECT p.a, p.b, coalesce(d.dot / (na.norm * nb.norm), 0) AS s
  FROM mpairs p LEFT JOIN mdots d ON d.a = p.a AND d.b = p.b
  LEFT JOIN cv_norm na ON na.key = p.a LEFT JOIN cv_norm nb ON nb.key = p.b),
pick1 AS (
  SELECT query_id, chunk_id, 1 AS rank, k FROM mc WHERE vec_rank = 1)"""
    ]
    for n in range(2, steps + 1):
        before = " UNION ALL ".join(f"SELECT * FROM pick{i}" for i in range(1, n))
        parts.append(
            f"""
picked{n} AS ({before}),
pick{n} AS (
  SELECT m.query_id, m.chunk_id, {n} AS rank, m.k
  FROM mc m JOIN picked{n} p ON p.query_id = m.query_id JOIN mlike l ON l.a = m.chunk_id AND l.b = p.chunk_id
  WHERE m.k >= {n}
    AND NOT EXISTS (SELECT 1 FROM picked{n} x WHERE x.query_id = m.query_id AND x.chunk_id = m.chunk_id)
  GROUP BY m.query_id, m.chunk_id, m.k, m.near, m.vec_rank
  QUALIFY row_number() OVER (PARTITION BY m.query_id
    ORDER BY round({lam} * m.near - (1 - {lam}) * max(l.s), 9) DESC, m.vec_rank) = 1)"""
        )
    union = " UNION ALL ".join(f"SELECT * FROM pick{i}" for i in range(1, steps + 1))
    parts.append(
        f"""
mmr AS (
  SELECT u.query_id, u.chunk_id, m.vec_score, m.vec_rank, m.vec_score AS score, u.rank
  FROM ({union}) u JOIN mc m ON m.query_id = u.query_id AND m.chunk_id = u.chunk_id)"""
    )
    return ",".join(parts)


HITS = """
near AS (
  SELECT query_id, chunk_id, vec_score, vec_rank, vec_score AS score, vec_rank AS rank
  FROM cand WHERE rmode = 'similarity' AND vec_rank <= k),
ranked AS (SELECT * FROM near UNION ALL SELECT * FROM hybrid UNION ALL SELECT * FROM mmr),
hits AS (
  SELECT r.query_id, r.rank::INT AS rank, c.*, r.score, r.vec_score, r.vec_rank::INT AS vec_rank
  FROM ranked r JOIN chunks c USING (chunk_id))
"""

VECTORS = hashed("cv", "chunks", "chunk_id", "text")


def hits(queries: str = ITEMS, source: str = "items", mode: str = "mode", **options: str) -> list[str]:
    """Everything from the tables to ``hits``; ``mode`` may be a literal."""
    return [
        STORE,
        queries,
        resolved(source, mode, **options),
        hashed("qv", "params", "query_id", "question"),
        VECTORS,
        SCORED,
        HYBRID,
        mmr(),
        HITS,
    ]


HIT_COLUMNS = "query_id, rank, chunk_id, source_id, doc_type, round(score, 6) AS score"

LABEL_HITS = f"""
cells AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings),
means AS (SELECT label, pos, round(avg(value), 6) AS mean FROM cells GROUP BY ALL),
lq AS (
  SELECT label::VARCHAR AS query_id, list(mean ORDER BY pos) AS vec,
    {cycle("label", ["'all'", "'external'", "'project'"])} AS scope
  FROM means GROUP BY label),
lv AS (
  SELECT vec_id::VARCHAR AS chunk_id, label, CASE WHEN label < 3 THEN 'external' ELSE 'project' END AS doc_type,
    embedding::DOUBLE[] AS vec FROM embeddings)
"""


def label_topk(condition: str, k: int) -> str:
    return with_(
        LABEL_HITS,
        select=f"""
SELECT query_id, rank::INT AS rank, chunk_id, label, round(d, 6) AS score FROM (
  SELECT query_id, chunk_id, label, d, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank
  FROM (SELECT query_id, chunk_id, label, round(1 - list_cosine_similarity(lq.vec, lv.vec), 9) AS d
        FROM lq JOIN lv ON {condition}))
WHERE rank <= {k}""",
    )


def label_lsh(bits: int, tables: int, dim: int, k: int) -> str:
    """As label_topk, over the pairs whose codes are at most one bit apart in some table."""

    def codes(name: str, table: str, key: str) -> str:
        return f"""
{name}_cells AS (SELECT {key} AS key, unnest(range(len(vec))) AS d, unnest(vec) AS value FROM {table}),
{name}_sides AS (SELECT key, p, sum(value * side) AS s FROM {name}_cells JOIN planes USING (d) GROUP BY ALL),
{name} AS (
  SELECT key, p // {bits} AS t, sum(CASE WHEN s >= 0 THEN 1 << (p % {bits}) ELSE 0 END)::INT AS code
  FROM {name}_sides GROUP BY ALL)"""

    return with_(
        LABEL_HITS,
        f"""planes AS (
  SELECT p, d, CASE WHEN substr(md5(p || ':' || d), 1, 1) < '8' THEN 1 ELSE -1 END AS side
  FROM (SELECT unnest(range({bits * tables})) AS p), (SELECT unnest(range({dim})) AS d))""",
        codes("qcodes", "lq", "query_id"),
        codes("vcodes", "lv", "chunk_id"),
        """met AS (
  SELECT DISTINCT a.key AS query_id, b.key AS chunk_id FROM qcodes a JOIN vcodes b USING (t)
  WHERE bit_count(xor(a.code, b.code)) <= 1)""",
        select=f"""
SELECT query_id, rank::INT AS rank, chunk_id, round(d, 6) AS score FROM (
  SELECT query_id, chunk_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank
  FROM (SELECT query_id, chunk_id, round(1 - list_cosine_similarity(lq.vec, lv.vec), 9) AS d
        FROM met JOIN lq USING (query_id) JOIN lv USING (chunk_id) WHERE lq.scope = 'all' OR lq.scope = lv.doc_type))
WHERE rank <= {k}""",
    )


# --- text --------------------------------------------------------------------


def norm_sid(x: str) -> str:
    x = rf"regexp_replace({strip(x)}, '^[`''\"]+|[`''\"]+$', '', 'g')"
    x = rf"regexp_replace({x}, '^(?:source_id|source|citation)\s*[:=]\s*', '', 'i')"
    x = rf"regexp_replace({x}, '[.,;:]+$', '')"
    return rf"lower(replace({x}, '\', '/'))"


def sid_variants(full: str) -> str:
    """Variants of an already normalised id."""
    path = f"split_part({full}, '#', 1)"
    file = f"split_part({path}, '/', -1)"
    page = f"substr({full}, length({path}) + 2)"
    return (
        f"list_distinct(list_filter([{full}, {path}, {file}, "
        f"CASE WHEN {page} <> '' THEN {file} || '#' || {page} ELSE '' END], lambda v: v <> ''))"
    )


CITED = r"regexp_extract_all({x}, '\[([^\[\]\n]{{1,100}})\]', 1)"


def citations(x: str) -> str:
    return CITED.format(x=x)


def is_unknown(x: str) -> str:
    flat = rf"lower(regexp_replace({strip(f'coalesce({x}, {q("")})')}, '\s+', ' ', 'g'))"
    return f"starts_with({flat}, {q(UNKNOWN_ANSWER.rstrip('.').lower())})"


def valid(answer: str, allowed: str) -> str:
    """At least one citation, and one of them allowed (no list: any)."""
    cited = citations(answer)
    accepted = f"flatten(list_transform({allowed}, lambda s: {sid_variants(norm_sid('s'))}))"
    mapped = f"list_transform({cited}, lambda c: {norm_sid('c')})"
    return (
        f"(len({cited}) > 0 AND CASE WHEN {allowed} IS NULL THEN true "
        f"ELSE coalesce(list_has_any({mapped}, {accepted}), false) END)"
    )


ANSWERS = rf"""
answers AS (
  SELECT conv_id || '-' || turn AS query_id,
    CASE WHEN conv_id % 11 = 0 THEN '  I  don''t KNOW based on the' || chr(10) || 'provided documents and more'
    ELSE text || {cycle("conv_id", [
        "' [' || doc || name || '#p6]'", "' [' || name || '] [nothing]'",
        "' [Source: `' || replace(doc, '/', chr(92)) || name || '.`]'", "' [wrong]'", "''"])} END AS answer,
    CASE WHEN conv_id % 13 <> 0 THEN [doc || name || '#p6', 'src0/readme.md'] END AS source_ids
  FROM (SELECT *, 'external/Src' || (conv_id % 20) || '/' AS doc, conv_id || '.pdf' AS name
        FROM conversations WHERE role = 'assistant'))
"""

LEADS = [
    "'Create an ADR about '",
    "'Write user stories for '",
    "'Provide a solution outline for '",
    "'Prepare a risk assessment of '",
    "'Draft the assessment of '",
    "''",
]

QUESTIONS = f"""
questions AS (
  SELECT conv_id, turn, conv_id || '-' || turn AS query_id,
    {cycle("conv_id", LEADS)} || text AS question,
    {cycle("conv_id", ["'adr'", "'user_stories'", "'solution_outline'", "'risk_assessment'", "'risk_assessment'", "'ask'"])} AS expected_tool,
    {cycle("turn", ["NULL", "''", "' External '", "'ALL'", "'*'", "'other'", "'project'"])} AS scope,
    {cycle("conv_id", ["NULL", "'auto'", "' MMR'", "'hybrid'", "'similarity'", "'bm25'", "''"])} AS mode,
    {cycle("conv_id", ["NULL", "'0'", "'-3'", "'abc'", "'4'", "' 30 '", "'200'", "'2.5'"])} AS k_header,
    CASE WHEN conv_id % 3 = 0 THEN turn::INT - 1 END AS k_given
  FROM conversations WHERE role = 'user')
"""

# A header counts only as a positive whole number; it wins over the given k.
HEADED = rf"""
headed AS (
  SELECT * EXCLUDE (k_given), coalesce(
    CASE WHEN regexp_full_match(trim(k_header), '\d+') AND trim(k_header)::INT > 0 THEN trim(k_header)::INT END,
    k_given) AS k FROM questions)
"""


def words(x: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


def is_artifact(x: str) -> str:
    return (
        f"({words(x, ARTIFACT_TERMS)} OR ({words(x, CREATE_VERBS)} AND {words(x, ARTIFACT_NOUNS)}))"
    )


def routed(x: str) -> str:
    low = f"lower({x})"
    return f"""CASE WHEN NOT {is_artifact(low)} THEN 'ask'
    WHEN {words(low, ("adr", "architecture decision", "decision record"))} THEN 'adr'
    WHEN {words(low, ("user story", "stories", "acceptance criteria"))} THEN 'user_stories'
    WHEN {words(low, ("outline", "architecture", "assumptions"))} THEN 'solution_outline'
    WHEN {words(low, ("risk", "mitigation", "assessment"))} THEN 'risk_assessment' ELSE 'ask' END"""


# --- JSON --------------------------------------------------------------------

JSON_TEXTS = '"context": "c", "decision": "d", "summary": "s", "epic": "e"'
JSON_LISTS = (
    '"alternatives": ["a"], "consequences": [], "architecture": ["x"], "risks": ["r", "q"], '
    '"assumptions": [], "stories": ["s"], "acceptance_criteria": ["c"], "mitigations": ["m"]'
)
GOOD = (
    f"'{{\"title\": \"Title ' || conv_id || '\", {JSON_TEXTS}, {JSON_LISTS}, "
    "\"sources\": [\"s' || conv_id || '\"]}'"
)

OUTPUTS = f"""
outputs AS (
  SELECT conv_id || '-' || turn AS query_id,
    {cycle("conv_id", ["'adr'", "'solution_outline'", "'user_stories'", "'risk_assessment'"])} AS tool,
    CASE WHEN role = 'system' THEN {GOOD} ELSE {cycle("conv_id", [
        GOOD,
        q(f'{{"title": "Tiny", {JSON_TEXTS}, {JSON_LISTS}, "sources": []}}'),
        q(f'{{"title": 12345, {JSON_TEXTS}, {JSON_LISTS}, "sources": []}}'),
        q(f'{{"title": "Long enough", {JSON_TEXTS}, {JSON_LISTS}, "sources": ["a", 1]}}'),
        q(f'{{"title": "Long enough", {JSON_TEXTS}, {JSON_LISTS}}}'),
        "'  ' || chr(10)",
        q('{"title": '),
    ])} END AS output
  FROM conversations)
"""

# Text that is no JSON becomes null, so that the field tests below see nothing.
PARSED = "parsed AS (SELECT *, CASE WHEN json_valid(output) THEN output::JSON END AS j FROM outputs)"


def is_text(field: str) -> str:
    return f"coalesce(json_type(j, '$.{field}') = 'VARCHAR', false)"


def is_text_list(field: str) -> str:
    return (
        f"coalesce(json_type(j, '$.{field}') = 'ARRAY' AND len(list_filter("
        f"json_extract(j, '$.{field}[*]'), lambda e: json_type(e) <> 'VARCHAR')) = 0, false)"
    )


def structured_error(tool: str = "tool", output: str = "output") -> str:
    whens = []
    for name, texts in TOOL_TEXT_FIELDS.items():
        checks = [is_text(f) for f in texts] + [is_text_list(f) for f in TOOL_LIST_FIELDS[name]]
        if "title" in texts:
            checks.append("coalesce(length(json_extract_string(j, '$.title')) >= 5, false)")
        whens.append(f"WHEN {tool} = '{name}' THEN " + " AND ".join(checks))
    return (
        f"CASE WHEN {strip(f'coalesce({output}, {q("")})')} = '' THEN 'empty_model_output' "
        f"WHEN NOT (CASE {' '.join(whens)} ELSE false END) THEN 'invalid_structured_output' END"
    )


def gate_case(index: int, tool: str = "tool") -> str:
    whens = " ".join(
        f"WHEN {tool} = '{t}' THEN {q(g[index]) if isinstance(g[index], str) else g[index]}"
        for t, g in TOOL_GATES.items()
    )
    return f"CASE {whens} END"


# --- per query ---------------------------------------------------------------

CONTEXTS = f"""
contexts AS (
  SELECT query_id, string_agg('[' || source_id || ']' || chr(10) || text, {q(CONTEXT_SEPARATOR)} ORDER BY rank) AS context
  FROM hits GROUP BY query_id)
"""

SOURCES = """
sources AS (
  SELECT query_id, source_id, min(rank)::INT AS position, max_by(chunk_index, rank) AS last_chunk,
    max_by(source_path, rank) AS source_path, max_by(doc_type, rank) AS doc_type, max_by(h1, rank) AS h1,
    max_by(coalesce('|lang=' || lang, ''), rank) AS lang_part
  FROM hits GROUP BY ALL),
source_lists AS (
  SELECT query_id, list(source_id ORDER BY position) AS source_ids,
    list(source_id || '/' || last_chunk ORDER BY position) AS source_marks FROM sources GROUP BY ALL)
"""


def gate(min_docs: str = "1", min_unique: str = "1") -> str:
    return f"""
seen AS (
  SELECT query_id, count(*) AS n_docs, count(DISTINCT nullif(source_id, '')) AS n_sources, min(score) AS best_score
  FROM hits GROUP BY ALL),
gate AS (
  SELECT p.query_id, coalesce(n_docs, 0) AS n_docs, coalesce(n_sources, 0) AS n_sources, best_score,
    coalesce(coalesce(n_docs, 0) >= {min_docs} AND coalesce(n_sources, 0) >= {min_unique}
      AND best_score <= threshold, false) AS grounded
  FROM params p LEFT JOIN seen USING (query_id))
"""


# --- the splitter ------------------------------------------------------------


def _separators(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(q(v).replace("\n", "' || chr(10) || '") for v in values) + "]"


PLAIN_RULE = f"{PLAIN_SIZE} AS size, {PLAIN_OVERLAP} AS overlap, {_separators(PLAIN_SEPARATORS)} AS seps"
PAGED_RULE = f"{PAGED_SIZE} AS size, {PAGED_OVERLAP} AS overlap, {_separators(PAGED_SEPARATORS)} AS seps"


def whole_roots(table: str, key: str, rule: str) -> str:
    """Every text as one root: (key, root, lo, text) and the rule to cut it by."""
    return f"roots AS (SELECT {key} AS key, 0 AS root, 0 AS lo, text, {rule} FROM {table})"


def format_roots(table: str, key: str, name: str) -> str:
    """Markdown by its header sections, page text and other text as a whole."""
    return rf"""
formats AS (
  SELECT {key} AS key, text, CASE WHEN ends_with(lower({name}), '.md') THEN 'md'
    WHEN ends_with(lower({name}), '.pdf') OR contains(lower({name}), '.pdf#p') THEN 'pdf' ELSE 'other' END AS format
  FROM {table}),
md_lines AS (
  SELECT key, generate_subscripts(parts, 1) AS n, unnest(parts) AS line
  FROM (SELECT key, string_split(text, chr(10)) AS parts FROM formats WHERE format = 'md')),
md_placed AS (
  SELECT *, sum(length(line) + 1) OVER w - length(line) - 1 AS place,
    sum(regexp_matches(line, '^[ \t]*(```|~~~)')::INT) OVER w % 2 AS inside
  FROM md_lines WINDOW w AS (PARTITION BY key ORDER BY n)),
md_begins AS (
  SELECT key, place FROM md_placed WHERE n = 1 OR (inside = 0 AND regexp_matches(line, '^#{{1,3}}([ \t]|$)'))),
md_sections AS (
  SELECT key, place, lead(place) OVER (PARTITION BY key ORDER BY place) AS following FROM md_begins),
roots AS (
  SELECT key, place AS root, place AS lo,
    substr(text, place::BIGINT + 1, (coalesce(following, length(text)) - place)::BIGINT) AS text, {PLAIN_RULE}
  FROM md_sections JOIN formats USING (key)
  UNION ALL SELECT key, 0, 0, text, {PAGED_RULE} FROM formats WHERE format = 'pdf'
  UNION ALL SELECT key, 0, 0, text, {PLAIN_RULE} FROM formats WHERE format = 'other')
"""


def _pieces(table: str) -> str:
    """Segments cut before each occurrence of the first separator, from their level on, that they hold."""
    return f"""
SELECT key, path, j, size, overlap, seps, n, piece,
  lo + sum(length(piece)) OVER (PARTITION BY key, path ORDER BY n) - length(piece) AS lo
FROM (
  SELECT key, path, lo, j, size, overlap, seps, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS n
  FROM (
    SELECT *, list_filter(list_transform(string_split(text, seps[j]),
      lambda p, i: CASE WHEN i = 1 THEN p ELSE seps[j] || p END), lambda p: p <> '') AS pieces
    FROM {table} WHERE seps[j] <> ''))"""


def _first(text: str, level: str) -> str:
    return f"list_filter(range({level}, len(seps) + 1), lambda i: seps[i] = '' OR contains({text}, seps[i]))[1]"


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# Cut places of the hierarchical splitter from ``roots``. ``segs`` are the roots and all pieces that are longer than the
# size, cut again by the separators that follow. Neighbouring short pieces of a segment are a run; a run is packed from
# its first piece on as far as the size allows, and the next chunk begins with the first piece that keeps the overlap and
# the size. Begins and ends of chunks are those of their text without blanks.
CUTS = f"""
segs AS (
  SELECT key, [root::BIGINT] AS path, lo::BIGINT AS lo, text, size, overlap, seps, {_first("text", "1")} AS j FROM roots
  UNION ALL
  SELECT key, list_append(path, n), lo::BIGINT, piece, size, overlap, seps, {_first("piece", "j + 1")}
  FROM ({_pieces("segs")}) WHERE length(piece) > size),
pieces AS (
  SELECT *, sum((length(piece) > size)::INT) OVER (PARTITION BY key, path ORDER BY n) AS run FROM ({_pieces("segs")})),
runs AS (
  SELECT key, path, run, any_value(size) AS size, any_value(overlap) AS overlap,
    list(lo::BIGINT ORDER BY n) AS starts, list((lo + length(piece))::BIGINT ORDER BY n) AS ends
  FROM pieces WHERE length(piece) <= size GROUP BY key, path, run),
packs AS (
  SELECT *, 0::BIGINT AS a, 0::BIGINT AS b, 1::BIGINT AS f FROM runs
  UNION ALL
  SELECT key, path, run, size, overlap, starts, ends, starts[f],
    CASE WHEN i > len(starts) THEN ends[-1] ELSE starts[i] END,
    CASE WHEN i > len(starts) THEN i ELSE f + 1 + len(list_filter(starts[f + 1 : i - 1],
      lambda s: starts[i] - s > overlap OR ends[i] - s > size)) END
  FROM (SELECT *, f + len(list_filter(ends[f : f + size], lambda e: e - starts[f] <= size)) AS i
    FROM packs WHERE f <= len(starts))),
spans AS (
  SELECT key, a, b FROM packs WHERE b > a
  UNION ALL
  SELECT key, lo + s, least(lo + s + size, lo + length(text)) FROM (
    SELECT *, unnest(range(0, greatest(length(text) - overlap, 1), size - overlap)) AS s FROM segs WHERE seps[j] = '')),
bodies AS (
  SELECT s.key, a, b, substr(t.text, a + 1, b - a) AS body FROM spans s JOIN texts t USING (key)),
cuts AS (
  SELECT key, b - length(ltrim(body, {_BLANKS})) AS first, a + length(rtrim(body, {_BLANKS})) AS last
  FROM bodies WHERE trim(body, {_BLANKS}) <> '')
"""


def split_cuts(roots: str, table: str, key: str) -> str:
    return f"{roots},\ntexts AS (SELECT {key} AS key, text FROM {table}),{CUTS}"
