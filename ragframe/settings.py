"""Word lists, patterns, sentences, thresholds and sizes.

Everything in the first part of this module must keep exactly these values for
results to come out right; the second part sizes the Spark jobs.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

# --- fixed values: personal-data patterns, in the order they are applied -----
# (entity, pattern, confidence of a hit)
PII_PATTERNS = (
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.85),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.6),
    ("API_KEY", r"\b(?:sk|pk|api|key|token)[-_]?[A-Za-z0-9]{12,}\b", 0.6),
    ("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", 0.6),
    (
        "PHONE_NUMBER",
        r"\b(?:\+?\d{1,3}[-\s]?)?(?:\(\d{2,4}\)|\d{2,4})[-\s]?\d{3,4}[-\s]?\d{3,4}\b",
        0.6,
    ),
)

# --- fixed values: sentences, tokens, citation format ------------------------
UNKNOWN_ANSWER = "I don't know based on the provided documents."
UNKNOWN_SOURCE = "unknown_source"
TOKEN_PATTERN = "[a-z0-9]{2,}"
CITATION_PATTERN = r"\[([^\[\]\n]{1,100})\]"
CITATION_PREFIX_PATTERN = r"(?i)^(?:source_id|source|citation)\s*[:=]\s*"
CONTEXT_SEPARATOR = "\n\n---\n\n"
PAGE_MARK = "#p"
EXTERNAL_PREFIX = "external/"
TEXT_SUFFIXES = (".md", ".txt")
PAGED_SUFFIX = ".pdf"
UUID_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"

# --- fixed values: artifact words and tools ----------------------------------
ARTIFACT_TERMS = (
    "adr",
    "architecture decision",
    "decision record",
    "solution outline",
    "user story",
    "user stories",
    "acceptance criteria",
    "risk assessment",
    "risk analysis",
    "risk register",
)
CREATE_VERBS = ("create", "draft", "write", "generate", "produce", "prepare")
ARTIFACT_NOUNS = ("outline", "stories", "assessment", "adr", "decision record")
DEFAULT_ALTERNATIVES = ("Option A", "Option B", "Option C")

# tool -> (min_docs, min_unique_sources, default threshold, message of a failed gate)
TOOL_GATES = {
    "ask": (1, 1, 0.8, "Retrieved context did not meet groundedness thresholds."),
    "adr": (2, 2, 0.75, "Not enough context from documents for ADR."),
    "solution_outline": (3, 2, 0.75, "Not enough context from documents for Solution Outline."),
    "user_stories": (2, 1, 0.75, "Not enough context from documents for User Stories."),
    "risk_assessment": (2, 2, 0.75, "Not enough context from documents for Risk Assessment."),
}
ARTIFACT_TOOLS = tuple(t for t in TOOL_GATES if t != "ask")

# tool -> fields of its structured output, in order; list fields hold strings
TOOL_TEXT_FIELDS = {
    "adr": ("title", "context", "decision"),
    "solution_outline": ("title", "summary"),
    "user_stories": ("epic",),
    "risk_assessment": (),
}
TOOL_LIST_FIELDS = {
    "adr": ("alternatives", "consequences", "sources"),
    "solution_outline": ("architecture", "risks", "assumptions", "sources"),
    "user_stories": ("stories", "acceptance_criteria", "sources"),
    "risk_assessment": ("risks", "mitigations", "sources"),
}
MIN_TITLE_LENGTH = 5

# --- fixed values: error codes and messages ----------------------------------
ERR_CONTEXT = "not_enough_context"
ERR_CITATION = "citation_validation_failed"
ERR_EMPTY = "empty_model_output"
ERR_STRUCTURED = "invalid_structured_output"
MSG_CITATION = "Model output did not cite retrieved sources in an acceptable format."
MSG_EMPTY = "Model returned an empty structured response."
MSG_STRUCTURED = "Model output was not valid structured JSON."

# --- fixed values: splitters --------------------------------------------------
PLAIN_SIZE, PLAIN_OVERLAP = 900, 150
PLAIN_SEPARATORS = ("\n\n", "\n", " ", "")
PAGED_SIZE, PAGED_OVERLAP = 700, 120
PAGED_SEPARATORS = ("\n## ", "\n# ", "\n\n", "\n", " ", "")


@dataclass(frozen=True)
class RetrievalDefaults:
    """Fallbacks used for every retrieval parameter a query row leaves open."""

    mode: str = "auto"
    scope: str = "project"
    k: int = 6
    similarity_fetch_k: int = 24
    mmr_fetch_k: int = 24
    mmr_lambda: float = 0.5
    hybrid_fetch_k: int = 24
    external_fetch_min: int = 60
    external_fetch_multiplier: int = 5
    external_fetch_max: int = 120
    alpha: float = 0.7
    alpha_project: float | None = None
    alpha_external: float | None = None
    alpha_all: float | None = None
    threshold_project: float = 0.65
    threshold_external: float = 0.8
    threshold_all: float | None = None

    @classmethod
    def from_settings(cls, settings: Mapping[str, str]) -> RetrievalDefaults:
        """Read text settings keyed by field name; a bad number keeps the default."""
        chosen = {}
        for f in fields(cls):
            raw = settings.get(f.name)
            if raw is None:
                continue
            if f.name in ("mode", "scope"):
                chosen[f.name] = raw
                continue
            number = int if str(f.type) == "int" else float
            try:
                chosen[f.name] = number(raw)
            except ValueError:
                continue
        return cls(**chosen)


# --- sizes of the Spark jobs --------------------------------------------------
# Scores are rounded to this many decimals before ranking: block products add up
# in an order that depends on the batch, and a re-run task must rank the same.
SCORE_DECIMALS = 9
# A block of queries is broadcast; these bound its vectors and its hits.
QUERY_BLOCK_ROWS = 8192
QUERY_BLOCK_BYTES = 64 * 1024 * 1024
QUERY_BLOCK_HITS = 200_000
# Files that one scan of a second look at the store names; further ones are further scans.
SCAN_FILES = 10_000
# Most names of sources that an upsert hands to the scan of the source index as literals.
INDEX_NAMES = 10_000
# Tasks of one scan for candidates; each returns short lists, so more of them
# than the largest clusters run at once would only lengthen the shuffle.
SCORE_TASKS = 32_768
# Entrants that wait, at least, before a task sorts them into its best lists.
BUFFER_ROWS = 1 << 17
# Cells of one matrix of vectors or scores inside a task (8 bytes each); Arrow batches are worked off in such slices.
SCORE_CELLS = 500_000
# Texts that a task embeds at once.
EMBED_ROWS = 1024
# Largest side, in rows, that an upsert or a rule join may broadcast.
BROADCAST_ROWS = 500_000
# Files of a folder tree that one task reads, and the bytes it hands on at once.
TREE_FILES_PER_TASK = 1000
TREE_BATCH_BYTES = 4 << 20
# Documents of one source that are numbered together in one window group.
INDEX_BLOCK = 4096
EMBEDDING_DIM = 256
