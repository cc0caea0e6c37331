"""Toxic spans by a linear-chain conditional random field with two tags.

Labels are per document, so token labels come first: a word or word beginning is a cue if it occurs in training
documents labelled toxic and (nearly) never in others; the cues in toxic documents are labelled toxic, all other tokens
clean. The field is then trained on these token sequences, each the whole text; toxic documents without a cue are left
out of this step. It has emission weights for a token's word, beginning, end and neighbours, and weights of the tag
transitions, by the gradient that forward-backward gives. A document's score is a logistic function of its tokens'
marginals; spans of tokens whose marginal reaches ``SPAN_CUT`` are its offending offsets.

The model is fitted on at most ``SAMPLE_ROWS`` labelled documents; scoring reads every whole text once, without a
shuffle. Scores depend on the text only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import Batches, WordRows, labelled_sample, saved, shared, text_batches, with_text_column

# Bound of the labelled sample that the model is fitted on.
SAMPLE_ROWS = 8_000

# Hashed features; beginnings of 4 to 6 letters, ends of 3.
FEATURES = 1 << 17
BEGINNINGS, ENDING = (4, 5, 6), 3

# A cue is in so many toxic documents, and of its documents this share is toxic.
CUE_DOCUMENTS, CUE_SHARE = 4, 0.97

SPAN_CUT = 0.5
# Rounds over the whole sample, step of a weight, gradient below which a weight's steps are smaller.
ROUNDS, RATE, PRIOR = 12, 0.5, 2.0
# Most tasks that sum gradients; tokens in a row of packed texts, unless the last one is longer.
TASKS = 16
SEQUENCE_TOKENS = 1 << 18

_PIECE = re.compile(r"\S+")


def keys(word: str) -> list[str]:
    """What a token may be recognised by: the word itself and its beginnings, without case and outer punctuation."""
    core = word.lower().strip(".,;:!?\"'()[]{}*_-#&%$|<>~`")
    return [core, *(core[:n] + "-" for n in BEGINNINGS if len(core) > n)] if core else []


def _slots(words: Iterable[str]) -> np.ndarray:
    """The features of each word, five at most; FEATURES, which weighs nothing, fills up its row."""
    slots = []
    for word in words:
        core = keys(word)
        names = [*core, "-" + core[0][-ENDING:]] if core else ["\x00"]
        slots += map(xxhash.xxh32_intdigest, names)
        slots += [-1] * (5 - len(names))
    found = np.array(slots, np.int64).reshape(-1, 5)
    return np.where(found < 0, FEATURES, found % FEATURES)


@dataclass
class Field:
    """Weights: per feature for the token itself, for the token before and the one after; transitions [from, to]."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    moves: np.ndarray
    calibration: tuple[float, float, float]


def marginals(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of the toxic tag for each token, by forward-backward over all sequences side by side."""
    _, forward, backward = _messages(scores, sizes, moves)
    both = forward * backward
    return both / (1 + both)


def _messages(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of the toxic tag for each token: by itself, by what is before it and itself, by what is after it.

    ``scores`` are the tokens' log-odds for the toxic tag, sequence after sequence. With two tags a message is a
    single ratio, so each step of all running sequences is one vector operation.
    """
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    starts, lengths = starts[order], sizes[order]
    odds = np.exp(np.clip(scores, -40, 40))
    (a, b), (c, d) = np.exp(moves)
    forward, backward = np.ones_like(odds), np.ones_like(odds)
    running = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if lengths.size else []
    ratio = None
    for t, n in enumerate(running):
        at = starts[:n] + t
        ratio = odds[at] if t == 0 else odds[at] * (b + d * ratio[:n]) / (a + c * ratio[:n])
        ratio = np.minimum(ratio, 1e30)
        forward[at] = ratio
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        at = starts[:n] + t
        more = running[t + 1] if t + 1 < len(running) else 0
        if more:
            ahead = starts[:more] + t + 1
            weight = np.minimum(odds[ahead] * backward[ahead], 1e30)
            backward[at[:more]] = (c + d * weight) / (a + b * weight)
    return odds, forward, backward


def token_scores(rows: np.ndarray, sizes: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds of tokens from the table's columns: own, as the token before, as the token after."""
    scores = table[rows, 0] + bias
    ends = np.cumsum(sizes)
    inner = np.ones(max(0, rows.size - 1), bool)
    borders = ends[:-1] - 1
    inner[borders[(borders >= 0) & (borders < inner.size)]] = False
    scores[1:] += np.where(inner, table[rows[:-1], 1], 0)
    scores[:-1] += np.where(inner, table[rows[1:], 2], 0)
    return scores


def document_features(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per sequence: the largest marginal, and the logarithm of one plus their sum. Zeros for an empty one."""
    out = np.zeros((sizes.size, 2))
    full = np.flatnonzero(sizes)
    if full.size:
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full, 0] = np.maximum.reduceat(p, starts)
        out[full, 1] = np.log1p(np.add.reduceat(np.where(p > 0.05, p, 0), starts))
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str, rest: Column, rows: int = SAMPLE_ROWS) -> Field:
    """Fit on labelled rows of ``docs`` for which ``rest`` (over doc_id) is false.

    Null texts are left out; empty ones count for the document scores only. Rows that repeat an id count each, with the
    id's label. Without a labelled row all scores are those of the first weights.
    """
    sample = saved(labelled_sample(docs, labels, label, rest, rows), "toxic-sample")
    return _trained(sample, _cues(sample))


def _cues(sample: DataFrame) -> set[str]:
    def count(batches: Batches) -> Batches:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[toxic > 0].update({k for w in set(text.split()) for k in keys(w)})
        names = list(found[0].keys() | found[1].keys())
        columns = [pa.array([c[n] for n in names], pa.int64()) for c in found]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], ["item", "clean", "toxic"])

    counts = text_batches(sample, count, "item string, clean bigint, toxic bigint")
    counts = counts.groupBy("item").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sure = (F.col("toxic") >= CUE_DOCUMENTS) & (F.col("toxic") >= CUE_SHARE * (F.col("clean") + F.col("toxic")))
    # words of the bounded sample
    return {r["item"] for r in counts.where(sure).select("item").collect()}


class Words:
    """word -> row of a table with the three weights of its features summed; the table grows with the words seen."""

    def __init__(self, field: Field, limit: int = 400_000):
        self.weights, self.limit = (field.own, field.before, field.after), limit
        self.table = np.zeros((4096, 3))
        self.rows: dict[str, int] = {}

    def _add(self, words: list[str]) -> None:
        first, last = len(self.rows), len(self.rows) + len(words)
        while last > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        slots = _slots(words)
        self.table[first:last] = np.stack([w[slots].sum(axis=1) for w in self.weights], axis=1)
        self.rows.update(zip(words, range(first, last), strict=True))

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of all words, words per text, and the table they refer to."""
        if len(self.rows) > self.limit:
            self.rows.clear()
        words = [t.split() for t in texts]
        new = set().union(*words).difference(self.rows)
        if new:
            self._add(list(new))
        sizes = np.array([len(w) for w in words], np.int64)
        rows = np.fromiter((r for w in words for r in map(self.rows.__getitem__, w)), np.int64, int(sizes.sum()))
        return rows, sizes, self.table


def _trained(sample: DataFrame, cues: set[str]) -> Field:
    """Steps in the driver along exact gradients, which tasks sum over the sample's whole texts.

    Every token of a clean document and of a toxic one with a cue is used, in every round. A toxic document without a
    cue says nothing about its tokens; it counts for the document scores only. The driver gets a sum per task, of a
    size that does not depend on the texts.
    """
    sequences = saved(_sequences(sample, cues), "toxic-sequences")
    field = Field(*(np.zeros(FEATURES + 1) for _ in range(3)), -3.0, np.zeros((2, 2)), (0.0, 0.0, 0.0))
    weights = np.concatenate([np.zeros(3 * (FEATURES + 1) + 4), [field.bias]])
    squares = np.zeros_like(weights)
    for _ in range(ROUNDS):
        gradient = _summed(sequences, field)
        squares += gradient * gradient
        weights += RATE * gradient / (PRIOR + np.sqrt(squares))
        own, before, after = weights[:-5].reshape(3, -1)
        field = Field(own, before, after, float(weights[-1]), weights[-5:-1].reshape(2, 2), field.calibration)
    field.calibration = _calibrated(sample, field)
    return field


def _sequences(sample: DataFrame, cues: set[str]) -> DataFrame:
    """Whole tagged texts, many a row: features of the words, the tokens' words, tokens per text, the tokens' tags."""

    def packed(words: dict[str, int], rows: list[int], sizes: list[int], tags: list[int]) -> pa.RecordBatch:
        slots = _slots(words).ravel()
        columns = [pa.array([c], pa.list_(k)) for c, k in zip((slots, rows, sizes, tags), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["slots", "rows", "sizes", "tags"])

    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int8())

    def tagged(batches: Batches) -> Batches:
        is_cue = WordRows(lambda w: int(any(k in cues for k in keys(w))))
        words, rows, sizes, tags = {}, [], [], []
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = text.split()
                marks = [is_cue[w] for w in tokens] if toxic > 0 else [0] * len(tokens)
                if not tokens or (toxic > 0 and not any(marks)):
                    continue
                rows += [words.setdefault(w, len(words)) for w in tokens]
                sizes.append(len(tokens))
                tags += marks
                if len(rows) >= SEQUENCE_TOKENS:
                    yield packed(words, rows, sizes, tags)
                    words, rows, sizes, tags = {}, [], [], []
        if sizes:
            yield packed(words, rows, sizes, tags)

    schema = "slots array<int>, rows array<int>, sizes array<int>, tags array<tinyint>"
    return text_batches(sample.coalesce(TASKS), tagged, schema)


def _summed(sequences: DataFrame, field: Field) -> np.ndarray:
    """Gradient of the log-likelihood over all sequences: own, before, after, transitions, bias."""
    known = shared(sequences.sparkSession, field)

    def run(batches: Batches) -> Batches:
        field, total = known(), np.zeros(3 * (FEATURES + 1) + 5)
        for batch in batches:
            for i in range(batch.num_rows):
                total += _gradient(field, *(c[i].values.to_numpy(zero_copy_only=False) for c in batch.columns))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["at", "part"])

    got = text_batches(sequences.coalesce(TASKS), run, "at int, part double").toArrow()
    size = 3 * (FEATURES + 1) + 5
    return np.bincount(got.column("at").to_numpy(), got.column("part").to_numpy(), size)


def _gradient(field: Field, slots: np.ndarray, rows: np.ndarray, sizes: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Tags and pairs of tags as they are minus those expected, summed by feature."""
    slots = slots.reshape(-1, 5)
    table = np.stack([w[slots].sum(axis=1) for w in (field.own, field.before, field.after)], axis=1)
    odds, forward, backward = _messages(token_scores(rows, sizes, table, field.bias), sizes, field.moves)
    both = forward * backward
    error = tags - both / (1 + both)
    inner = np.ones(rows.size, bool)
    inner[np.cumsum(sizes) - 1] = False
    left = np.flatnonzero(inner)
    right = left + 1
    by_word = (
        np.bincount(rows, error, len(slots)),
        np.bincount(rows[left], error[right], len(slots)),
        np.bincount(rows[right], error[left], len(slots)),
    )
    by_slot = np.stack([np.bincount(slots.ravel(), np.repeat(g, 5), FEATURES + 1) for g in by_word])
    # the last slot only fills up rows
    by_slot[:, -1] = 0
    ahead = odds[right] * backward[right]
    pairs = np.exp(field.moves).ravel()[:, None] * np.stack([np.ones(left.size), ahead, forward[left], forward[left] * ahead])
    seen = np.bincount(2 * tags[left].astype(np.int64) + tags[right], minlength=4)
    return np.concatenate([by_slot.ravel(), seen - (pairs / pairs.sum(axis=0)).sum(axis=1), [error.sum()]])


def _calibrated(sample: DataFrame, field: Field) -> tuple[float, float, float]:
    """Logistic weights of the document features, fitted on the sample's whole texts."""
    known = shared(sample.sparkSession, field)

    def run(batches: Batches) -> Batches:
        field = known()
        words = Words(field)
        for batch in batches:
            rows, sizes, table = words.read(batch.column(0).to_pylist())
            p = marginals(token_scores(rows, sizes, table, field.bias), sizes, field.moves)
            x = document_features(p, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], ["most", "sum", "label"])

    got = text_batches(sample, run, "most double, sum double, label int").toArrow()
    x = np.stack([got.column(c).to_numpy().astype(float) for c in ("most", "sum")], axis=1)
    y = (got.column("label").to_numpy() > 0).astype(float)
    weights, bias = np.array([4.0, 1.0]), -3.0
    if not y.size:
        return bias, *weights.tolist()
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    for _ in range(3000):
        error = y - 1 / (1 + np.exp(-(x @ weights + bias)))
        weights = np.maximum(weights + 2.0 * (x.T @ error / y.size - 1e-4 * weights), 0)
        bias += 2.0 * error.mean()
    return float(bias), float(weights[0]), float(weights[1])


def score(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with a struct column ``toxicity``: score, spans (start, end in code points, of toxic words in a row).

    Null texts count as empty. All other columns stay; one called ``toxicity`` is replaced.
    """
    known = shared(docs.sparkSession, field)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def start():
        field = known()
        words, (bias, most, total) = Words(field), field.calibration

        def scored(column: pa.Array) -> pa.Array:
            texts = [t or "" for t in column.to_pylist()]
            rows, sizes, table = words.read(texts)
            p = marginals(token_scores(rows, sizes, table, field.bias), sizes, field.moves)
            x = document_features(p, sizes)
            scores = 1 / (1 + np.exp(-(bias + x @ np.array([most, total]))))
            starts = np.cumsum(sizes) - sizes
            found = [
                offsets(t, p[s : s + n] >= SPAN_CUT) if m >= SPAN_CUT else []
                for t, s, n, m in zip(texts, starts, sizes, x[:, 0], strict=True)
            ]
            return pa.StructArray.from_arrays([pa.array(scores), pa.array(found, spans)], ["score", "spans"])

        return scored

    kind = "struct<score:double,spans:array<struct<start:int,end:int>>>"
    return with_text_column(docs, "toxicity", kind, start)


def offsets(text: str, toxic: np.ndarray) -> list[dict]:
    """Code-point ranges of runs of toxic words."""
    out: list[dict] = []
    joined = False
    for match, hit in zip(_PIECE.finditer(text), toxic, strict=True):
        if hit and joined:
            out[-1]["end"] = match.end()
        elif hit:
            out.append({"start": match.start(), "end": match.end()})
        joined = bool(hit)
    return out
