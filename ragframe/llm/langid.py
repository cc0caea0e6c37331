"""Language identification as a mixture of languages.

A language is a distribution over character n-grams (1 to 3, with word borders), learned from all training documents.
A document is a mixture: each word comes from one language with the likelihood of its n-grams. Expectation-maximisation
estimates the proportions; languages are taken in order of proportion as long as each raises the log-likelihood by
more than ``PENALTY`` times the logarithm of the number of words. The prediction is the largest part of the chosen set.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import Batches, saved, shared, text_batches, with_text_column

# Hashed n-grams: the counts of a language are BUCKETS numbers, whatever the input.
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
LONGEST = 3
SMOOTHING = 0.5
ROUNDS = 12
PENALTY = 3.0
NO_LANGUAGE = "und"
WORD_CHARS = 40
# Words of a text that are looked up at once.
PIECE_WORDS = 10_000

# Letters in a row count as words of so many at most, so one word stays small.
_LETTERS = re.compile(rf"[^\W\d_]{{1,{WORD_CHARS}}}")

# Odd numbers of a multiplicative hash over code points.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def letter_runs(text: str) -> list[str]:
    """Letters in a row. The pattern takes numerals like ² or ½ along, which seldom occur; they part words here."""
    found = _LETTERS.findall(text)
    if not found or "".join(found).isalpha():
        return found
    return [w for run in found for w in ("".join(c if c.isalpha() else " " for c in run).split())]


def grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per n: buckets of the n-grams of all words, word after word, and how many each word has.

    A word is lower-cased and has a space at both ends, so it has at least one n-gram of each length.
    """
    spaced = [f" {w.lower()} " for w in words]
    sizes = np.fromiter(map(len, spaced), np.int64, len(spaced))
    points = np.frombuffer("".join(spaced).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(sizes.size), sizes)
    code = np.zeros(points.size, np.uint64)
    for n in range(1, LONGEST + 1):
        count = max(0, points.size - n + 1)
        code = code[:count] * _STEP + points[n - 1 :] + np.uint64(1)
        within = word[:count] == word[n - 1 :]
        mixed = (code ^ (code >> np.uint64(29))) * _MIX
        yield (mixed[within] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), sizes - n + 1


@dataclass
class Languages:
    names: list[str]
    logs: np.ndarray  # BUCKETS x languages


def learn(docs: DataFrame, rest: Column) -> Languages:
    """n-gram counts of all rows with a language and a text for which ``rest`` (over doc_id) is false.

    Rows that repeat an id count each; texts without a letter add nothing, but their language can still be chosen.
    """

    def count(batches: Batches) -> Batches:
        words: dict[str, Counter] = {}
        found: dict[str, np.ndarray] = {}

        def empty() -> None:
            for lang, counted in words.items():
                table = found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                times = np.fromiter(counted.values(), np.int64, len(counted))
                for buckets, sizes in grams(list(counted)):
                    table += np.bincount(buckets, np.repeat(times, sizes), BUCKETS).astype(np.int64)
            words.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(letter_runs(text.lower()))
            if sum(map(len, words.values())) > 200_000:
                empty()
        empty()
        for lang, table in found.items():
            place = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * place.size, pa.string()), pa.array(place, pa.int64()), pa.array(table[place])],
                ["lang", "bucket", "n"],
            )

    rows = docs.where(~rest & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = text_batches(rows, count, "lang string, bucket bigint, n bigint")
    counts = saved(counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "lang-counts")
    # languages x BUCKETS numbers at most
    found = counts.toArrow().combine_chunks()
    coded = pc.dictionary_encode(found.column("lang")).combine_chunks() if found.num_rows else None
    names = sorted(coded.dictionary.to_pylist()) if coded else []
    table = np.full((BUCKETS, max(1, len(names))), SMOOTHING)
    if coded:
        place = np.array([names.index(n) for n in coded.dictionary.to_pylist()])
        table[found.column("bucket").to_numpy(), place[coded.indices.to_numpy()]] += found.column("n").to_numpy()
    return Languages(names, np.log(table / table.sum(axis=0)))


class Reader:
    """word -> row of its log-likelihood per language, in a table that grows with the words seen."""

    def __init__(self, languages: Languages, limit: int = 300_000):
        self.languages, self.limit = languages, limit
        self.table = np.zeros((4096, len(languages.names)))
        self.rows: dict[str, int] = {}

    def _add(self, words: list[str]) -> None:
        first, last = len(self.rows), len(self.rows) + len(words)
        while last > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first:last] = sum(
            np.add.reduceat(self.languages.logs[buckets], np.cumsum(sizes) - sizes, axis=0)
            for buckets, sizes in grams(words)
        )
        self.rows.update(zip(words, range(first, last), strict=True))

    def likelihoods(self, text: str) -> np.ndarray:
        """words x languages; the words' n-grams counted per word."""
        words = letter_runs(text)
        out = []
        # in pieces, so that emptying the table cannot mix rows
        for start in range(0, len(words), PIECE_WORDS):
            piece = words[start : start + PIECE_WORDS]
            if len(self.rows) + len(piece) > self.limit:
                self.rows.clear()
            new = [w for w in dict.fromkeys(piece) if w not in self.rows]
            if new:
                self._add(new)
            rows = np.fromiter(map(self.rows.__getitem__, piece), np.int64, len(piece))
            out.append(self.table[rows])
        return np.concatenate(out) if out else np.zeros((0, len(self.languages.names)))


def proportions(logs: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation over the rows of a words x languages table: shares and log-likelihood."""
    top = logs.max(axis=1, keepdims=True)
    odds = np.exp(logs - top)
    shares = np.full(logs.shape[1], 1 / logs.shape[1])
    for _ in range(ROUNDS if logs.shape[1] > 1 else 0):
        # the mean over the words of each language's part in the word's likelihood
        shares = shares * ((1 / (odds @ shares)) @ odds) / len(odds)
    return shares, float(top.sum() + np.log(odds @ shares).sum())


def mixture(logs: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The chosen languages of a document, largest part first, and their shares."""
    shares, _ = proportions(logs)
    order = np.argsort(-shares, kind="stable")
    chosen, part, best = order[:1], np.ones(1), logs[:, order[0]].sum()
    for size in range(2, len(order) + 1):
        tried, likelihood = proportions(logs[:, order[:size]])
        if likelihood - best <= PENALTY * np.log(len(logs) + 1):
            break
        chosen, part, best = order[:size], tried, likelihood
    ranked = np.argsort(-part, kind="stable")
    return [int(chosen[i]) for i in ranked], part[ranked]


def identify(docs: DataFrame, languages: Languages) -> DataFrame:
    """``docs`` with a struct column ``language``: lang_pred, score, languages, shares.

    ``score`` is the share of the predicted language in the document. Null texts, texts without a letter and models
    without a language give ``und`` and 0. Other columns stay; one called ``language`` is replaced.
    """
    known = shared(docs.sparkSession, languages)
    kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]

    def one(text: str | None, reader: Reader) -> tuple:
        logs = reader.likelihoods(text or "")
        if not logs.size:
            return NO_LANGUAGE, 0.0, [], []
        chosen, part = mixture(logs)
        names = [reader.languages.names[i] for i in chosen]
        return names[0], float(min(1.0, part[0])), names, part.tolist()

    def start():
        reader = Reader(known())

        def identified(texts: pa.Array) -> pa.Array:
            found = [one(t, reader) for t in texts.to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "languages", "shares"])

        return identified

    kind = "struct<lang_pred:string,score:double,languages:array<string>,shares:array<double>>"
    return with_text_column(docs, "language", kind, start)
