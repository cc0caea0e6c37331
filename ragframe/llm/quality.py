"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word and every word shape ("Xx.", "x#") has a sparse random index vector. Its context vector is the sum of the
index vectors of its neighbours over the training documents, so words in like company get like vectors and unseen words
still have a shape. A document is the mean of its words' and shapes' vectors and a few shares (repeated words and
lines). The network's logits are divided by a temperature fitted on training rows that the weights have not seen.

The model is fitted on at most ``SAMPLE_ROWS`` labelled documents; scoring reads every whole text once, without a
shuffle. Scores depend on the text only.
"""

from __future__ import annotations


from collections import Counter
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import Batches, WordRows, labelled_sample, saved, shared, text_batches, with_text_column

# Bound of the labelled sample that the model is fitted on.
SAMPLE_ROWS = 8_000

# Most frequent words and shapes of the sample that get a context vector, and their least count.
WORDS, SHAPES, LEAST = 16_000, 400, 3

WIDTH, SPIKES, HIDDEN, EPOCHS = 48, 6, 24, 120

# Tasks that gather context vectors; each hands one table of (WORDS + SHAPES) x WIDTH numbers to the driver.
GATHERERS = 6

SEED = 7


def shape(word: str) -> str:
    """Kinds of a word's characters in order, runs as one, at most eight; punctuation stands for itself."""
    kinds = ("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return "".join(k for k, _ in groupby(kinds))[:8]


@dataclass
class Inventory:
    """Rows of the vector table: 0 is any other word, then the words; the shapes follow in the same way."""

    words: dict[str, int]
    shapes: dict[str, int]

    @property
    def size(self) -> int:
        return len(self.words) + len(self.shapes) + 2

    @property
    def first_shape(self) -> int:
        return len(self.words) + 1

    def reader(self) -> WordRows:
        """word -> both rows packed into one number."""
        other = self.first_shape

        def make(word: str) -> int:
            return self.words.get(word.lower(), 0) << 32 | self.shapes.get(shape(word), other)

        return WordRows(make)


def _rows(text: str, reader: WordRows) -> tuple[np.ndarray, np.ndarray]:
    both = np.fromiter(map(reader.__getitem__, text.split()), np.int64)
    return both >> 32, both & 0xFFFFFFFF


def index_vectors(size: int) -> np.ndarray:
    """Sparse ternary index vectors: SPIKES entries of +1 or -1 per row."""
    random = np.random.default_rng(SEED)
    out = np.zeros((size, WIDTH), np.float32)
    places = random.random((size, WIDTH)).argsort(axis=1)[:, :SPIKES]
    np.put_along_axis(out, places, random.choice([-1, 1], (size, SPIKES)).astype(np.float32), axis=1)
    return out


@dataclass
class Model:
    inventory: Inventory
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    weights: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def score(self, features: np.ndarray) -> np.ndarray:
        inputs, bias, outputs, shift = self.weights
        hidden = np.tanh((features - self.mean) / self.spread @ inputs + bias)
        return 1 / (1 + np.exp(-np.clip((hidden @ outputs + shift) / self.temperature, -30, 30)))


def features(text: str, reader: WordRows, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector, mean shape vector, and shares of a document; zeros for an empty one."""
    words, shapes = _rows(text, reader)
    if not words.size:
        return np.zeros(2 * WIDTH + 5, np.float32)
    lines = [line for line in text.split("\n") if line]
    pieces = text.split()
    shares = (
        np.log1p(words.size) / 10,
        len(set(pieces)) / len(pieces),
        len(set(lines)) / max(1, len(lines)),
        np.mean(words == 0),
        len(text) / (10 * words.size),
    )
    return np.concatenate([vectors[words].mean(axis=0), vectors[shapes].mean(axis=0), np.array(shares, np.float32)])


def fit(docs: DataFrame, labels: DataFrame, label: str, rest: Column, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows of ``docs`` for which ``rest`` (over doc_id) is false.

    Null texts are left out, empty ones count as a document without features. Rows that repeat an id count each, with
    the id's label. Without a labelled row every score is 0.5.
    """
    sample = saved(labelled_sample(docs, labels, label, rest, rows).repartition(GATHERERS), "quality-sample")
    inventory = _inventory(sample)
    vectors = _context_vectors(sample, inventory)
    x, y = _training_rows(sample, inventory, vectors)
    return _network(x, y, inventory, vectors)


def _inventory(sample: DataFrame) -> Inventory:
    def count(batches: Batches) -> Batches:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word, n in Counter(text.split()).items():
                    found["w" + word.lower()] += n
                    found["s" + shape(word)] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(found.values(), pa.int64())], ["item", "n"])

    counts = text_batches(sample.select("text"), count, "item string, n bigint")
    counts = counts.groupBy("item").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)

    def top(kind: str, most: int) -> list[str]:
        of_kind = counts.where(F.col("item").startswith(kind)).orderBy(F.desc("n"), "item").limit(most)
        return [r["item"][1:] for r in of_kind.collect()]

    words, shapes = top("w", WORDS), top("s", SHAPES)
    return Inventory(
        {w: i + 1 for i, w in enumerate(words)}, {s: len(words) + 2 + i for i, s in enumerate(shapes)}
    )


def _context_vectors(sample: DataFrame, inventory: Inventory) -> np.ndarray:
    def gather(batches: Batches) -> Batches:
        index, reader = index_vectors(inventory.size), inventory.reader()
        # the neighbour before counts with its entries shifted by one
        ahead = np.roll(index, 1, axis=1)
        total = np.zeros_like(index)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for row in _rows(text, reader):
                    np.add.at(total, row[1:], ahead[row[:-1]])
                    np.add.at(total, row[:-1], index[row[1:]])
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.int32).tobytes()], pa.binary())], ["total"])

    parts = text_batches(sample.select("text"), gather, "total binary").collect()
    total = sum((np.frombuffer(p["total"], np.int32).astype(np.int64) for p in parts), np.zeros(inventory.size * WIDTH, np.int64))
    total = total.reshape(-1, WIDTH).astype(np.float32)
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1)


def _training_rows(sample: DataFrame, inventory: Inventory, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known = sample.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Batches) -> Batches:
        reader = inventory.reader()
        for batch in batches:
            rows = [features(t, reader, known.value).astype(np.float32).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["x", "label"])

    found = text_batches(sample.select("text", "label"), run, "x binary, label int").toArrow()
    x = np.array([np.frombuffer(r, np.float32) for r in found.column("x").to_pylist()], np.float64)
    y = found.column("label").to_numpy().astype(np.float64)
    if not y.size:
        return np.zeros((0, 2 * WIDTH + 5)), y
    # the same order in every run
    order = np.lexsort((*x.T[:3], y))
    return x[order], (y[order] > 0).astype(np.float64)


def _network(x: np.ndarray, y: np.ndarray, inventory: Inventory, vectors: np.ndarray) -> Model:
    """Adam on the cross-entropy; the temperature is the one that suits a fifth of the rows best."""
    random = np.random.default_rng(SEED)
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-3) if y.size else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    weights = [random.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)]
    kept = random.random(y.size) < 0.8
    inputs, target = ((x - mean) / spread)[kept], y[kept]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(target.size)
        for start in range(0, target.size, 256):
            rows = order[start : start + 256]
            a = inputs[rows]
            hidden = np.tanh(a @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -30, 30))) - target[rows]) / rows.size
            back = error[:, None] * weights[2] * (1 - hidden**2)
            slopes = [a.T @ back + 1e-4 * weights[0], back.sum(axis=0), hidden.T @ error + 1e-4 * weights[2], error.sum(keepdims=True)]
            step += 1
            for i, slope in enumerate(slopes):
                first[i] += 0.1 * (slope - first[i])
                second[i] += 0.001 * (slope**2 - second[i])
                fall = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                weights[i] = weights[i] - 0.003 * fall
    model = Model(inventory, vectors, mean, spread, (*weights[:3], float(weights[3][0])), 1.0)
    rest, truth = x[~kept], y[~kept]
    if truth.size:

        def loss(temperature: float) -> float:
            model.temperature = temperature
            p = np.clip(model.score(rest), 1e-9, 1 - 1e-9)
            return -float(np.mean(truth * np.log(p) + (1 - truth) * np.log(1 - p)))

        model.temperature = min(np.geomspace(0.5, 5, 41), key=loss)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``score`` (replaced if there): probability of label 1. Null texts count as empty."""
    known = shared(docs.sparkSession, model)

    def start():
        model = known()
        reader = model.inventory.reader()

        def scored(texts: pa.Array) -> pa.Array:
            x = [features(t or "", reader, model.vectors) for t in texts.to_pylist()]
            return pa.array(model.score(np.array(x, np.float64)) if x else [], pa.float64())

        return scored

    return with_text_column(docs, "score", "double", start)
