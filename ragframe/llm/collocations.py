"""Phrase collocations from a weighted de Bruijn graph of words, per language.

Only the longest grams are counted. They are the edges of a graph whose nodes are the pairs of words that two edges
overlap in: an edge (w1, w2, w3) goes from (w1, w2) to (w2, w3), its weight is how often it occurs. Shorter counts
follow: a node occurs as often as its outgoing edges together, plus the times it stands at the end of a piece, where no
edge leaves it; in the same way a word by the pairs that it begins, plus the times it ends a piece.

A word or pair that occurs less than ``LEAST`` times is in no candidate, so beyond it an edge needs no words: all that
goes on from there is one edge with an open end, whose weight still counts in the flow. Which words and pairs may be
frequent is found before by counts of their hashes; a clash of hashes only keeps words that were not needed.

Unary paths (runs of edges whose inner nodes have one edge in and one out) become one row each, with the counts of all
their nodes and words, so long repeated passages are a row, and phrases are scored along the paths without further joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.llm.common import Batches, may_hold, membership, raw_text, saved, text_batches
from ragframe.settings import BROADCAST_ROWS

LEAST = 10
NO_LANGUAGE = "und"

# Bytes of text that are cut into words at once, to the next end of a piece.
SLICE_BYTES = 1 << 20
# Distinct words and grams that a scan task holds before it hands them on.
WORDS_HELD, GRAMS_HELD = 500_000, 2_000_000
# Words are numbered within a task by so many bits, so three fit in a number.
WORD_BITS = 20
# Edges in a row of a path; a longer path goes on in the next row.
PATH_EDGES = 1_000
# Bits of the filter of frequent words and pairs: a multiple of their number, 2**28 (32 MB) at most.
FILTER_MOST_BITS = 28
# Parts of a language that are ranked on their own before the whole.
RANKED_APART = 16

_END = b"\xff"
# Ends of pieces become a byte that no UTF-8 text has; blanks and tabs part words.
_CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _END * 10 + b" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD6E8FEB86659FD93)


def _slices(texts: list[bytes]) -> Iterator[tuple[list[bytes], bool]]:
    """Words of some texts with _END between pieces, in parts of about SLICE_BYTES; is a part cut within a piece?"""
    text = _END.join(texts).lower().translate(_CUT)
    start = 0
    while start < len(text):
        end, within = len(text), False
        if end - start > SLICE_BYTES:
            end = text.find(_END, start + SLICE_BYTES, start + 2 * SLICE_BYTES)
            if end < 0:
                end = text.find(b" ", start + SLICE_BYTES)
                within = end >= 0
                end = end if within else len(text)
        yield text[start:end].replace(_END, b" \xff ").split(), within
        start = end


class _Words:
    """Words of a task: a number for each (0 ends a piece), and its hash."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {_END: 0}
        self.hashes = np.zeros(1 << 16, np.uint64)

    def __len__(self) -> int:
        return len(self.numbers)

    def row(self, tokens: list[bytes]) -> np.ndarray:
        numbers = self.numbers
        for word in set(tokens).difference(numbers):
            at = numbers[word] = len(numbers)
            if at >= self.hashes.size:
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[at] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))

    def alone(self, row: np.ndarray, lang: int) -> np.ndarray:
        """Hashes of the words in the language that ``lang`` stands for."""
        return self._mixed(row, np.uint64(0), lang)

    def pairs(self, row: np.ndarray, lang: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each word with the one after it: is it a pair, and its hash."""
        return (row[:-1] > 0) & (row[1:] > 0), self._mixed(row[:-1], self.hashes[row[1:]], lang)

    def _mixed(self, row: np.ndarray, second: np.ndarray, lang: int) -> np.ndarray:
        first = self.hashes[row]
        mixed = ((first ^ np.uint64(lang)) * _MIX) ^ (first >> np.uint64(31))
        mixed = (mixed + second) * _TURN
        return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)

    def texts(self) -> pa.Array:
        """The words by number; none for 0."""
        return pa.array([b"", *list(self.numbers)[1:]], pa.binary())


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words of some of its texts), each followed by the two words after it or by two ends of a piece."""
    texts: dict[str, list[bytes]] = {}
    for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        texts.setdefault(lang, []).append(raw)
    for lang, raws in texts.items():
        carried: list[bytes] = []
        for tokens, within in _slices(raws):
            tokens = carried + tokens
            carried = tokens[-2:] if within else []
            yield lang, tokens if within else [*tokens, _END, _END]


class _Sums:
    """Counts of numbers, kept as sorted arrays."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, values: np.ndarray) -> None:
        self.parts.append(np.unique(values, return_counts=True))
        self.size += self.parts[-1][0].size
        if len(self.parts) > 64 or self.size > 2 * GRAMS_HELD:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) != 1:
            values = np.concatenate([p[0] for p in self.parts] or [np.zeros(0, np.int64)])
            counts = np.concatenate([p[1] for p in self.parts] or [np.zeros(0, np.int64)])
            distinct, place = np.unique(values, return_inverse=True)
            self.parts = [(distinct, np.bincount(place, counts, distinct.size).astype(np.int64))]
            self.size = distinct.size
        return self.parts[0]


def _frequent(texts: DataFrame, least: int) -> np.ndarray:
    """A filter that holds the hashes of all words and pairs with ``least`` occurrences in a language."""

    def count(batches: Batches) -> Batches:
        words, sums = _Words(), _Sums()
        for batch in batches:
            for lang, tokens in _parts(batch):
                row, code = words.row(tokens)[:-1], xxhash.xxh64_intdigest(lang)
                paired, hashes = words.pairs(row, code)
                sums.add(hashes[paired])
                sums.add(words.alone(row[:-1], code)[row[:-1] > 0])
                if sums.size > GRAMS_HELD or len(words) > WORDS_HELD:
                    yield _batch(sums)
                    words, sums = _Words(), _Sums()
        yield _batch(sums)

    def _batch(sums: _Sums) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in sums.merged()], ["hash", "n"])

    found = text_batches(texts, count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    found = saved(found.where(F.col("n") >= least).select("hash"), "phrase-frequent")
    bits = max(20, min(FILTER_MOST_BITS, (64 * found.count()).bit_length()))
    return membership(found, bits, hashed=True)


def grams(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The weighted edges: (lang, w1, w2, w3, n), one occurrence of a row per word of the texts.

    ``w3`` is null where the piece ends or the second pair is rare, ``w2`` too where the first pair is, and all are
    where the first word is rare.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), raw_text().alias("raw"))
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(texts, least))

    def count(batches: Batches) -> Batches:
        filter_bits = shared.value
        words, sums = _Words(), {}
        for batch in batches:
            for lang, tokens in _parts(batch):
                row, code = words.row(tokens), xxhash.xxh64_intdigest(lang)
                paired, hashes = words.pairs(row, code)
                often = paired & may_hold(filter_bits, hashes)
                first = row[:-2]
                known = may_hold(filter_bits, words.alone(first, code))
                second = np.where(often[:-1], row[1:-1], 0)
                third = np.where(often[:-1] & often[1:], row[2:], 0)
                packed = (first << (2 * WORD_BITS)) | (second << WORD_BITS) | third
                sums.setdefault(lang, _Sums()).add(np.where(known, packed, 0)[first > 0])
                if len(words) > WORDS_HELD or sum(s.size for s in sums.values()) > GRAMS_HELD:
                    yield from _batches(words, sums)
                    words, sums = _Words(), {}
        yield from _batches(words, sums)

    def _batches(words: _Words, sums: dict[str, _Sums]) -> Batches:
        texts, mask = words.texts(), (1 << WORD_BITS) - 1
        for lang, counted in sums.items():
            values, counts = counted.merged()
            for start in range(0, values.size, 50_000):
                part = values[start : start + 50_000]
                places = [(part >> shift) & mask for shift in (2 * WORD_BITS, WORD_BITS, 0)]
                first, *others = [texts.take(pa.array(p, mask=(p == 0) & (i > 0))) for i, p in enumerate(places)]
                gram = pc.binary_join_element_wise(first, *others, b" ", null_handling="skip")
                langs = pa.array([lang] * part.size, pa.string())
                yield pa.RecordBatch.from_arrays([langs, gram, pa.array(counts[start : start + part.size])], names)

    names = ["lang", "gram", "n"]
    counted = text_batches(texts, count, "lang string, gram binary, n bigint")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    parts = F.split(F.when(F.length("gram") > 0, F.col("gram").cast("string")), " ")
    columns = [F.get("parts", F.lit(i)).alias(f"w{i + 1}") for i in range(3)]
    summed = saved(counted.select("lang", parts.alias("parts"), "n").select("lang", *columns, "n"), "phrase-grams")
    shared.unpersist()
    return summed


def _counted_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _flows(edges: DataFrame, least: int) -> DataFrame:
    """Nodes with ``least`` occurrences: (lang, w1, w2, flow, f1, f2) with the counts of both words."""
    words = edges.where("w1 is not null").groupBy("lang", "w1").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = saved(words, "phrase-words")
    nodes = edges.where("w2 is not null").groupBy("lang", "w1", "w2").agg(F.sum("n").alias("flow"))
    nodes = nodes.where(F.col("flow") >= least)
    words = _counted_small(words)
    first = words.select("lang", "w1", F.col("f").alias("f1"))
    second = words.select("lang", F.col("w1").alias("w2"), F.col("f").alias("f2"))
    return saved(nodes.join(first, ["lang", "w1"]).join(second, ["lang", "w2"]), "phrase-nodes")


def paths(edges: DataFrame, nodes: DataFrame, least: int = LEAST) -> DataFrame:
    """The frequent part of the graph, its unary paths compacted.

    One row per path of at most PATH_EDGES edges: lang, words, weights (of its edges), flows (of its nodes: one more),
    counts (of its words: two more).
    """
    start = nodes.select("lang", "w1", "w2", F.col("flow").alias("flow_u"), F.col("f1").alias("c1"), F.col("f2").alias("c2"))
    end = nodes.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("flow").alias("flow_v"), F.col("f2").alias("c3"))
    often = edges.where((F.col("n") >= least) & F.col("w3").isNotNull())
    often = often.join(start, ["lang", "w1", "w2"]).join(end, ["lang", "w2", "w3"])
    often = saved(often.withColumn("edge", F.monotonically_increasing_id()), "phrase-edges")

    into = often.groupBy("lang", F.col("w2").alias("x"), F.col("w3").alias("y"))
    into = into.agg(F.count(F.lit(1)).alias("ways_in"), F.max("edge").alias("before"))
    out = often.groupBy("lang", F.col("w1").alias("x"), F.col("w2").alias("y"))
    out = out.agg(F.count(F.lit(1)).alias("ways_out"), F.max("edge").alias("edge"))
    inner = into.where("ways_in = 1").join(out.where("ways_out = 1"), ["lang", "x", "y"])
    placed = _heads(inner.where("edge <> before").select("edge", F.col("before").alias("head"), F.lit(1).cast("bigint").alias("place")))

    rows = often.join(placed, "edge", "left").withColumns(
        {"head": F.coalesce("head", "edge"), "place": F.coalesce("place", F.lit(0).cast("bigint"))}
    )
    step = F.struct("place", "w1", "w2", "w3", "n", "flow_u", "flow_v", "c1", "c2", "c3")
    rows = rows.groupBy("lang", "head", F.floor(F.col("place") / PATH_EDGES).alias("part"))
    rows = rows.agg(F.array_sort(F.collect_list(step)).alias("steps"))
    begin = F.get("steps", F.lit(0))
    whole = rows.select(
        "lang",
        F.concat(F.array(begin["w1"], begin["w2"]), F.col("steps.w3")).alias("words"),
        F.col("steps.n").alias("weights"),
        F.concat(F.array(begin["flow_u"]), F.col("steps.flow_v")).alias("flows"),
        F.concat(F.array(begin["c1"], begin["c2"]), F.col("steps.c3")).alias("counts"),
    )
    return saved(whole, "phrase-paths")


def _heads(before: DataFrame) -> DataFrame:
    """(edge, head, place): the first edge of each edge's path and the steps from there, by doubling.

    ``before`` has the edge in front of each edge that has one. Edges on a ring have no first edge; they are left out,
    and so are paths of their own.
    """
    state, open_rows = saved(before, "phrase-heads"), None
    while True:
        ahead = state.select(F.col("edge").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        moved = state.join(ahead, "head", "left").select(
            "edge",
            F.coalesce("further", "head").alias("head"),
            (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"),
            F.col("further").isNotNull().alias("open"),
        )
        moved = saved(moved, "phrase-heads")
        state, was, open_rows = moved.select("edge", "head", "place"), open_rows, moved.where("open").count()
        # every round ends some path as long as one is left, so the others are rings
        if not open_rows or open_rows == was:
            return moved.where("not open").select("edge", "head", "place")


def _cut(a: str, left: str, right: str, k: int) -> Column:
    """Score and parts of one cut, lowest score first, then the smallest cut. Exact in numbers of 38 digits."""
    a_, left_, right_ = (f"cast({c} as decimal(38,0))" for c in (a, left, right))
    score = F.expr(f"(cast(1000000 as decimal(38,0)) * {a_} * {a_}) div ({left_} * {right_})")
    return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))


def collocations(docs: DataFrame, least: int = LEAST, share: int = 50, most: int | None = 2000) -> DataFrame:
    """Phrases of two and three words of ``docs`` (lang, text), per language: lang, rank, phrase, a, l, r, n, score.

    A-Z in lower case; pieces end at ``.,;:!?`` and line ends, words at blanks and tabs. ``a`` is how often the phrase
    occurs, at least ``least`` times; l and r are the counts of its parts at the cut that scores lowest, score is
    floor(1000000 * a * a / (l * r)), n all words of the language. A phrase goes if a longer one that holds it occurs
    ``share`` per cent as often. Ranked by score, a and the phrase; ``most`` are returned per language (None: all).
    Null languages count as ``und``, null and empty texts have no words, repeated rows count each. Other columns are
    ignored.
    """
    edges = grams(docs, least)
    totals = edges.groupBy("lang").agg(F.sum("n").alias("n"))
    nodes = _flows(edges, least)
    chains = paths(edges, nodes, least)
    three = chains.select("lang", F.posexplode("weights").alias("i", "a"), "words", "flows", "counts").select(
        "lang",
        F.slice("words", F.col("i") + 1, 3).alias("words"),
        "a",
        F.expr("counts[i]").alias("c1"),
        F.expr("flows[i + 1]").alias("last"),
        F.expr("flows[i]").alias("first"),
        F.expr("counts[i + 2]").alias("c3"),
    )
    three = saved(
        three.withColumn("cut", F.least(_cut("a", "c1", "last", 1), _cut("a", "first", "c3", 2))).select("lang", "words", "a", "cut"),
        "phrase-three",
    )
    # of each pair, the most frequent phrase that holds it
    held = three.select("lang", "a", F.explode(F.array(F.slice("words", 1, 2), F.slice("words", 2, 2))).alias("words"))
    held = held.groupBy("lang", "words").agg(F.max("a").alias("longer"))
    two = nodes.select("lang", F.array("w1", "w2").alias("words"), F.col("flow").alias("a"), _cut("flow", "f1", "f2", 1).alias("cut"))
    two = two.join(held, ["lang", "words"], "left").where(f"longer is null or 100 * longer < {share} * a").drop("longer")
    found = two.unionByName(three).select(
        "lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", F.col("cut.score").cast("bigint").alias("score")
    )
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    if most is not None:
        # the best of each part are few, however many phrases a language has
        found = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART)))
        apart = Window.partitionBy("lang", "part").orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(apart)).where(F.col("rank") <= most).drop("rank", "part")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    return ranked.join(_counted_small(totals), "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


ORACLE = r"""
with recursive pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) as piece
    from documents),
words as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces),
places as (select lang, w, unnest(generate_series(1, len(w))) as i from words),
one as (select lang, w[i] as w1, count(*) as f from places group by all),
two as (select lang, w[i] as w1, w[i + 1] as w2, count(*) as f from places where i < len(w) group by all having count(*) >= 10),
three as (select lang, w[i] as w1, w[i + 1] as w2, w[i + 2] as w3, count(*) as f
    from places where i + 1 < len(w) group by all having count(*) >= 10),
totals as (select lang, sum(f)::bigint as n from one group by lang),
scored as (
    select t.lang, t.w1, t.w2, t.w1 || ' ' || t.w2 as phrase, t.f as a, x.f as l, y.f as r, false as three,
        1000000::hugeint * t.f * t.f // (x.f::hugeint * y.f) as score, 1 as k
    from two t join one x on t.lang = x.lang and t.w1 = x.w1 join one y on t.lang = y.lang and t.w2 = y.w1
    union all
    select t.lang, t.w1, t.w2, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, true,
        1000000::hugeint * t.f * t.f // (x.f::hugeint * y.f), 1
    from three t join one x on t.lang = x.lang and t.w1 = x.w1 join two y on t.lang = y.lang and t.w2 = y.w1 and t.w3 = y.w2
    union all
    select t.lang, t.w1, t.w2, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, true,
        1000000::hugeint * t.f * t.f // (x.f::hugeint * y.f), 2
    from three t join two x on t.lang = x.lang and t.w1 = x.w1 and t.w2 = x.w2 join one y on t.lang = y.lang and t.w3 = y.w1),
cuts as (select *, row_number() over (partition by lang, phrase order by score, k) as choice from scored),
longer as (
    select lang, w1, w2, max(f) as f from (
        select lang, w1, w2, f from three union all select lang, w2, w3, f from three) group by all),
kept as (
    select c.* from cuts c left join longer g on not c.three and c.lang = g.lang and c.w1 = g.w1 and c.w2 = g.w2
    where c.choice = 1 and (g.f is null or 100 * g.f < 50 * c.a)),
ranked as (
    select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, score
    from kept)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join totals using (lang) where rank <= 2000
"""
