"""Near-duplicate groups by MinHash with tensored banding.

A document's sketch is ``collections`` small hash collections of ``rows`` minhashes each. A table key is a pair of
collections, so 16 collections of 3 give 120 tables of 6 minhashes from 48 minhashes instead of 720. Two sets with
similarity 0.8 share no key with probability 2e-4, with 0.85 4e-6.

Equal sets are one class. A class meets others through table keys that at least two classes share, and links are
confirmed on the full sets. Every member of a bucket is compared with its smallest class first; a group of like sets
then is one component, with as many comparisons as members. Members of buckets that still hold several components are
compared further, but only where the sets can be similar enough: with shingles ordered from rare to common, similar
sets share one so early in both that enough shingles follow it. Thus many sets with one common passage do not meet, no
bucket is capped and no pair within a component is written out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragframe.llm.common import (
    Batches,
    WordRows,
    may_hold,
    member,
    membership,
    raw_text,
    saved,
    text_batches,
)

COLLECTIONS = 16
ROWS = 3
PERCENT = 80

# Odd multipliers and offsets of the hash functions, from a fixed seed.
_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(1, 1 << 63, COLLECTIONS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RANDOM.integers(1, 1 << 63, ROWS + 2, np.uint64) * np.uint64(2) + np.uint64(1)

# Shingles that are hashed at once.
SLICE = 4096

def shingles(raw: bytes, hashes: WordRows, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words are one shingle, none an empty set."""
    row = np.fromiter(map(hashes.__getitem__, raw.lower().split()), np.uint64)
    if not row.size:
        return row
    width = min(words, row.size)
    count = row.size - width + 1
    mixed = np.full(count, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ row[i : i + count]) * _MIX[0]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def word_hashes() -> WordRows:
    return WordRows(xxhash.xxh64_intdigest)


def sketch(shingle_set: np.ndarray) -> np.ndarray:
    """One number per collection, mixed from its minhashes."""
    least = np.full(_FACTORS.size, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, shingle_set.size, SLICE):
        block = shingle_set[start : start + SLICE, None] * _FACTORS
        np.minimum(least, (block ^ (block >> np.uint64(32))).min(axis=0), out=least)
    out = np.zeros(COLLECTIONS, np.uint64)
    for i, part in enumerate(least.reshape(COLLECTIONS, ROWS).T):
        out = (out ^ part) * _MIX[i + 1]
        out ^= out >> np.uint64(31)
    return out


def near_groups(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Links have 100 * intersection >= percent * union of their shingle sets. Null texts and texts without words have
    the empty set and link with nothing; their component is their own id. Rows with one doc_id count as one document.
    Rows with a null id link with nothing but equal sets, and get those sets' component. Other columns are ignored.
    """
    sketched = saved(_sketched(docs, words), "near-sketch")
    known = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("cls"), F.first("sub").alias("sub"))
    classes = saved(classes, "near-classes")
    roots = _components_of_classes(docs, classes, words, percent)
    named = classes.select("digest", "cls").join(roots, "cls", "left")
    # ids that several classes share belong together as well
    named = named.select("digest", F.coalesce("root", "cls").alias("component_id"))
    grouped = sketched.where("n_shingles > 0").select("doc_id", "n_shingles", "digest")
    grouped = grouped.join(named, "digest", "left").select("doc_id", "n_shingles", "component_id")
    alone = sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone)


def drop_near(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest id; all columns stay.

    Rows without an id stay unless their set equals that of a row with one.
    """
    groups = near_groups(docs.select("doc_id", "text"), words, percent)
    gone = groups.where("component_id is not null and doc_id <> component_id").select("doc_id").distinct()
    gone = saved(gone, "near-gone")
    suspect = member(membership(gone))(F.xxhash64("doc_id"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("near_id"), suspect.alias("suspect"))
    # ids outside the filter stay for certain; only the others move
    clear = rows.where("not suspect").select("row.*")
    kept = rows.where("suspect").join(gone, F.col("near_id") == gone["doc_id"], "left_anti")
    return clear.unionByName(kept.select("row.*"))


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Batches) -> Batches:
        hashes = word_hashes()
        for batch in batches:
            sizes, digests, subs = [], [], []
            for raw in batch.column(1).to_pylist():
                found = shingles(raw, hashes, words)
                sizes.append(found.size)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                subs.append(sketch(found).view(np.int64) if found.size else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(subs, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "sub"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_shingles bigint, digest binary, sub array<bigint>"
    return text_batches(docs.select("doc_id", raw_text().alias("raw")), run, schema)


def _components_of_classes(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(cls, root) for classes that are linked with a smaller one."""
    members = _members(classes)

    sets = saved(_sets(docs, members.select("cls").distinct(), words), "near-sets")
    pairs = members.where("cls <> leader").select(F.col("leader").alias("a"), F.col("cls").alias("b")).distinct()
    stars = components(_linked(saved(pairs, "near-pairs"), sets, percent))
    unsettled = _open_classes(members, stars)
    if unsettled.isEmpty():
        return stars
    pairs = _meeting(saved(_prefixes(unsettled, sets, percent), "near-prefixes"), percent)
    links = _linked(saved(pairs, "near-pairs"), sets, percent)
    if links.isEmpty():
        return stars
    return components(links.unionByName(stars.select(F.col("root").alias("a"), F.col("cls").alias("b"))))


def _members(classes: DataFrame) -> DataFrame:
    """(table_key, cls, leader): the classes of each table key that at least two share, and the smallest of them.

    Two classes share a key only if they share both of its collections, so collections that no other class has are left
    out before the keys are made; most classes then have none.
    """
    numbered = F.transform("sub", lambda value, i: F.struct(i.alias("i"), F.xxhash64(i, value).alias("value")))
    single = classes.select("cls", F.inline(numbered))
    common = single.groupBy("value").agg(F.min("cls").alias("least"), F.max("cls").alias("most"))
    common = common.where("least < most").select("value")
    # at most COLLECTIONS values a class
    left = single.join(common, "value", "left_semi").groupBy("cls")
    left = left.agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("sub"))
    left = saved(left.where("size(sub) > 1"), "near-collections")
    pair = """transform(sequence(1, size(sub) - 1), j -> transform(sequence(0, j - 1),
        i -> xxhash64(sub[i].value, sub[j].value)))"""
    keys = left.select("cls", F.explode(F.flatten(F.expr(pair))).alias("table_key"))
    met = keys.groupBy("table_key").agg(F.min("cls").alias("leader"), F.max("cls").alias("most"))
    met = saved(met.where("leader < most").select("table_key", "leader"), "near-buckets")
    return saved(keys.join(met, "table_key"), "near-members")


def _open_classes(members: DataFrame, stars: DataFrame) -> DataFrame:
    """(cls, root) of the classes in buckets that hold several components."""
    rooted = members.select("table_key", "cls").join(stars, "cls", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "cls"))
    open_keys = rooted.groupBy("table_key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    open_keys = open_keys.where("low <> high").select("table_key")
    rooted = rooted.join(open_keys, "table_key", "left_semi").select("cls", "root").distinct()
    return saved(rooted, "near-open")


def _prefixes(unsettled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(cls, root, n, shingle, place): the shingles of each set by which it can meet similar ones, rare ones first.

    Sets of n and m >= n shingles that are similar share at least need = ceil(p * (n + m) / (1 + p)), so the first that
    they share stands at most at n - need + 1 in one and at m - need + 1 in the other. As n >= p * m, the latter is at
    most m - ceil(m * p) + 1, and n has no later place than that.
    """
    tokens = unsettled.join(sets, F.col("cls") == sets["doc_id"])
    # an id may have several sets, and repeated rows have one set several times
    tokens = tokens.select("cls", "root", "own", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    spread = tokens.groupBy("shingle").agg(F.count("*").alias("sets"))
    order = Window.partitionBy("cls", "own").orderBy("sets", "shingle")
    ranked = tokens.join(spread, "shingle").withColumn("place", F.dense_rank().over(order))
    least = F.expr(f"n - (n * {percent} + 99) div 100 + 1")
    ranked = ranked.where((F.col("place") <= least) & (F.col("sets") > 1))
    return ranked.select("cls", "root", "n", "shingle", "place")


def _meeting(tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a shingle with enough shingles from there on in both sets.

    The first shingle that two similar sets share always has them, as all they share stands from there on; a later
    match seldom does, so a pair appears about once.
    """
    small, large = tokens.alias("s"), tokens.alias("l")
    need = F.expr(f"((s.n + l.n) * {percent} + {99 + percent}) div {100 + percent}")
    meet = [
        F.col("s.shingle") == F.col("l.shingle"),
        F.col("s.root") != F.col("l.root"),
        (F.col("s.n") < F.col("l.n")) | ((F.col("s.n") == F.col("l.n")) & (F.col("s.cls") < F.col("l.cls"))),
        F.col("s.n") - F.col("s.place") + 1 >= need,
        F.col("l.n") - F.col("l.place") + 1 >= need,
    ]
    pairs = small.join(large, meet)
    return pairs.select(F.least("s.cls", "l.cls").alias("a"), F.greatest("s.cls", "l.cls").alias("b")).distinct()


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """The full shingle sets of ``ids`` (and of a few others that a filter of bounded size lets through), each with its hash."""
    bits = membership(ids)

    def run(batches: Batches) -> Batches:
        hashes = word_hashes()
        for batch in batches:
            wanted = may_hold(bits, batch.column(1).to_numpy())
            batch = batch.filter(pa.array(wanted))
            found = [shingles(raw, hashes, words).view(np.int64) for raw in batch.column(2).to_pylist()]
            own = pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 for s in found], pa.int64())
            found = pa.array(found, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), own, found], ["doc_id", "own", "shingles"])

    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h"), raw_text().alias("raw"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return text_batches(rows, run, f"doc_id {id_type}, own bigint, shingles array<bigint>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough by their full sets."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            linked = []
            for x, y in zip(_arrays(batch.column("x")), _arrays(batch.column("y")), strict=True):
                common = np.intersect1d(x, y, assume_unique=True).size
                linked.append(100 * common >= percent * (x.size + y.size - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    id_type = pairs.schema["a"].dataType.simpleString()
    first = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y")
    return saved(text_batches(both, run, f"a {id_type}, b {id_type}").distinct(), "near-links")


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    offsets = column.offsets.to_numpy()
    return np.split(column.values.to_numpy()[: offsets[-1]], offsets[1:-1]) if len(column) else []


def components(links: DataFrame) -> DataFrame:
    """(cls, root): each node's smallest reachable node, for nodes that are not themselves the smallest.

    Large-star and small-star steps by turns: first every larger neighbour, then every smaller one is hung on the
    smallest neighbour, until nothing changes. Each step is written, so no step depends on an earlier one.
    """
    edges = saved(_directed(links.select("a", "b")), "near-star")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(_directed(large), "near-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = saved(_directed(hung.unionByName(least.select("a", F.col("m").alias("b")))), "near-star")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges.select(F.col("a").alias("cls"), F.col("b").alias("root"))
        state = seen


def _directed(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
