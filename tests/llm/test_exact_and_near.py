import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ragframe.llm import exact_dedup, minhash


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_directory_splits_overfull_buckets_only():
    loads = np.zeros(16, np.int64)
    loads[3], loads[8:] = 100, 1
    buckets, depth = exact_dedup.split_directory(loads, 10)
    assert depth == 4
    assert len(set(buckets[8:])) == 1 and list(buckets).count(buckets[3]) == 1
    assert list(buckets) == sorted(buckets)
    assert exact_dedup.split_directory(np.zeros(8, np.int64), 10)[1] == 0


def test_normalised_bytes():
    for text in ("", " ", "a  b", "\n a\t\x0b", "é x "):
        assert exact_dedup.normalised(text.encode()).decode() == norm(text)


def test_mark_exact(odd):
    rows = odd.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    found = exact_dedup.mark_exact(odd).collect()
    assert len(found) == len(rows)
    sizes = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in found:
        ids = sizes[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == (min(known) if known else None)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept) == set(sizes) and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_drop_exact_keeps_rows_whole(odd, none):
    left = exact_dedup.drop_exact(odd)
    assert left.columns == odd.columns
    rows = left.collect()
    assert Counter(norm(r.text) for r in rows) == Counter({norm(r.text) for r in odd.collect()})
    assert exact_dedup.drop_exact(none).count() == 0
    assert exact_dedup.mark_exact(none).count() == 0


def test_equal_keys_are_chained():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict(
        {
            "hash_key": [1, 1, 1],
            "text_sha256": ["x", "x", "x"],
            "body": [b"a", b"b", b"a"],
            "keep_id": [5, 6, 4],
            "keep_rows": [1, 1, 2],
            "group_size": [1, 1, 2],
        }
    )
    out = [r for b in exact_dedup._chain(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["keep_id"], r["keep_rows"], r["group_size"]) for r in out) == [(4, 2, 3), (6, 1, 1)]


def brute(rows, words):
    sets, parent = {}, {}
    for i, text in rows.items():
        found = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
        k = min(words, len(found))
        sets[i] = {tuple(found[j : j + k]) for j in range(len(found) - k + 1)} if found else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both, any_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both and 100 * both >= 80 * any_:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in rows}


def chain(spark):
    """A drifting family, an unlinked one with a long common passage, and small sets."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = {}
    for i in range(30):
        rows[i] = " ".join(base)
        base = list(base)
        base[rng.integers(60)] = f"e{i}"
    common = " ".join(f"c{i}" for i in range(40))
    for i in range(30):
        rows[100 + i] = common + " " + " ".join(f"u{i}x{j}" for j in range(14))
    rows |= {200: "A b", 201: "a B", 202: "a", 203: "A", 204: "", 205: None, 206: "c d e"}
    return rows, spark.createDataFrame([(k, v) for k, v in rows.items()], "doc_id long, text string").repartition(3)


def test_near_groups_equal_brute_force(spark):
    rows, docs = chain(spark)
    for words in (2, 5):
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(docs, words).collect()}
        assert found == brute(rows, words)


def test_near_groups_of_edited_copies(spark):
    """Copies with few to many edits, every row twice: many pairs just below the limit in common buckets."""
    rng = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in range(90)], {}
    for i in range(120):
        words = list(base)
        for place in rng.integers(90, size=rng.integers(16)):
            words[place] = f"e{rng.integers(12)}"
        rows[i] = " ".join(words[: 90 - rng.integers(12)])
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found = minhash.near_groups(docs.unionByName(docs), 2).collect()
    expected = brute(rows, 2)
    assert len(rows) > len({component for _, component in expected.values()}) > 2
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(2 * [(i, *v) for i, v in expected.items()])


def test_near_on_odd_rows(odd, none):
    found = minhash.near_groups(odd, 5)
    assert found.count() == odd.count()
    one = {r.doc_id: r.component_id for r in found.where("doc_id is not null").collect()}
    assert one[2] == 1 and one[7] == 6 and one[3] == 3 and one[5] == 5
    left = minhash.drop_near(odd, 5)
    assert left.columns == odd.columns
    assert left.where("doc_id in (2, 7)").count() == 0
    assert minhash.near_groups(none).count() == 0 and minhash.drop_near(none).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (5, 4), (4, 6), (10, 11), (11, 12), (12, 13), (13, 14)]
    found = minhash.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.cls: r.root for r in found} == {2: 1, 3: 1, 9: 1, 5: 4, 6: 4, 11: 10, 12: 10, 13: 10, 14: 10}
    assert all(r.cls > r.root for r in found)


def test_sketch_collisions_follow_similarity():
    rng = np.random.default_rng(1)
    same = rng.integers(0, 1 << 62, 900).astype(np.uint64)
    a, b = (np.unique(np.concatenate([same, rng.integers(0, 1 << 62, 50).astype(np.uint64)])) for _ in "ab")
    equal = (minhash.sketch(a) == minhash.sketch(b)).sum()
    assert equal >= 2
    assert (minhash.sketch(a) == minhash.sketch(rng.integers(0, 1 << 62, 900).astype(np.uint64))).sum() == 0


def test_exact_plan_moves_no_text_of_unique_rows(odd):
    assert exact_dedup.drop_exact(odd.where(F.col("doc_id") < 3)).count() == 1


def test_very_long_texts_among_near_copies(spark):
    """The work on a set follows its size, not its square."""
    words = [f"w{i}" for i in range(100_000)]
    rows = {1: " ".join(words)}
    for i in (2, 3):
        words[50_000 + i] = f"x{i}"
        rows[i] = " ".join(words)
    half = [w if i % 9 else f"y{i}" for i, w in enumerate(words)]
    rows[4] = " ".join(half)
    half[::9] = [f"z{i}" for i in range(len(half[::9]))]
    rows[5] = " ".join(half)
    rows |= {10 + i: f"short {i} " + "a b c d e f g h i j k l m n o p q r s t u v w x y z" for i in range(3)}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(docs, 2).collect()}
    assert found == brute(rows, 2)
