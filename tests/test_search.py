import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from ragframe.functions.vectors import cosine_distance, embed, hash_embedder, vector_lists
from ragframe.operators import search as search_module
from ragframe.operators import store as chunk_store
from ragframe.functions.params import resolve_params
from ragframe.operators.scoring import Best as _Best
from ragframe.operators.scoring import nearest, scored, unit_rows
from ragframe.operators.search import (
    hybrid_topk,
    mmr_scores,
    mmr_topk,
    query_blocks,
    report,
    search,
    search_lsh,
    similarity_topk,
)
from ragframe.settings import RetrievalDefaults

DIM = 12


@pytest.fixture(scope="module")
def corpus():
    """300 chunks, a third of them copies of one another, one without a direction."""
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((300, DIM)).astype(np.float32)
    vectors[:100] = vectors[0]
    vectors[299] = 0
    rows = []
    for i, v in enumerate(vectors):
        kind = "external" if i % 3 == 0 else "project"
        words = " ".join(f"w{j:02d}" for j in range(i % 17, i % 17 + 6))
        rows.append((f"c{i:03d}", f"{kind}/{i % 40}.md", kind, words, [float(x) for x in v]))
    return rows


@pytest.fixture(scope="module")
def store(spark, corpus):
    schema = "chunk_id string, source_id string, doc_type string, text string, embedding array<float>"
    return spark.createDataFrame(corpus, schema).repartition(7).cache()


@pytest.fixture(scope="module")
def asked(corpus):
    rng = np.random.default_rng(8)
    scopes = ["all", "external", "project", None]
    out = []
    for i in range(30):
        v = rng.standard_normal(DIM)
        if i == 5:
            v = np.array(corpus[0][4]) + 0.01 * v
        out.append((f"q{i}", f"w{i % 17:02d} w{(i + 3) % 17:02d} other", scopes[i % 4], [float(x) for x in v]))
    return out


@pytest.fixture(scope="module")
def queries(spark, asked):
    return spark.createDataFrame(asked, "query_id string, question string, scope string, qvec array<double>")


def unit(v):
    n = np.linalg.norm(v)
    return v / n if n else v


def brute(corpus, asked, depth, final):
    """The same by hand: nearest ``depth`` in scope, then ``final`` per query."""
    out = {}
    for qid, question, scope, qvec in asked:
        wanted = scope or "project"
        rows = []
        for cid, _, kind, text, vec in corpus:
            if wanted in ("all", kind):
                d = round(1 - float(unit(np.array(vec, dtype=float)) @ unit(np.array(qvec))), 9) + 0.0
                rows.append((d, cid, text, unit(np.array(vec, dtype=float))))
        rows.sort(key=lambda r: (r[0], r[1]))
        out[qid] = final(question, rows[: depth(wanted)])
    return out


def as_lists(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


def test_similarity_is_exact_also_among_copies(store, queries, corpus, asked):
    got = as_lists(similarity_topk(store, queries, k=9))
    assert got == brute(corpus, asked, lambda s: 24, lambda q, rows: [r[1] for r in rows[:9]])


def test_many_blocks_give_the_same(store, queries, corpus, asked, monkeypatch):
    monkeypatch.setattr(search_module, "QUERY_BLOCK_ROWS", 8)
    got = as_lists(similarity_topk(store, queries, k=9))
    assert got == brute(corpus, asked, lambda s: 24, lambda q, rows: [r[1] for r in rows[:9]])


def test_more_hits_than_may_be_broadcast(store, queries, corpus, asked, monkeypatch):
    monkeypatch.setattr(search_module, "QUERY_BLOCK_HITS", 10)
    got = as_lists(similarity_topk(store, queries.filter("query_id < 'q2'"), k=20))
    wanted = brute(corpus, asked, lambda s: 24, lambda q, rows: [r[1] for r in rows[:20]])
    assert got == {q: wanted[q] for q in got} and len(got) == 12


def test_hybrid_by_hand(store, queries, corpus, asked):
    def final(question, rows):
        q = set(question.split())
        scored = []
        for rank, (d, cid, text, _) in enumerate(rows):
            share = len(q & set(text.split())) / len(q)
            scored.append((round(1 - (0.7 / (1 + d) + (1 - 0.7) * share), 9), rank, cid))
        return [s[2] for s in sorted(scored)[:6]]

    depth = {"external": 60, "project": 24, "all": 24}.get
    assert as_lists(hybrid_topk(store, queries)) == brute(corpus, asked, depth, final)


def test_mmr_by_hand(store, queries, corpus, asked):
    def final(_, rows):
        picks, left = [], list(range(len(rows)))
        while left and len(picks) < 6:
            def gain(i):
                worst = max((float(rows[i][3] @ rows[p][3]) for p in picks), default=0.0)
                return (-round(0.5 * (1 - rows[i][0]) - 0.5 * worst, 9), i)

            best = min(left, key=gain)
            picks.append(best)
            left.remove(best)
        return [rows[p][1] for p in picks]

    assert as_lists(mmr_topk(store, queries)) == brute(corpus, asked, lambda s: 24, final)


def test_mmr_and_hybrid_reduce_to_similarity(store, queries):
    near = as_lists(similarity_topk(store, queries))
    assert as_lists(mmr_topk(store, queries, defaults=RetrievalDefaults(mmr_lambda=1.0))) == near
    only_vectors = RetrievalDefaults(alpha=1.0)
    assert as_lists(hybrid_topk(store, queries, defaults=only_vectors)) == near


def test_smaller_k_is_a_prefix(store, queries):
    few, many = (as_lists(similarity_topk(store, queries, k=k)) for k in (4, 5))
    assert all(many[q][:4] == few[q] for q in many)


def test_auto_mode_and_overrides(spark, store, queries):
    mixed = queries.withColumn("mode", F.when(F.col("query_id") == "q1", "similarity")).withColumn(
        "k", F.when(F.col("query_id") == "q2", 2)
    )
    got, auto = as_lists(search(store, mixed)), as_lists(mmr_topk(store, queries))
    assert got["q1"] == as_lists(similarity_topk(store, queries))["q1"]
    assert len(got["q2"]) == 2 and got["q0"] == auto["q0"]
    assert got["q5"] == as_lists(hybrid_topk(store, queries))["q5"]


def test_scores_are_cosine_distances(store, queries):
    hits = similarity_topk(store, queries, k=3).select("query_id", "chunk_id", "score")
    pairs = hits.join(store, "chunk_id").join(queries, "query_id")
    off = pairs.select(F.abs(F.col("score") - cosine_distance(F.col("embedding"), F.col("qvec"))))
    assert max(r[0] for r in off.collect()) < 1e-8


def test_mmr_scores_fall_back(spark):
    picks = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("r", 1, "a")], "query_id string, rank int, chunk_id string")
    near = spark.createDataFrame([("q", "a", 0.1), ("q", "z", 0.4)], "query_id string, chunk_id string, score double")
    got = {(r.query_id, r.rank): r.score for r in mmr_scores(picks, near).collect()}
    assert got == {("q", 1): 0.1, ("q", 2): 0.4, ("r", 1): 1.0}


def test_lsh_is_a_subset_with_recall(store, queries):
    exact = as_lists(similarity_topk(store, queries, k=5))
    close = as_lists(search_lsh(store, queries, DIM, bits=2, tables=12, k=5, mode="similarity"))
    found = sum(len(set(exact[q]) & set(close.get(q, []))) for q in exact)
    assert found / sum(map(len, exact.values())) > 0.8
    all_codes = as_lists(search_lsh(store, queries, DIM, bits=1, tables=64, k=5, mode="similarity"))
    assert sum(all_codes[q] == exact[q] for q in exact) >= 29


@pytest.mark.parametrize("mode", ["similarity", "hybrid", "mmr"])
def test_no_queries_and_no_chunks(store, queries, mode):
    assert search(store, queries.limit(0), mode=mode).count() == 0
    assert search(store.limit(0), queries, mode=mode).count() == 0


def test_lists_with_very_many_ties():
    """Copies arrive in any order and in many slices; the smallest ids stay."""
    rng = np.random.default_rng(3)
    best = _Best(np.array([5, 2, 400]))
    ids = np.array([f"{i:0{4 + i % 3}d}".encode() for i in range(1500)])
    distance = np.round(rng.random((1500, 3)) + 0.5, 2)
    distance[rng.random(1500) < 0.4] = 0.25
    distance[::7, 1] = np.inf
    for part in np.array_split(rng.permutation(1500), 40):
        best.add(distance[part], ids[part], np.zeros(len(part), dtype=np.int64))
    for query, depth in enumerate((5, 2, 400)):
        seen = [(d, i) for d, i in zip(distance[:, query], ids, strict=True) if np.isfinite(d)]
        mine = best.query == query
        got = list(zip(best.distance[mine], best.chunk[mine], strict=True))
        assert got == sorted(seen)[:depth]


def test_plans(spark, store, queries, tmp_path):
    path = str(tmp_path / "store")
    chunks = store.withColumn("source_path", F.col("source_id")).withColumn("chunk_index", F.lit(0))
    chunk_store.write_store(chunks, path)
    saved = chunk_store.read_store(spark, path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    hits = search(saved, queries.filter("query_id = 'q2'"), k=3, mode="similarity", scope="project")
    plan = plan_of(hits)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "text#" in line)
    assert "file_name#" in scan and "= project)" in scan, scan
    assert "embedding" not in scan
    nearest_plan = plan_of(nearest(saved, next(query_blocks(resolve_params(queries)))[1]))
    assert nearest_plan.count("WindowGroupLimit") == 2
    assert "text#" not in nearest_plan


def test_report_and_default_embedding(spark):
    df = spark.createDataFrame(
        [("c1", "a.md", "project", "H", "red apple"), ("c2", "b.md", "project", None, "blue sky")],
        "chunk_id string, source_id string, doc_type string, h1 string, text string",
    )
    asked = spark.createDataFrame([(1, "an apple that is red")], "query_id int, question string")
    rows = report(search(embed(df), asked, k=1), asked).collect()
    assert [(r.query_id, r.source_id, r.h1, r.rank) for r in rows] == [("1", "a.md", "H", 1)]
    norms = embed(df).select(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)).collect()
    assert all(abs(r[0] - 1) < 1e-6 for r in norms)


def test_ids_need_not_be_unique_or_set(spark, store, corpus, asked):
    schema = "query_id string, question string, scope string, qvec array<float>"
    rows = [("1", *asked[0][1:]), ("1", *asked[4][1:]), (None, *asked[8][1:])]
    hits = similarity_topk(store, spark.createDataFrame(rows, schema), k=3).collect()
    alone = [
        r.chunk_id
        for q in (asked[0], asked[4], asked[8])
        for r in similarity_topk(store, spark.createDataFrame([q], schema), k=3).collect()
    ]
    assert sorted(r.chunk_id for r in hits) == sorted(alone)
    assert sorted((r.query_id or "") for r in hits) == [""] * 3 + ["1"] * 6


def test_one_deep_query_among_many(spark, store, corpus, asked, monkeypatch):
    monkeypatch.setattr(search_module, "QUERY_BLOCK_ROWS", 64)
    schema = "query_id string, question string, scope string, qvec array<float>, k int"
    rows = [(f"q{i}", *asked[i % 30][1:], 200_000 if i == 7 else 2) for i in range(300)]
    hits = similarity_topk(store, spark.createDataFrame(rows, schema))
    counts = {r.query_id: r["count"] for r in hits.groupBy("query_id").count().collect()}
    assert len(counts) == 300 and counts["q6"] == 2 and counts["q7"] > 90


def test_vectors_of_another_length_are_named(spark, store, queries):
    odd = spark.createDataFrame([("x", "project/1.md", "project", "t", [1.0, 2.0])], store.schema)
    with pytest.raises(Exception, match="chunk x has a vector of 2 numbers"):
        similarity_topk(odd, queries).collect()


def test_second_looks_open_only_files_with_candidates(spark, tmp_path, monkeypatch):
    """However many files hold candidates, no scan reads the others."""
    monkeypatch.setattr(search_module, "SCAN_FILES", 3)
    path = str(tmp_path / "files")
    rows = spark.range(40).selectExpr("cast(id as string) as chunk_id", "'project' as doc_type", "concat('text ', id) as text")
    rows.repartition(20).write.parquet(path)
    store = chunk_store.with_file(spark.read.parquet(path))
    wanted = store.where("cast(chunk_id as int) < 12").select("chunk_id", "file")
    files = {r.file for r in wanted.collect()}
    assert len(files) > 3
    found = search_module._only_files(store, wanted)
    assert {r.file for r in found.select("file").collect()} == files
    assert found.count() == store.where(F.col("file").isin(list(files))).count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == -(-len(files) // 3)


def test_buffered_lists_equal_sorting():
    rng = np.random.default_rng(8)
    for room in (1, 50, 10_000):
        fetch = rng.integers(1, 9, 20)
        best = _Best(fetch, room)
        distance = np.round(rng.integers(0, 30, (400, 20)) / 10, 1)
        distance[rng.random(distance.shape) < 0.1] = np.inf
        names = np.array([f"c{i:03d}".encode() for i in rng.permutation(400)])
        for at in range(0, 400, 37):
            best.add(distance[at : at + 37], names[at : at + 37], np.zeros(len(names[at : at + 37]), np.int64))
        for q in range(20):
            want = sorted((d, n) for d, n in zip(distance[:, q], names, strict=True) if np.isfinite(d))[: fetch[q]]
            got = [(d, n) for d, n in zip(best.distance[best.query == q], best.chunk[best.query == q], strict=True)]
            assert got == want


def test_a_task_holds_a_slice_of_a_batch_as_numbers():
    """What scoring and embedding hold in Python does not follow the size of an Arrow batch."""
    rng = np.random.default_rng(3)
    rows, dim = 40_000, 64
    vectors = rng.random((rows, dim)).astype(np.float32)
    lists = pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * dim, pa.array(vectors.reshape(-1)))
    ids = pa.array([f"c{i:05d}" for i in range(rows)])
    kinds = pa.array(["external" if i % 3 == 0 else "project" for i in range(rows)])
    names = ["chunk_id", "embedding", "file", "doc_type"]
    batch = pa.RecordBatch.from_arrays([ids, lists, pa.array([""] * rows), kinds], names=names)
    wanted = unit_rows(rng.random((5, dim)))
    scopes = ["all", "external", "project", "all", "all"]
    tracemalloc.start()
    found = list(scored(iter([batch]), list("abcde"), wanted, scopes, np.full(5, 4, dtype=np.int64)))
    scoring = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # as float64, all vectors are 20 MB
    assert scoring < 15e6
    distance = np.round(1.0 - unit_rows(vectors.astype(np.float64)) @ wanted.T, 9)
    for q, (name, scope) in enumerate(zip("abcde", scopes, strict=True)):
        seen = [i for i in range(rows) if scope == "all" or (scope == "external") == (i % 3 == 0)]
        want = sorted((distance[i, q], f"c{i:05d}") for i in seen)[:4]
        got = [(r["vec_score"], r["chunk_id"]) for b in found for r in b.to_pylist() if r["query_id"] == name]
        assert got == want

    texts = pa.array([f"word{i % 50} and{i % 7}" for i in range(20_000)])
    embedder = hash_embedder()
    tracemalloc.start()
    made = tracemalloc.get_traced_memory()[0]
    for _ in vector_lists(iter([texts]), embedder):
        pass
    embedding = tracemalloc.get_traced_memory()[1] - made
    tracemalloc.stop()
    # as float64, all vectors are 40 MB
    assert embedding < 15e6
    got = np.concatenate([v.flatten().to_numpy().reshape(-1, 256) for v in vector_lists(iter([texts]), embedder)])
    assert np.array_equal(got, embedder(texts.to_pylist()))
