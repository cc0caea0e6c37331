import numpy as np
import pytest
from pyspark.sql import functions as F

from ragframe.functions.vectors import embed
from ragframe.operators import lsh
from ragframe.operators.search import search_lsh, similarity_topk
from ragframe.plans import fixtures as fx
from ragframe.session import new_path

DIM = 64


def as_lists(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 6)))
    return out


def brute(rows, asked, bits, tables, k):
    """Best k of the vectors with a code at most one bit apart, one pair after the other."""
    sides = lsh.planes(DIM, bits * tables)

    def codes(v):
        return [sum(1 << i for i in range(bits) if v @ sides[:, t * bits + i] >= 0) for t in range(tables)]

    known = {c: (codes(v), v, kind) for c, v, kind in rows}
    out, pairs = {}, 0
    for name, q, scope in asked:
        mine, found = codes(q), []
        for c, (theirs, v, kind) in known.items():
            if any(bin(a ^ b).count("1") <= 1 for a, b in zip(mine, theirs, strict=True)):
                pairs += 1
                if scope in ("all", kind):
                    size = np.linalg.norm(v) * np.linalg.norm(q)
                    found.append((round(1 - (v @ q / size if size else 0.0), 9), c))
        out[name] = [(c, round(d, 6)) for d, c in sorted(found)[:k]]
    return {n: hits for n, hits in out.items() if hits}, pairs


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, DIM))
    rows = [(f"c{i}", centres[i % 12] + 0.6 * rng.standard_normal(DIM)) for i in range(600)]
    rows = [(c, v, "external" if i % 4 == 0 else "project") for i, (c, v) in enumerate(rows)]
    # a third of all rows are copies, two have no length
    rows += [(f"copy{i}", rows[0][1], "project") for i in range(300)]
    return rows + [("zero", np.zeros(DIM), "project"), ("null", None, "project")]


def tables_of(spark, vectors):
    store = spark.createDataFrame(
        [(c, None if v is None else v.tolist(), kind) for c, v, kind in vectors],
        "chunk_id string, embedding array<double>, doc_type string",
    ).repartition(4)
    asked = [(f"q{i}", vectors[i * 40][1] + 0.01, ("all", "project", "external")[i % 3]) for i in range(15)]
    queries = spark.createDataFrame(
        [(n, "?", s, v.tolist()) for n, v, s in asked],
        "query_id string, question string, scope string, qvec array<double>",
    )
    return store, queries, asked


def test_results_and_scored_pairs_equal_brute_force(spark, vectors):
    store, queries, asked = tables_of(spark, vectors)
    rows = [(c, np.zeros(DIM) if v is None else v, kind) for c, v, kind in vectors]
    for bits, tables in ((8, 6), (1, 2), (5, 3)):
        index = lsh.build_index(store, new_path(spark, "codes"), DIM, bits, tables)
        wanted, pairs = brute(rows, asked, bits, tables, 7)
        assert as_lists(search_lsh(store, queries, DIM, index=index, mode="similarity", k=7)) == wanted
        scored = lsh.scored_pairs(index, queries).agg(F.sum("pairs")).first()[0]
        assert scored == pairs <= len(rows) * len(asked)


def test_a_written_index_is_read_again(spark, vectors):
    store, queries, _ = tables_of(spark, vectors)
    path = new_path(spark, "codes")
    first = as_lists(search_lsh(store, queries, DIM, index=lsh.build_index(store, path, DIM), mode="similarity"))
    again = lsh.read_index(spark, path)
    assert (again.dim, again.bits, again.tables) == (DIM, 7, 14)
    assert as_lists(search_lsh(store, queries, DIM, index=again, mode="similarity")) == first


def test_recall_and_work_on_the_vector_table(spark):
    """Every fiftieth vector asks: nine of ten neighbours are found, with fewer pairs than exact search has."""
    store = fx.vectors(spark, "/root/testdata/sf0.1")
    queries = store.filter(F.col("chunk_id").cast("long") % 50 == 0).select(
        F.col("chunk_id").alias("query_id"), F.lit("?").alias("question"), F.col("embedding").alias("qvec"), F.lit("all").alias("scope")
    )
    index = lsh.build_index(store, new_path(spark, "codes"), DIM)
    exact = as_lists(similarity_topk(store, queries))
    close = as_lists(search_lsh(store, queries, DIM, index=index, mode="similarity"))
    found = sum(len(set(exact[q]) & set(close[q])) for q in exact)
    assert found >= 0.9 * sum(map(len, exact.values()))
    scored = lsh.scored_pairs(index, queries).agg(F.sum("pairs")).first()[0]
    assert scored < 0.7 * store.count() * len(exact)


def test_empty_tables_and_wrong_lengths(spark, vectors):
    store, queries, _ = tables_of(spark, vectors)
    index = lsh.build_index(store, new_path(spark, "codes"), DIM, 4, 3)
    assert search_lsh(store, queries.limit(0), DIM, index=index, mode="similarity").count() == 0
    bare = lsh.build_index(store.limit(0), new_path(spark, "codes"), DIM, 4, 3)
    assert search_lsh(store.limit(0), queries, DIM, index=bare, mode="similarity").count() == 0
    with pytest.raises(ValueError):
        search_lsh(store, queries.withColumn("qvec", F.slice("qvec", 1, 8)), DIM, index=index, mode="similarity")
    with pytest.raises(ValueError):
        lsh.build_index(store, new_path(spark, "codes"), DIM, 0, 3)


def test_texts_are_embedded_for_it(spark):
    texts = [(f"c{i}", f"word{i} word{i + 1} shared", "project") for i in range(40)]
    store = embed(spark.createDataFrame(texts, "chunk_id string, text string, doc_type string"))
    asked = spark.createDataFrame([("q", "word7 word8 shared")], "query_id string, question string")
    dim = len(store.first().embedding)
    hit = search_lsh(store, asked, dim, bits=2, tables=8, mode="hybrid", k=1).first()
    assert hit.chunk_id == "c7"
