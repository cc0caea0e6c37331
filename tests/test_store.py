import pytest
from pyspark.sql import functions as F

from ragframe.operators import store as st
from ragframe.plans.ingest import chunk_documents, ingest_documents
from ragframe.sources import paths

SCHEMA = "chunk_id string, source_id string, source_path string, doc_type string, chunk_index int, text string"


def chunks(spark, rows):
    return spark.createDataFrame([(c, s, p, "project", i, t) for c, s, p, i, t in rows], SCHEMA)


def ids_of(df):
    return sorted(r.chunk_id for r in df.select("chunk_id").collect())


OLD = [
    ("1", "a.md", "a.md", 0, "x"),
    ("2", "a.md", "a.md", 1, "x"),
    ("3", "b.pdf#p1", "b.pdf", 0, "x"),
    ("4", "b.pdf#p2", None, 0, "x"),
    ("5", "a#pb.pdf#p3", "elsewhere", 0, "x"),
    ("6", "a#pb.pdfx#p3", "elsewhere", 0, "x"),
    ("7", "c.md", "c.md", 0, "x"),
    ("8", "d.md", "a.md", 0, "x"),
]


@pytest.mark.parametrize(
    "path, gone",
    [
        ("a.md", ["1", "2", "8"]),
        ("b.pdf", ["3", "4"]),
        ("b.pdf#p1", ["3"]),
        ("a#pb.pdf", ["5"]),
        ("a", ["5", "6"]),
        ("d.md", ["8"]),
        ("c", []),
    ],
)
def test_replaced_rule(spark, path, gone):
    targets = spark.createDataFrame([(path,)], "source_path string")
    assert ids_of(st.replaced(chunks(spark, OLD), targets)) == gone


def test_upsert_in_memory(spark):
    new = chunks(spark, [("n1", "b.pdf#p9", "b.pdf", 0, "y")])
    after, stats = st.upsert(chunks(spark, OLD), new)
    assert ids_of(after) == ["1", "2", "5", "6", "7", "8", "n1"]
    assert stats.first().asDict() == {
        "status": "ok",
        "raw_docs": 1,
        "chunks": 1,
        "replaced_sources": 1,
        "replaced_points": 2,
    }


def test_upsert_on_disk(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    assert st.store_info(spark, path).first() == (False, 0)
    st.write_store(chunks(spark, OLD), path)
    new = chunks(spark, [("n1", "a.md", "a.md", 0, "y"), ("n2", "z.md", "z.md", 0, "y")])
    stats = st.upsert_store(spark, path, new).first()
    assert (stats.chunks, stats.replaced_sources, stats.replaced_points) == (2, 2, 3)
    wanted = ["3", "4", "5", "6", "7", "n1", "n2"]
    assert ids_of(st.read_store(spark, path)) == wanted

    # The same batch again replaces itself.
    assert st.upsert_store(spark, path, new).first().replaced_points == 2
    assert ids_of(st.read_store(spark, path)) == wanted

    # A join that is not broadcast gives the same.
    monkeypatch.setattr(st, "BROADCAST_ROWS", 0)
    assert ids_of(st.read_store(spark, path)) == wanted

    st.compact(spark, path)
    assert ids_of(st.read_store(spark, path)) == wanted
    assert not paths.exists(spark, f"{path}/chunks/batch=0")
    st.upsert_store(spark, path, chunks(spark, [("n3", "c.md", "c.md", 0, "")]))
    assert ids_of(st.read_store(spark, path)) == ["3", "4", "5", "6", "n1", "n2", "n3"]


def test_batch_without_commit_is_invisible(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    st.write_store(chunks(spark, OLD), path)
    new = chunks(spark, [("n1", "a.md", "a.md", 0, "y")])

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(st, "_commit", lost)
        with pytest.raises(RuntimeError):
            st.upsert_store(spark, path, new)
    assert paths.exists(spark, f"{path}/chunks/batch=1")
    assert len(ids_of(st.read_store(spark, path))) == 8
    st.upsert_store(spark, path, new)
    assert ids_of(st.read_store(spark, path)) == ["3", "4", "5", "6", "7", "n1"]


def test_label_counts_once(spark, tmp_path):
    path = str(tmp_path / "store")
    first = st.upsert_store(spark, path, chunks(spark, OLD), label="day 1").first()
    again = st.upsert_store(spark, path, chunks(spark, OLD[:1]), label="day 1").first()
    assert first == again and len(ids_of(st.read_store(spark, path))) == 8


def test_batch_without_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = spark.createDataFrame([("e.txt", "e.txt", "project", " ")], "source_id string, source_path string, doc_type string, text string")
    stats = ingest_documents(spark, docs, path).first()
    assert (stats.status, stats.raw_docs, stats.chunks) == ("ok", 1, 0)
    assert ids_of(st.read_store(spark, path)) == []
    stats = ingest_documents(spark, docs.limit(0), path).first()
    assert (stats.status, stats.raw_docs) == ("no_docs_found", 0)


def test_paging(spark):
    df = chunks(spark, OLD)
    first = [r.chunk_id for r in st.sample(df, 3).collect()]
    then = [r.chunk_id for r in st.sample(df, 3, first[-1]).collect()]
    assert first + then == ["1", "2", "3", "4", "5", "6"]
    row = st.sample(df, 1, "3").first()
    assert row.metadata_keys == ["chunk_index", "doc_type", "source_id", "text"]


def test_ids_are_stable_and_unique(spark):
    text = "some words here. " * 300
    docs = spark.createDataFrame(
        [(f"f{i}.txt", f"f{i}.txt", "project", text) for i in range(5)],
        "source_id string, source_path string, doc_type string, text string",
    )
    once, again = (ids_of(chunk_documents(d)) for d in (docs, docs.repartition(3)))
    assert once == again and len(set(once)) == len(once) > 20
    assert chunk_documents(docs).filter(F.length("text") > 900).count() == 0


def test_an_upsert_opens_no_old_chunk_file(spark, tmp_path):
    path = str(tmp_path / "store")

    def chunks(rows):
        return spark.createDataFrame(
            [(f"{s}-{i}", s, p, i, "t", "project") for s, p, n in rows for i in range(n)],
            "chunk_id string, source_id string, source_path string, chunk_index int, text string, doc_type string",
        )

    st.upsert_store(spark, path, chunks([("a.md", "a.md", 3), ("b.pdf#p1", "b.pdf", 2), ("b.pdf#p2", "b.pdf", 2), ("c", "c", 1)]))
    st.upsert_store(spark, path, chunks([("a.md", "a.md", 5)]))
    for file in (tmp_path / "store" / "chunks").rglob("*.parquet"):
        file.write_bytes(b"nobody reads this")
    for crc in (tmp_path / "store" / "chunks").rglob(".*.crc"):
        crc.write_bytes(b"")
    stats = st.upsert_store(spark, path, chunks([("a.md", "a.md", 1), ("b.pdf#p1", "b.pdf", 1), ("new", "new", 1)])).first()
    # the first version of a.md is replaced already
    assert (stats.chunks, stats.replaced_sources, stats.replaced_points) == (3, 3, 5 + 4)
    index = spark.read.parquet(f"{path}/replaced/batch=2").collect()
    assert {r.source_id for r in index} == {"a.md", "b.pdf#p1", "b.pdf#p2"}


def test_the_index_is_joined_where_names_are_many(spark, tmp_path, monkeypatch):
    stats = []
    for most in (10_000, 1):
        monkeypatch.setattr(st, "INDEX_NAMES", most)
        path = str(tmp_path / f"store{most}")
        rows = [(f"{s}-{i}", s, s, i, "t", "project") for s in ("a", "b", None) for i in range(3)]
        schema = "chunk_id string, source_id string, source_path string, chunk_index int, text string, doc_type string"
        df = spark.createDataFrame(rows, schema)
        for _ in range(2):
            last = st.upsert_store(spark, path, df).first()
        st.compact(spark, path)
        again = st.upsert_store(spark, path, df.where("source_id = 'a'")).first()
        stats.append((last, again, st.read_store(spark, path).count()))
    assert stats[0] == stats[1] and stats[0][1].replaced_points == 3
