import datetime

import pytest
from pyspark.sql import functions as F

from ragframe.functions.metadata import overlaid, with_meta
from ragframe.operators import grounding
from ragframe.operators import store as st
from ragframe.operators.search import search
from ragframe.plans.ingest import chunk_documents, ingest_documents
from ragframe.session import new_path

SCHEMA = (
    "source_id string, doc_type string, text string, author string, pages int, day date, "
    "tags array<string>, raw binary, meta map<string,string>"
)
ROWS = [
    ("a.md", "project", "# t\none two", "Ann", 3, datetime.date(2024, 5, 1), ["x", "y"], b"z", {"team": "ops", "author": "old"}),
    ("b.txt", "external", "three four", None, None, None, None, None, None),
]


def documents(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_columns_become_keys(spark):
    folded = with_meta(documents(spark), ["source_id", "doc_type", "text"])
    assert folded.columns == ["source_id", "doc_type", "text", "meta"]
    got = {r.source_id: r.meta for r in folded.collect()}
    assert got["a.md"] == {"team": "ops", "author": "Ann", "pages": "3", "day": "2024-05-01", "tags": '["x","y"]'}
    assert got["b.txt"] == {}


def test_a_table_without_extra_columns(spark):
    plain = spark.createDataFrame([("a", "t")], "source_id string, text string")
    assert with_meta(plain, ["source_id", "text"]).first().meta is None
    assert with_meta(plain.limit(0), ["source_id"]).count() == 0


def test_overlaid_maps(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"c": None}), (None, None)],
                               "l map<string,string>, r map<string,string>")
    got = [r[0] for r in df.select(overlaid(F.col("l"), F.col("r"))).collect()]
    assert got == [{"a": "1", "b": "3"}, {"c": None}, {}]


@pytest.mark.parametrize("mode", ["similarity", "hybrid", "mmr"])
def test_extra_keys_come_back_with_the_sources(spark, mode):
    path = new_path(spark, "store")
    ingest_documents(spark, documents(spark), path)
    asked = spark.createDataFrame([("q", "one two three", "all")], "query_id string, question string, scope string")
    found = grounding.sources(search(st.read_store(spark, path), asked, mode=mode)).collect()
    meta = {r.source_id: r.meta for r in found}
    assert meta["a.md"]["team"] == "ops" and meta["a.md"]["author"] == "Ann" and meta["a.md"]["h1"] == "t"
    assert meta["a.md"]["chunk_index"] == "0" and "start" not in meta["a.md"]
    assert set(meta["b.txt"]) == {"source_id", "source_path", "doc_type", "chunk_index"}


def test_named_fields_win_over_keys_of_the_same_name(spark):
    hits = spark.createDataFrame([("q", 1, "s", {"source_id": "other", "lang": "de"})],
                                 "query_id string, rank int, source_id string, meta map<string,string>")
    assert grounding.sources(hits).first().meta == {"source_id": "s", "lang": "de"}


def test_batches_without_meta_are_read(spark):
    """A batch written before chunks had metadata, and one after."""
    path = new_path(spark, "store")
    st.write_store(chunk_documents(documents(spark)).drop("meta"), path)
    old = spark.read.parquet(f"{path}/chunks/batch=0").drop("meta")
    bare = new_path(spark, "bare")
    old.write.partitionBy("doc_type").parquet(f"{bare}/chunks/batch=0")
    for part in ("sources", "commits", "replaced"):
        spark.read.parquet(f"{path}/{part}/batch=0").write.parquet(f"{bare}/{part}/batch=0")
    more = spark.createDataFrame([("c.txt", "project", "five", "Bo")], "source_id string, doc_type string, text string, author string")
    ingest_documents(spark, more, bare)
    got = {r.source_id: r.meta for r in st.read_store(spark, bare).collect()}
    assert got == {"a.md": None, "b.txt": None, "c.txt": {"author": "Bo"}}
    st.compact(spark, bare)
    assert {r.source_id: r.meta for r in st.read_store(spark, bare).collect()} == got
    keys = {r.source_id: list(r.metadata_keys) for r in st.sample(st.read_store(spark, bare)).collect()}
    assert "author" in keys["c.txt"] and "author" not in keys["a.md"]


def test_chunk_ids_do_not_depend_on_the_scan(spark):
    rows = [("s", f"p{i % 3}.txt", f"text {i} " * (1 + i % 4 * 90), i) for i in range(40)]
    rows += [("s", "p0.txt", "twice", 1), ("s", "p0.txt", "twice", 2), ("alone", "z", "one", 0), (None, None, "n", 0)]
    schema = "source_id string, source_path string, text string, place int"
    seen = []
    for parts in (1, 3, 7):
        table = spark.createDataFrame(rows[::-1] if parts == 3 else rows, schema).repartition(parts)
        made = chunk_documents(table.withColumn("doc_type", F.lit("project"))).collect()
        assert len({r.chunk_id for r in made}) == len(made)
        seen.append(sorted((r.chunk_id, r.source_path, r.text, r.meta["place"]) for r in made))
    assert seen[0] == seen[1] == seen[2]
    order = sorted((r.chunk_index, r.source_path) for r in made if r.source_id == "s")
    assert [p for _, p in order] == sorted(p for _, p in order)
