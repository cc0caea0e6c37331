import json

import pytest

from ragframe.operators import store as st
from ragframe.plans import fixtures as fx
from ragframe.plans.ingest import ingest_tree, load_documents
from ragframe.session import new_path
from ragframe.sources import files
from ragframe.streaming.ingest import ingest_stream


def make_tree(base):
    (base / "external" / "deep").mkdir(parents=True)
    (base / "a.md").write_text("# Title\nmail me@example.org")
    (base / "B.TXT").write_bytes(b"caf\xc3\xa9 \xff\xfe ok")
    (base / "empty.txt").write_text("")
    (base / "skip.csv").write_text("no")
    (base / "external" / "deep" / "x y.md").write_text("deep text")
    (base / "external" / "c.pdf").write_bytes(b"one|two|!|four")


def page_reader():
    """A reader as a closure, which is sent to the workers by value."""

    def page_texts(content):
        for part in content.decode().split("|"):
            if part == "!":
                raise ValueError("broken page")
            yield " " if part == "two" else part

    return page_texts


def test_tree(spark, tmp_path):
    make_tree(tmp_path)
    for base in (str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/"):
        rows = {r.rel_path: r.text for r in files.read_tree(spark, base).collect()}
        assert rows == {
            "a.md": "# Title\nmail me@example.org",
            "B.TXT": "café  ok",
            "empty.txt": "",
            "external/deep/x y.md": "deep text",
        }


def test_documents_of_a_tree_with_a_broken_page(spark, tmp_path):
    make_tree(tmp_path)
    docs = {r.source_id: r for r in load_documents(spark, str(tmp_path), page_reader()).collect()}
    assert set(docs) == {"a.md", "B.TXT", "empty.txt", "external/deep/x y.md", "external/c.pdf#p1"}
    assert docs["a.md"].text == "# Title\nmail <EMAIL_ADDRESS>"
    page = docs["external/c.pdf#p1"]
    assert (page.source_path, page.doc_type, page.text) == ("external/c.pdf", "external", "one")


def test_ingest_tree_twice(spark, tmp_path):
    make_tree(tmp_path)
    path = new_path(spark, "store")
    first = ingest_tree(spark, str(tmp_path), path, page_texts=page_reader()).first()
    assert (first.raw_docs, first.chunks, first.replaced_points) == (5, 4, 0)
    again = ingest_tree(spark, str(tmp_path), path, page_texts=page_reader()).first()
    assert (again.chunks, again.replaced_points) == (4, 4)
    assert st.read_store(spark, path).count() == 4


def test_jsonl(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"question": "a", "ground_truth": "b"}\n\n  \n{"question": "c"}\n')
    schema = "question string, ground_truth string"
    rows = files.read_jsonl(spark, str(path), schema).collect()
    assert [tuple(r) for r in rows] == [("a", "b"), ("c", None)]
    missing = files.read_jsonl(spark, str(tmp_path / "none.jsonl"), schema)
    assert missing.count() == 0 and missing.columns == ["question", "ground_truth"]


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([("q", None)], "question string, score double")
    summary = spark.createDataFrame([(1, 0.5)], "total int, accuracy double")
    files.write_report(rows, summary, str(tmp_path / "r"))
    parts = [p.read_text() for p in (tmp_path / "r" / "rows").glob("*.json")]
    assert json.loads("".join(parts)) == {"question": "q", "score": None}


def test_stream_takes_the_newest_text_and_counts_batches_once(spark, tmp_path):
    source, path, progress = (str(tmp_path / n) for n in ("in", "store", "progress"))
    schema = "rel_path string, text string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    arrive([("a.md", "first"), ("b.txt", "b")])
    ingest_stream(spark, source, path, progress).awaitTermination()
    arrive([("a.md", "second"), ("external/c.md", "c")])
    ingest_stream(spark, source, path, progress).awaitTermination()
    ingest_stream(spark, source, path, progress).awaitTermination()
    rows = {r.source_id: (r.text, r.doc_type) for r in st.read_store(spark, path).collect()}
    assert rows == {
        "a.md": ("second", "project"),
        "b.txt": ("b", "project"),
        "external/c.md": ("c", "external"),
    }
    assert st.commits(spark, path).count() == 2


def test_only_bytes_that_are_no_utf8_are_dropped(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("kept � mark".encode())
    (tmp_path / "b.md").write_bytes("both � and ".encode() + b"\xff\xc3(" + "é".encode())
    (tmp_path / "c.txt").write_bytes("plain é".encode())
    found = {r.rel_path: r.text for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert found == {"a.md": "kept � mark", "b.md": "both � and (é", "c.txt": "plain é"}


def test_failed_files_are_told(spark, tmp_path):
    def page_texts(content):
        for i, page in enumerate(content.decode().split("|"), 1):
            if page == "bad":
                raise ValueError(f"page {i} is broken")
            yield page

    for name, body in (("a.pdf", "one|two"), ("b.pdf", "one|two|bad|four"), ("c.PDF", "bad")):
        (tmp_path / name).write_bytes(body.encode())
    scanned = files.scan_paged(spark, str(tmp_path), page_texts)
    pages = sorted(map(tuple, files.paged_rows(scanned).collect()))
    assert pages == [("a.pdf", 1, "one"), ("a.pdf", 2, "two"), ("b.pdf", 1, "one"), ("b.pdf", 2, "two")]
    assert pages == sorted(map(tuple, files.read_paged(spark, str(tmp_path), page_texts).collect()))
    failed = sorted(map(tuple, files.failed_files(scanned).collect()))
    assert failed == [("b.pdf", "ValueError: page 3 is broken", 2), ("c.PDF", "ValueError: page 1 is broken", 0)]


def test_tree_lists_every_name_in_tasks(spark, tmp_path):
    """Names that Spark's sources skip, names with signs of an address, links to folders."""
    for folder in ("_x", ".git/deep", "a%20b+c", "é"):
        (tmp_path / folder).mkdir(parents=True)
    texts = {
        "_x/_a.md": "one", ".git/deep/.b.TXT": "two", "a%20b+c/d e.txt": "", "é/f#g?.md": "caf� \U0001f600",
        "_SUCCESS.txt": "", "a.md.txt": "three",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / ".md").write_text("a name without a suffix")
    (tmp_path / "loop").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "_x" / "link.md").symlink_to(tmp_path / "a.md.txt")
    found = {r.rel_path: r.text for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert found == {**texts, "_x/link.md": "three"}


def test_tree_without_files_and_without_a_folder(spark, tmp_path):
    assert files.read_tree(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_tree(spark, str(tmp_path / "none"))


def test_tree_with_more_files_than_a_batch_holds(spark, tmp_path, monkeypatch):
    from ragframe.sources import tree

    monkeypatch.setattr(tree, "TREE_BATCH_BYTES", 10)
    for i in range(50):
        (tmp_path / f"d{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 3}" / f"{i}.txt").write_text("x" * i)
    found = {r.rel_path: len(r.text) for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert found == {f"d{i % 3}/{i}.txt": i for i in range(50)}


def test_files_for_the_stream_follow_the_splits_of_the_table(spark, sf_dir, tmp_path):
    """More documents are more files, not longer ones; they still come in two batches."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = str(tmp_path / "sf" / "documents.parquet")
    docs.repartition(9, "doc_id").write.parquet(table)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    # every file is a split of its own
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        source, path = str(tmp_path / "in"), str(tmp_path / "store")
        assert fx.incoming(spark, str(tmp_path / "sf"), source) == 9
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert len(list((tmp_path / "in").glob("part-*.parquet"))) == 9
    written = spark.read.parquet(source)
    given = fx.files(spark, sf_dir).select("rel_path", "text")
    assert written.exceptAll(given).isEmpty() and given.exceptAll(written).isEmpty()
    ingest_stream(spark, source, path, str(tmp_path / "progress"), max_files=5).awaitTermination()
    assert st.commits(spark, path).count() == 2
    # a table of one small file gives four
    assert fx.incoming(spark, sf_dir, str(tmp_path / "small")) == 4
