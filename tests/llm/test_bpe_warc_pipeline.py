import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ragframe.llm import bpe, mixing, warc
from ragframe.llm.common import table
from ragframe.llm.queries import QUERIES, vocabulary_path
from tests.llm.test_exact_and_near import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary_path())


def same(row, text, library):
    ids = library.encode(text or "", add_special_tokens=False).ids
    packed = np.array(ids, "<u4").tobytes()
    assert row.n_tokens == len(ids) and row.token_ids == ids
    assert row.ids_sha256 == hashlib.sha256(packed).hexdigest()
    assert row.decoded == library.decode(ids, skip_special_tokens=False)


def test_words_equal_the_library(library):
    coder = bpe.Coder(bpe.Vocabulary(open(vocabulary_path(), encoding="utf-8").read()))
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdeest in'!?.1éß<|endoftext|>lolaaaa") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 3000, "<|startoftext|><|endoftext|>", "ΑΣ Σ ς", "x\x1cy\x85z", " ", "é", "İ", "'s''s", "\U0001f600"]
    for text in texts:
        ids = np.frombuffer(coder.encode(text), "<u4")
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_memories_may_be_emptied(library, monkeypatch):
    for name in ("PIECES", "PAIRS"):
        monkeypatch.setattr(bpe, name, 20)
    coder = bpe.Coder(bpe.Vocabulary(open(vocabulary_path(), encoding="utf-8").read()))
    text = "The tokens of many different words are forgotten and found again, words and tokens."
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents_equal_the_library(spark, odd, none, library, sf_dir):
    for docs in (odd, table(spark, sf_dir, "documents")):
        for r in bpe.encode_documents(docs, vocabulary_path()).collect():
            same(r.bpe, r.text, library)
    assert bpe.encode_documents(none, vocabulary_path()).count() == 0


def pages(spark):
    html = ["<p>a</p>", "", None, "<p>a</p>", "é" * 10, "x\r\n\r\ny" * 50_000, "<p>a</p>", "only once"]
    rows = [(i, f"http://h/{i}\r\nX: ü", h) for i, h in enumerate(html)]
    rows += [(None, None, "<p>a</p>"), (0, "again", "<p>a</p>"), (None, "u", "alone")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, warc_type string, length int")


def test_archives_give_back_pages(spark):
    docs = pages(spark).repartition(3)
    found = Counter(map(tuple, warc.archived_pages(docs).collect()))
    first = {}
    for r in docs.collect():
        if r.page_id is not None:
            first[r.html or ""] = min(first.get(r.html or "", r.page_id), r.page_id)
    want = Counter()
    for r in docs.collect():
        body = r.html or ""
        again = body in first and r.page_id != first[body]
        raw = body.encode()
        want[(r.page_id, len(raw), warc.payload_digest(raw), "revisit" if again else "response", first[body] if again else None)] += 1
    assert found == want
    assert warc.archived_pages(docs.where("false")).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_pages(pages(spark), path, least_bytes=9)
    assert warc.read_archives(spark, path).where("warc_type = 'revisit'").count() == 0


def test_filters_are_decided_on_headers(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_pages(pages(spark), path)
    whole = warc.read_archives(spark, path)
    rows = whole.collect()
    for column in warc.HEADERS:
        for value in {r[column] for r in rows} - {None}:
            wanted = Counter(r for r in rows if r[column] == value)
            assert Counter(warc.read_archives(spark, path, **{column: value}).collect()) == wanted
            assert whole.where(F.col(column) == value).count() == wanted.total()
    # what one plan asked for does not stay
    assert whole.count() == len(rows)
    both = warc.read_archives(spark, path, payload=False, warc_type=["revisit"], refers_to=0)
    assert {(r.warc_type, r.refers_to, r.payload) for r in both.collect()} == {("revisit", "0", None)}
    with pytest.raises(ValueError):
        warc.read_archives(spark, path, payload_size=1)


def test_any_id_and_address_come_back(spark, tmp_path):
    names = ["a+b", "a b", "a%2Bb", "100%", "none", "", "ü\r\nX: y", "#?&=", None]
    rows = [(n, None if n is None else f"http://h/{n}?q=ü b+c%20", f"<p>{i // 2}</p>") for i, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(2)
    found = {r.page_id: r for r in warc.archived_pages(docs, f"file://{tmp_path}/w").collect()}
    assert set(found) == set(names)
    for i, n in enumerate(names):
        twin = names[i ^ 1] if (i ^ 1) < len(names) else None
        first = min(n, twin) if n is not None and twin is not None else None
        assert found[n].refers_to == (first if first != n else None)
    read = warc.read_archives(spark, f"file://{tmp_path}/w").select("page_id", "target_uri").collect()
    assert {tuple(r) for r in read} == {r[:2] for r in rows}


def test_uncommitted_files_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_pages(pages(spark).limit(2), path)
    (tmp_path / "w" / "lost.warc.gz").write_bytes(b"not a record")
    assert warc.read_archives(spark, path).count() == 2


def test_pipeline(spark, library):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier",
        "exact dedup",
        "MinHash near-dedup",
        "mixing sources to target weights",
        "BPE encoding and decoding",
    ]
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    rows = corpus_pipeline.run(spark, sf_dir)
    assert set(docs.columns) < set(rows.columns)
    found = rows.collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in found:
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)

    # from the classifier's documents on, everything by other means: plain sets, all pairs, SQL
    good = {r.doc_id for r in QUERIES["op5_quality"](spark, sf_dir).where("predicted = 1").collect()}
    first = {}
    for i in sorted(good):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    groups = brute({i: texts[i] for i in first.values()}, 5)
    left = [i for i, (_, root) in groups.items() if i == root]
    assert len(left) < len(first) < len(good)
    db = duckdb.connect()
    kept = docs.where(F.col("doc_id").isin(left)).toArrow()
    db.register("documents", kept)
    times = db.sql(f"select doc_id, taken // size as times from ({mixing.ORACLE}) where taken > 0").fetchall()
    assert Counter(r.doc_id for r in found) == dict(times)


def test_pipeline_on_odd_rows(spark, odd, none, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            left = stage(spark, docs, str(tmp_path))
            left.write.mode("overwrite").format("noop").save()
            assert set(docs.columns) - {"bpe"} <= set(left.columns)
