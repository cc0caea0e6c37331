import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragframe.functions import ids
from ragframe.operators import chunking
from ragframe.settings import INDEX_BLOCK, PAGED_SEPARATORS, PLAIN_SEPARATORS

TEXTS = st.text(alphabet="ab \n#", max_size=400)


@given(TEXTS, st.integers(5, 60), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_spans_cover_the_text(text, size, overlap):
    for separators in (PLAIN_SEPARATORS, PAGED_SEPARATORS):
        spans = list(chunking.sized_spans(text, 0, len(text), size, overlap, separators))
        if not text:
            continue
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
            assert a < c <= b <= d and b - c <= overlap
        assert all(0 < b - a <= size for a, b in spans)


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_sections_put_together_are_the_text(text):
    sections = [span for span, _ in chunking.header_sections(text)]
    assert "".join(text[a:b] for a, b in sections) == text


def pieces(text, size, overlap, separators):
    rule = (size, overlap, separators)
    return [c[1] for c in chunking.document_chunks(text, rule, False)]


def test_separator_order():
    text = "one two\n\nthree four\nfive"
    assert pieces(text, 12, 0, PLAIN_SEPARATORS) == ["one two", "three four", "five"]
    assert pieces("abcdefghij", 4, 1, PLAIN_SEPARATORS) == ["abcd", "defg", "ghij"]
    assert pieces("aa bb cc dd", 6, 3, PLAIN_SEPARATORS) == ["aa bb", "bb cc", "cc dd"]
    assert pieces("x\n## Head\nbody", 10, 0, PAGED_SEPARATORS) == ["x", "## Head", "body"]
    assert pieces(" \n ", 10, 0, PLAIN_SEPARATORS) == []


def test_markdown_headers(spark):
    text = (
        "before\n# A\na text\n## B\nb text\n### C\n```\n# fenced\n```\n# D\nd text\n#### deep\n#no header"
    )
    df = spark.createDataFrame([("s", text)], "source_id string, text string")
    rows = chunking.split_markdown(df).orderBy("pos").collect()
    assert [(r.h1, r.h2, r.h3) for r in rows] == [
        (None, None, None),
        ("A", None, None),
        ("A", "B", None),
        ("A", "B", "C"),
        ("D", None, None),
    ]
    assert rows[1].text == "# A\na text" and rows[3].text.endswith("```")
    assert rows[4].text.endswith("#no header")
    assert all(text[r.start : r.start + len(r.text)] == r.text for r in rows)


def test_split_documents_by_format(spark):
    long = "word " * 400
    rows = [("a.md", f"# T\n{long}"), ("b.PDF", long), ("c.pdf#p2", long), ("d.txt", long), ("e.txt", "")]
    df = spark.createDataFrame(rows, "source_id string, text string")
    out = chunking.split_documents(df).collect()
    longest = {}
    for r in out:
        longest[r.source_id] = max(longest.get(r.source_id, 0), len(r.text))
    assert longest["a.md"] > 700 and longest["d.txt"] > 700
    assert 580 < longest["b.PDF"] <= 700 and 580 < longest["c.pdf#p2"] <= 700
    assert "e.txt" not in longest
    assert {r.h1 for r in out if r.source_id == "a.md"} == {"T"}
    for sid in longest:
        got = sorted(r.chunk_index for r in out if r.source_id == sid)
        assert got == list(range(len(got)))


def test_fixed_windows_equal_the_last_separator(spark):
    text = "".join(chr(97 + i % 26) for i in range(2000))
    for n in (0, 1, 149, 150, 900, 901, 1650, 1651, 2000):
        df = spark.createDataFrame([(text[:n],)], "text string")
        got = [r.text for r in chunking.chunk_fixed(df).orderBy("pos").collect()]
        assert got == pieces(text[:n], 900, 150, ("",)), n


def test_chunk_id(spark):
    df = spark.createDataFrame([("runbook.md", 0), ("ä/ü.md#p3", 17)], "source_id string, chunk_index int")
    got = [r.chunk_id for r in ids.with_chunk_id(df).collect()]
    assert got[0] == "87c7ebeb-50c0-56bb-8d9a-afd90390039e"
    assert got[1] == str(uuid.uuid5(uuid.NAMESPACE_URL, "ä/ü.md#p3::17"))


def test_chunk_index_of_a_source_with_many_documents(spark):
    """One source over several blocks, with gaps, next to small ones."""
    hot = [("hot", i * 700, p) for i in range(60) for p in range(i % 4)]
    small = [(f"s{i}", 0, p) for i in range(20) for p in range(2)]
    df = spark.createDataFrame(hot + small, "source_id string, doc_order long, pos int")
    assert max(r[1] for r in hot) > 5 * INDEX_BLOCK
    got = {(r.source_id, r.doc_order, r.pos): r.chunk_index for r in ids.with_chunk_index(df).collect()}
    assert [got[k] for k in sorted(hot)] == list(range(len(hot)))
    assert all(got[(s, o, p)] == p for s, o, p in small)


def test_document_names(spark):
    df = spark.createDataFrame([("A.MD",), ("x.pdf#p1",), ("x.PDF",), ("x.pdf.txt",), ("md",)], "s string")
    assert [r[0] for r in df.select(ids.doc_format(F.col("s"))).collect()] == [
        "md",
        "pdf",
        "pdf",
        "other",
        "other",
    ]


def test_fences_end_with_their_own_mark():
    text = "```\n~~~\n# code\n```\n# real\n``` x ```\n## more\n~~~\n# no\n```\n~~~\n### last"
    found = [headers for _, headers in chunking.header_sections(text)]
    assert found[-1] == ("real", "more", "last")
    assert all(h[0] in (None, "real") for h in found)


def test_documents_of_one_source_are_numbered_through(spark):
    from ragframe.plans.ingest import chunk_documents

    rows = [("a.md", "# t\none"), ("a.md", "# t\ntwo"), ("b.txt", "three")]
    docs = spark.createDataFrame(rows, "source_id string, text string").withColumn("doc_type", F.lit("project"))
    found = chunk_documents(docs).collect()
    assert len({r.chunk_id for r in found}) == 3
    assert sorted((r.source_id, r.chunk_index) for r in found) == [("a.md", 0), ("a.md", 1), ("b.txt", 0)]


def test_the_splitters_sql_cuts_as_the_splitter():
    """The oracle's own rule against the splitter, with small sizes, so that every case comes up."""
    import duckdb
    import numpy as np

    from ragframe.plans import oracles as sql

    rng = np.random.default_rng(11)
    letters = np.array(list("abc  \n\n#"))
    texts = ["".join(rng.choice(letters, rng.integers(0, 120))) for _ in range(300)]
    texts += ["", " \n ", "abcdefghijklmnop" * 3, "\n\n\n", "a\n\n" + "b" * 30 + "\n\nc d", "\n## x\n# y\n\nz"]
    db = duckdb.connect()
    db.execute("create table t (id int, text varchar)")
    db.executemany("insert into t values (?, ?)", list(enumerate(texts)))
    for size, overlap, separators in ((12, 4, PLAIN_SEPARATORS), (7, 0, PLAIN_SEPARATORS), (15, 6, PAGED_SEPARATORS)):
        rule = f"{size} AS size, {overlap} AS overlap, {sql._separators(separators)} AS seps"
        query = sql.recursive(
            sql.split_cuts(sql.whole_roots("t", "id", rule), "t", "id"),
            select="SELECT key, first, last FROM cuts ORDER BY ALL",
        )
        wanted = [
            (i, c[0], c[0] + len(c[1]))
            for i, t in enumerate(texts)
            for c in chunking.document_chunks(t, (size, overlap, separators), False)
        ]
        assert [tuple(map(int, r)) for r in db.sql(query).fetchall()] == sorted(wanted)
        # what every splitter keeps would not tell these cuts from others
        other = [
            (i, c[0], c[0] + len(c[1]))
            for i, t in enumerate(texts)
            for c in chunking.document_chunks(t, (1, 0, separators), False)
        ]
        assert sorted(other) != sorted(wanted)
