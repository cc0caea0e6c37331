import itertools
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ragframe.llm import collocations, html, variants

ODD_PAGES = [
    (1, "http://a/1", "<article><h1>T</h1><p>One, two &amp; three.</p></article>", 5),
    (2, "http://a/2", None, 5),
    (2, None, "", 5),
    (None, "http://a/3", "<p>no id</p>", None),
    (4, "http://a/4", "<div>" * 3000 + "deep" + "</div>" * 3000, 1),
    (5, "http://a/5", "<p>" + "long words, " * 50_000 + "</p>", 1),
    (1, "http://a/1", "<article><h1>T</h1><p>One, two &amp; three.</p></article>", 5),
]


# --- spelling variants -------------------------------------------------------


def edits(a: str, b: str) -> bool:
    """Exactly one letter inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, slips):
    out = Counter()
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    out.pop("", None)
    return out


def brute_forms(words: dict[str, int]) -> set:
    near = {w: [x for x in words if edits(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            if words[best] >= 5 * words[w]:
                form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def test_forms_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(variants, "GROUP", 3)
    letters = "abé"
    words = {"".join(w): 1 + i * i % 97 for n in (2, 3, 4) for i, w in enumerate(itertools.product(letters, repeat=n))}
    words |= {"aaaaaa" * 20: 9, "aaaaaa" * 20 + "b": 1, "a": 500, "conversation": 500, "conversaton": 10, "conversatin": 1}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = variants.variant_forms(df).collect()
    brute = brute_forms({w: n for w, n in words.items() if len(w) > 1})
    assert {tuple(r) for r in got} == brute | {("a", None, "a", 500, 0, None)}
    assert len(got) == len(words)


def test_links_come_once(spark, monkeypatch):
    monkeypatch.setattr(variants, "GROUP", 2)
    words = ["aaaa", "aaaaa", "aaaaaa", "aabaa", "abab", "ababa", "baba", "babab", "aab", "aba", "baa"]
    found = variants.near_links(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    pairs = [frozenset((r.s, r.t)) for r in found]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {frozenset(p) for p in itertools.combinations(words, 2) if edits(*p)}


def test_a_slip_is_found_and_mended(spark):
    rows = [(i, "Conversation Straße straße ÀÉÎ " * 3) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = brute_words(rows, 199)
    assert {tuple(r) for r in variants.word_counts(docs, 199).collect()} == set(counts.items())
    got = {r.word: r for r in variants.spelling_variants(docs, least_count=1, slips=199).collect()}
    wrong = {w for w in counts if len(w) >= 6 and w not in ("conversation", "straße")}
    assert wrong and all(got[w].root in ("conversation", "straße") for w in wrong)


def test_variants_of_odd_rows(odd, none):
    counts = {r.word: r.n for r in variants.word_counts(odd).collect()}
    assert counts == dict(brute_words([(r.doc_id, r.text) for r in odd.collect()], None))
    got = variants.spelling_variants(odd, least_letters=2, least_count=1).collect()
    assert {tuple(r) for r in got} == brute_forms({w: n for w, n in counts.items() if len(w) > 1})
    assert variants.spelling_variants(none).count() == 0
    assert variants.spelling_variants(none, slips=199).columns == ["word", "form", "root", "n", "n_near", "form_n"]


# --- collocations ------------------------------------------------------------


def brute_phrases(rows, least=10, most=2000):
    grams, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f = grams.setdefault(lang, Counter())
            for size in (1, 2, 3):
                f.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in grams.items():
        found = []
        for phrase, a in f.items():
            if len(phrase) == 1 or a < least:
                continue
            if len(phrase) == 2 and any(
                100 * b >= 50 * a for p, b in f.items() if len(p) == 3 and b >= least and phrase in (p[:2], p[1:])
            ):
                continue
            cuts = [(10**6 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]]) for k in range(1, len(phrase))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return set(out)


def same_phrases(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n long, phrase string").repartition(3)
    got = collocations.collocations(docs, **options).collect()
    assert {tuple(r) for r in got} == brute_phrases(rows, **options)
    assert len({(r.lang, r.rank) for r in got}) == len(got)


def test_phrases_equal_brute_force(spark):
    text = "In the end, the end of the line was the end of the line. New York; new york\tNew  York!"
    rows = [("en", text)] * 7 + [("de", text), (None, "na na na na na na na na na na na na na na"), ("en", None), ("en", "")]
    rows += [("en", "a b a b a b a b a b a b a b a b a b a b a b a b a b")]
    rows += [("en", f"start {i} alpha beta gamma delta epsilon stop {i}") for i in range(12)]
    rows += [("und", "na na"), ("fr", "où là\x0boù là\x0coù là x"), ("fr", "où là " * 30)]
    same_phrases(spark, rows)
    same_phrases(spark, rows, least=2)
    same_phrases(spark, rows, least=2, most=3)


def test_phrases_do_not_depend_on_slices(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 64)
    monkeypatch.setattr(collocations, "GRAMS_HELD", 40)
    monkeypatch.setattr(collocations, "PATH_EDGES", 2)
    words = "one two three four five six seven eight nine ten".split()
    rows = [("en", " ".join(words[(i * j) % 10] for j in range(60 + i))) for i in range(20)]
    same_phrases(spark, rows, least=3)


def test_a_path_is_one_row(spark):
    rows = [("en", "the quick brown fox jumps over a lazy dog")] * 3 + [("en", "a lazy cat")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string")
    edges = collocations.grams(docs, 2)
    found = collocations.paths(edges, collocations._flows(edges, 2), 2).collect()
    texts = {" ".join(r.words): r for r in found}
    # (a, lazy) has two ways out
    assert set(texts) == {"the quick brown fox jumps over a lazy", "a lazy dog", "a lazy cat"}
    long = texts["the quick brown fox jumps over a lazy"]
    assert long.weights == [3] * 6 and long.flows == [3] * 6 + [6] and long.counts == [3] * 6 + [6, 6]


def test_large_counts_are_exact(spark):
    a, left, right = 123_456_789_012_345, 223_456_789_012_345, 143_456_789_012_345
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations._cut("a", "l", "r", 1).alias("cut"))
    assert row.first().cut.score == 10**6 * a * a // (left * right)


def test_phrases_of_odd_rows(odd, none):
    got = {tuple(r) for r in collocations.collocations(odd, least=2).collect()}
    assert got == brute_phrases([(r.lang, r.text) for r in odd.collect()], least=2)
    assert collocations.collocations(none).count() == 0


# --- main text ---------------------------------------------------------------

LONG = "This is a longer paragraph, with a comma, and quite a few words so that it scores well against what is around."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<html><head><title>t</title></head><body></body></html>", ""),
        ("just text &amp; more&nbsp;of &lt;it&gt; &#8364; &AMP", "just text & more of <it> € &"),
        (
            f'<div id="header"><a href=/>Site</a></div><div class="menu"><ul><li><a>A</a><li><a>B</a></ul></div>'
            f'<div class="with-sidebar"><div class="content"><h1>Title</h1><p>{LONG}<p>short</p></div>'
            f'<div class="sidebar"><p>{LONG}</p></div></div><div id="comments"><p>{LONG}</p><p>{LONG}</p></div>',
            f"Title {LONG} short",
        ),
        (f"<table><tr><td><a>x</a><br><a>y</a></td><td><p>{LONG}</p><p>{LONG}</p></td></tr></table>", f"{LONG} {LONG}"),
        (
            f"<main><section><h2>A</h2><p>{LONG}</p></section><section><p>{LONG}</p></section><aside>no</aside></main>",
            f"A {LONG} {LONG}",
        ),
        (f"<div><div><p>{LONG}</p></div><div><p>{LONG}</p></div></div><div><a>1</a> <a>2</a></div>", f"{LONG} {LONG}"),
        (
            f'<article><header><h1>T</h1><p class=byline>by X</p></header><p>{LONG}</p><form>f</form>'
            f'<div class="cookieNotice">c</div><ul><li>one</li></ul><ul><li><a>m</a><li><a>n</a></ul></article>',
            f"T {LONG} one",
        ),
        (
            '<nav><a>n</a></nav><article><h1>T</h1><p>Ok.</p></article>'
            '<div class="ad">Buy this, now, really, cheap, big, and more, and still more text.</div>',
            "T Ok.",
        ),
        ("<article><p>one<b>two<p>three &am", "onetwo three &am"),
        ('<article><script>var a="<p>x</p>";</script><p>x<!-- c --> y</p>\n<pre>a\n b</pre></article><p>t <a href="x', "x y a b"),
        (f"<h1>Head</h1><div class=post><p>{LONG}</p></div>", f"Head {LONG}"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=a>", "</div>", "<b", "</b>", "<ul><li>", "x, y", "&lt", "<!--", "-->", "<a href='", "'>", "<td>", "</table>", "<![CDATA[", "<?", "\n"])))
def test_broken_pages_are_read(parts):
    text = html.main_text("".join(parts))
    assert text == " ".join(text.split())


def test_pages_of_the_table(spark):
    """These pages hold one article each, in known places."""
    from ragframe.llm.common import table
    from ragframe.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in QUERIES["op13_html"](spark, sf_dir).collect()}
    import html as entities

    rows = table(spark, sf_dir, "pages").collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1)
        want = " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_odd_pages(spark):
    pages = spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string, text long")
    got = html.extract(pages).collect()
    assert len(got) == len(ODD_PAGES)
    assert sorted((r.text[:9], r.n_chars) for r in got) == sorted(
        [("T One, tw", 19)] * 2 + [("", 0)] * 2 + [("no id", 5), ("deep", 4), ("long word", 599_999)]
    )
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_variants", "op12_collocations"])
def test_queries_equal_sql(spark, name):
    from ragframe.llm.queries import ORACLES, QUERIES

    sf_dir = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    theirs = db.sql(ORACLES[name])
    mine = QUERIES[name](spark, sf_dir).select(*theirs.columns)
    assert sorted(map(str, map(tuple, mine.collect()))) == sorted(map(str, theirs.fetchall()))
