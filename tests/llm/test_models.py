import itertools
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragframe.llm import langid, quality, toxicity
from ragframe.llm.common import held_out, table
from ragframe.llm.queries import QUERIES


def accuracy(spark, sf_dir, name, label):
    found = QUERIES[name](spark, sf_dir)
    known = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
    rows = found.join(known, "doc_id").where("held_out").select("label", "predicted", "score").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    return np.mean([r.label == r.predicted for r in rows]), rows


def test_quality_on_held_out_rows(spark):
    share, rows = accuracy(spark, "/root/testdata/sf0.01", "op5_quality", "quality")
    assert share > 0.93 and {r.label for r in rows} == {0, 1}


def test_toxicity_on_held_out_rows(spark):
    share, rows = accuracy(spark, "/root/testdata/sf0.01", "op1_toxicity", "toxic")
    assert share > 0.88
    clean = [r.predicted for r in rows if not r.label]
    assert np.mean(clean) < 0.03


def test_languages_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = QUERIES["op8_langid"](spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 1, 0, 5])
    scores, moves = rng.normal(size=9), rng.normal(size=(2, 2))
    found, at = toxicity.marginals(scores, sizes, moves), 0
    for n in sizes:
        total, hit = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=int(n)):
            value = sum(scores[at + i] for i, t in enumerate(tags) if t)
            value = np.exp(value + sum(moves[a, b] for a, b in itertools.pairwise(tags)))
            total += value
            hit += value * np.array(tags, float)
        assert np.allclose(found[at : at + n], hit / total)
        at += n
    assert toxicity.marginals(np.zeros(0), np.zeros(0, int), moves).size == 0


def test_offsets():
    text = "ab  cd\nef gh"
    assert toxicity.offsets(text, np.array([False, True, True, False])) == [{"start": 4, "end": 9}]


def test_mixture_of_two_languages():
    logs = np.full((40, 3), -10.0)
    logs[:30, 0], logs[30:, 2] = -2, -2
    chosen, part = langid.mixture(logs)
    assert chosen == [0, 2] and part == pytest.approx([0.75, 0.25], abs=0.01)
    chosen, part = langid.mixture(logs[:30])
    assert chosen == [0] and part.tolist() == [1]


def test_odd_rows(odd, none, labels):
    rest = held_out(F.col("doc_id"), 4, 2)
    for docs in (odd, none):
        model = quality.fit(docs, labels, "quality", rest)
        scored = quality.score(docs, model)
        assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"]
        assert all(0 <= r.score <= 1 for r in scored.collect())
        field = toxicity.fit(docs, labels, "toxic", rest)
        assert all(0 <= r.toxicity.score <= 1 for r in toxicity.score(docs, field).collect())
        found = langid.identify(docs, langid.learn(docs, rest)).collect()
        assert len(found) == docs.count()
        for r in found:
            assert (r.language.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert quality.score(none, quality.fit(odd, labels, "quality", rest)).count() == 0


def test_labels_of_held_out_rows_do_not_matter(odd, labels, spark):
    rest = held_out(F.col("doc_id"), 4, 2)
    flipped = labels.withColumn("quality", F.when(rest, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [
        {r.doc_id: r.score for r in quality.score(odd.where("doc_id < 7"), quality.fit(odd, x, "quality", rest)).collect()}
        for x in (labels, flipped)
    ]
    assert scores[0] == pytest.approx(scores[1])


def test_numerals_are_no_letters(spark):
    languages = langid.learn(spark.createDataFrame([(1, "le mot", "fr"), (2, "das Wort", "de")], "doc_id long, text string, lang string"), F.lit(False))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["²", "½ 12", "Ⅷ ①", "_", "٣", "mot²", "字", "ª"])], "doc_id long, text string")
    found = {r.text: r.language.lang_pred for r in langid.identify(docs, languages).collect()}
    assert [t for t, lang in found.items() if lang == "und"] == ["²", "½ 12", "Ⅷ ①", "_", "٣"]
    assert found["mot²"] == "fr"


def test_mixture_of_six_languages():
    logs = np.full((60, 8), -12.0)
    for i in range(6):
        logs[10 * i : 10 * i + 10, i] = -2
    chosen, part = langid.mixture(logs)
    assert sorted(chosen) == list(range(6)) and part == pytest.approx([1 / 6] * 6, abs=0.01)


def test_language_counts_equal_plain_python(spark):
    rows = [(1, "le mot le", "fr"), (2, "Das Wort", "de"), (2, "das", "de"), (3, None, "de"), (4, "x", None), (5, "12", "it")]
    languages = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), F.lit(False))
    assert languages.names == ["de", "fr"]
    for i, words in enumerate((["das", "wort", "das"], ["le", "mot", "le"])):
        counts = np.full(langid.BUCKETS, langid.SMOOTHING)
        for word in words:
            for buckets, _ in langid.grams([word]):
                np.add.at(counts, buckets, 1)
        assert np.allclose(languages.logs[:, i], np.log(counts / counts.sum()))


def test_gradient_equals_differences():
    rng = np.random.default_rng(5)
    width = toxicity.FEATURES + 1
    weights = [rng.normal(0, 0.3, width) for _ in range(3)]
    for w in weights:
        w[-1] = 0
    field = toxicity.Field(*weights, -0.4, rng.normal(size=(2, 2)), (0.0, 0.0, 0.0))
    slots = toxicity._slots(["Alpha", "beta,", "c", "--"])
    rows, sizes = np.array([0, 1, 2, 3, 1, 0]), np.array([4, 2])
    tags = np.array([0, 1, 1, 0, 0, 1], np.int8)
    slope = toxicity._gradient(field, slots.ravel(), rows, sizes, tags)

    def likelihood(field):
        table = np.stack([w[slots].sum(axis=1) for w in (field.own, field.before, field.after)], axis=1)
        scores, at, total = toxicity.token_scores(rows, sizes, table, field.bias), 0, 0.0
        for n in sizes:
            value = {
                t: sum(scores[at + i] for i in range(n) if t[i]) + sum(field.moves[a, b] for a, b in itertools.pairwise(t))
                for t in itertools.product((0, 1), repeat=int(n))
            }
            total += value[tuple(tags[at : at + n])] - np.logaddexp.reduce(list(value.values()))
            at += n
        return total

    def moved(part, place, by):
        parts = [field.own.copy(), field.before.copy(), field.after.copy(), field.bias, field.moves.copy()]
        if part == 3:
            parts[3] += by
        else:
            parts[part].reshape(-1)[place] += by
        return likelihood(toxicity.Field(*parts, field.calibration))

    for part in range(3):
        for place in {int(s) for s in slots.ravel() if s < toxicity.FEATURES}:
            near = (moved(part, place, 1e-5) - moved(part, place, -1e-5)) / 2e-5
            assert slope[part * width + place] == pytest.approx(near, abs=1e-6)
    for place in range(4):
        near = (moved(4, place, 1e-5) - moved(4, place, -1e-5)) / 2e-5
        assert slope[-5 + place] == pytest.approx(near, abs=1e-6)
    assert slope[-1] == pytest.approx((moved(3, 0, 1e-5) - moved(3, 0, -1e-5)) / 2e-5, abs=1e-6)


def test_words_in_bulk_equal_single_ones():
    rng = np.random.default_rng(6)
    field = toxicity.Field(*(rng.normal(size=toxicity.FEATURES + 1) for _ in range(3)), 0.0, np.zeros((2, 2)), (0.0, 0.0, 0.0))
    for w in (field.own, field.before, field.after):
        w[-1] = 0
    words = toxicity.Words(field)
    texts = ["one Two, three one", "", "two one " + "x" * 200, "--"]
    rows, sizes, table = words.read(texts)
    assert sizes.tolist() == [4, 0, 3, 1]
    for row, word in zip(rows, " ".join(texts).split(), strict=True):
        slots = [s for s in toxicity._slots([word])[0] if s < toxicity.FEATURES]
        assert np.allclose(table[row], [w[slots].sum() for w in (field.own, field.before, field.after)])


def test_models_reach_workers_without_the_package(tmp_path):
    """Tasks of a session that was started elsewhere do not find the package on their path."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
import __spark_entry__ as entry
from ragframe.session import local_session
spark = local_session("elsewhere", "2")
for name in ("op1_toxicity", "op5_quality", "op8_langid"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() == 200
"""
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
