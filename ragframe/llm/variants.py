"""Spelling variants: words one edit apart, and the frequent word that a rare one is a form of.

Words meet by asymmetric chunks. A word of ``size`` letters contributes its two disjoint halves, as chunks; a word of
the same size or one letter longer contributes the grams that can equal them. One edit lies in one of the halves, so the
other is preserved: the first at its place, the second shifted by the difference in length. A key thus is a word
without the window that may hold the edit. A key that more than ``GROUP`` words share is not joined: its words meet
again by both halves of its window, down to windows of one letter, where the letters themselves bound a group. The
place of the first difference lies in one window only, so each pair is found once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import Batches, raw_text, saved, text_batches

# Words that a key may have before its window is halved.
GROUP = 24
# Distinct words that a scan task holds before it hands on their counts.
HELD = 200_000

# Text is lower-cased (A-Z) before.
_RUN = re.compile("[a-zÀ-ÿ]+")


def slipped(run: str, crc: int, slips: int) -> str:
    """``run`` without one letter if ``slips`` divides the checksum ``crc``."""
    if crc % slips:
        return run
    place = crc % len(run)
    return run[:place] + run[place + 1 :]


def word_counts(docs: DataFrame, slips: int | None = None) -> DataFrame:
    """(word, n): runs of Latin letters in all whole texts, A-Z in lower case, and how often they occur.

    With ``slips``, a run of a document loses a letter where ``slips`` divides the crc32 of ``<doc_id>:<run>``, as if
    mistyped; a null id counts as the text ``null``. Null texts have no words. Other columns are ignored.
    """

    def count(batches: Batches) -> Batches:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Counter(_RUN.findall(raw.lower().decode("utf-8", "replace")))
                if slips is None:
                    held.update(found)
                    continue
                begun = zlib.crc32(f"{doc_id}:".encode())
                for run, n in found.items():
                    held[slipped(run, zlib.crc32(run.encode(), begun), slips)] += n
            if len(held) > HELD:
                yield counted(held)
                held = Counter()
        yield counted(held)

    def counted(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
        )

    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    counts = text_batches(docs.select(doc_id, raw_text().alias("raw")), count, "word string, n bigint")
    return counts.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(tokens: DataFrame) -> DataFrame:
    """A key per token: the word without its window, and all that says where the window is."""
    before = F.expr("substring(word, 1, a)")
    after = F.expr("substring(word, b + longer + 1)")
    return tokens.withColumn("key", F.concat_ws("|", "size", "a", "b", before, after))


def _halves(a: Column, b: Column) -> Column:
    middle = F.floor((a + b) / 2).cast("int")
    return F.array(
        F.struct(a.cast("int").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), b.cast("int").alias("b"))
    )


def _windowed(tokens: DataFrame, a: Column, b: Column) -> DataFrame:
    kept = tokens.select("word", "n", "size", "longer", F.explode(_halves(a, b)).alias("w"))
    return _keyed(kept.select("word", "n", "size", "longer", "w.a", "w.b"))


def near_links(words: DataFrame) -> DataFrame:
    """Pairs of ``words`` (word, n; distinct, of two letters or more) one edit apart, each once: s, s_n, t, t_n.

    ``t`` is one letter longer, or of the same length and behind in code-point order. Null and empty words, and words
    of one letter, link with nothing.
    """
    length = F.length("word")
    sides = F.array(
        F.struct(length.alias("size"), F.lit(0).alias("longer")),
        F.struct((length - 1).alias("size"), F.lit(1).alias("longer")),
    )
    tokens = words.where(length >= 2).select("word", "n", F.explode(sides).alias("side")).where("side.size >= 2")
    tokens = _windowed(tokens.select("word", "n", "side.size", "side.longer"), F.lit(0), F.col("size"))
    links = None
    while True:
        tokens = saved(tokens, "variant-keys")
        groups = tokens.groupBy("key").agg(
            F.count(F.when(F.col("longer") == 0, 1)).alias("base"), F.count(F.lit(1)).alias("words")
        )
        # without a base word, or alone, a key links nothing
        groups = groups.where("base > 0 and words > 1")
        done = (F.col("words") <= GROUP) | (F.col("b") - F.col("a") == 1)
        split = saved(tokens.join(groups.select("key", "words"), "key").withColumn("done", done), "variant-groups")
        found = saved(_joined(split.where("done")), "variant-links")
        links = found if links is None else links.unionByName(found)
        tokens = split.where("not done")
        if tokens.isEmpty():
            return links
        tokens = _windowed(tokens, F.col("a"), F.col("b"))


def _joined(tokens: DataFrame) -> DataFrame:
    """Pairs of one key that are one edit apart and first differ within its window."""
    base = tokens.where("longer = 0").select("key", "size", "b", F.col("word").alias("s"), F.col("n").alias("s_n"))
    other = tokens.select("key", "longer", F.col("word").alias("t"), F.col("n").alias("t_n"))
    pairs = base.join(other, "key").where("longer = 1 or s < t")
    within = F.expr("b = size or substring(s, 1, b) <> substring(t, 1, b)")
    return pairs.where(within & (F.levenshtein("s", "t", 1) == 1)).select("s", "s_n", "t", "t_n")


def variant_forms(words: DataFrame, times: int = 5) -> DataFrame:
    """Per row of ``words`` (word, n; distinct): word, form, root, n, n_near, form_n.

    ``form`` is the most frequent near word (of equals the first in code-point order) if it occurs ``times`` as often as
    the word itself; ``root`` is the end of the chain of forms, the word itself without one.
    """
    links = near_links(words)
    both = links.unionByName(links.select(*[F.col(c).alias(d) for c, d in zip(("t", "t_n", "s", "s_n"), links.columns, strict=True)]))
    near = both.groupBy(F.col("s").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"),
        F.max("s_n").alias("n"),
        F.min(F.struct((-F.col("t_n")).alias("less"), F.col("t").alias("t"))).alias("best"),
    )
    better = -F.col("best.less") >= times * F.col("n")
    near = near.select(
        "word",
        "n_near",
        F.when(better, F.col("best.t")).alias("form"),
        F.when(better, -F.col("best.less")).alias("form_n"),
    )
    near = saved(near, "variant-near")
    roots = _roots(near.where("form is not null").select("word", F.col("form").alias("root")))
    whole = words.select("word", "n").join(near, "word", "left").join(roots, "word", "left")
    return whole.select(
        "word",
        "form",
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        "form_n",
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): ends of the chains of forms. Each round doubles the steps that a row has taken."""
    state = saved(forms, "variant-roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = state.join(ahead, "root", "left")
        moved = saved(
            moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "variant-roots",
        )
        state = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return state


def spelling_variants(
    docs: DataFrame, least_letters: int = 6, least_count: int = 5, times: int = 5, slips: int | None = None
) -> DataFrame:
    """Variants among the words of ``docs`` (doc_id, text) with so many letters and occurrences."""
    counts = word_counts(docs, slips).where((F.length("word") >= least_letters) & (F.col("n") >= least_count))
    return variant_forms(saved(counts, "variant-words"), times)


# crc32 by its table, made by its rule; a letter from À to ÿ is two bytes, the second its code point less 64.
ORACLE = r"""
with recursive steps as (
    select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
        lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crcs),
runs as (
    select coalesce(doc_id::varchar, 'null') as id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run
    from documents),
counted as (select id, run, count(*) as n from runs group by all),
bytes as (
    select id, run, n, flatten(list_transform(string_split(id || ':' || run, ''),
        lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end)) as b
    from counted),
sums as (
    select run, n, xor(4294967295, list_reduce(list_concat([4294967295::bigint], b),
        lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1]))) as h
    from bytes, steps),
written as (
    select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n
    from sums),
words as (
    select word, sum(n)::bigint as n from written where length(word) >= 6 group by word having sum(n) >= 5),
less as (
    select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest
    from (select word, n, unnest(range(length(word))) as i from words)),
near as (
    select a.word, b.word as other, b.n as other_n from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
    union select l.word, w.word, w.n from less l join words w on w.word = l.rest
    union select w.word, l.word, l.n from less l join words w on w.word = l.rest),
best as (
    select word, count(*) as n_near, max(other_n) as most, min(struct_pack(less := -other_n, other := encode(other))) as b
    from near group by word),
formed as (
    select w.word, w.n, coalesce(n_near, 0) as n_near, case when most >= 5 * w.n then decode(b.other) end as form,
        case when most >= 5 * w.n then most end as form_n
    from words w left join best using (word)),
chain as (
    select word, word as root, 0 as step from formed
    union all select c.word, f.form, step + 1 from chain c join formed f on c.root = f.word where f.form is not null),
roots as (select word, arg_max(root, step) as root from chain group by word)
select word, form, root, n, n_near, form_n from formed join roots using (word)
"""
