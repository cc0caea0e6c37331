import hashlib
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ragframe.llm import chat, mixing, rules
from ragframe.llm.common import table


def targets(sizes):
    """Reshare what sources cannot take until none is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 3 * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    rows = [(i, f"w{i} " * (i % 17 + 1), ["b", "a", None, "c", "d"][min(4, i % 23)]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = mixing.mix(docs).collect()
    assert len(found) == 600
    sizes, taken = Counter(), Counter()
    source = {i: s for i, _, s in rows}
    for r in found:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert r.taken in [r.size * k for k in range(4)]
    want = targets(sizes)
    for r in found:
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert r.source_size == sizes[source[r.doc_id]]
    assert all(abs(taken[s] - want[s]) <= 18 for s in want)
    assert sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix(docs.repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in found}


def test_mix_odd_rows(odd, none):
    found = mixing.mix(odd).collect()
    assert len(found) == odd.count()
    assert {r.size for r in found if r.doc_id in (3, 4, 5)} == {0}
    taken = mixing.take_mix(odd)
    assert taken.columns == odd.columns and taken.count() > 0
    assert mixing.mix(none).count() == 0 and mixing.take_mix(none).count() == 0


def test_take_mix_repeats_rows(spark):
    docs = spark.createDataFrame([(i, f"x{i} y", "ab"[i % 10 > 0]) for i in range(100)], "doc_id long, text string, source string")
    times = {r.doc_id: r.taken // 2 for r in mixing.mix(docs).collect()}
    assert Counter(r.doc_id for r in mixing.take_mix(docs).collect()) == Counter({i: n for i, n in times.items() if n})


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(turns):
    return digest("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns))


def test_chat_round_trip(spark):
    control = "</s>[INST] ok [/INST]"
    long = "many words here " * 600
    convs = {
        1: [(0, "system", "be kind"), *[(i, "user" if i % 2 else "assistant", f"turn {i} " + "w " * (40 * i)) for i in range(1, 30)]],
        2: [(0, "user", control), (1, "assistant", control), (2, "assistant", "<\\|x <|turn|> [\\/INST] <\\\\|")],
        3: [(0, None, None), (1, "assistant", ""), (2, "a\n%0A%b<|", "x\n\n")],
        4: [(0, "user", long), (1, "assistant", long), (2, "assistant", "b"), (2, "assistant", "a"), (2, "assistant", "a")],
        None: [(0, "assistant", "hi")],
    }
    rows = [(c, t, r, x) for c, turns in convs.items() for t, r, x in turns]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for found in chat.format_conversations(turns).collect():
        have = sorted(convs[found.conv_id], key=lambda x: (x[0], x[1] or "", x[2] or ""))
        learnt = "".join(t or "" for _, r, t in have if r == "assistant")
        assert found.n_turns == len(have)
        assert found.turns_sha256 == told(have)
        assert (found.loss_chars, found.loss_sha256) == (len(learnt), digest(learnt))
    windows = chat.windows(turns).where("conv_id = 1").orderBy("window").collect()
    assert len(windows) > 3
    for w in windows:
        assert w.formatted.startswith("<|turn|>system\nbe kind")
        new = w.formatted.split("<|turn|>")[w.context + 1 :]
        tokens = [len(re.findall(r"\S+", t.partition("\n")[2].removesuffix("<|end|>\n"))) + 4 for t in new]
        assert len(tokens) == 1 or sum(tokens) <= chat.STEP
    assert any(w.context > 1 for w in windows)


def test_chat_escapes_are_reversible(spark):
    texts = ["<|", "<\\|", "<\\\\|a", "[INST]", "[\\INST]", "</s><s>", "<<SYS>>", "plain < | text", "\\<|\\", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("back")).collect()
    for r in rows:
        assert r.back == r.t
        assert not re.search(r"<\||</?s>|\[/?INST\]", r.e)
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), failed


def test_rule_counts(spark, odd, none):
    texts = ["a b c a b c a b c", "x y z x y z", "l one\nl one\n \n \nl two\nl one", "a a a a", "p q", "#*$ é é <>|&%\n", "\n\n"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for rows in (docs.unionByName(odd.select(docs.columns)), docs):
        by = defaultdict(set)
        for r in rows.collect():
            by[r.doc_id].add(base(r.text))
        found = rules.judge(rows).collect()
        assert len(found) == rows.count()
        for r in found:
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
            assert got in by[r.doc_id]
            assert not (r.base_failed and r.kept)
    assert rules.judge(none).count() == 0


def test_rules_adapt_to_the_group(spark):
    def text(i, mark):
        return " ".join(f"w{i}n{j}{mark}" for j in range(60))

    rows = [(i, text(i, ""), "en", "clean") for i in range(120)] + [(200 + i, text(i, "|"), "en", "tables") for i in range(120)]
    rows += [(1000, text(1000, "|"), "en", "clean"), (1001, text(1001, "|||||||"), "en", "tables")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in rules.judge(docs).collect()}
    assert not kept[1000] and not kept[1001]
    assert all(v for k, v in kept.items() if k < 1000)


def test_native_operators_use_no_python(spark, odd, sf_dir):
    from ragframe.llm.queries import QUERIES

    for name in ("op2_mixing", "op6_chat", "op10_quality_rules"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|MapInArrow", plan)


def plain_limits(values, margin, two_sided):
    """(least, most, low, high) of a group's values, by sorting its bins."""
    bins = sorted(math.ceil(math.log(max(v, rules.SMALLEST)) / math.log(rules.GAMMA)) for v in values)

    def quantile(tenths):
        at = next(i for i in range(len(bins)) if 10 * (i + 1) >= tenths * len(bins))
        return rules.GAMMA ** bins[at] * (2 / (1 + rules.GAMMA))

    low, middle, high = quantile(1), quantile(5), quantile(9)
    below = low - ((middle - low) * rules.FENCE or margin) if two_sided else -math.inf
    return below, high + ((high - middle) * rules.FENCE or margin), low, high


def test_kept_equals_plain_python(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    counts, groups = {}, defaultdict(lambda: defaultdict(list))
    for r in docs.collect():
        n, chars, symbols, lines, repeats, failed = base(r.text)
        counts[r.doc_id] = (failed, r.lang, r.source, {} if failed else {
            "symbols": symbols / chars, "lines": lines / n, "repeats": repeats / n, "length": chars / n})
        if not failed:
            for group in ((r.lang, r.source), (r.lang,), ()):
                for rule, value in counts[r.doc_id][3].items():
                    groups[group][rule].append(value)
    limits = {}
    for group in sorted(groups, key=len):
        for rule, (_, margin, two_sided) in rules.RULES.items():
            wider = limits.get((group[:-1], rule)) if group else None
            own = plain_limits(groups[group][rule], margin, two_sided)
            small = group and len(groups[group][rule]) < rules.LEAST_ROWS
            beyond = wider and not (own[3] <= wider[1] and own[2] >= wider[0])
            limits[group, rule] = wider if small or beyond else own
    found = rules.judge(docs).collect()
    assert len(found) == len(counts)
    for r in found:
        failed, lang, source, measures = counts[r.doc_id]
        bad = [rule for rule, v in measures.items() if not limits[(lang, source), rule][0] <= v <= limits[(lang, source), rule][1]]
        assert (r.base_failed, r.failed_rules, r.kept) == (failed, bad, not failed and not bad)
    assert 0 < sum(bool(r.failed_rules) for r in found) < 0.2 * len(found)


def test_clashing_columns_change_no_verdict(odd):
    names = ["doc_id", "text", "lang", "source"]
    plain = Counter(map(str, rules.judge(odd.select(names)).collect()))
    clash = odd.select(*names, F.lit(1).alias("rule"), F.lit(2).alias("n_words"), F.lit(3).alias("limit"), F.lit("x").alias("kept"))
    assert Counter(map(str, rules.judge(clash).collect())) == plain


def test_odd_groups_do_not_set_their_own_limit(spark):
    def text(i, mark):
        return " ".join(f"w{i}n{j}{mark if j % 2 else ''}" for j in range(60))

    rows = [(i, text(i, ""), "en", "clean") for i in range(600)]
    rows += [(1000 + i, text(i, "$$$" if i % 5 == 0 else ""), "en", "bad") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert all(r.kept == (r.doc_id < 1000 or r.doc_id % 5 != 0) for r in rules.judge(docs).collect())
