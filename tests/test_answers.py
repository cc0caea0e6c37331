import json

import pytest
from pyspark.sql import functions as F

from ragframe.functions import artifacts as art
from ragframe.operators import answers, evaluation, grounding
from ragframe.plans import artifact, ask
from ragframe.settings import ARTIFACT_TOOLS, TOOL_LIST_FIELDS, TOOL_TEXT_FIELDS, UNKNOWN_ANSWER

HITS = "query_id string, rank int, source_id string, doc_type string, h1 string, text string, score double"


def hits(spark, rows):
    return spark.createDataFrame(rows, HITS)


def test_sources_keep_first_place_and_last_metadata(spark):
    df = hits(
        spark,
        [
            ("q", 1, "a", "project", "one", "x", 0.1),
            ("q", 2, None, "project", None, "y", 0.2),
            ("q", 3, "a", "external", None, "z", 0.3),
        ],
    )
    rows = {r.source_id: r for r in grounding.sources(df).collect()}
    assert rows["a"].position == 1 and rows["a"].meta == {"source_id": "a", "doc_type": "external"}
    assert rows["unknown_source"].position == 2
    lists = grounding.source_lists(df).first()
    assert lists.source_ids == ["a", "unknown_source"]
    assert grounding.contexts(df).first().context == (
        "[a]\nx\n\n---\n\n[unknown_source]\ny\n\n---\n\n[a]\nz"
    )


def test_gate(spark):
    df = hits(
        spark,
        [
            ("one", 1, "a", "p", None, "x", 0.5),
            ("one", 2, "a", "p", None, "x", 0.6),
            ("edge", 1, "a", "p", None, "x", 0.5),
            ("edge", 2, "b", "p", None, "x", 0.4),
            ("blank", 1, "", "p", None, "x", 0.1),
            ("blank", 2, "b", "p", None, "x", 0.1),
            ("far", 1, "a", "p", None, "x", 0.7),
            ("far", 2, "b", "p", None, "x", 0.41),
        ],
    )
    asked = spark.createDataFrame([("one",), ("edge",), ("none",), ("blank",), ("far",)], "query_id string")
    got = grounding.grounded(df, asked, min_docs=2, min_unique_sources=2, threshold=0.4)
    assert {r.query_id: r.grounded for r in got.collect()} == {
        "one": False,
        "edge": True,
        "none": False,
        "blank": False,
        "far": False,
    }


def test_prompt_without_sources(spark):
    asked = spark.createDataFrame([("q", "who is a@b.org? {context}")], "query_id string, question string")
    got = grounding.prompts(asked, hits(spark, []), "S", "C:{context} Q:{question} {{x}}").first()
    assert got.prompt == (
        "S\n\nC: Q:who is <EMAIL_ADDRESS>? {context} {x}\n\n"
        "Allowed source_ids for citations (use only these):\n- (none)"
    )


def valid_output(tool):
    out = {f: "some text" for f in TOOL_TEXT_FIELDS[tool]}
    out.update({f: ["a"] for f in TOOL_LIST_FIELDS[tool]})
    return out


def errors(spark, pairs):
    df = spark.createDataFrame(
        [(t, o if isinstance(o, str) or o is None else json.dumps(o)) for t, o in pairs],
        "tool string, output string",
    )
    return [r.error for r in answers.validate(df).collect()]


@pytest.mark.parametrize("tool", ARTIFACT_TOOLS)
def test_structured_outputs(spark, tool):
    good = valid_output(tool)
    lists = TOOL_LIST_FIELDS[tool]
    cases = [
        (good, None),
        ({**good, "extra": {"x": 1}}, None),
        ({**good, lists[0]: []}, None),
        ({**good, lists[0]: ["a", 1]}, "invalid_structured_output"),
        ({**good, lists[0]: ["a", None]}, "invalid_structured_output"),
        ({**good, lists[0]: "a"}, "invalid_structured_output"),
        ({k: v for k, v in good.items() if k != "sources"}, "invalid_structured_output"),
        ("[1]", "invalid_structured_output"),
        ("{", "invalid_structured_output"),
        (" \n", "empty_model_output"),
        (None, "empty_model_output"),
    ]
    if "title" in TOOL_TEXT_FIELDS[tool]:
        cases += [
            ({**good, "title": "four"}, "invalid_structured_output"),
            ({**good, "title": "fives"}, None),
            ({**good, "title": 12345}, "invalid_structured_output"),
        ]
    assert errors(spark, [(tool, o) for o, _ in cases]) == [e for _, e in cases]


def test_artifact_words_and_rules(spark):
    rows = [
        ("Create an ADR on queue selection", True, "adr"),
        ("Write an architecture decision record", True, "adr"),
        ("Create an outline with risks and assumptions", True, "solution_outline"),
        ("Provide a solution outline for rollout", True, "solution_outline"),
        ("Generate user stories and acceptance criteria", True, "user_stories"),
        ("Write user stories for access", True, "user_stories"),
        ("Prepare a risk assessment", True, "risk_assessment"),
        ("List project risks with mitigations", False, "ask"),
        ("What is the retention policy?", False, "ask"),
        ("Which stories are told?", False, "ask"),
        ("Which quadrant is it?", True, "adr"),
    ]
    df = spark.createDataFrame(rows, "q string, artifact boolean, tool string")
    got = df.select("*", art.is_artifact_request(F.col("q")).alias("a"), art.route_by_rules(F.col("q")).alias("t"))
    for r in got.collect():
        assert (r.a, r.t) == (r.artifact, r.tool), r.q


def test_tool_calls(spark):
    rows = [
        ("1", "Create an ADR", '{"tool": "adr", "args": {"decision": "d", "alternatives": ["x"]}}'),
        ("2", "Create an ADR", '{"tool": "adr", "args": {}}'),
        ("3", "Create an ADR", "nonsense"),
        ("4", "What is new?", '{"tool": "adr", "args": {}}'),
        ("5", "Create an ADR", '{"tool": "other", "args": {"request": "r"}}'),
        ("6", "Create an ADR", None),
    ]
    df = spark.createDataFrame(rows, "query_id string, question string, routing string")
    got = {r.query_id: r for r in artifact.tool_calls(df).collect()}
    assert (got["1"].tool, got["1"].request, got["1"].alternatives) == ("adr", "d", ["x"])
    assert got["1"].context_query == "Create an ADR"
    assert got["2"].alternatives == ["Option A", "Option B", "Option C"]
    assert {i: got[i].tool for i in "3456"} == dict.fromkeys("3456", "ask")
    assert got["4"].request == "What is new?"


def test_ask_responses(spark):
    df = hits(
        spark,
        [(q, 1, "docs/a.md", "project", None, "x", 0.2) for q in ("good", "bad", "unknown", "silent")]
        + [("far", 1, "docs/a.md", "project", None, "x", 0.9)],
    )
    names = ["good", "bad", "unknown", "silent", "far", "empty"]
    asked = spark.createDataFrame([(n, f"{n} of a@b.org") for n in names], "query_id string, question string")
    given = [
        ("good", "mail c@d.org [A.md]"),
        ("bad", "no source"),
        ("unknown", UNKNOWN_ANSWER.upper() + " sorry"),
        ("far", "x [a.md]"),
    ]
    drafts = spark.createDataFrame(given, "query_id string, answer string")
    got = {r.query_id: r for r in ask.respond(asked, df, drafts).collect()}
    assert got["good"].answer == "mail <EMAIL_ADDRESS> [A.md]" and got["good"].error is None
    assert got["good"].sources[0].source_id == "docs/a.md"
    assert got["good"].agent_args == {"question": "good of <EMAIL_ADDRESS>"}
    for name in ("bad", "silent"):
        assert got[name].error == "citation_validation_failed" and got[name].answer == UNKNOWN_ANSWER
        assert len(got[name].sources) == 1
    assert got["unknown"].answer == UNKNOWN_ANSWER and got["unknown"].error is None
    for name in ("far", "empty"):
        assert got[name].error == "not_enough_context" and got[name].sources == []


def test_finalize(spark):
    rows = [(["b", "x"], ["a", "b"]), (["x"], ["a", "b", "c", "d"]), ([], [])]
    df = spark.createDataFrame(rows, "cited array<string>, known array<string>")
    got = [r[0] for r in df.select(answers.finalize(F.col("cited"), F.col("known"))).collect()]
    assert got == [["b"], ["a", "b", "c"], []]


def test_audit(spark):
    df = spark.createDataFrame(
        [("q", "[A.md] and [z] [a.md#p2]", ["d/a.md#p2"]), ("r", "none", None)],
        "query_id string, answer string, source_ids array<string>",
    )
    rows = [(r.position, r.citation, r.matched) for r in answers.citation_audit(df).collect()]
    assert sorted(rows) == [(0, "A.md", True), (1, "z", False), (2, "a.md#p2", True)]


def test_evaluation(spark):
    df = spark.createDataFrame(
        [("adr", "adr"), ("adr", None), ("ask", "adr")], "expected_tool string, predicted_tool string"
    )
    assert tuple(evaluation.tool_accuracy(df).first())[:2] == (3, 1)
    assert tuple(evaluation.tool_accuracy(df.limit(0)).first()) == (0, 0, 0.0)
    pairs = {(r.expected_tool, r.predicted_tool): r.n for r in evaluation.tool_confusion(df).collect()}
    assert pairs == {("adr", "adr"): 1, ("adr", "invalid"): 1, ("ask", "adr"): 1}
    means = spark.createDataFrame(
        [(1, 0.5, None, "x"), (2, float("nan"), None, "y"), (4, None, None, "z")],
        "a int, b double, c double, s string",
    )
    assert {r.metric: (r.mean, r.row_count) for r in evaluation.metric_means(means).collect()} == {
        "a": (2.3333, 3),
        "b": (0.5, 3),
    }
    assert evaluation.metric_means(means.select("s")).count() == 0


def test_assertions_and_lexical_shares(spark):
    outputs = spark.createDataFrame([("1", "runs daily [a.md]"), ("2", "x")], "case_id string, output string")
    rules = spark.createDataFrame(
        [("1", "contains", "daily"), ("1", "regex", r"\[a\.md\]"), ("2", "contains", "y"), ("3", "contains", "z")],
        "case_id string, kind string, value string",
    )
    got = {r.case_id: (r.rules, r.passed, r.all_passed) for r in evaluation.assertions(outputs, rules).collect()}
    assert got == {"1": (2, 2, True), "2": (1, 0, False), "3": (1, 0, False)}
    rows = spark.createDataFrame(
        [("red fox", "red dog", ["the red", "fox"], "red cat"), ("aa", "", [], None)],
        "question string, answer string, contexts array<string>, ground_truth string",
    )
    first, second = (tuple(r)[1:] for r in evaluation.lexical_quality(rows).collect())
    assert first == (0.5, 0.5, 0.5, 0.5) and second == (0.0, 0.0, 0.0, 0.0)


def test_no_source_list_accepts_no_citation(spark):
    row = [("q", "Answer [x.md]", None)]
    df = spark.createDataFrame(row, "query_id string, answer string, source_ids array<string>")
    assert answers.normalize(df).first().error == "citation_validation_failed"
