"""Whole paths around the outside model, on a small store."""

import json

import pytest
from pyspark.sql import functions as F

from ragframe.functions.vectors import embed
from ragframe.plans import artifact, ask, evaluate
from ragframe.settings import RetrievalDefaults

TEXTS = [
    ("ops/backup.md", "snapshots run daily and are kept thirty days"),
    ("ops/backup.md", "restore drills happen every quarter"),
    ("ops/access.md", "production access is limited to people on call"),
    ("external/guide.pdf#p2", "prompt injection is the first risk of the list"),
    ("external/guide.pdf#p3", "supply chain risk is the third risk of the list"),
]


@pytest.fixture(scope="module")
def store(spark):
    rows = [
        (f"c{i}", s, s.split("#")[0], "external" if s.startswith("external") else "project", i, t)
        for i, (s, t) in enumerate(TEXTS)
    ]
    schema = "chunk_id string, source_id string, source_path string, doc_type string, chunk_index int, text string"
    return embed(spark.createDataFrame(rows, schema)).cache()


def test_ask_there_and_back(spark, store):
    asked = spark.createDataFrame(
        [
            (1, "snapshots run daily and are kept", None),
            (2, "first risk of the list", "external"),
            (3, "zzz yyy xxx", None),
        ],
        "query_id int, question string, scope string",
    )
    prompts = {r.query_id: r.prompt for r in ask.ask_prompts(asked, store).collect()}
    assert set(prompts) == {"1", "2"}
    assert "- [ops/backup.md]" in prompts["1"] and "external" not in prompts["1"]
    assert prompts["2"].index("[external/guide.pdf#p2]") < prompts["2"].index("[external/guide.pdf#p3]")
    answers = spark.createDataFrame(
        [(1, "daily [backup.md]"), (2, "injection [guide.pdf]"), (3, "x [backup.md]")],
        "query_id int, answer string",
    )
    got = {r.query_id: r for r in ask.ask(asked, store, answers).collect()}
    assert got["1"].answer == "daily [backup.md]" and got["2"].error is None
    assert got["3"].error == "not_enough_context"
    assert [s.source_id for s in got["1"].sources][0] == "ops/backup.md"


def test_artifacts_there_and_back(spark, store):
    routing = [
        ("a", "Create an ADR on snapshots run daily", {"tool": "adr", "args": {"decision": "keep x@y.org"}}),
        ("b", "Prepare a risk assessment: first risk of the list", {"tool": "risk_assessment", "args": {}}),
        ("c", "snapshots run daily and are kept?", {"tool": "adr", "args": {}}),
    ]
    questions = spark.createDataFrame(
        [(i, q, json.dumps(r)) for i, q, r in routing], "query_id string, question string, routing string"
    ).withColumn("scope", F.lit("all"))
    calls = artifact.tool_calls(questions)
    templates = {"adr": "{{j}} {context} | {decision} | {alternatives}", "risk_assessment": "{request}"}
    defaults = RetrievalDefaults(threshold_all=0.95)
    prompts = {
        r.query_id: r.prompt
        for r in artifact.artifact_prompts(calls, store, templates, "S", defaults).collect()
    }
    assert set(prompts) == {"a", "b"}
    assert prompts["a"].startswith("S\n\n{j} [") and "keep <EMAIL_ADDRESS>" in prompts["a"]
    assert prompts["a"].endswith('["Option A","Option B","Option C"]')
    good = {"risks": ["r of x@y.org"], "mitigations": [], "sources": ["external/guide.pdf#p2", "no"]}
    outputs = spark.createDataFrame(
        [("a", "{}"), ("b", json.dumps(good))], "query_id string, output string"
    )
    answers = spark.createDataFrame([("c", "yes [backup.md]")], "query_id string, answer string")
    plain, made = artifact.route(questions, store, answers, outputs, defaults)
    assert [(r.query_id, r.answer) for r in plain.collect()] == [("c", "yes [backup.md]")]
    rows = {r.query_id: r for r in made.collect()}
    assert rows["a"].error == "invalid_structured_output" and rows["a"].structured is None
    assert (rows["a"].agent_args.decision, rows["a"].agent_args.request) == ("keep <EMAIL_ADDRESS>", None)
    assert rows["b"].agent_args.decision is None and rows["b"].agent_args.request.startswith("Prepare")
    assert rows["b"].error is None
    assert rows["b"].structured.sources == ["external/guide.pdf#p2"]
    assert rows["b"].structured.risks == ["r of <EMAIL_ADDRESS>"]
    assert rows["b"].structured.title is None


def test_routing_prompts_and_evaluation(spark, tmp_path):
    questions = spark.createDataFrame(
        [
            (1, "Create an ADR for x@y.org", "adr"),
            (2, "What is new?", "ask"),
            (3, "Prepare a risk assessment", "risk_assessment"),
            (4, "Create an ADR", "ask"),
            (5, None, "ask"),
        ],
        "query_id int, question string, expected_tool string",
    )
    prompts = artifact.routing_prompts(questions, "{{t}} {question}").collect()
    assert {r.query_id: r.prompt for r in prompts} == {
        "1": "{t} Create an ADR for <EMAIL_ADDRESS>",
        "3": "{t} Prepare a risk assessment",
        "4": "{t} Create an ADR",
    }
    answers = spark.createDataFrame(
        [(1, '{"tool": "adr", "args": {}}'), (2, '{"tool": "adr", "args": {}}'), (4, "nonsense")],
        "query_id int, routing string",
    )
    summary = evaluate.routing_eval(questions, answers, str(tmp_path / "report")).first()
    assert (summary.total, summary.correct, summary.accuracy) == (5, 4, 0.8)
    rows = spark.read.json(str(tmp_path / "report" / "rows")).collect()
    assert {r.query_id: r.predicted_tool for r in rows} == {
        "1": "adr", "2": "ask", "3": "invalid", "4": "ask", "5": "ask",
    }
    empty = evaluate.routing_eval(questions.limit(0), answers, str(tmp_path / "none")).first()
    assert (empty.total, empty.accuracy) == (0, 0.0)


def test_evaluation_table(spark, store):
    asked = spark.createDataFrame(
        [("1", "first risk of the list", "Injection."), ("2", "zzz", None)],
        "query_id string, question string, ground_truth string",
    )
    answers = spark.createDataFrame([("1", "injection [guide.pdf]")], "query_id string, answer string")
    rows = {r.query_id: r for r in evaluate.eval_dataset(asked, store, answers, paged_questions=True).collect()}
    assert len(rows["1"].contexts) == 3 and rows["1"].answer == "injection [guide.pdf]"
    assert rows["2"].answer.startswith("I don't know") and rows["2"].ground_truth == ""
    only = evaluate.eval_dataset(asked, store, answers).filter("query_id = '1'").first()
    assert not any("risk" in c for c in only.contexts)
