import pytest
from pyspark.sql import functions as F

from ragframe.functions.params import resolve_params, tool_gate, try_setting
from ragframe.settings import RetrievalDefaults

SCHEMA = "query_id string, mode string, scope string, k int, k_header string"


def resolve(spark, mode=None, scope=None, k=None, header=None, **defaults):
    df = spark.createDataFrame([("q", mode, scope, k, header)], SCHEMA)
    return resolve_params(df, RetrievalDefaults(**defaults)).first()


@pytest.mark.parametrize(
    "scope, k, wanted", [("external", 6, 60), ("external", 30, 120), ("external", 200, 200), ("project", 6, 24)]
)
def test_hybrid_depth(spark, scope, k, wanted):
    assert resolve(spark, "hybrid", scope, k).fetch_k == wanted


@pytest.mark.parametrize("header, wanted", [("0", 6), ("-3", 6), ("abc", 6), ("4", 4), ("2.5", 6)])
def test_header_k(spark, header, wanted):
    assert resolve(spark, header=header).k == wanted


def test_k_order_and_lower_bound(spark):
    assert resolve(spark, k=3, header="5").k == 5
    assert resolve(spark, k=-2).k == 1
    assert resolve(spark, k=None, **{"similarity_fetch_k": 2}).k == 6


def test_mode_and_scope(spark):
    assert resolve(spark).mode == "mmr"
    assert resolve(spark, scope=" EXTERNAL ").mode == "hybrid"
    assert resolve(spark, mode="bm25").mode == "similarity"
    assert resolve(spark, scope="*").scope == "all"
    assert resolve(spark, scope="elsewhere").scope == "project"
    assert resolve(spark, scope="").scope == "project"


def test_alpha_and_threshold(spark):
    row = resolve(spark, scope="external", alpha_external=0.45)
    assert (row.alpha, row.threshold) == (0.45, 0.8)
    row = resolve(spark, scope="all")
    assert (row.alpha, row.threshold) == (0.7, 0.8)
    assert resolve(spark, scope="all", threshold_all=0.5).threshold == 0.5


def test_settings_with_bad_numbers(spark):
    d = RetrievalDefaults.from_settings({"k": "x", "alpha": "0.3", "mode": "mmr", "mmr_fetch_k": "9"})
    assert (d.k, d.alpha, d.mode, d.mmr_fetch_k) == (6, 0.3, "mmr", 9)
    df = spark.createDataFrame([("12",), (" 7 ",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(try_setting(F.col("v"), 1)).collect()] == [12, 7, 1, 1]


def test_unknown_tool_has_the_gate_of_ask(spark):
    df = spark.createDataFrame([("adr",), ("solution_outline",), ("??",)], "t string")
    rows = df.withColumns(tool_gate(F.col("t"))).collect()
    assert [(r.min_docs, r.min_unique_sources, r.caller_threshold) for r in rows] == [
        (2, 2, 0.75),
        (3, 2, 0.75),
        (1, 1, 0.8),
    ]
