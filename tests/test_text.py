import pytest
from pyspark.sql import functions as F

from ragframe.functions import citations as cit
from ragframe.functions import text

UNKNOWN = "I don't know based on the provided documents."


def apply(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(fn(F.col("v")).alias("out")).collect()]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("mail a.b+c@ex-ample.org now", "mail <EMAIL_ADDRESS> now"),
        ("from 192.168.10.254 to here", "from <IP_ADDRESS> to here"),
        ("key sk-Abcdefgh12345678 end", "key <API_KEY> end"),
        ("pay DE12345678901234567890 now", "pay <IBAN> now"),
        # The pattern starts at a word boundary, which a plus after a blank is not.
        ("call +49 1711 234 5678 or 12 34", "call +<PHONE_NUMBER> or 12 34"),
        ("call 0711 234 5678, 9 rooms", "call <PHONE_NUMBER>, 9 rooms"),
        ("call (0711) 123-4567", "call (0711) 123-4567"),
        ("no personal data, 12 of 34", "no personal data, 12 of 34"),
        ("", ""),
    ],
)
def test_redact(spark, given, wanted):
    assert apply(spark, text.redact, [given]) == [wanted]


def test_redact_is_idempotent_and_keeps_null(spark):
    values = ["x@y.org 10.0.0.1 token-ABCDEFGHIJKLMN 555-123-4567", None, "plain"]
    once = apply(spark, text.redact, values)
    assert apply(spark, text.redact, once) == once
    assert once[1] is None and once[2] == "plain"
    assert apply(spark, lambda c: text.redact(c, enabled=False), values) == values


def test_pii_switch():
    assert text.pii_enabled(None) and text.pii_enabled("ON") and text.pii_enabled("1")
    assert not text.pii_enabled("0") and not text.pii_enabled("off")


def test_pii_counts(spark):
    df = spark.createDataFrame(
        [("a@b.org c@d.org 1.2.3.4",), ("DE12345678901234567890",), (None,)], "t string"
    )
    got = {r.entity: r.hits for r in text.pii_counts(df, "t").collect()}
    assert got == {
        "EMAIL_ADDRESS": 2,
        "IP_ADDRESS": 1,
        "API_KEY": 0,
        "IBAN": 1,
        "PHONE_NUMBER": 0,
    }


def test_redact_columns_walks_nested_values(spark):
    df = spark.sql(
        """select 7 as n, array(named_struct('m', map('a@b.org', 'c@d.org'), 'k', 1)) as deep,
           cast(null as struct<x:string>) as gone"""
    )
    row = text.redact_columns(df).first()
    assert row.n == 7 and row.gone is None
    assert row.deep[0].m == {"a@b.org": "<EMAIL_ADDRESS>"} and row.deep[0].k == 1
    assert text.redact_columns(df, ["gone"]).first().deep[0].m == {"a@b.org": "c@d.org"}


def test_tokens_and_strip(spark):
    got = apply(spark, text.tokens, ["A bc BC-d3 x", ""])
    assert got == [["bc", "d3"], []]
    assert apply(spark, text.strip, ["\n\t a b \x0b\n"]) == ["a b"]


def test_source_id_variants(spark):
    got = apply(spark, cit.source_id_variants, ["External/a.pdf#p6", "  ", "a.md", "x#"])
    assert set(got[0]) == {"external/a.pdf#p6", "external/a.pdf", "a.pdf", "a.pdf#p6"}
    assert got[1] == [] and got[2] == ["a.md"] and set(got[3]) == {"x#", "x"}


@pytest.mark.parametrize(
    "raw, wanted",
    [
        (" 'Source_ID: A\\B.md.,' ", "a\\b.md".replace("\\", "/")),
        ("citation=x.txt;", "x.txt"),
        ("`Src`", "src"),
        ("resource: y", "resource: y"),
    ],
)
def test_normalize_source_id(spark, raw, wanted):
    assert apply(spark, cit.normalize_source_id, [raw]) == [wanted]


def test_citations(spark):
    rows = [
        ("Answer [source1]", None, True),
        ("No citations here", None, False),
        ("good [A.md] and [bad]", ["a.md"], True),
        ("only [bad]", ["a.md"], False),
        ("[a\nb] []", None, False),
        ("[" + "x" * 101 + "]", None, False),
        ("[x]", [], False),
    ]
    df = spark.createDataFrame(rows, "t string, allowed array<string>, wanted boolean")
    got = df.select(cit.has_valid_citation(F.col("t"), F.col("allowed")).alias("g"), "wanted")
    assert all(r.g == r.wanted for r in got.collect())


def test_unknown_answer(spark):
    values = [UNKNOWN, "  i DON'T  know\nbased on the provided documents, and more", "I know", None]
    assert apply(spark, cit.is_unknown, values) == [True, True, False, False]
