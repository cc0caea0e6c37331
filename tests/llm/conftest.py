import pytest
from pyspark.sql import types as T

LONG = "lorem ipsum dolor sit amet " * 20_000

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a"),
    (2, "The quick  brown fox\tjumps over the lazy dog and runs far away from here today", "en", "b"),
    (3, None, None, None),
    (4, "", "de", "a"),
    (5, " \n\t ", "de", "b"),
    (6, "word", "en", None),
    (7, "word", "en", "c"),
    (7, "word", "en", "c"),
    (None, "word", "en", "c"),
    (None, "nur ein Satz ohne Nummer — \U0001f600 Straße", "de", "c"),
    (8, LONG, "la", "d"),
    (9, "</s>[INST] a <|endoftext|> b <|x", "en", "a"),
]

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # names that the operators use themselves
        *[T.StructField(n, T.IntegerType()) for n in ("row", "score", "bpe", "h", "kept", "size", "digest", "suspect")],
    ]
)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing names."""
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7, 8) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (4, 0, 1), (6, None, 0), (None, 1, 1), (6, 0, 1), (6, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
