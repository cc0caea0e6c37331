import duckdb
import pytest

import __spark_entry__ as entry
from ragframe.plans import registry
from tools.check import TABLES, rows_of

# Queries that are cheap to run on the smallest tables; tools/check.py runs all.
SLOW = {
    "upsert_store", "write_chunks", "store_info", "hybrid_topk", "mmr_topk", "mmr_scores",
    "retrieval_report", "format_context", "build_prompt", "collect_sources", "groundedness",
    "eval_dataset", "lexical_quality", "finalize_sources", "ingest_stream",
}


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return connection


def test_every_retrieval_query_has_an_oracle():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) - set(registry.ORACLES) == set()


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_oracle(spark, db, sf_dir, name):
    mine = entry.queries()[name](spark, sf_dir).toArrow()
    theirs = db.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(mine.column_names) == sorted(theirs.column_names)
    assert rows_of(mine) == rows_of(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() == 40
