"""Every registered query against its SQL oracle on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from passagemill.plans import catalogue  # noqa: E402
from tools.check_oracles import TABLES, rows_of  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: query for name, query in entry.queries().items() if name in catalogue.QUERIES}
ORACLES = {name: text for name, text in entry.oracle_sql().items() if name in catalogue.QUERIES}


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_oracles_name_queries():
    assert set(QUERIES) == set(catalogue.QUERIES)
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"chunk_recursive", "embed_word2vec"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF_DIR)
    got = [tuple(row) for row in df.collect()]
    assert got
    if name in ORACLES:
        result = sql.execute(ORACLES[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
