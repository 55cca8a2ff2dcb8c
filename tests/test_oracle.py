"""Every registered query against its SQL twin in DuckDB (exact row multiset)."""

import duckdb
import pytest

import __spark_entry__ as entry
from stockyard.plans.registry import QUERIES
from stockyard.plans.sql_twins import ORACLE
from stockyard.sources.star import TABLE_NAMES
from tools.oracle_check import rows_of

from conftest import SMALL

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLE_NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def test_every_query_has_a_twin_or_is_marked_rows_only():
    rows_only = {"lsh_topk"}
    assert set(NAMES) - set(ORACLE) == rows_only


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_twin(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert len(rows) > 0
        return
    res = con.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert rows_of(df.columns, rows) == rows_of(ocols, res.fetchall())


def test_entry_lists_every_query():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "StockSymbol"
