"""Every registered query runs on the smallest tables; those with SQL must equal it."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert df.columns
        return
    cur = duck.execute(ORACLES[name])
    columns, want = rows([d[0] for d in cur.description], cur.fetchall())
    mine, have = rows(df.columns, got)
    assert mine == columns
    assert have - want == Counter() and want - have == Counter()


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) > 0.8 * len(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
