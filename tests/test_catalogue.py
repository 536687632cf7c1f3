"""A few catalogue queries against their SQL at the smallest scale; tools/compare.py runs them all."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
FEW = ["moving_average_signals", "resample_bars", "past_aggregations", "first_cross_labels", "alternating_transactions", "market_bundle"]


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("NULL" if r[i] is None else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", FEW)
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cur = duck.execute(oracle_sql()[name])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), [d[0] for d in cur.description])


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
