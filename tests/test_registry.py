"""Every registered query against its SQL twin on the smallest tables; queries without a twin must give rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(repr, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in ORACLES:
        assert rows
        return
    listed = ", ".join(f'"{c}"' for c in columns)
    described = con.execute(f"DESCRIBE SELECT * FROM ({ORACLES[name]}) q").fetchall()
    assert sorted(d[0] for d in described) == columns
    assert rows == sorted(tuple(map(repr, r)) for r in con.execute(f"SELECT {listed} FROM ({ORACLES[name]}) q").fetchall())
